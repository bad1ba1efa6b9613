"""Operators on events of a match and on what changes while it goes on: a moving camera, locks by windows of votes, shots
of possessions, tackles at changes of owner, random samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchflow.functions import geometry as g
from pitchflow.operators import play
from pitchflow.operators.sequence import debounce
from pitchflow.operators.tracks import let
from pitchflow.params import DEFAULT, Params

FRAME, TRACK = ["match_id", "frame_idx"], ["match_id", "track_id"]


def project_moving(points: DataFrame, matrices: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """points(match_id, frame_idx, x, y, ...) with mx, my by the match's latest matrix at or before their frame; before the
    first, by the default scaling. matrices(match_id, frame_idx, h): nine numbers, row by row. An as-of join in one shuffle:
    both sides go through one window by match, in which a matrix comes before the points of its frame."""
    own = points.columns
    with_h = points.withColumn("h", F.lit(None).cast("array<double>")).withColumn("_point", F.lit(1))
    both = with_h.unionByName(matrices.select(*FRAME, "h", F.lit(0).alias("_point")), allowMissingColumns=True)
    w = Window.partitionBy("match_id").orderBy("frame_idx", "_point").rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("h", F.last("h", ignorenulls=True).over(w)).filter("_point = 1")
    mx, my = g.project(F.col("x"), F.col("y"), [F.get("h", F.lit(i)) for i in range(9)])
    dx, dy = g.to_meters(F.col("x"), F.col("y"), p)
    return known.select(*own, F.when(F.col("h").isNull(), dx).otherwise(mx).alias("mx"), F.when(F.col("h").isNull(), dy).otherwise(my).alias("my"))


# --- locks by windows of votes


def window_votes(rows: DataFrame, frames: int = 30, most: int = 30, sure: float = 0.85, overlap: float = 0.2, look: float = 0.45) -> DataFrame:
    """rows(match_id, track_id, frame_idx, number, confidence, iou, cosine), a row for each frame in which a track is seen:
    the number that leads the votes of the last frames (of equals the one voted first), its votes, share and mean
    confidence. A read is a vote if it is sure and box and look (where known) fit the track."""
    fits = (F.col("confidence") >= sure) & (F.col("iou").isNull() | (F.col("iou") >= overlap)) & (F.col("cosine").isNull() | (1 - F.col("cosine") <= look))
    recent = F.collect_list(F.when(fits & F.col("number").isNotNull(), F.struct("number", "confidence"))).over(Window.partitionBy(*TRACK).orderBy("frame_idx").rangeBetween(-frames, 0))
    last = F.slice("recent", F.greatest(F.lit(1), F.size("recent") - most + 1), F.lit(most))

    def best(v: Column) -> Column:
        numbers = v["number"]
        count = lambda n: F.size(v) - F.size(F.array_remove(numbers, n))
        tally = F.transform(F.array_distinct(numbers), lambda n: F.struct(count(n).alias("votes"), (-F.array_position(numbers, n)).alias("first"), n.alias("number")))
        total = lambda n: F.aggregate(v, F.lit(0.0), lambda s, x: s + F.when(x["number"] == n, x["confidence"]).otherwise(0.0))
        return let(F.array_max(tally), lambda t: F.struct(t["number"].alias("number"), t["votes"].alias("votes"), (t["votes"] / F.size(v)).alias("share"), F.round(total(t["number"]) / t["votes"], 9).alias("mean"), F.size(v).alias("seen")))

    # as rows of a generator the results are computed once: a filter on them is not pushed below, to compute them again
    return rows.withColumn("recent", recent).filter(F.size("recent") > 0).select(*TRACK, "frame_idx", F.inline(F.array(let(last, best))))


def window_locks(led: DataFrame, least: int = 8, share: float = 0.6, mean: float = 0.80, flip: int = 16, flip_mean: float = 0.85, rest: int = 150) -> DataFrame:
    """(match_id, track_id, number, first_number, locked_at, changed_at, flips, refused) of tracks that lock. led: what
    window_votes() gives. A track locks the first number with votes enough; another one challenges it by twice the votes and
    takes over if the lock has stood for rest frames, else it is refused (counted by frames). A fold over those rows of a
    track in which some number could lock."""
    may = led.filter((F.col("votes") >= least) & (F.col("seen") >= least) & (F.col("share") >= share) & (F.col("mean") >= mean))
    listed = may.groupBy(*TRACK).agg(F.array_sort(F.collect_list(F.struct("frame_idx", "number", ((F.col("votes") >= flip) & (F.col("mean") >= flip_mean)).alias("strong")))).alias("rows"))

    def step(s: Column, x: Column) -> Column:
        against = s["number"].isNotNull() & (s["number"] != x["number"]) & x["strong"]
        locks, flips = s["number"].isNull(), against & (x["frame_idx"] - s["changed_at"] >= rest)
        return F.struct(
            F.when(locks | flips, x["number"]).otherwise(s["number"]).alias("number"), F.when(locks, x["number"]).otherwise(s["first_number"]).alias("first_number"),
            F.when(locks, x["frame_idx"]).otherwise(s["locked_at"]).alias("locked_at"), F.when(flips, x["frame_idx"]).otherwise(s["changed_at"]).alias("changed_at"),
            (s["flips"] + F.when(flips, 1).otherwise(0)).alias("flips"), (s["refused"] + F.when(against & ~flips, 1).otherwise(0)).alias("refused"))

    none = F.lit(None).cast("int")
    start = F.struct(none.alias("number"), none.alias("first_number"), none.alias("locked_at"), F.lit(0).alias("changed_at"), F.lit(0).alias("flips"), F.lit(0).alias("refused"))
    return listed.select(*TRACK, F.aggregate("rows", start, step).alias("s")).select(*TRACK, "s.*")


# --- possessions


def segment_shots(segs: DataFrame, balls: DataFrame, boxes: DataFrame, teams: DataFrame, p: Params = DEFAULT, after: int = 3, speed: float = 0.015, near: float = 0.50, pressure: float = 90.0, bucket: int = 64) -> DataFrame:
    """The fastest ball of each possession, up to some frames after it, where it is fast and near enough to a goal to be a
    shot; all in pixels. segs(match_id, owner, start, end); balls(match_id, frame_idx, box_idx, x, y); boxes(match_id,
    frame_idx, track_id, cls, x, y). Possessions reach into one another; they meet the frames by buckets, so none is
    compared with all of a match."""
    first = balls.groupBy(*FRAME).agg(F.min_by(F.struct("x", "y"), "box_idx").alias("b")).select(*FRAME, "b.x", "b.y")
    w = Window.partitionBy("match_id").orderBy("frame_idx")
    moved = g.distance(F.col("x"), F.col("y"), F.lag("x").over(w), F.lag("y").over(w))
    fast = first.withColumn("v", F.when(F.lag("frame_idx").over(w) == F.col("frame_idx") - 1, moved).otherwise(0.0)).withColumn("bucket", F.expr(f"frame_idx div {bucket}"))
    begin, end = F.greatest(F.col("start"), F.lit(1)), F.col("end") + after
    spans = segs.filter("owner is not null").select("match_id", F.col("owner").alias("track_id"), "start", begin.alias("lo"), end.alias("hi"))
    spans = spans.withColumn("bucket", F.explode(F.sequence(F.expr(f"lo div {bucket}"), F.expr(f"hi div {bucket}"))))
    # frames without a ball have no speed and are no peak, unless all are
    met = spans.join(fast, ["match_id", "bucket"]).filter(F.col("frame_idx").between(F.col("lo"), F.col("hi")))
    peak = met.groupBy("match_id", "track_id", "start").agg(F.max(F.struct("v", (-F.col("frame_idx")).alias("f"), "x", "y")).alias("m"))
    far = g.pixel_goal_distance(F.col("m.x"), F.col("m.y"), p)
    shots = peak.filter((F.col("m.v") >= speed * p.width) & (far <= near * p.width)).select("match_id", (-F.col("m.f")).alias("frame_idx"), "track_id", "start", F.col("m.v").alias("speed"), F.col("m.x").alias("bx"), F.col("m.y").alias("by"))
    worn = boxes.join(teams.select(*TRACK, "team"), TRACK, "left")
    mine = worn.groupBy(*FRAME, "track_id").agg(F.max(F.struct("x", "y", "team")).alias("me"))
    others = worn.filter("cls in (1, 2)").select(*FRAME, F.col("track_id").alias("other"), F.col("team").alias("their"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    close = g.distance(F.col("me.x"), F.col("me.y"), F.col("ox"), F.col("oy")) <= pressure
    against = shots.select(*FRAME, "track_id").distinct().join(mine.hint("merge"), [*FRAME, "track_id"]).join(others.hint("merge"), FRAME).filter((F.col("other") != F.col("track_id")) & ~F.col("their").eqNullSafe(F.col("me.team")) & close)
    pressed = against.select(*FRAME, "track_id", F.lit(True).alias("pressed")).distinct()
    out = shots.join(pressed, [*FRAME, "track_id"], "left").withColumn("pressed", F.coalesce("pressed", F.lit(False)))
    return out.withColumn("xg", g.pixel_xg(F.col("bx"), F.col("by"), pressed=F.col("pressed"), p=p)).drop("bx", "by")


def transition_tackles(segs: DataFrame, balls: DataFrame, boxes: DataFrame, teams: DataFrame, won: DataFrame, p: Params = DEFAULT, held: int = 20, reach: float = 1.5, least: float = 1.0) -> DataFrame:
    """Tackles at changes of owner: (match_id, frame_idx, track_id, on_track). The loser held the ball for long enough and is
    of another team, an opponent is within reach, and the ball, which was moving, loses half its speed or turns back over
    two frames; not within a second of a tackle that was won otherwise (won: match_id, frame_idx), and each winner at most
    once in 45 seconds."""
    w = Window.partitionBy("match_id").orderBy("start")
    pairs = segs.select("match_id", F.col("owner").alias("a"), "start", F.col("end").alias("frame_idx"), F.lead("owner").over(w).alias("b")).filter((F.col("a") != F.col("b")) & (F.col("frame_idx") - F.col("start") >= held))
    # each tackle covers the frames less than a second away; a frame is covered or not, so an equi-join tells
    span = int(-(-p.effective_fps // 1)) - 1
    covered = won.select("match_id", F.explode(F.expr(f"sequence(frame_idx - {span}, frame_idx + {span})")).alias("frame_idx")).distinct()
    pairs = pairs.join(covered, FRAME, "left_anti")
    team = lambda c: teams.select("match_id", F.col("track_id").alias(c), F.col("team").alias(f"{c}_team"))
    pairs = pairs.join(team("a"), ["match_id", "a"], "left").join(team("b"), ["match_id", "b"], "left")
    known = lambda c: F.col(c).isNotNull() & (F.col(c) != "Unknown")
    pairs = pairs.filter(~F.coalesce(known("a_team") & known("b_team") & (F.col("a_team") == F.col("b_team")), F.lit(False)))
    f = Window.partitionBy("match_id").orderBy("frame_idx")
    at = F.when(F.col("mx").isNotNull(), F.struct("mx", "my"))
    around = balls.select(*FRAME, at.alias("m"), F.lag(at, 2).over(f).alias("l"), F.lead(at, 2).over(f).alias("n"))
    x1, y1, x2, y2 = (F.col(a) - F.col(b) for a, b in (("m.mx", "l.mx"), ("m.my", "l.my"), ("n.mx", "m.mx"), ("n.my", "m.my")))
    before, then = F.sqrt(x1 * x1 + y1 * y1), F.sqrt(x2 * x2 + y2 * y2)
    moved = around.filter("l is not null and m is not null and n is not null").filter((before > least) & ((then < 0.5 * before) | (x1 * x2 + y1 * y2 < 0))).select(*FRAME)
    hit = pairs.join(moved, FRAME, "left_semi").select(*FRAME, F.col("a").alias("track_id"), "b")
    close = play.opponent_near(hit.select(*FRAME, "track_id"), boxes, reach).select(*FRAME, "track_id")
    lost = hit.join(close, [*FRAME, "track_id"], "left_semi").select(*FRAME, F.col("b").alias("track_id"), F.col("track_id").alias("on_track"))
    return debounce(lost, TRACK, p.seconds(45), strict=False)


# --- samples


def random_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each match (all, if there are fewer) without replacement, the same in every run: those whose key and seed
    hash lowest. Each part of a match names its n lowest first, so no task orders a whole match."""
    drawn = F.md5(F.concat_ws("-", "match_id", key, F.lit(seed)))
    least = lambda *parts: F.row_number().over(Window.partitionBy("match_id", *parts).orderBy("drawn", key))
    some = rows.withColumn("drawn", drawn).withColumn("part", F.substring("drawn", 32, 1))
    some = some.withColumn("place", least("part")).filter(F.col("place") <= n)
    return some.withColumn("place", least()).filter(F.col("place") <= n).drop("drawn", "part", "place")


def first_jobs(jobs: DataFrame, n: int) -> DataFrame:
    """The n jobs that were updated first; an ordered limit, of which each task keeps n rows."""
    return jobs.orderBy("updated_at", "task_id").limit(n)
