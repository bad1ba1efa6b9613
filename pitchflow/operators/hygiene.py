"""Clean tracks and results: duplicates, rescues and merges of tracks, gates on pairs, running statistics, cascades of
recognizers, output filters.

boxes(match_id, frame_idx, box_idx, track_id, x1 .. y2). Boxes that meet boxes of their frame are merged (hint): neither
side is ever small enough to be sent to all, whatever Spark takes its size for."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchflow.functions import geometry as g
from pitchflow.functions import labels as l
from pitchflow.operators.sequence import frames_window
from pitchflow.operators.tracks import let

FRAME, TRACK = ["match_id", "frame_idx"], ["match_id", "track_id"]
_CORNERS = ("x1", "y1", "x2", "y2")


def _side(boxes: DataFrame, prefix: str, *more: str) -> DataFrame:
    return boxes.select(*FRAME, F.col("track_id").alias(f"{prefix}id"), *[F.col(c).alias(f"{prefix}{c}") for c in (*_CORNERS, *more)])


def _mid(prefix: str, axis: str) -> Column:
    return (F.col(f"{prefix}{axis}1") + F.col(f"{prefix}{axis}2")) / 2


def with_age(boxes: DataFrame) -> DataFrame:
    """Frames since each track was first seen."""
    return boxes.join(boxes.groupBy(*TRACK).agg(F.min("frame_idx").alias("born")), TRACK).withColumn("age", F.col("frame_idx") - F.col("born"))


def duplicates(first: DataFrame, second: DataFrame, distance: float = 0.15) -> DataFrame:
    """Of two lists of boxes with age, the tracks to drop in each frame: where two lie on one another, the younger one, of
    equals the first list's."""
    pairs = _side(first, "a_", "age").join(_side(second, "b_", "age").hint("merge"), FRAME).filter(1 - g.iou("a_", "b_") < distance)
    return pairs.select(*FRAME, F.when(F.col("a_age") > F.col("b_age"), F.col("b_id")).otherwise(F.col("a_id")).alias("track_id")).distinct()


def overlapping(boxes: DataFrame, least: float = 0.05, cell: int = 64) -> DataFrame:
    """Pairs of boxes of a frame whose overlap is above least: a_id < b_id, iou, whether a lies inside b, and how far apart
    they are. Boxes meet by the columns of cells that they touch, each pair in the first column that both touch."""
    low = F.floor(F.col("x1") / cell)
    in_cells = boxes.withColumn("low", low).withColumn("cell", F.explode(F.sequence(low, F.floor(F.col("x2") / cell))))
    a, b = (_side(in_cells, p, "low", "cell") for p in ("a_", "b_"))
    met = a.withColumnRenamed("a_cell", "cell").join(b.withColumnRenamed("b_cell", "cell").hint("merge"), [*FRAME, "cell"])
    met = met.filter((F.col("a_id") < F.col("b_id")) & (F.col("cell") == F.greatest("a_low", "b_low"))).withColumn("iou", g.iou("a_", "b_")).filter(F.col("iou") > least)
    return met.select(*FRAME, "a_id", "b_id", "iou", g.contains("a_", "b_").alias("inside"), g.center_distance_norm("a_", "b_").alias("apart"))


def rescue_pairs(lost: DataFrame, found: DataFrame, oldest: int = 45, distance: float = 0.5, near: float = 0.7) -> DataFrame:
    """Last boxes of lost tracks and boxes of new ones up to oldest frames later, that overlap too little to be matched but
    lie close, neither inside the other. Frames fall into buckets, and a box meets the same and the next bucket only."""
    old = _side(lost, "a_").withColumnRenamed("frame_idx", "lost_at").withColumn("bucket", F.explode(F.expr(f"array(lost_at div {oldest}, lost_at div {oldest} + 1)")))
    new = _side(found, "b_").withColumn("bucket", F.expr(f"frame_idx div {oldest}"))
    pairs = old.join(new, ["match_id", "bucket"]).withColumn("gap", F.col("frame_idx") - F.col("lost_at")).filter((F.col("gap") >= 1) & (F.col("gap") <= oldest) & (F.col("a_id") != F.col("b_id")))
    apart = g.center_distance_norm("a_", "b_")
    pairs = pairs.filter((1 - g.iou("a_", "b_") > distance) & ~g.contains("a_", "b_") & ~g.contains("b_", "a_") & (apart <= near))
    return pairs.select("match_id", "frame_idx", "a_id", "b_id", "gap", apart.alias("apart"))


def near_misses(new: DataFrame, tracked: DataFrame, widths: float = 0.6, least_height: float = 40.0, weak: float = 0.5) -> DataFrame:
    """New boxes (with conf) that must not start a track: their centre lies within so many widths of a track's box, or they
    are weak and low."""
    d = g.distance(_mid("a_", "x"), _mid("a_", "y"), _mid("b_", "x"), _mid("b_", "y"))
    close = _side(new, "a_").join(_side(tracked, "b_").hint("merge"), FRAME).filter((F.col("a_id") != F.col("b_id")) & (d < widths * (F.col("b_x2") - F.col("b_x1"))))
    low = new.filter((F.col("conf") < weak) & (F.col("y2") - F.col("y1") < least_height)).select(*FRAME, "track_id")
    return close.select(*FRAME, F.col("a_id").alias("track_id")).unionByName(low).distinct()


def ghost_merge(new: DataFrame, seen: DataFrame, age: int = 30, reach: float = 50.0) -> DataFrame:
    """New tracks (first boxes) near where a number was seen at most age frames before: the nearest, then the latest number.
    seen(match_id, frame_idx, number, track_id, x, y)."""
    at = lambda k: F.expr(f"frame_idx div {age}") + k
    old = seen.select("match_id", F.col("frame_idx").alias("seen_at"), "number", F.col("track_id").alias("other"), "x", "y", F.explode(F.array(at(0), at(1))).alias("bucket"))
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    pairs = new.select(*FRAME, "track_id", x.alias("nx"), y.alias("ny"), F.expr(f"frame_idx div {age}").alias("bucket")).join(old, ["match_id", "bucket"])
    gap = F.col("frame_idx") - F.col("seen_at")
    pairs = pairs.withColumn("d", g.distance(F.col("nx"), F.col("ny"), F.col("x"), F.col("y"))).filter((gap >= 1) & (gap <= age) & (F.col("d") < reach) & (F.col("other") != F.col("track_id")))
    return pairs.groupBy(*TRACK, "frame_idx").agg(F.min(F.struct("d", (-F.col("seen_at")).alias("late"), "number")).alias("b")).select(*TRACK, "frame_idx", "b.number", "b.d")


def gallery_consistent(scored: DataFrame, keys: list[str], least: float = 0.6) -> DataFrame:
    """scored(keys, cosine), null where the gallery is empty: whether a crop fits its gallery, and how well."""
    best = scored.groupBy(*keys).agg(F.max("cosine").alias("best"))
    return best.select(*keys, F.coalesce(F.col("best") >= least, F.lit(True)).alias("fits"), F.coalesce("best", F.lit(1.0)).alias("similarity"))


def appearance_gate(pairs: DataFrame, strong: float = 0.70, weak: float = 0.55, overlap: float = 0.2) -> DataFrame:
    """pairs(iou, cosine, close): the cost of a match, 1 where it is refused. Half the cosine distance may be up to strong
    where boxes overlap or are close, else up to weak; the smaller of it and the boxes' distance counts."""
    look = (1 - F.col("cosine")) / 2
    limit = F.when((F.col("iou") > overlap) | F.col("close"), strong).otherwise(weak)
    return pairs.withColumn("cost", F.when(look > limit, 1.0).otherwise(F.least(1 - F.col("iou"), look)))


def running_quantile(rows: DataFrame, value: str, q: float = 0.05, last: int = 1000, every: int = 100, least: int = 500, default: float = 0.28) -> DataFrame:
    """Every so many rows of a match, the quantile of its last values (last: a multiple of every); a default before there
    are enough. Rows fall into blocks of every; a window of the last blocks exists only where a block is full, so a value
    is held in as many lists as blocks make a window, and not in as many as rows."""
    numbered = rows.select("match_id", value, F.row_number().over(frames_window()).alias("n"))
    blocks = numbered.groupBy("match_id", F.expr(f"(n - 1) div {every}").alias("block")).agg(F.collect_list(value).alias("own"), F.count("*").alias("size"))
    recent = F.flatten(F.collect_list("own").over(Window.partitionBy("match_id").orderBy("block").rowsBetween(1 - last // every, 0)))
    asked = blocks.withColumn("v", F.sort_array(recent)).filter(F.col("size") == every).select("match_id", ((F.col("block") + 1) * every).cast("int").alias("n"), "v")
    place = (F.size("v") - 1) * F.lit(q)
    low = F.floor(place).cast("int")
    at = lambda i: F.element_at("v", i + 1)
    high = F.least(low + 1, F.size("v") - 1)
    return asked.select("match_id", "n", F.when(F.col("n") < least, default).otherwise(at(low) + (at(high) - at(low)) * (place - low)).alias("threshold"))


def aerial_balls(balls: DataFrame, share: float = 0.7, speed: float = 5.0, first: int = 100) -> DataFrame:
    """balls(match_id, frame_idx, x1 .. y2): frames in which the ball looks small against the match's first ones and moves
    fast. Speed is that since the frame before; where the ball was lost, there is none."""
    w = frames_window()
    sized = balls.withColumn("area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).withColumn("x", (F.col("x1") + F.col("x2")) / 2).withColumn("y", (F.col("y1") + F.col("y2")) / 2).withColumn("k", F.row_number().over(w))
    usual = sized.filter(F.col("k") <= first).groupBy("match_id").agg(F.percentile("area", F.lit(0.5)).alias("usual"))
    moved = F.when(F.lag("frame_idx").over(w) == F.col("frame_idx") - 1, g.distance(F.col("x"), F.col("y"), F.lag("x").over(w), F.lag("y").over(w)))
    return sized.withColumn("speed", moved).join(usual, "match_id").filter((F.col("area") < share * F.col("usual")) & (F.col("speed") > speed)).select(*FRAME, "area", "speed")


def scene_cuts(rows: DataFrame, order: str, histogram: str, least: float = 0.6) -> DataFrame:
    """Rows of a match whose histogram correlates less than that with the one before."""
    before = F.lag(histogram).over(Window.partitionBy("match_id").orderBy(order))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    centred = lambda v: let(total(v) / F.size(v), lambda mean: F.transform(v, lambda x: x - mean))
    both = rows.withColumn("a", before).filter("a is not null").select("match_id", order, centred(F.col("a")).alias("a"), centred(F.col(histogram)).alias("b"))
    dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y))
    r = dot(F.col("a"), F.col("b")) / F.sqrt(dot(F.col("a"), F.col("a")) * dot(F.col("b"), F.col("b")))
    return both.select("match_id", order, r.alias("correlation")).filter(F.col("correlation") < least)


def rolling_mode(rows: DataFrame, value: str, n: int) -> DataFrame:
    """At each row of a track, the most frequent of its last n values (of equals the one that came first), with its share."""
    w = frames_window(*TRACK).rowsBetween(1 - n, 0)
    ranked = F.array_max(F.transform(F.col("last"), lambda x: F.struct(F.size(F.filter("last", lambda y: y == x)).alias("n"), (-F.array_position("last", x)).alias("p"), x.alias("v"))))
    return rows.withColumn("last", F.collect_list(value).over(w)).withColumn("m", ranked).select(*TRACK, "frame_idx", F.col("m.v").alias(value), (F.col("m.n") / F.size("last")).alias("share"))


def agreed_reads(reads: DataFrame, n: int = 5, least: int = 2, more: float = 0.1, most: float = 0.99) -> DataFrame:
    """Each read as a recognizer with a memory gives it: the most frequent of the track's last n numbers (of equals the one
    that came first), with more confidence, if that came at least so often; else the read itself."""
    mode = rolling_mode(reads, "number", n).withColumnRenamed("number", "agreed")
    votes = F.round(F.col("share") * F.least(F.lit(n), F.col("k")))
    k = F.row_number().over(frames_window(*TRACK))
    both = reads.withColumn("k", k).join(mode, [*TRACK, "frame_idx"]).withColumn("agrees", votes >= least)
    return both.select(*TRACK, "frame_idx", F.when(F.col("agrees"), F.col("agreed")).otherwise(F.col("number")).alias("number"), F.when(F.col("agrees"), F.least(F.lit(most), F.col("confidence") + more)).otherwise(F.col("confidence")).alias("confidence"))


def lock_metrics(reads: DataFrame, locks: DataFrame) -> DataFrame:
    """Of the tracks of a match with any read: the share that locks, changes of the read number, and the median number of
    frames from the first read to the lock."""
    before = F.lag("number").over(frames_window(*TRACK))
    per_track = reads.withColumn("changed", (before != F.col("number")).cast("int")).groupBy(*TRACK).agg(F.coalesce(F.sum("changed"), F.lit(0)).alias("changes"), F.min("frame_idx").alias("first"))
    both = per_track.join(locks.select(*TRACK, F.col("frame_idx").alias("locked_at")), TRACK, "left")
    return both.groupBy("match_id").agg((100 * F.count("locked_at") / F.count("*")).alias("locked_percent"), F.sum("changes").alias("changes"), F.percentile(F.col("locked_at") - F.col("first"), F.lit(0.5)).alias("median_frames"))


def best_crops(boxes: DataFrame, most: int = 10) -> DataFrame:
    """The tallest boxes of each track, the first of equals."""
    place = F.row_number().over(Window.partitionBy(*TRACK).orderBy(F.desc("h"), "frame_idx"))
    return boxes.withColumn("h", F.col("y2") - F.col("y1")).withColumn("place", place).filter(F.col("place") <= most).select(*TRACK, "frame_idx", "h", "place")


def systematic_sample(frames: DataFrame, wanted: int = 1000) -> DataFrame:
    """Every n-th frame of a match, n so that about as many as wanted are left."""
    step = frames.groupBy("match_id").agg(F.greatest(F.lit(1), F.expr(f"count(*) div {wanted}")).alias("step"))
    return frames.join(step, "match_id").filter("frame_idx % step = 0").select(*FRAME)


def score_batches(rows: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame], schema: str, load: Callable | None = None) -> DataFrame:
    """Rows scored by a user's function on batches. load: makes the model, once a task; predict then gets it as well."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load() if load else None
        for batch in batches:
            yield predict(batch, model) if load else predict(batch)

    return rows.mapInPandas(score, schema)


def verify(primary: DataFrame, verifier: DataFrame, keys: list[str], never: int = 10) -> DataFrame:
    """primary(keys, number, confidence, review): where a row asks for review, the verifier(keys, second) decides, but
    doesn't turn an answer into the number that it invents most."""
    both = primary.join(verifier.select(*keys, "second"), keys, "left")
    taken = F.col("review") & F.col("second").isNotNull() & (F.col("second") != F.col("number")) & (F.col("second") != never)
    return both.select(*keys, F.when(taken, F.col("second")).otherwise(F.col("number")).alias("number"), F.coalesce(taken, F.lit(False)).alias("corrected"))


def output_filter(stats: DataFrame, least: int = 30, least_recovered: int = 20) -> DataFrame:
    """stats(match_id, team, number, observations, confidence, recovered): no one without a number, none seen too rarely
    (recovered numbers may be seen less), one for each team and number, and only numbers that can be worn."""
    seen = stats.filter(F.col("number").isNotNull() & ((F.col("observations") >= least) | (F.col("recovered") & (F.col("observations") >= least_recovered))))
    place = F.row_number().over(Window.partitionBy("match_id", "team", "number").orderBy(F.desc("confidence"), F.desc("observations"), "track_id"))
    return seen.withColumn("place", place).filter((F.col("place") == 1) & l.jersey_range(F.col("number"))).drop("place")


def flat_rows(stats: DataFrame) -> DataFrame:
    """A player's row of the accuracy report: number, passes, accuracy, tackles, expected goals and goals; nothing divides by
    nothing."""
    rate = F.when(F.col("passes_total") > 0, F.round(100 * F.col("passes_complete") / F.col("passes_total"), 1)).otherwise(0.0)
    return stats.select(*TRACK, "team", "number", F.col("passes_total").alias("passes"), rate.alias("accuracy"), "tackles", F.round("xg", 2).alias("xg"), "goals")


# --- in pixels


def nearest_owner_px(balls: DataFrame, boxes: DataFrame, reach: float = 80.0) -> DataFrame:
    """The nearest player, keeper or referee to a frame's first ball box, without filling gaps."""
    ball = balls.groupBy(*FRAME).agg(F.min_by(F.struct(((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y")), "box_idx").alias("ball"))
    d = g.distance((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, F.col("ball.x"), F.col("ball.y"))
    near = boxes.filter("cls in (1, 2, 3)").join(ball, FRAME).withColumn("d", d).filter(F.col("d") < reach)
    return near.groupBy(*FRAME).agg(F.min(F.struct("d", "box_idx", "track_id")).alias("m")).select(*FRAME, F.col("m.track_id").alias("owner"), F.col("m.d").alias("d"))


def under_pressure_px(asked: DataFrame, boxes: DataFrame, teams: DataFrame, reach: float = 90.0) -> DataFrame:
    """asked(match_id, frame_idx, track_id) that have a player or keeper of the other team near."""
    worn = boxes.filter("cls in (1, 2)").join(teams.select(*TRACK, "team"), TRACK)
    mine = _side(worn, "a_", "team").withColumnRenamed("a_id", "track_id").hint("merge").join(asked.select(*FRAME, "track_id"), [*FRAME, "track_id"])
    d = g.distance(_mid("a_", "x"), _mid("a_", "y"), _mid("b_", "x"), _mid("b_", "y"))
    return mine.join(_side(worn, "b_", "team").hint("merge"), FRAME).filter((F.col("a_team") != F.col("b_team")) & (d <= reach)).select(*FRAME, "track_id").distinct()


def ball_near_feet(balls: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes whose foot is within 0.9 widths or a quarter of the height of a ball's centre."""
    ball = balls.select(*FRAME, ((F.col("x1") + F.col("x2")) / 2).alias("bx"), ((F.col("y1") + F.col("y2")) / 2).alias("by_"))
    reach = F.greatest(0.9 * (F.col("x2") - F.col("x1")), 0.25 * (F.col("y2") - F.col("y1")))
    near = g.distance((F.col("x1") + F.col("x2")) / 2, F.col("y2"), F.col("bx"), F.col("by_")) < reach
    return boxes.join(ball, FRAME).filter(near).select(*FRAME, "track_id").distinct()
