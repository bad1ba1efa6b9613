"""Ball, possession, passes, duels, shots and goals.

Inputs: frames(match_id, frame_idx), detections(match_id, frame_idx, box_idx, cls, track_id, x1 .. y2, conf),
teams(match_id, track_id, team). Everything is joined on the frame within a match and windowed by match. Where an operator
looks at the boxes of a frame together it takes them as one row (in_frames), so that joins move a row for each frame and
not one for each box; it packs them itself if it is given single boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchflow.functions import geometry as g
from pitchflow.operators.sequence import debounce, frames_window, islands, known_before
from pitchflow.operators.tracks import let
from pitchflow.params import DEFAULT, Params

FRAME = ["match_id", "frame_idx"]


def best_ball(detections: DataFrame) -> DataFrame:
    """The most confident ball box of each frame, the first of equals."""
    x, y = g.center("x1", "y1", "x2", "y2")
    balls = detections.filter(F.col("cls").isin(0, 32))
    return balls.groupBy(*FRAME).agg(F.max_by(F.struct(x.alias("bx"), y.alias("by")), F.struct(F.col("conf"), -F.col("box_idx"))).alias("b")).select(*FRAME, "b.bx", "b.by")


def ball_track(frames: DataFrame, detections: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """A row for each frame; gaps of at most interpolate_gap frames filled linearly. Pixels bx, by and metres mx, my."""
    spine = frames.join(best_ball(detections), FRAME, "left")
    at = F.when(F.col("bx").isNotNull(), F.struct("frame_idx", "bx", "by"))
    back = Window.partitionBy("match_id").orderBy(F.desc("frame_idx"))
    known = spine.withColumn("a", known_before(at, frames_window())).withColumn("b", known_before(at, back))
    steps = F.col("b.frame_idx") - F.col("a.frame_idx")
    fill = lambda c: F.when(F.col(c).isNotNull(), F.col(c)).when(steps <= p.interpolate_gap, F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) / steps * (F.col("frame_idx") - F.col("a.frame_idx")))
    out = known.select(*FRAME, F.col("bx").isNotNull().alias("is_raw"), fill("bx").alias("bx"), fill("by").alias("by"))
    mx, my = g.to_meters(F.col("bx"), F.col("by"), p)
    return out.withColumn("mx", mx).withColumn("my", my)


def players(detections: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Boxes that carry an id, with their centre in metres."""
    x, y = g.center("x1", "y1", "x2", "y2")
    px, py = g.to_meters(x, y, p)
    return detections.filter("track_id is not null").select(*FRAME, "box_idx", "cls", "track_id", px.alias("px"), py.alias("py"))


def in_frames(boxes: DataFrame) -> DataFrame:
    """A row for each frame: boxes, in their order. Rows that are packed already stay as they are."""
    if "boxes" in boxes.columns:
        return boxes.select(*FRAME, "boxes")
    return boxes.groupBy(*FRAME).agg(F.sort_array(F.collect_list(F.struct("box_idx", "track_id", "cls", "px", "py"))).alias("boxes"))


def one_by_one(frames: DataFrame, *more: str) -> DataFrame:
    """The boxes of packed frames as rows again."""
    return frames.select(*FRAME, *more, F.inline("boxes"))


def _marked(frames: DataFrame, *more: str) -> DataFrame:
    """The boxes of packed frames as rows, and whether each leads: is the first of its id in the frame. Ids are looked for only
    in frames that hold one twice; they have a column of their own, since what stands beside an explode is evaluated for each
    of its rows, and what is exploded once more for its size."""
    twice = lambda ids: F.when(F.size(F.array_distinct(ids)) < F.size(ids), ids)
    rows = frames.withColumn("ids", let(F.col("boxes.track_id"), twice)).select(*FRAME, *more, "ids", F.posexplode("boxes").alias("k", "b"))
    leads = F.col("ids").isNull() | (F.array_position("ids", F.col("b.track_id")) == F.col("k") + 1)
    return rows.select(*FRAME, *more, "b.*", leads.alias("leads"))


def first_boxes(boxes: DataFrame) -> DataFrame:
    """The first box of each id in each frame."""
    if "boxes" not in boxes.columns:
        return boxes.groupBy(*FRAME, "track_id").agg(F.min(F.struct("box_idx", "cls", "px", "py")).alias("b")).select(*FRAME, "track_id", "b.*")
    return _marked(boxes).filter("leads").drop("leads")


def owner_in(boxes: Column, mx: Column, my: Column, p: Params = DEFAULT) -> Column:
    """Of a frame's boxes the nearest to a place within the radius, of any class, the first of equals: (d, box_idx, track_id)."""
    near = F.array_min(F.transform(boxes, lambda x: F.struct(g.distance(x["px"], x["py"], mx, my).alias("d"), x["box_idx"].alias("box_idx"), x["track_id"].alias("track_id"))))
    return F.when(mx.isNotNull(), let(near, lambda m: F.when(m["d"] <= p.owner_radius, m)))


def nearest_owner(balls: DataFrame, boxes: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Each frame's owner."""
    # both sides have a row for each frame, so neither is ever small enough to be sent to all
    both = in_frames(boxes).hint("merge").join(balls.filter("mx is not null").select(*FRAME, "mx", "my"), FRAME)
    return both.select(*FRAME, owner_in(F.col("boxes"), F.col("mx"), F.col("my"), p).alias("m")).filter("m is not null").select(*FRAME, F.col("m.track_id").alias("owner"), F.col("m.d").alias("owner_distance"))


def carried(owner: Column, p: Params = DEFAULT) -> Column:
    """The last known owner of a match's rows of frames, for at most fill_limit frames."""
    last = known_before(F.when(owner.isNotNull(), F.struct("frame_idx", owner.alias("owner"))), frames_window())
    return F.when(F.col("frame_idx") - last["frame_idx"] <= p.fill_limit, last["owner"])


def ownership(frames: DataFrame, owners: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Dense owners, carried on for at most fill_limit frames."""
    return frames.join(owners.select(*FRAME, "owner"), FRAME, "left").select(*FRAME, carried(F.col("owner"), p).alias("owner"))


def segments(owned: DataFrame) -> DataFrame:
    return islands(owned, "owner")


def dominant_class(boxes: DataFrame) -> DataFrame:
    """Most frequent class of each id over its first box of each frame; ties to the class seen first."""
    counted = first_boxes(boxes).groupBy("match_id", "track_id", "cls").agg(F.count("*").alias("n"), F.min("frame_idx").alias("seen"))
    return counted.groupBy("match_id", "track_id").agg(F.max_by("cls", F.struct(F.col("n"), -F.col("seen"))).alias("dominant_class"))


def steps(boxes: DataFrame) -> DataFrame:
    """Distance of each id to where it was last seen, over the first box of each frame. One shuffle: windows of one order
    tell first boxes from others and carry the last first one."""
    w = Window.partitionBy("match_id", "track_id").orderBy("frame_idx", "box_idx")
    before = F.lag("frame_idx").over(w)
    marked = boxes.select(*FRAME, "track_id", "box_idx", "px", "py", (before.isNull() | (before != F.col("frame_idx"))).alias("leads"))
    last = F.last(F.when(F.col("leads"), F.struct("px", "py")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = marked.withColumn("last", last).filter("leads")
    return first.select(*FRAME, "track_id", "px", "py", g.distance(F.col("px"), F.col("py"), F.col("last.px"), F.col("last.py")).alias("step"))


def distance_covered(boxes: DataFrame, p: Params = DEFAULT) -> DataFrame:
    near = F.when(F.col("step") < p.max_step, F.col("step"))
    return steps(boxes).groupBy("match_id", "track_id").agg(F.coalesce(F.sum(near), F.lit(0.0)).alias("distance_m"))


def track_summary(boxes: DataFrame) -> DataFrame:
    """What dominant_class() and residency() give of each id, in one pass over packed boxes."""
    place = [c for a in ("px", "py") for c in (F.sum(a).alias(f"sum_{a}"), F.count(a).alias(f"n_{a}"))]
    counted = _marked(in_frames(boxes)).groupBy("match_id", "track_id", "cls").agg(F.count_if("leads").alias("led"), F.min(F.when(F.col("leads"), F.col("frame_idx"))).alias("seen"), F.count_if(g.in_box_strict(F.col("px"), F.col("py"))).alias("inside"), F.count("*").alias("n"), *place)
    mean = lambda a: (F.sum(f"sum_{a}") / F.sum(f"n_{a}")).alias(f"avg_{a[1]}")
    return counted.groupBy("match_id", "track_id").agg(F.max_by("cls", F.struct(F.col("led"), -F.col("seen"))).alias("dominant_class"), F.sum("inside").alias("frames_in_box"), F.sum("n").alias("n"), mean("px"), mean("py"))


def residency(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("match_id", "track_id").agg(F.count_if(g.in_box_strict(F.col("px"), F.col("py"))).alias("frames_in_box"), F.count("*").alias("n"), F.avg("px").alias("avg_x"), F.avg("py").alias("avg_y"))


def attack_direction(resident: DataFrame, teams: DataFrame) -> DataFrame:
    """The team with the lower mean x attacks x = 105, the other 0; needs two teams."""
    means = resident.filter("n > 10").join(teams, ["match_id", "track_id"]).groupBy("match_id", "team").agg(F.avg("avg_x").alias("team_x"))
    w = Window.partitionBy("match_id")
    ranked = means.withColumn("k", F.row_number().over(w.orderBy("team_x", "team"))).withColumn("teams", F.count("*").over(w))
    return ranked.filter("teams >= 2 and k <= 2").select("match_id", "team", "team_x", F.when(F.col("k") == 1, 105.0).otherwise(0.0).alias("attacks_x"))


def opponent_near(asked: DataFrame, boxes: DataFrame, radius: float) -> DataFrame:
    """asked(match_id, frame_idx, track_id) with the first other box in array order nearer than radius. The packed boxes of a
    frame pass by what is asked of it (hint), so that they needn't be sorted; the same below."""
    both = asked.distinct().hint("shuffle_hash").join(in_frames(boxes), FRAME)
    own = F.get(F.filter("boxes", lambda x: x["track_id"] == F.col("track_id")), F.lit(0))
    near = lambda me: F.get(F.filter("boxes", lambda x: (x["track_id"] != F.col("track_id")) & (g.distance(me["px"], me["py"], x["px"], x["py"]) < radius)), F.lit(0))["track_id"]
    found = both.select(*asked.columns, let(own, near).alias("opponent"))
    return found.filter("opponent is not null").select(*asked.columns, "opponent")


def transitions(segs: DataFrame, balls: DataFrame, boxes: DataFrame, teams: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Changes of owner between possessions long enough, with why each is or isn't a pass (status)."""
    w = Window.partitionBy("match_id").orderBy("start")
    lead = lambda c: F.lead(c).over(w)
    pairs = segs.filter("owner is not null").select("match_id", F.col("owner").alias("a"), F.col("start").alias("a_start"), F.col("end").alias("a_end"), lead("owner").alias("b"), lead("start").alias("b_start"), lead("end").alias("b_end"))
    pairs = pairs.filter((F.col("a") != F.col("b")) & (F.col("a_end") - F.col("a_start") >= p.min_possession))
    around = frames_window()
    at = F.when(F.col("mx").isNotNull(), F.struct("frame_idx", "mx", "my"))
    seen = balls.select(*FRAME, F.last(at, ignorenulls=True).over(around.rowsBetween(-7, 0)).alias("before"), F.first(at, ignorenulls=True).over(around.rowsBetween(0, 7)).alias("after"))
    pairs = pairs.join(seen.select("match_id", F.col("frame_idx").alias("a_end"), F.col("before").alias("s")), ["match_id", "a_end"], "left")
    pairs = pairs.join(seen.select("match_id", F.col("frame_idx").alias("b_start"), F.col("after").alias("e")), ["match_id", "b_start"], "left")
    at_end = in_frames(boxes).select("match_id", F.col("frame_idx").alias("a_end"), "boxes")
    who = lambda c: F.array_max(F.filter("boxes", lambda x: x["track_id"] == F.col(c))).alias(f"{c}_box")
    pairs = pairs.hint("shuffle_hash").join(at_end, ["match_id", "a_end"], "left").select(*pairs.columns, who("a"), who("b"))
    team = lambda who: teams.select("match_id", F.col("track_id").alias(who), F.col("team").alias(f"{who}_team"))
    pairs = pairs.join(team("a"), ["match_id", "a"], "left").join(team("b"), ["match_id", "b"], "left")
    contact = g.distance(F.col("a_box.px"), F.col("a_box.py"), F.col("b_box.px"), F.col("b_box.py")) < 0.8
    start, end = F.when(F.col("s.frame_idx") >= F.col("a_start"), F.col("s")), F.when(F.col("e.frame_idx") <= F.col("b_end"), F.col("e"))
    pairs = pairs.withColumn("s", start).withColumn("e", end).withColumn("distance", g.distance(F.col("s.mx"), F.col("s.my"), F.col("e.mx"), F.col("e.my")))
    status = F.when(F.col("b_start") - F.col("a_end") > p.max_pass_gap, "gap").when(F.coalesce(contact, F.lit(False)), "contact").when(F.col("distance").isNull(), "no_ball").when(F.col("distance") <= p.pass_minimum, "short").otherwise("counted")
    known = F.col("a_team").isNotNull() & F.col("b_team").isNotNull()
    complete = ~(known & (F.col("a_team") != F.col("b_team")))
    into_box = ((F.col("e.mx") > 88.5) | (F.col("e.mx") < 16.5)) & (F.abs(F.col("e.my") - 34.0) < 20.15)
    cross = (F.abs(F.col("s.my") - 34.0) > 25.0) & into_box
    return pairs.select("match_id", "a", "b", "a_start", "a_end", "b_start", "b_end", "a_team", "b_team", status.alias("status"), "distance", F.coalesce(complete, F.lit(True)).alias("complete"), F.coalesce(cross, F.lit(False)).alias("is_cross"), g.pass_range(F.col("distance")).alias("reach"), F.col("s.mx").alias("start_x"), F.col("s.my").alias("start_y"), F.col("e.mx").alias("end_x"), F.col("e.my").alias("end_y"))


def passes(trans: DataFrame) -> DataFrame:
    return trans.filter("status = 'counted'").drop("status")


def pass_funnel(trans: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return trans.groupBy("match_id").agg(F.count("*").alias("transitions"), *[n(s) for s in ("gap", "contact", "no_ball", "short", "counted")])


def interceptions(passed: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Incomplete passes between two teams, at most one in 30 seconds for each receiver."""
    cut = passed.filter(~F.col("complete") & (F.col("distance") > 3.0)).select("match_id", F.col("b").alias("track_id"), F.col("b_start").alias("frame_idx"), "end_x")
    return debounce(cut, ["match_id", "track_id"], p.seconds(30)).withColumn("half", F.when(F.col("end_x") > 52.5, "opponent").when(F.col("end_x") < 52.5, "own"))


def dribbles(owned: DataFrame, balls: DataFrame, boxes: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Take-ons: an opponent near, the ball moved, at most one in three seconds for each carrier; retained or not."""
    w = frames_window()
    look = p.dribble_lookback
    ball = balls.select(*FRAME, g.distance(F.col("mx"), F.col("my"), F.lag("mx", look).over(w), F.lag("my", look).over(w)).alias("moved"))
    ahead = owned.withColumn("next", F.collect_list(F.coalesce("owner", F.lit(-1))).over(w.rowsBetween(0, p.retention_window - 1)))
    held = ahead.filter("owner is not null").join(ball, FRAME).filter((F.col("frame_idx") < look) | (F.col("moved") > 1.5))
    held = held.select(*FRAME, F.col("owner").alias("track_id"), F.size(F.filter("next", lambda x: x == F.col("owner"))).alias("kept"))
    near = opponent_near(held, boxes, p.dribble_radius)
    counted = debounce(near, ["match_id", "track_id"], p.effective_fps * 3)
    return counted.select(*FRAME, "track_id", "opponent", (F.col("kept") > p.retention_window * 0.5).alias("retained"))


def tackles(dribbled: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Take-ons that failed, at most one in a minute for each opponent."""
    lost = dribbled.filter("not retained").select(*FRAME, F.col("opponent").alias("track_id"), F.col("track_id").alias("on_track"))
    return debounce(lost, ["match_id", "track_id"], p.seconds(60), order=("frame_idx", "on_track"))


def fast_balls(balls: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Pairs of detected balls two frames apart that move faster than a shot must; from (x1, y1) to (x2, y2)."""
    w = frames_window()
    raw = F.when(F.col("is_raw"), F.struct("mx", "my"))
    pairs = balls.withColumn("m2", raw).withColumn("m1", F.lag(raw, 2).over(w)).filter("m1 is not null and m2 is not null")
    pairs = pairs.select(*FRAME, F.col("m1.mx").alias("x1"), F.col("m1.my").alias("y1"), F.col("m2.mx").alias("x2"), F.col("m2.my").alias("y2"))
    return pairs.withColumn("speed", g.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) / (2.0 / p.effective_fps)).filter(F.col("speed") > p.shot_speed)


def shots(balls: DataFrame, owned: DataFrame, boxes: DataFrame, classes: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Fast balls bound for a goal, credited to the last owner who isn't a keeper; at most one in five seconds."""
    fast = fast_balls(balls, p).withColumn("goal_x", F.when(F.col("x2") > F.col("x1"), 105.0).when(F.col("x2") < F.col("x1"), 0.0)).filter("goal_x is not null")
    slope = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    fast = fast.filter((F.abs(F.col("x2") - F.col("goal_x")) <= 35.0) & (F.abs(F.col("x2") - F.col("x1")) > 0.1)).withColumn("slope", slope)
    y = F.col("y2") + F.col("slope") * (F.col("goal_x") - F.col("x2"))
    fast = fast.filter((y > p.post_low) & (y < p.post_high))
    who = owned.select(*FRAME, F.coalesce("owner", F.lag("owner", 5).over(frames_window())).alias("track_id")).filter("track_id is not null")
    fast = fast.join(who, FRAME).join(classes.filter("dominant_class <> 1").select("match_id", "track_id"), ["match_id", "track_id"], "left_semi")
    taken = debounce(fast, ["match_id"], p.seconds(5), strict=False)
    pressed = opponent_near(taken.select(*FRAME, "track_id"), boxes, p.dribble_radius).select(*FRAME, F.lit(True).alias("near"))
    taken = taken.join(pressed, FRAME, "left").withColumn("pressed", F.coalesce("near", F.lit(False))).drop("near")
    chance = lambda under: g.xg(F.col("x1"), F.col("y1"), F.col("goal_x"), pressed=under)
    away = g.distance(F.col("x2"), F.col("y2"), F.col("goal_x"), F.lit(34.0))
    return taken.withColumn("xg", chance(F.col("pressed"))).withColumn("free_xg", chance(F.lit(False))).withColumn("reach", g.shot_range(away))


def goals(taken: DataFrame, balls: DataFrame, boxes: DataFrame, teams: DataFrame, directions: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Shots that stay on course, or whose ball vanishes in front of the goal; one in 30 seconds for each team."""
    course, zone, gone, needed = max(3, int(0.5 * p.effective_fps)), max(10, p.seconds(2)), int(p.effective_fps * 1.5), int(p.effective_fps * 0.8)
    ahead = taken.select("match_id", F.col("frame_idx").alias("at"), "goal_x", "slope", F.explode(F.expr(f"sequence(frame_idx, frame_idx + {zone + gone})")).alias("frame_idx"))
    ahead = ahead.join(balls.select(*FRAME, "mx", "my", F.lit(True).alias("there")), FRAME)
    k = F.col("frame_idx") - F.col("at")
    y = F.col("my") + F.col("slope") * (F.col("goal_x") - F.col("mx"))
    on = k.between(1, course) & y.between(p.post_low - 0.5, p.post_high + 0.5)
    inside = (k < zone) & F.when(F.col("goal_x") > 0, F.col("mx") > 98.0).otherwise(F.col("mx") < 7.0) & F.col("my").between(p.post_low - 1.5, p.post_high + 1.5)
    missing = F.when(F.col("mx").isNull(), F.col("frame_idx"))
    seen = ahead.groupBy("match_id", "at").agg(F.count_if(on).alias("on_course"), F.max(F.when(inside, F.col("frame_idx"))).alias("last_in"), F.collect_list(missing).alias("missing"))
    vanished = F.size(F.filter("missing", lambda f: (f > F.col("last_in")) & (f < F.col("last_in") + gone))) >= needed
    gate = (F.abs(F.col("x1") - F.col("goal_x")) <= 30.0) & (F.col("free_xg") > 0.02)
    found = taken.join(seen.withColumnRenamed("at", "frame_idx"), FRAME).filter((gate & (F.col("on_course") >= 2)) | (F.col("last_in").isNotNull() & vanished))
    team_of = teams.select("match_id", "track_id", "team")
    found = found.join(team_of, ["match_id", "track_id"], "left")
    aims = directions.select("match_id", "team", F.col("attacks_x"))
    found = found.join(aims, ["match_id", "team"], "left")
    wrong = found.filter(F.col("attacks_x") != F.col("goal_x")).select(*FRAME, "goal_x")
    rivals = wrong.join(directions.select("match_id", F.col("team").alias("rival"), F.col("attacks_x").alias("goal_x")), ["match_id", "goal_x"])
    near = one_by_one(in_frames(boxes).join(rivals.hint("shuffle_hash"), FRAME), "rival").join(team_of.withColumnRenamed("team", "rival"), ["match_id", "track_id", "rival"]).join(balls.filter("mx is not null").select(*FRAME, "mx", "my"), FRAME)
    near = near.withColumn("d", g.distance(F.col("px"), F.col("py"), F.col("mx"), F.col("my"))).filter("d < 15.0")
    better = near.groupBy(*FRAME).agg(F.min(F.struct("d", "box_idx", "track_id", "rival")).alias("m")).select(*FRAME, F.col("m.track_id").alias("other"), F.col("m.rival").alias("rival"))
    found = found.join(better, FRAME, "left").select(*FRAME, F.coalesce("other", "track_id").alias("track_id"), F.coalesce("rival", "team", F.lit("unknown")).alias("team"), F.col("track_id").alias("shooter"), "goal_x")
    return debounce(found, ["match_id", "team"], p.seconds(30), strict=False)


def saves(balls: DataFrame, boxes: DataFrame, classes: DataFrame, owned: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Fast balls near a goal line that stop or turn within three frames beside a keeper."""
    w = frames_window()
    last = F.max("frame_idx").over(Window.partitionBy("match_id"))
    later = balls.select(*FRAME, last.alias("last"), F.lead("mx", 3).over(w).alias("x3"), F.lead("my", 3).over(w).alias("y3"))
    fast = fast_balls(balls, p).filter((F.col("x2") < 5.0) | (F.col("x2") > 100.0)).join(later, FRAME).filter("x3 is not null and frame_idx < last - 4")
    speed = g.distance(F.col("x3"), F.col("y3"), F.col("x2"), F.col("y2")) / (3.0 / p.effective_fps)
    fast = fast.filter((speed < 5.0) | (F.signum(F.col("x3") - F.col("x2")) != F.signum(F.col("x2") - F.col("x1"))))
    keepers = classes.filter("dominant_class = 1").select("match_id", "track_id")
    beside = _marked(in_frames(boxes).join(fast.select(*FRAME, "x2", "y2").hint("shuffle_hash"), FRAME), "x2", "y2").filter("leads")
    near = beside.filter(g.distance(F.col("px"), F.col("py"), F.col("x2"), F.col("y2")) < 2.0).join(keepers, ["match_id", "track_id"], "left_semi")
    found = debounce(near.select(*FRAME, "track_id"), ["match_id"], max(20, int(p.effective_fps)), strict=False, order=("frame_idx", "track_id"))
    back = found.select("match_id", "track_id", F.col("frame_idx").alias("at"), F.explode(F.expr("sequence(greatest(1, frame_idx - 49), frame_idx)")).alias("frame_idx"))
    back = back.join(owned.filter("owner is not null"), FRAME, "left").groupBy("match_id", "track_id", "at").agg(F.max(F.when(F.col("owner") != F.col("track_id"), F.col("frame_idx"))).alias("frame_idx"))
    origin = back.join(balls.filter("mx is not null").select(*FRAME, "mx", "my"), FRAME, "left")
    out = origin.select("match_id", "track_id", F.col("at").alias("frame_idx"), "mx", "my")
    away = g.distance(F.coalesce("mx", F.lit(52.5)), F.coalesce("my", F.lit(34.0)), F.lit(105.0), F.lit(34.0))
    return out.withColumn("origin_distance", away).select(*FRAME, "track_id", "origin_distance", g.save_range(F.col("origin_distance")).alias("reach"), (F.col("origin_distance") > 15.0).alias("jumping"))
