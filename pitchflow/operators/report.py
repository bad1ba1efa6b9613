"""Player counters, merging of fragments, caps, roles, output filters and player documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchflow.functions import geometry as g
from pitchflow.params import DEFAULT, Params

FRAME, TRACK = ["match_id", "frame_idx"], ["match_id", "track_id"]
# fixed values: ceilings for 90 minutes
CAPS = {"passes_total": 160, "passes_complete": 150, "shots": 14, "tackles": 18, "interceptions": 25, "distance_m": 14500.0}


def counters(parts: list[tuple[DataFrame, dict[str, object]]], metrics: list[str]) -> DataFrame:
    """One row for each track from rows of several kinds of events, all in one aggregation. parts: rows with match_id
    and track_id, and the value that each of them adds to a metric."""
    one = lambda x: x if isinstance(x, Column) else F.lit(x)
    zero = lambda rows, adds: rows.select(*TRACK, *[F.coalesce(one(adds.get(m, 0.0)), F.lit(0)).cast("double").alias(m) for m in metrics])
    long = reduce(DataFrame.unionByName, [zero(rows, adds) for rows, adds in parts])
    return long.groupBy(*TRACK).agg(*[F.sum(m).alias(m) for m in metrics])


def fragment_merge(stats: DataFrame, events: list[str], most: int = 20, goal_cap: int = 2) -> DataFrame:
    """stats(match_id, track_id, team, number, weight, ...): one row for each team and number. Events add up over the
    heaviest fragments; goals of the others count only if these have none; more than one fragment caps goals."""
    place = F.row_number().over(Window.partitionBy("match_id", "team", "number").orderBy(F.desc("weight"), "track_id"))
    ranked = stats.withColumn("place", place)
    inner = F.col("place") <= most
    total = lambda m: F.sum(F.when(inner & (F.col(m) > 0), F.col(m)).otherwise(0.0)).alias(m)
    out = ranked.groupBy("match_id", "team", "number").agg(F.count("*").alias("fragments"), F.min_by("track_id", "place").alias("primary"), F.sum("weight").alias("weight"), *[total(m) for m in events], F.sum(F.when(~inner, F.col("goals")).otherwise(0.0)).alias("other_goals"))
    goals = F.when(F.col("goals") > 0, F.col("goals")).otherwise(F.least(F.lit(1.0), F.col("other_goals")))
    return out.withColumn("goals", F.when(F.col("fragments") > 1, F.least(F.lit(float(goal_cap)), goals)).otherwise(goals)).drop("other_goals")


def rate_caps(stats: DataFrame, frames: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Ceilings for 90 minutes, scaled to the match's length; distance is not rounded."""
    length = frames.groupBy("match_id").agg((F.count("*") / p.effective_fps / 60.0).alias("minutes"))
    share = F.greatest(F.lit(0.05), F.col("minutes") / 90.0)
    capped = stats.join(length, "match_id")
    for m, per_90 in CAPS.items():
        if m in stats.columns:
            cap = per_90 * share if m == "distance_m" else F.greatest(F.lit(1.0), F.bround(per_90 * share))
            capped = capped.withColumn(m, F.least(F.col(m), cap))
    return capped.select(stats.columns)


def presence_filter(stats: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """stats(frames, goals, active, dominant_class, recovered): without those seen under 1.5 s, and ghosts under 200 frames
    that do nothing and keep no goal; numbers recovered by votes are exempt from both."""
    seconds = F.col("frames") / p.effective_fps
    short = (seconds < 1.5) & (F.col("goals") == 0)
    ghost = (seconds > 2.0) & (F.col("frames") < 200) & (F.col("goals") == 0) & ~F.col("active") & (F.col("dominant_class") != 1)
    return stats.filter(F.col("recovered") | (~short & ~ghost))


def roles(tracks: DataFrame, kits: DataFrame) -> DataFrame:
    """tracks(match_id, track_id, color, number, in_box): referee, goalkeeper or player by outlying colour and number."""
    worn = tracks.join(kits.select("match_id", "color", F.lit(True).alias("kit")), ["match_id", "color"], "left")
    outlier = F.col("kit").isNull() & F.col("color").isNotNull() & (F.col("color") != "Unknown")
    role = F.when(F.col("number") == 1, "Goalkeeper").when(outlier & F.col("number").isNull(), "Referee").when(outlier & (F.col("in_box") > 0.80), "Goalkeeper").otherwise("Player")
    return worn.select(*TRACK, role.alias("role"))


def roles_by_class(tracks: DataFrame, kits: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """tracks(match_id, track_id, color, cls, x): as the detector says; outlying colours near an end keep goal."""
    worn = tracks.join(kits.select("match_id", "color", F.lit(True).alias("kit")), ["match_id", "color"], "left")
    edge = (F.col("x") < p.pitch_x * 0.15) | (F.col("x") > p.pitch_x * 0.85)
    outlier = F.col("kit").isNull() & F.col("color").isNotNull() & (F.col("color") != "Unknown")
    return worn.select(*TRACK, F.when(F.col("cls") == 1, "Goalkeeper").when(F.col("cls") == 3, "Referee").when(outlier & edge, "Goalkeeper").otherwise("Player").alias("role"))


def keeper_sides(boxes: DataFrame, teams: DataFrame, least: int = 5, p: Params = DEFAULT) -> DataFrame:
    """Keepers with enough samples, and the half that they stand in."""
    means = boxes.filter("cls = 1").join(teams, TRACK).groupBy("match_id", "team").agg(F.avg("px").alias("x"), F.count("*").alias("n")).filter(F.col("n") >= least)
    return means.select("match_id", "team", "n", "x", F.when(F.col("x") < p.pitch_x / 2, "left").otherwise("right").alias("side"))


def accuracy(totals: DataFrame, truth: DataFrame) -> DataFrame:
    """totals and truth(metric, team, value): accuracy in percent; with a truth of 0, 100 if nothing was found, else 0."""
    both = truth.select("metric", "team", F.col("value").alias("truth")).join(totals.select("metric", "team", F.col("value").alias("found")), ["metric", "team"], "left").fillna(0.0, ["found"])
    score = F.when(F.col("truth") == 0, F.when(F.col("found") == 0, 100.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 100.0 * (1 - F.abs(F.col("found") - F.col("truth")) / F.col("truth"))))
    return both.withColumn("accuracy", score)


def packing(passed: DataFrame, boxes: DataFrame, teams: DataFrame) -> DataFrame:
    """Opponents whose x lies between the ends of a pass, when it starts; none for passes under 2 m along the pitch."""
    others = boxes.join(teams, TRACK).select("match_id", F.col("frame_idx").alias("a_end"), F.col("team").alias("o_team"), F.col("px").alias("ox"))
    low, high = F.least("start_x", "end_x"), F.greatest("start_x", "end_x")
    between = (F.col("ox") > low) & (F.col("ox") < high) & (F.abs(F.col("end_x") - F.col("start_x")) >= 2.0)
    return passed.join(others, ["match_id", "a_end"]).filter(F.col("o_team") != F.col("a_team")).groupBy("match_id", "a", "b", "a_end").agg(F.count_if(between).alias("packed"))


def defenders_in_cone(taken: DataFrame, boxes: DataFrame, teams: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Opponents strictly inside the triangle of ball and posts at a shot, and the chance that this leaves."""
    own = taken.join(teams, TRACK).select(*FRAME, F.col("track_id").alias("shooter"), F.col("team").alias("s_team"), "x2", "y2", "goal_x")
    others = boxes.join(teams, TRACK).select(*FRAME, F.col("team").alias("o_team"), "px", "py")
    cross = lambda ax, ay, bx, by: (bx - ax) * (F.col("py") - ay) - (by - ay) * (F.col("px") - ax)
    x, y, gx, lo, hi = F.col("x2"), F.col("y2"), F.col("goal_x"), F.lit(p.post_low), F.lit(p.post_high)
    sides = [cross(x, y, gx, lo), cross(gx, lo, gx, hi), cross(gx, hi, x, y)]
    inside = reduce(lambda a, b: a & b, [s > 0 for s in sides]) | reduce(lambda a, b: a & b, [s < 0 for s in sides])
    counted = own.join(others, FRAME).groupBy(*FRAME, "shooter").agg(F.count_if((F.col("o_team") != F.col("s_team")) & inside).alias("defenders"))
    return counted.withColumn("density_xg", g.density_xg(F.col("defenders")))


def assists(taken: DataFrame, passed: DataFrame) -> DataFrame:
    """Expected assists: a shot's xG to the passer of the match's latest pass before it, if that went to the shooter and
    no earlier shot used it."""
    before = passed.select("match_id", F.col("b_start").alias("frame_idx"), F.lit(0).alias("kind"), F.struct("a", "b", "b_start").alias("p"), F.lit(None).cast("int").alias("track_id"), F.lit(None).cast("double").alias("xg"))
    shots = taken.select("match_id", "frame_idx", F.lit(1).alias("kind"), F.lit(None).cast(before.schema["p"].dataType).alias("p"), "track_id", "xg")
    w = Window.partitionBy("match_id").orderBy("frame_idx", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = before.unionByName(shots).withColumn("latest", F.last("p", ignorenulls=True).over(w)).filter("kind = 1 and latest.b = track_id")
    first = found.groupBy("match_id", F.col("latest.a").alias("a"), F.col("latest.b_start").alias("b_start")).agg(F.min_by("xg", "frame_idx").alias("xg"))
    return first.groupBy("match_id", F.col("a").alias("track_id")).agg(F.sum("xg").alias("expected_assists"))


def turnovers(owned: DataFrame, teams: DataFrame) -> DataFrame:
    """Each change of owner: a pass within a team, else an interception."""
    w = Window.partitionBy("match_id").orderBy("frame_idx")
    moves = owned.filter("owner is not null").withColumn("before", F.lag("owner").over(w)).filter("before <> owner")
    team = lambda who: teams.select("match_id", F.col("track_id").alias(who), F.col("team").alias(f"{who}_team"))
    both = moves.join(team("owner"), ["match_id", "owner"], "left").join(team("before"), ["match_id", "before"], "left")
    return both.select(*FRAME, "before", "owner", F.when(F.col("owner_team") == F.col("before_team"), "pass").otherwise("interception").alias("type"))


def in_box_touches(segs: DataFrame, balls: DataFrame) -> DataFrame:
    """Possessions that end with the ball in a penalty box."""
    ends = segs.filter("owner is not null").select("match_id", F.col("end").alias("frame_idx"), "owner").join(balls, FRAME)
    return ends.filter(g.in_penalty_box(F.col("mx"), F.col("my"))).groupBy("match_id", F.col("owner").alias("track_id")).agg(F.count("*").alias("in_box_touches"))


def documents(stats: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """A nested document for each player: names, and derived rates with a guard for nothing."""
    known = F.col("number").isNotNull()
    rate = F.when(F.col("passes_total") > 0, F.round(100 * F.col("passes_complete") / F.col("passes_total"), 1)).otherwise(0.0)
    return stats.select(
        "match_id",
        F.when(known, F.concat(F.lit("Player "), F.col("number"))).otherwise(F.concat(F.lit("Unknown_"), F.col("primary"))).alias("player_name"),
        F.col("number").alias("jersey_number"), F.coalesce("team", F.lit("White")).alias("team"), F.col("weight").alias("observations"),
        F.round(F.least(F.lit(1.0), F.col("weight") / 100), 2).alias("confidence_score"),
        F.struct("passes_total", "passes_complete", rate.alias("pass_accuracy"), "shots", F.round("xg", 2).alias("xg"), "goals", F.round(F.col("touches") / p.effective_fps, 2).alias("time_on_ball")).alias("stats"),
    )


#: Every field of a player's full document, as an expression over the merged counters (the same in SQL). What no operator
#: can see (woodwork, offside, set pieces, hands, fouls, challenges) is 0, as documents have it.
STAT_FIELDS = {
    "total_distance": "round(distance_m, 2)", "time_on_ball_s": "round(touches / (25e0 / 3), 2)", "touch_frames": "touches",
    "goals_total": "goals", "shots_on_target_total": "shots", "shots_wide_total": "0e0", "penalty_total": "0e0",
    "crosses_total": "crosses", "crosses_accurate_total": "crosses_complete", "dribbles_total": "dribbles", "dribbles_successful_total": "dribbles_retained",
    "passes_total": "passes_total", "passes_accurate": "passes_complete", "accurate_passes_percent": "CASE WHEN passes_total > 0 THEN round(100 * passes_complete / passes_total, 1) ELSE 0e0 END",
    "challenges_total": "0e0", "challenges_won_total": "0e0", "tackles_total": "tackles", "tackles_successful_total": "tackles", "ball_interceptions_total": "interceptions", "fouls_total": "0e0",
    "xg_foot_no_opponent": "round(xg_free, 2)", "xg_header_no_opponent": "0e0", "xg_foot_opponent_present": "round(xg_pressed, 2)", "xg_header_opponent_present": "0e0",
    "blocked_shots_by_opponent": "0e0", "shots_on_post_bar": "0e0", "goals_standard_situation": "0e0", "free_kick_scored": "0e0",
    "expected_assists": "round(expected_assists, 2)", "offsides_total": "0e0", "packing_total": "0e0", "ball_touches_total": "touches", "fouls_suffered": "0e0",
    "ball_recoveries_opp_half": "interceptions_opponent_half", "ball_recoveries_own_half": "interceptions_own_half", "played_offside": "0e0",
    "foot_passes_open_play_total": "passes_total", "hand_passes_total": "0e0", "short_passes_total": "passes_short", "medium_passes_total": "passes_medium", "long_passes_total": "passes_long",
    "accurate_foot_passes_open_play_total": "passes_complete", "hand_passes_accurate_total": "0e0",
    "short_passes_accurate_total": "passes_short_accurate", "medium_passes_accurate_total": "passes_medium_accurate", "accurate_long_passes_total": "passes_long_accurate",
    "close_range_shots_total": "shots_close", "mid_range_shots_total": "shots_mid", "long_range_shots_total": "shots_long",
    "shots_saved_total": "saves", "close_range_saved_total": "saves_close", "mid_range_saved_total": "saves_mid", "long_range_saved_total": "saves_long", "jumping_saves_total": "saves_jumping", "saves_without_jumping_total": "saves - saves_jumping",
    "penalties_saved_total": "0e0", "freekick_saved_total": "0e0", "corners_saved_total": "0e0", "goals_standard_situation_conceded": "0e0", "xg_per_shot_saved": "0e0", "in_box_touches": "in_box_touches",
}


def stat_documents(merged: DataFrame) -> DataFrame:
    """What fragment_merge() gives, as (match_id, team, number, stats): a struct of all STAT_FIELDS."""
    return merged.select("match_id", "team", "number", F.struct(*[F.expr(e).cast("double").alias(n) for n, e in STAT_FIELDS.items()]).alias("stats"))
