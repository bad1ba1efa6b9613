"""Jersey numbers and kit colours of tracks from noisy reads.

reads(match_id, frame_idx, track_id, number, confidence); colors(match_id, frame_idx, track_id, cls, color)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchflow.functions import labels as l
from pitchflow.operators.lineage import cut, shared
from pitchflow.operators.sequence import debounce

TRACK = ["match_id", "track_id"]


def _in_order(*keys: str):
    return Window.partitionBy(*(keys or TRACK)).orderBy("frame_idx")


def majority(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Most frequent value of each key, of equals the one seen first, with its votes and all samples."""
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("votes"), F.min("frame_idx").alias("seen"))
    return counted.groupBy(*keys).agg(F.min(F.struct((-F.col("votes")).alias("n"), "seen", F.col(value).alias("v"))).alias("best"), F.sum("votes").alias("samples")).select(*keys, F.col("best.v").alias(value), (-F.col("best.n")).alias("votes"), "samples")


def scores(reads: DataFrame, floor: float = 0.40) -> DataFrame:
    """Score (sum of confidences from floor) and tally of each number of a track, ranked by (score, number as text)."""
    rated = reads.filter(F.col("confidence") >= floor).groupBy(*TRACK, "number").agg(F.round(F.sum("confidence"), 6).alias("score"), F.count("*").alias("tally"))
    rank = Window.partitionBy(*TRACK).orderBy(F.desc("score"), F.desc(F.col("number").cast("string")))
    return rated.withColumn("place", F.row_number().over(rank)).withColumn("second", F.coalesce(F.lead("score").over(rank), F.lit(0.0)))


def weighted_vote(reads: DataFrame) -> DataFrame:
    """Winner by tier weights 3, 2, 1 and its share of all weight."""
    weighed = reads.withColumn("w", l.confidence_tier(F.col("confidence"))).groupBy(*TRACK, "number").agg(F.sum("w").alias("w"))
    return weighed.groupBy(*TRACK).agg(F.min(F.struct((-F.col("w")).alias("n"), F.col("number").alias("v"))).alias("best"), F.sum("w").alias("total")).select(*TRACK, F.col("best.v").alias("number"), (-F.col("best.n") / F.col("total")).alias("share"))


def vote_recovery(reads: DataFrame) -> DataFrame:
    """Tracks whose best number has two reads or more, a score of 0.5 and a margin of 0.3."""
    return scores(reads).filter("place = 1 and tally >= 2 and score - second >= 0.3 and score >= 0.50").select(*TRACK, "number")


def finalize_bindings(reads: DataFrame, bound: DataFrame, registered: DataFrame) -> DataFrame:
    """Unbound tracks take their best number with evidence over 1.0, or over 0.5 if the number is registered."""
    best = scores(reads).filter("place = 1").join(bound.select(*TRACK), TRACK, "left_anti")
    known = registered.select("match_id", "number").distinct().withColumn("known", F.lit(True))
    return best.join(known, ["match_id", "number"], "left").filter((F.col("score") > 1.0) | (F.coalesce("known", F.lit(False)) & (F.col("score") > 0.5))).select(*TRACK, "number", "score")


def first_lock(reads: DataFrame, floor: float = 0.15) -> DataFrame:
    """The first read of each track with enough confidence."""
    return reads.filter(F.col("confidence") >= floor).groupBy(*TRACK).agg(F.min_by("number", "frame_idx").alias("number"), F.min("frame_idx").alias("frame_idx"))


def running_scores(reads: DataFrame) -> DataFrame:
    """Score of the read number so far, and the track's sum and number of distinct numbers so far."""
    per_number = Window.partitionBy(*TRACK, "number").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    whole = _in_order().rowsBetween(Window.unboundedPreceding, 0)
    return reads.withColumn("score", F.sum("confidence").over(per_number)).withColumn("total", F.sum("confidence").over(whole)).withColumn("numbers", F.size(F.collect_set("number").over(whole)))


def dirichlet_lock(reads: DataFrame) -> DataFrame:
    """First read at which a number's share, with a prior of 1 for each number seen, is over 0.7 and evidence over 2.5."""
    run = running_scores(reads).withColumn("share", (F.col("score") + 1.0) / (F.col("total") + F.col("numbers")))
    locked = run.filter((F.col("score") > 2.5) & (F.col("share") > 0.7))
    return locked.groupBy(*TRACK).agg(F.min_by("number", "frame_idx").alias("number"), F.min("frame_idx").alias("frame_idx"))


def tier_lock(reads: DataFrame, needed: float = 6.0) -> DataFrame:
    """First read at which a number's tier sum reaches needed and no other number of the track leads it."""
    tier = l.confidence_tier(F.col("confidence"))
    own = F.sum(tier).over(Window.partitionBy(*TRACK, "number").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0))
    most = F.max("own").over(_in_order().rowsBetween(Window.unboundedPreceding, 0))
    run = reads.withColumn("own", own).withColumn("most", most).filter((F.col("own") >= needed) & (F.col("own") >= F.col("most")))
    return run.groupBy(*TRACK).agg(F.min_by("number", "frame_idx").alias("number"), F.min("frame_idx").alias("frame_idx"))


def rolling_vote(reads: DataFrame, n: int = 10) -> DataFrame:
    """Share of the read number among the track's last n reads."""
    last = F.collect_list("number").over(_in_order().rowsBetween(-(n - 1), 0))
    return reads.withColumn("last", last).select(*TRACK, "frame_idx", "number", (F.size(F.filter("last", lambda x: x == F.col("number"))) / F.size("last")).alias("share"))


def run_of_three(reads: DataFrame) -> DataFrame:
    """The first number read three times in a row (confidence .99), else the last read; whether it asks for review."""
    w = _in_order()
    run = reads.withColumn("third", (F.lag("number", 1).over(w) == F.col("number")) & (F.lag("number", 2).over(w) == F.col("number")))
    best = run.groupBy(*TRACK).agg(F.min_by(F.when(F.col("third"), F.col("number")), F.when(F.col("third"), F.col("frame_idx"))).alias("steady"), F.max_by("number", "frame_idx").alias("latest"), F.max_by("confidence", "frame_idx").alias("confidence"))
    out = best.select(*TRACK, F.coalesce("steady", "latest").alias("number"), F.when(F.col("steady").isNotNull(), 0.99).otherwise(F.col("confidence")).alias("confidence"))
    return out.withColumn("review", F.col("number").isin(11, 19, 29) | (F.col("confidence") < 0.80))


def lock_changes(reads: DataFrame) -> DataFrame:
    """How often the read number of a track changes."""
    before = F.lag("number").over(_in_order())
    return reads.withColumn("changed", (before != F.col("number")).cast("int")).groupBy(*TRACK).agg(F.coalesce(F.sum("changed"), F.lit(0)).alias("changes"))


def merge_conflicts(reads: DataFrame, floor: float = 0.85, times: int = 3) -> DataFrame:
    """Tracks with two numbers or more, each read several times with confidence over floor."""
    often = reads.filter(F.col("confidence") > floor).groupBy(*TRACK, "number").agg(F.count("*").alias("n")).filter(F.col("n") >= times)
    return often.groupBy(*TRACK).agg(F.count("*").alias("numbers"), F.sum("n").alias("reads")).filter("numbers >= 2")


def first_reader(reads: DataFrame, colors: DataFrame) -> DataFrame:
    """The track that first read each number of a match, with the last colour seen of it by then."""
    first = reads.groupBy("match_id", "number").agg(F.min(F.struct("frame_idx", "track_id")).alias("f")).select("match_id", "number", "f.frame_idx", "f.track_id")
    seen = colors.select(*TRACK, F.col("frame_idx").alias("seen"), "color")
    then = first.join(seen, TRACK, "left").withColumn("color", F.when(F.col("seen") <= F.col("frame_idx"), F.col("color")))
    return then.groupBy("match_id", "number", "frame_idx", "track_id").agg(F.max_by("color", F.when(F.col("color").isNotNull(), F.col("seen"))).alias("color"))


def raw_read_recovery(reads: DataFrame, found: DataFrame, least: int = 20) -> DataFrame:
    """Numbers that no track holds but many reads show, given to the track with most of them."""
    counted = reads.groupBy("match_id", "number", "track_id").agg(F.count("*").alias("n"))
    best = counted.groupBy("match_id", "number").agg(F.sum("n").alias("reads"), F.min(F.struct((-F.col("n")).alias("n"), F.col("track_id").alias("t"))).alias("b"))
    return best.filter(F.col("reads") >= least).join(found.select("match_id", "number").distinct(), ["match_id", "number"], "left_anti").select("match_id", F.col("b.t").alias("track_id"), "number", "reads")


def registry(reads: DataFrame, least: float = 0.5) -> DataFrame:
    """(match_id, track_id, number): the track that is first to read each number of a match with confidence enough."""
    first = reads.filter(F.col("confidence") >= least).groupBy("match_id", "number").agg(F.min(F.struct("frame_idx", "track_id")).alias("f"))
    return first.select("match_id", F.col("f.track_id").alias("track_id"), "number")


def tallies(reads: DataFrame, needed: float = 6.0, floor: float = 0.40, sure: float = 0.5) -> DataFrame:
    """(match_id, track_id, number): all that the rules for a track's number ask of its reads, in one pass: when the number
    locks it (tier_lock), its score and tally (scores), all its reads, and when it was first read surely."""
    rows = reads.repartition(*TRACK)  # the windows and the groups need no other layout
    own = F.sum(l.confidence_tier(F.col("confidence"))).over(_in_order(*TRACK, "number").rowsBetween(Window.unboundedPreceding, 0))
    run = rows.withColumn("own", own).withColumn("most", F.max("own").over(_in_order().rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda test: F.min(F.when(test, F.col("frame_idx")))
    rated, voted = F.when(F.col("confidence") >= floor, F.col("confidence")), F.col("confidence") >= floor
    return run.groupBy(*TRACK, "number").agg(at((F.col("own") >= needed) & (F.col("own") >= F.col("most"))).alias("locked_at"), F.round(F.sum(rated), 6).alias("score"), F.count_if(voted).alias("tally"), F.count("*").alias("reads"), at(F.col("confidence") >= sure).alias("sure_at"))


def track_to_jersey(reads: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """Number of each track: a lock, else registered (registered(match_id, track_id, number), or by registry()), else
    recovered by votes, else by raw reads; the earlier source wins. A track that registered several numbers takes the
    smallest. The reads are gone through once; all sources come from a row for each number of a track."""
    told = shared(tallies(reads))
    locks = told.filter("locked_at is not null").groupBy(*TRACK).agg(F.min_by("number", "locked_at").alias("number"))
    if registered is None:
        first = told.filter("sure_at is not null").groupBy("match_id", "number").agg(F.min(F.struct("sure_at", "track_id")).alias("f"))
        registered = first.select("match_id", F.col("f.track_id").alias("track_id"), "number")
    rank = Window.partitionBy(*TRACK).orderBy(F.desc("score"), F.desc(F.col("number").cast("string")))
    votes = told.filter("tally > 0").withColumn("place", F.row_number().over(rank)).withColumn("second", F.coalesce(F.lead("score").over(rank), F.lit(0.0)))
    votes = votes.filter("place = 1 and tally >= 2 and score - second >= 0.3 and score >= 0.50")
    sources = [rows.select(*TRACK, "number") for rows in (locks, registered, votes)]
    held = reduce(DataFrame.unionByName, sources).select("match_id", "number").distinct()
    most = told.groupBy("match_id", "number").agg(F.sum("reads").alias("n"), F.min(F.struct((-F.col("reads")).alias("n"), F.col("track_id").alias("t"))).alias("b"))
    raw = most.filter("n >= 20").join(held, ["match_id", "number"], "left_anti").select("match_id", F.col("b.t").alias("track_id"), "number")
    every = reduce(DataFrame.unionByName, [rows.withColumn("source", F.lit(k)) for k, rows in enumerate([*sources, raw], 1)])
    return every.groupBy(*TRACK).agg(F.min(F.struct("source", "number")).alias("b")).select(*TRACK, "b.number", "b.source")


def roster_snap(numbers: DataFrame, roster: DataFrame) -> DataFrame:
    """numbers(match_id, track_id, team, number) against roster(team, number): kept, snapped to the nearest plausible
    number (of the own team first), or off the roster."""
    on = roster.select("number").distinct().withColumn("on_roster", F.lit(True))
    cands = roster.select(F.col("team").alias("r_team"), F.col("number").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("number")).filter(l.plausible_misread(F.col("number"), F.col("r")))
    off = numbers.join(on, "number", "left_anti").select("number", "team").distinct()
    near = off.join(cands, "number").groupBy("number", "team").agg(F.min(F.struct((F.col("r_team") != F.col("team")).cast("int").alias("away"), F.abs(F.col("r") - F.col("number")).alias("d"), F.col("r"))).alias("b"))
    out = numbers.join(on, "number", "left").join(near.select("number", "team", F.col("b.r").alias("r")), ["number", "team"], "left")
    status = F.when(F.col("on_roster"), "on_roster").when(F.col("r").isNotNull(), "snapped").otherwise("off_roster")
    return out.select(*TRACK, "team", "number", F.when(F.col("on_roster"), F.col("number")).otherwise(F.coalesce("r", "number")).alias("mapped"), status.alias("status"))


def roster_reconcile(mapped: DataFrame, reads: DataFrame, roster: DataFrame) -> DataFrame:
    """mapped(match_id, track_id, team, number): numbers off the roster go to the team's number with most direct and
    half-weighted confusable reads (1.0 at least), else the track is dropped."""
    valid = roster.select("number").distinct()
    kept = mapped.join(valid, "number", "left_semi").select(*TRACK, "number")
    lost = mapped.join(valid, "number", "left_anti").select(*TRACK, "team")
    counted = reads.groupBy(*TRACK, F.col("number").alias("read")).agg(F.count("*").alias("n"))
    cands = roster.select("team", F.col("number").alias("r"))
    pairs = lost.join(counted, TRACK).join(cands, "team")
    credit = F.when(F.col("read") == F.col("r"), F.col("n") * 1.0).when(l.plausible_misread(F.col("read"), F.col("r")), F.col("n") * 0.5).otherwise(0.0)
    best = pairs.groupBy(*TRACK, "r").agg(F.sum(credit).alias("s")).filter("s >= 1.0").groupBy(*TRACK).agg(F.min(F.struct((-F.col("s")).alias("s"), F.col("r"))).alias("b"))
    return kept.unionByName(best.select(*TRACK, F.col("b.r").alias("number")))


def color_settle(colors: DataFrame, at: int = 10) -> DataFrame:
    """First known colour of a track, corrected once by its tenth known one; keepers keep the first, referees none."""
    known = colors.filter("cls <> 3 and color <> 'Unknown'").withColumn("k", F.row_number().over(_in_order()))
    return known.filter((F.col("k") == 1) | ((F.col("k") == at) & (F.col("cls") != 1))).groupBy(*TRACK).agg(F.max_by("color", "k").alias("color"))


def kit_discovery(colors: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """The two kits of a match: the two most frequent of the four most frequent player colours, referees' top colour
    left out unless keepers wear it. forced(match_id, color, place): kits that are known beforehand, instead of what a
    match shows."""
    counted = colors.filter("color <> 'Unknown'").groupBy("match_id", "cls", "color").agg(F.count("*").alias("n"))
    rank = Window.partitionBy("match_id", "cls").orderBy(F.desc("n"), "color")
    ranked = counted.withColumn("k", F.row_number().over(rank))
    keepers = ranked.filter("cls = 1 and k <= 2").select("match_id", "color")
    referees = ranked.filter("cls = 3 and k = 1").select("match_id", "color").join(keepers, ["match_id", "color"], "left_anti")
    left = ranked.filter("cls = 2 and k <= 4").join(referees, ["match_id", "color"], "left_anti")
    found = left.withColumn("place", F.row_number().over(rank)).filter("place <= 2").select("match_id", "color", "n", "place")
    if forced is None:
        return found
    seen = counted.filter("cls = 2").select("match_id", "color", "n")
    given = forced.select("match_id", "color", F.col("place").cast("int").alias("place")).join(seen, ["match_id", "color"], "left")
    return found.join(forced.select("match_id").distinct(), "match_id", "left_anti").unionByName(given.select("match_id", "color", F.coalesce("n", F.lit(0)).alias("n"), "place"))


def team_colors(colors: DataFrame, most: int = 2) -> DataFrame:
    counted = colors.filter(~F.col("color").isin("Unknown", "Gray")).groupBy("match_id", "color").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("n"), F.desc("color")))).filter(F.col("place") <= most)


def throttle(rows: DataFrame, gap: int = 4) -> DataFrame:
    """Rows of each track at least gap frames after the last one kept."""
    return debounce(rows.select(*TRACK, "frame_idx"), TRACK, gap, strict=False)


def every_nth(rows: DataFrame, n: int = 30, most: int = 10) -> DataFrame:
    """Observation 1, n + 1, 2n + 1 and so on of each track, at most so many."""
    k = F.row_number().over(_in_order())
    return rows.withColumn("k", k).filter((F.col("k") % n == 1) & (F.col("k") <= n * most))


def unique_per_team(rows: DataFrame, *best: Column) -> DataFrame:
    """One row for each team and number, the best; rows without a number all stay."""
    place = F.row_number().over(Window.partitionBy("match_id", "team", "number").orderBy(*best))
    return rows.withColumn("place", place).filter(F.col("number").isNull() | (F.col("place") == 1)).drop("place")


def revoke_lower(rows: DataFrame, *best: Column) -> DataFrame:
    """As unique_per_team, but the others stay without their number."""
    place = F.row_number().over(Window.partitionBy("match_id", "team", "number").orderBy(*best))
    return rows.withColumn("place", place).withColumn("number", F.when(F.col("place") == 1, F.col("number"))).drop("place")


def collisions(active: DataFrame) -> DataFrame:
    """Tracks that lose their number because another active track of the frame holds it: locked first, then the lower id.

    active(match_id, frame_idx, track_id, number, locked)."""
    w = Window.partitionBy("match_id", "frame_idx", "number").orderBy(F.desc("locked"), "track_id")
    return active.withColumn("place", F.row_number().over(w)).filter("place > 1").groupBy(*TRACK).agg(F.count("*").alias("frames"))


def first_seen_registry(reads: DataFrame, teams: DataFrame) -> DataFrame:
    """Each track is decided by its first confident read; the first track of a team and number owns it."""
    first = reads.filter(F.col("confidence") >= 0.5).groupBy(*TRACK).agg(F.min_by("number", "frame_idx").alias("number"), F.min("frame_idx").alias("frame_idx")).join(teams, TRACK)
    owner = F.first("track_id").over(Window.partitionBy("match_id", "team", "number").orderBy("frame_idx", "track_id"))
    return first.select(*TRACK, "team", "number", owner.alias("root"))


def resolve_roots(edges: DataFrame) -> DataFrame:
    """Follow child to parent to the end of each chain by pointer doubling; nodes of a cycle end at its smallest id.
    As many rounds as the match with most edges could need, so that what isn't at an end by then is on or before a cycle.

    edges(match_id, child, parent), one parent for each child."""
    at = edges.select("match_id", "child", F.col("parent").alias("root"), F.least("child", "parent").alias("low"), F.lit(False).alias("done"))
    longest = edges.groupBy("match_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    for _ in range(int(longest).bit_length() + 1):
        step = at.select("match_id", F.col("child").alias("root"), F.col("root").alias("next"), F.col("low").alias("next_low"))
        at = cut(at.join(step, ["match_id", "root"], "left").select("match_id", "child", F.coalesce("next", "root").alias("root"), F.least("low", F.coalesce("next_low", "low")).alias("low"), F.col("next").isNull().alias("done")))
        if at.filter("not done").isEmpty():
            break
    return at.select("match_id", "child", F.when(F.col("done"), F.col("root")).otherwise(F.col("low")).alias("root"))
