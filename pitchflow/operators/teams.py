"""Which team a player is of: medians of colours, two clusters for each match and their names, and assignment by kits."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchflow.functions import labels as l
from pitchflow.operators.lineage import shared

TRACK = ["match_id", "track_id"]


def hsv_median(samples: DataFrame) -> DataFrame:
    """samples(match_id, track_id, h, s, v): the median of each for each track."""
    return samples.groupBy(*TRACK).agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in ("h", "s", "v")])


def hue_features(medians: DataFrame) -> DataFrame:
    """The hue as a point on the circle, with saturation and value."""
    angle = F.col("h") * (math.pi / 90)
    return medians.select("*", F.array(F.cos(angle), F.sin(angle), F.col("s"), F.col("v")).alias("features"))


def apart(a: Column, b: Column) -> Column:
    """Squared distance of two arrays, rounded so that the order of addition decides nothing."""
    return F.round(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x), 9)


def cluster_teams(rows: DataFrame) -> DataFrame:
    """rows(match_id, track_id, features): two clusters for each match by Lloyd's steps, the bigger one 0; matches with
    fewer than two rows have one. Starts from the row farthest from the match's mean and the row farthest from that, and
    goes on until no centre of any match moves; a match whose centres stand takes no part in later rounds. Centres are
    rounded to nine digits, so that they come to stand and the order of addition decides nothing."""
    rows = shared(rows.select(*TRACK, "features"))
    width = rows.select(F.size("features")).first()
    size = width[0] if width else 0
    mean = F.array(*[F.avg(F.col("features")[i]) for i in range(size)]) if size else F.array().cast("array<double>")
    far = lambda d: F.max_by("features", F.struct(d, -F.col("track_id")))
    first = rows.join(rows.groupBy("match_id").agg(mean.alias("m")), "match_id").groupBy("match_id").agg(far(apart(F.col("features"), F.col("m"))).alias("a"))
    centers = rows.join(first, "match_id").groupBy("match_id").agg(F.first("a").alias("a"), far(apart(F.col("features"), F.col("a"))).alias("b"))
    side = F.when(apart(F.col("features"), F.col("b")) < apart(F.col("features"), F.col("a")), 1).otherwise(0)
    moved = lambda k, old: F.when(F.count_if(F.col("cluster") == k) > 0, F.array(*[F.round(F.avg(F.when(F.col("cluster") == k, F.col("features")[i])), 9) for i in range(size)])).otherwise(F.first(old)).alias(old)
    still, stand = shared(centers), []
    while not still.isEmpty():
        placed = rows.join(still, "match_id").withColumn("cluster", side)
        new = placed.groupBy("match_id").agg(F.first("a").alias("a0"), F.first("b").alias("b0"), moved(0, "a"), moved(1, "b"))
        new = shared(new.withColumn("stands", (F.col("a") == F.col("a0")) & (F.col("b") == F.col("b0"))).drop("a0", "b0"))
        stand.append(new.filter("stands").drop("stands"))
        still = new.filter("not stands").drop("stands")
    centers = reduce(DataFrame.unionByName, stand, centers.limit(0))
    placed = rows.join(centers, "match_id").select(*TRACK, side.alias("cluster"))
    w = Window.partitionBy("match_id")
    ones = F.count_if(F.col("cluster") == 1).over(w)
    return placed.select(*TRACK, F.when(ones * 2 > F.count("*").over(w), 1 - F.col("cluster")).otherwise(F.col("cluster")).alias("cluster"))


def cluster_labels(clusters: DataFrame, medians: DataFrame) -> DataFrame:
    """A colour's name for each cluster, from its members' medians; pale clusters are white."""
    p = lambda c, q: F.percentile(c, F.lit(q))
    out = clusters.join(medians, TRACK).groupBy("match_id", "cluster").agg(F.count("*").alias("members"), p("h", 0.5).alias("h"), p("s", 0.5).alias("s"), p("v", 0.5).alias("v"), p("s", 0.1).alias("low_s"))
    pale = (F.col("low_s") < 0.25) & (F.col("v") > 0.70)
    return out.select("match_id", "cluster", "members", F.when(pale, "white").otherwise(l.describe_color(F.col("h"), F.col("s"), F.col("v"))).alias("label"))


def cluster_names(members: DataFrame) -> DataFrame:
    """members(match_id, cluster, number, color): each cluster by its members' most frequent known colour, the first in
    order of equals; two of one name are told apart as _A and _B."""
    known = F.when(F.col("color") != "Unknown", F.col("color"))
    counted = members.groupBy("match_id", "cluster", known.alias("color")).agg(F.count("*").alias("n"))
    best = counted.groupBy("match_id", "cluster").agg(F.min(F.when(F.col("color").isNotNull(), F.struct((-F.col("n")).alias("n"), "color"))).alias("b"))
    named = best.select("match_id", "cluster", F.coalesce("b.color", F.concat(F.lit("Team"), F.col("cluster"))).alias("name"))
    same = F.count("*").over(Window.partitionBy("match_id", "name")) > 1
    return named.select("match_id", "cluster", F.when(same, F.concat("name", F.when(F.col("cluster") == 0, "_A").otherwise("_B"))).otherwise(F.col("name")).alias("name"))


def primary_kits(players: DataFrame, kits: DataFrame) -> DataFrame:
    """(match_id, a, b, kinds): the two kits of each match. players(match_id, number, kit, cls), without keepers and unknown
    kits counted; kits(match_id, color, place): what was discovered, if anything. Discovered kits win if one of them is
    worn, and the worn one comes first; else the two most worn ones; a single one has a likely opponent."""
    counted = players.filter("cls <> 1 and kit <> 'Unknown'").groupBy("match_id", "kit").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("k", F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("n"), "kit")))
    worn = ranked.groupBy("match_id").agg(F.count("*").alias("kinds"), F.collect_set("kit").alias("worn"), F.max(F.when(F.col("k") == 1, F.col("kit"))).alias("top"), F.max(F.when(F.col("k") == 2, F.col("kit"))).alias("second"))
    pair = kits.groupBy("match_id").agg(F.max(F.when(F.col("place") == 1, l.team_color(F.col("color")))).alias("k1"), F.max(F.when(F.col("place") == 2, l.team_color(F.col("color")))).alias("k2"))
    both = worn.join(pair, "match_id", "left")
    on = lambda c: F.coalesce(F.array_contains("worn", F.col(c)), F.lit(False))
    guided = F.col("k1").isNotNull() & F.col("k2").isNotNull() & (on("k1") | on("k2")) & (F.col("kinds") >= 2)
    a = F.when(guided & on("k1"), F.col("k1")).when(guided, F.col("k2")).otherwise(F.col("top"))
    b = F.when(guided & on("k1"), F.col("k2")).when(guided, F.col("k1")).otherwise(F.coalesce("second", l.likely_opponent(F.col("top"))))
    return both.select("match_id", a.alias("a"), b.alias("b"), "kinds")


def _nearer_kit(kit: Column, a: Column, b: Column, smaller: Column) -> Column:
    """The primary kit for a third one by hue: if one of the two has no hue, it takes whatever isn't near the other."""
    h, ha, hb = (l.reference_hue(x) for x in (kit, a, b))
    gap = lambda x, y: F.coalesce(F.least(F.abs(x - y), 180 - F.abs(x - y)), F.lit(180))
    far = lambda other: h.isNotNull() & (gap(h, other) > 30)
    by_hue = F.when(gap(h, ha) == gap(h, hb), smaller).when(gap(h, ha) < gap(h, hb), a).otherwise(b)
    return F.when(ha.isNull() & hb.isNotNull(), F.when(far(hb), a).otherwise(b)).when(hb.isNull() & ha.isNotNull(), F.when(far(ha), b).otherwise(a)).otherwise(by_hue)


def assign_teams(players: DataFrame, kits: DataFrame) -> DataFrame:
    """(match_id, number, kit, team) of every player. players(match_id, number, color, cls, observations).

    Kits decide first; third kits go to the nearer one by hue; where one team is more than twice the other, those seen least
    move over (never number 1) while the sizes differ by more than two and until none is more than one and a half times
    the other; unknown kits and keepers go to the team with the nearer mean number."""
    worn = players.withColumn("kit", l.team_color(F.col("color")))
    pairs = primary_kits(worn, kits)
    field, n, a, b = F.col("cls") != 1, F.col("number"), F.col("a"), F.col("b")
    is_a, is_b = field & (F.col("kit") == a), field & (F.col("kit") == b)
    count = lambda c: F.count_if(c).alias
    sums = worn.join(pairs, "match_id").groupBy("match_id").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.first("kinds").alias("kinds"), count(is_a)("size_a"), count(is_b)("size_b"), F.avg(F.when(is_a, n)).alias("mean_a"), F.avg(F.when(is_b, n)).alias("mean_b"))
    rows = worn.join(sums, "match_id", "left")
    to_a = F.abs(n - F.coalesce("mean_a", F.lit(15.0))) < F.abs(n - F.coalesce("mean_b", F.lit(25.0)))
    nearer = F.when(to_a, a).otherwise(b)
    single = F.col("kinds") == 1
    smaller = F.when(F.col("size_a") > F.col("size_b"), b).otherwise(a)
    unknown = F.when(single, b).when((F.col("size_a") > 0) & (F.col("size_b") > 0), nearer).when(F.col("size_a") > 0, b).when(F.col("size_b") > 0, a)
    keeper = F.when(single, F.when(F.abs(n - F.col("mean_a")) < 10, a).otherwise(b)).when((F.col("size_a") > 0) & (F.col("size_b") > 0), nearer)
    first = F.when(~field, keeper).when(F.col("kit") == "Unknown", unknown).when(F.col("kit").isin(a, b) | single, F.when(F.col("kit") == b, b).otherwise(a)).otherwise(_nearer_kit(F.col("kit"), a, b, smaller))
    rows = rows.withColumn("first", first)
    # who moves from the bigger team: the i-th in order, if no one before him has balanced the teams
    big_is_a = F.col("size_a") > F.col("size_b")
    big, small = F.greatest("size_a", "size_b"), F.least("size_a", "size_b")
    in_big = field & ~single & (F.col("kit") == F.when(big_is_a, a).otherwise(b)) & (small > 0) & (big > 2 * small)
    order = Window.partitionBy("match_id", "in_big").orderBy("observations", "number")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("in_big", F.coalesce(in_big, F.lit(False))).withColumn("i", F.row_number().over(order)).withColumn("moved", F.coalesce(F.count_if(n != 1).over(upto), F.lit(0)))
    left, right = big - F.col("i"), small + F.col("moved") + 1
    balanced = (n != 1) & (F.greatest(left, right) <= 1.5 * F.greatest(F.lit(1), F.least(left, right)))
    rows = rows.withColumn("goes_on", (big - F.col("i") + 1 - small - F.col("moved")) > 2).withColumn("ends", balanced)
    stopped = F.coalesce(F.max((~F.col("goes_on") | F.col("ends")).cast("int")).over(upto), F.lit(0)) == 1
    moves = F.col("in_big") & F.col("goes_on") & ~stopped & (n != 1)
    rows = rows.withColumn("moves", moves)
    return rows.select("match_id", "number", "kit", F.when(F.col("moves"), F.when(big_is_a, b).otherwise(a)).otherwise(F.col("first")).alias("team"))


def tracks_inherit(assigned: DataFrame, numbers: DataFrame) -> DataFrame:
    """The team of each track that wears an assigned number. numbers(match_id, track_id, number)."""
    return numbers.select(*TRACK, "number").join(assigned.select("match_id", "number", "team"), ["match_id", "number"]).select(*TRACK, "number", "team")


def teams_by_color(colors: DataFrame, pairs: DataFrame, bound: DataFrame) -> DataFrame:
    """The team of each track that no number gave one, by its shirt: colors(match_id, track_id, color) of one of the match's
    two kits, or else nearer to one by hue, the first of equals; a kit without a hue takes what isn't near the other.
    pairs: what primary_kits() gives; bound(match_id, track_id): tracks that have a team."""
    kit, a, b = l.team_color(F.col("color")), F.col("a"), F.col("b")
    lost = colors.select(*TRACK, "color").join(bound.select(*TRACK), TRACK, "left_anti").join(pairs.select("match_id", "a", "b"), "match_id")
    team = F.when(kit == a, a).when(kit == b, b).otherwise(_nearer_kit(F.col("color"), a, b, a))
    return lost.select(*TRACK, "color", team.alias("team"))


def id_remap(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """rows with who: the number of a track where one is mapped, else the track itself."""
    return rows.join(numbers.select(*TRACK, "number"), TRACK, "left").withColumn("who", F.coalesce("number", "track_id")).drop("number")


def consolidate(rows: DataFrame, valid: DataFrame) -> DataFrame:
    """rows(match_id, number, team, weight): each number's weight under its heaviest valid team, Unknown if it has none.
    valid(match_id, team)."""
    known = rows.join(valid.select("match_id", "team", F.lit(True).alias("ok")), ["match_id", "team"], "left")
    per_team = known.groupBy("match_id", "number", "team").agg(F.sum("weight").alias("w"), F.count("*").alias("n"), F.max("ok").alias("ok"))
    best = F.min(F.when(F.col("ok"), F.struct((-F.col("w")).alias("w"), "team")))
    return per_team.groupBy("match_id", "number").agg(best.alias("b"), F.sum("w").alias("weight"), F.sum("n").alias("fragments")).select("match_id", "number", F.coalesce("b.team", F.lit("Unknown")).alias("team"), "weight", "fragments")


def largest_two(players: DataFrame) -> DataFrame:
    """players(match_id, number, color): the two most frequent colours of a match are its teams; others have none."""
    counted = players.groupBy("match_id", "color").agg(F.count("*").alias("n"))
    top = counted.withColumn("place", F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("n"), "color"))).filter("place <= 2")
    return players.join(top.select("match_id", "color", "place"), ["match_id", "color"], "left").select("match_id", "number", "color", "place")
