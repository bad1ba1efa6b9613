"""Queries on team assignment."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pitchflow.functions import labels as l
from pitchflow.operators import identity
from pitchflow.operators import teams as op
from pitchflow.plans import fixture
from pitchflow.plans.fixture import sql
from pitchflow.plans.identity import _MAJ

TRACK = ["match_id", "track_id"]
# a player's kit: what was seen first of the number's most seen track, but for some
_KIT = "CASE WHEN (number + match_id) % 7 = 0 THEN 'Unknown' WHEN (number * 3 + match_id) % 5 = 0 THEN 'Teal' WHEN match_id % 3 = 1 AND number BETWEEN 22 AND 27 THEN 'Red' ELSE color END"
_H = "CAST(CASE WHEN track_id // 100 <= 11 THEN 2 + frame_idx % 9 ELSE 100 + frame_idx % 30 END AS DOUBLE)"
_S = "CAST(CASE WHEN track_id // 100 <= 11 THEN 60 + (frame_idx + track_id) % 35 ELSE 10 + (frame_idx * 3 + track_id) % 40 END AS DOUBLE) / 100"
_V = "CAST(40 + (frame_idx * 7 + track_id) % 60 AS DOUBLE) / 100"


def _samples(s, d):
    spark = lambda e: e.replace("//", "DIV")
    return fixture.color_obs(s, d).filter("cls = 2").selectExpr("match_id", "track_id", f"{spark(_H)} AS h", f"{spark(_S)} AS s", f"{spark(_V)} AS v")


def _players(s, d):
    named = identity.majority(fixture.reads(s, d), "number", TRACK)
    first = fixture.color_obs(s, d).groupBy(*TRACK).agg(F.min_by("color", "frame_idx").alias("color"), F.min("cls").alias("cls"))
    both = named.join(first, TRACK)
    best = both.groupBy("match_id", "number").agg(F.max_by(F.struct("color", "cls", "samples"), F.struct("samples", -F.col("track_id"))).alias("b"))
    return best.select("match_id", "number", "b.color", "b.cls", F.col("b.samples").alias("observations")).withColumn("color", F.expr(_KIT))


def _kits(s, d):
    return identity.kit_discovery(fixture.color_obs(s, d)).filter("match_id % 2 = 0")


def hsv_median(s, d):
    return op.hsv_median(_samples(s, d)).select(*TRACK, *[F.round(c, 4).alias(c) for c in ("h", "s", "v")])


def _clusters(s, d):
    medians = op.hsv_median(_samples(s, d))
    return medians, op.cluster_teams(op.hue_features(medians))


def cluster_teams(s, d):
    return _clusters(s, d)[1]


def cluster_label(s, d):
    medians, clusters = _clusters(s, d)
    return op.cluster_labels(clusters, medians)


def _members(s, d):
    named = identity.majority(fixture.reads(s, d), "number", TRACK).select(*TRACK, "number")
    return _clusters(s, d)[1].join(named, TRACK).join(_players(s, d).select("match_id", "number", "color"), ["match_id", "number"]).select("match_id", "cluster", "number", "color")


def cluster_name(s, d):
    return op.cluster_names(_members(s, d))


def primary_kits(s, d):
    return op.primary_kits(_players(s, d).withColumn("kit", l.team_color(F.col("color"))), _kits(s, d)).select("match_id", "a", "b", "kinds")


def assign_teams(s, d):
    return op.assign_teams(_players(s, d), _kits(s, d))


def tracks_inherit(s, d):
    return op.tracks_inherit(op.assign_teams(_players(s, d), _kits(s, d)), identity.majority(fixture.reads(s, d), "number", TRACK))


def tracks_by_color(s, d):
    """Three in four of the tracks with a number have their team by it; the others, and those without one, by colour."""
    players, colors = _players(s, d), fixture.color_obs(s, d)
    kits = _kits(s, d)
    bound = op.tracks_inherit(op.assign_teams(players, kits), identity.majority(fixture.reads(s, d), "number", TRACK)).filter("track_id % 4 <> 0")
    worn = identity.majority(colors.filter("color <> 'Unknown'"), "color", TRACK)
    return op.teams_by_color(worn, op.primary_kits(players.withColumn("kit", l.team_color(F.col("color"))), kits), bound)


def id_remap(s, d):
    locks = identity.tier_lock(fixture.reads(s, d))
    return op.id_remap(fixture.color_obs(s, d).groupBy(*TRACK).agg(F.count("*").alias("seen")), locks)


def jersey_consolidate(s, d):
    named = identity.majority(fixture.reads(s, d), "number", TRACK)
    worn = named.join(identity.majority(fixture.color_obs(s, d), "color", TRACK).select(*TRACK, F.col("color").alias("team")), TRACK)
    valid = identity.kit_discovery(fixture.color_obs(s, d)).select("match_id", F.col("color").alias("team"))
    return op.consolidate(worn.select("match_id", "number", "team", F.col("samples").alias("weight")), valid)


def legacy_top2_teams(s, d):
    return op.largest_two(_players(s, d))


QUERIES = {f.__name__: f for f in (hsv_median, cluster_teams, cluster_label, cluster_name, primary_kits, assign_teams, tracks_inherit, tracks_by_color, id_remap, jersey_consolidate, legacy_top2_teams)}

_TIER = "CASE WHEN confidence >= 0.8 THEN 3 WHEN confidence >= 0.5 THEN 2 ELSE 1 END"
_TEAM = "CASE lower(color) " + " ".join(f"WHEN '{a}' THEN '{b.capitalize()}'" for a, b in l.TEAM_MERGE.items()) + " ELSE upper(color[1]) || lower(color)[2:] END"
_VS = "CASE top " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in l.OPPONENT.items()) + " ELSE 'TeamB' END"
_REF = "CASE lower({c}) " + " ".join(f"WHEN '{a}' THEN {h}" for a, h in l.REFERENCE_HUES.items()) + " END"
_D = "round((f[1]-{c}[1])*(f[1]-{c}[1]) + (f[2]-{c}[2])*(f[2]-{c}[2]) + (f[3]-{c}[3])*(f[3]-{c}[3]) + (f[4]-{c}[4])*(f[4]-{c}[4]), 9)"
_MEAN = "[" + ", ".join("avg(CASE WHEN {w} THEN " + f"f[{i}] END)" for i in (1, 2, 3, 4)) + "]"
_SIDE = f"CASE WHEN {_D.format(c='b')} < {_D.format(c='a')} THEN 1 ELSE 0 END"
_BASIC = "CASE " + " ".join(f"WHEN h < {a} THEN '{n}'" for a, n in l.BASIC_HUES) + " ELSE 'red' END"

_CLUSTER = {
    "medians": f"SELECT match_id, track_id, median(h) AS h, median(s) AS s, median(v) AS v FROM (SELECT match_id, track_id, {_H} AS h, {_S} AS s, {_V} AS v FROM color_obs WHERE cls = 2) t GROUP BY match_id, track_id",
    "points": f"SELECT *, [cos(h * {math.pi / 90}), sin(h * {math.pi / 90}), s, v] AS f FROM medians",
    "means": f"SELECT match_id, {_MEAN.format(w='TRUE')} AS m FROM points GROUP BY match_id",
    "seed_a": f"SELECT p.match_id, arg_max(f, struct_pack(d := {_D.format(c='m')}, t := -track_id)) AS a FROM points p JOIN means m ON m.match_id = p.match_id GROUP BY p.match_id",
    "center0": f"SELECT p.match_id, any_value(a) AS a, arg_max(f, struct_pack(d := {_D.format(c='a')}, t := -track_id)) AS b FROM points p JOIN seed_a s ON s.match_id = p.match_id GROUP BY p.match_id",
}
_ROUND = lambda w: "list_transform(" + _MEAN.format(w=w) + ", lambda x: round(x, 9))"
# rounds until the centres stand, however many
_CLUSTER["walk"] = f"SELECT match_id, a, b, FALSE AS stands FROM center0 UNION ALL SELECT match_id, na, nb, na = a AND nb = b FROM (SELECT match_id, any_value(a) AS a, any_value(b) AS b, CASE WHEN count(*) FILTER (WHERE c = 0) > 0 THEN {_ROUND('c = 0')} ELSE any_value(a) END AS na, CASE WHEN count(*) FILTER (WHERE c = 1) > 0 THEN {_ROUND('c = 1')} ELSE any_value(b) END AS nb FROM (SELECT p.match_id, f, a, b, {_SIDE} AS c FROM points p JOIN walk q ON q.match_id = p.match_id WHERE NOT q.stands) t GROUP BY match_id) t"
_CLUSTER["final"] = "SELECT match_id, a, b FROM walk WHERE stands"
_CLUSTER["clusters"] = f"SELECT match_id, track_id, CASE WHEN 2 * sum(c) OVER (PARTITION BY match_id) > count(*) OVER (PARTITION BY match_id) THEN 1 - c ELSE c END AS cluster FROM (SELECT p.match_id, track_id, {_SIDE} AS c FROM points p JOIN final q ON q.match_id = p.match_id) t"

_PLAYERS = {
    "named": _MAJ.format(v="number", t="reads"),
    "first_seen": "SELECT match_id, track_id, arg_min(color, frame_idx) AS color, min(cls) AS cls FROM color_obs GROUP BY match_id, track_id",
    "players": f"SELECT match_id, number, {_KIT} AS color, cls, observations FROM (SELECT n.match_id, n.number, f.color, f.cls, n.samples AS observations, row_number() OVER (PARTITION BY n.match_id, n.number ORDER BY n.samples DESC, n.track_id) AS rn FROM named n JOIN first_seen f ON f.match_id = n.match_id AND f.track_id = n.track_id) t WHERE rn = 1",
}
_KITS = {
    "kit_ranked": "SELECT *, row_number() OVER (PARTITION BY match_id, cls ORDER BY n DESC, color) AS k FROM (SELECT match_id, cls, color, count(*) AS n FROM color_obs WHERE color <> 'Unknown' GROUP BY match_id, cls, color) t",
    "kits": "SELECT match_id, color, place FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY n DESC, color) AS place FROM kit_ranked r WHERE cls = 2 AND k <= 4 AND NOT EXISTS (SELECT 1 FROM kit_ranked f WHERE f.cls = 3 AND f.k = 1 AND f.match_id = r.match_id AND f.color = r.color AND NOT EXISTS (SELECT 1 FROM kit_ranked g WHERE g.cls = 1 AND g.k <= 2 AND g.match_id = f.match_id AND g.color = f.color))) t WHERE place <= 2",
}
_PRIMARY = _PLAYERS | _KITS | {
    "worn": f"SELECT *, {_TEAM} AS kit FROM players",
    "kit_counts": "SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY n DESC, kit) AS k FROM (SELECT match_id, kit, count(*) AS n FROM worn WHERE cls <> 1 AND kit <> 'Unknown' GROUP BY match_id, kit) t",
    "kit_pairs": f"SELECT match_id, max(CASE WHEN place = 1 THEN {_TEAM} END) AS k1, max(CASE WHEN place = 2 THEN {_TEAM} END) AS k2 FROM kits WHERE match_id % 2 = 0 GROUP BY match_id",
    "pairs_": f"SELECT match_id, CASE WHEN guided AND on1 THEN k1 WHEN guided THEN k2 ELSE top END AS a, CASE WHEN guided AND on1 THEN k2 WHEN guided THEN k1 ELSE coalesce(second_, {_VS}) END AS b, kinds FROM (SELECT *, k1 IS NOT NULL AND k2 IS NOT NULL AND (on1 OR on2) AND kinds >= 2 AS guided FROM (SELECT c.*, k1, k2, coalesce(list_contains(worn_, k1), FALSE) AS on1, coalesce(list_contains(worn_, k2), FALSE) AS on2 FROM (SELECT match_id, count(*) AS kinds, list(kit) AS worn_, max(CASE WHEN k = 1 THEN kit END) AS top, max(CASE WHEN k = 2 THEN kit END) AS second_ FROM kit_counts GROUP BY match_id) c LEFT JOIN kit_pairs q ON q.match_id = c.match_id) t) t",
}
_GAP = "coalesce(least(abs(hk-{x}), 180-abs(hk-{x})), 180)"
_ASSIGN = _PRIMARY | {
    "sizes": "SELECT w.match_id, any_value(a) AS a, any_value(b) AS b, any_value(kinds) AS kinds, count(*) FILTER (WHERE cls <> 1 AND kit = a) AS sa, count(*) FILTER (WHERE cls <> 1 AND kit = b) AS sb, avg(CASE WHEN cls <> 1 AND kit = a THEN number END) AS ma, avg(CASE WHEN cls <> 1 AND kit = b THEN number END) AS mb FROM worn w JOIN pairs_ q ON q.match_id = w.match_id GROUP BY w.match_id",
    "hues": f"SELECT w.*, a, b, kinds, sa, sb, ma, mb, {_REF.format(c='kit')} AS hk, {_REF.format(c='a')} AS ha, {_REF.format(c='b')} AS hb, CASE WHEN abs(number - coalesce(ma, 15)) < abs(number - coalesce(mb, 25)) THEN a ELSE b END AS nearer FROM worn w LEFT JOIN sizes z ON z.match_id = w.match_id",
    "placed_first": f"SELECT *, CASE WHEN cls = 1 THEN CASE WHEN kinds = 1 THEN CASE WHEN abs(number - ma) < 10 THEN a ELSE b END WHEN sa > 0 AND sb > 0 THEN nearer END WHEN kit = 'Unknown' THEN CASE WHEN kinds = 1 THEN b WHEN sa > 0 AND sb > 0 THEN nearer WHEN sa > 0 THEN b WHEN sb > 0 THEN a END WHEN kit = b THEN b WHEN kit = a OR kinds = 1 THEN a WHEN ha IS NULL AND hb IS NOT NULL THEN CASE WHEN hk IS NOT NULL AND {_GAP.format(x='hb')} > 30 THEN a ELSE b END WHEN hb IS NULL AND ha IS NOT NULL THEN CASE WHEN hk IS NOT NULL AND {_GAP.format(x='ha')} > 30 THEN b ELSE a END WHEN {_GAP.format(x='ha')} = {_GAP.format(x='hb')} THEN CASE WHEN sa > sb THEN b ELSE a END WHEN {_GAP.format(x='ha')} < {_GAP.format(x='hb')} THEN a ELSE b END AS first_, greatest(sa, sb) AS big, least(sa, sb) AS small FROM hues",
    "queue": "SELECT match_id, number, big, small, row_number() OVER (PARTITION BY match_id ORDER BY observations, number) AS i, count(*) FILTER (WHERE number <> 1) OVER (PARTITION BY match_id ORDER BY observations, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS moved FROM placed_first WHERE cls <> 1 AND kinds > 1 AND kit = CASE WHEN sa > sb THEN a ELSE b END AND small > 0 AND big > 2 * small",
    "marked": "SELECT *, big - i + 1 - small - moved > 2 AS goes_on, number <> 1 AND greatest(big - i, small + moved + 1) <= 1.5 * greatest(1, least(big - i, small + moved + 1)) AS ends FROM queue",
    "movers": "SELECT * FROM (SELECT *, coalesce(max(CASE WHEN NOT goes_on OR ends THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM marked) t WHERE goes_on AND stopped = 0 AND number <> 1",
    "assigned": "SELECT p.match_id, p.number, kit, CASE WHEN m.number IS NOT NULL THEN CASE WHEN sa > sb THEN b ELSE a END ELSE first_ END AS team FROM placed_first p LEFT JOIN movers m ON m.match_id = p.match_id AND m.number = p.number",
}
_BY_COLOR = _ASSIGN | {
    "shirt": "SELECT match_id, track_id, color FROM (" + _MAJ.format(v="color", t="(SELECT * FROM color_obs WHERE color <> 'Unknown')") + ") t",
    "given": "SELECT n.match_id, n.track_id FROM named n JOIN assigned g ON g.match_id = n.match_id AND g.number = n.number WHERE n.track_id % 4 <> 0",
    "tinted": f"SELECT w.*, {_TEAM} AS kit, a, b, {_REF.format(c='color')} AS hk, {_REF.format(c='a')} AS ha, {_REF.format(c='b')} AS hb FROM shirt w JOIN pairs_ q ON q.match_id = w.match_id WHERE NOT EXISTS (SELECT 1 FROM given g WHERE g.match_id = w.match_id AND g.track_id = w.track_id)",
}
_LOCK = {"tiers": f"SELECT *, max(own) OVER (PARTITION BY match_id, track_id ORDER BY frame_idx) AS most FROM (SELECT *, sum({_TIER}) OVER (PARTITION BY match_id, track_id, number ORDER BY frame_idx) AS own FROM reads) t", "tlock": "SELECT match_id, track_id, arg_min(number, frame_idx) AS number FROM tiers WHERE own >= 6 AND own >= most GROUP BY match_id, track_id"}
ORACLE = {
    "tracks_by_color": sql(f"SELECT match_id, track_id, color, CASE WHEN kit = a THEN a WHEN kit = b THEN b WHEN ha IS NULL AND hb IS NOT NULL THEN CASE WHEN hk IS NOT NULL AND {_GAP.format(x='hb')} > 30 THEN a ELSE b END WHEN hb IS NULL AND ha IS NOT NULL THEN CASE WHEN hk IS NOT NULL AND {_GAP.format(x='ha')} > 30 THEN b ELSE a END WHEN {_GAP.format(x='ha')} <= {_GAP.format(x='hb')} THEN a ELSE b END AS team FROM tinted", _BY_COLOR),
    "hsv_median": sql("SELECT match_id, track_id, round(h, 4) AS h, round(s, 4) AS s, round(v, 4) AS v FROM medians", _CLUSTER),
    "cluster_teams": sql("SELECT match_id, track_id, CAST(cluster AS INT) AS cluster FROM clusters", _CLUSTER),
    "cluster_label": sql(f"SELECT match_id, CAST(cluster AS INT) AS cluster, members, CASE WHEN low_s < 0.25 AND v > 0.7 THEN 'white' WHEN s < 0.25 THEN CASE WHEN v > 0.75 THEN 'white' WHEN v < 0.35 THEN 'black' ELSE 'gray' END WHEN v > 0.8 THEN 'light_' || {_BASIC} WHEN v < 0.35 THEN 'dark_' || {_BASIC} ELSE {_BASIC} END AS label FROM (SELECT c.match_id, c.cluster, count(*) AS members, median(h) AS h, median(s) AS s, median(v) AS v, quantile_cont(s, 0.1) AS low_s FROM clusters c JOIN medians m ON m.match_id = c.match_id AND m.track_id = c.track_id GROUP BY c.match_id, c.cluster) t", _CLUSTER),
    "cluster_name": sql("SELECT match_id, CAST(cluster AS INT) AS cluster, CASE WHEN count(*) OVER (PARTITION BY match_id, name) > 1 THEN name || CASE WHEN cluster = 0 THEN '_A' ELSE '_B' END ELSE name END AS name FROM (SELECT match_id, cluster, coalesce(arg_min(color, struct_pack(n := -n, c := color)) FILTER (WHERE color <> 'Unknown'), 'Team' || cluster) AS name FROM (SELECT c.match_id, c.cluster, p.color, count(*) AS n FROM clusters c JOIN named m ON m.match_id = c.match_id AND m.track_id = c.track_id JOIN players p ON p.match_id = m.match_id AND p.number = m.number GROUP BY c.match_id, c.cluster, p.color) t GROUP BY match_id, cluster) t", _CLUSTER | _PLAYERS),
    "primary_kits": sql("SELECT match_id, a, b, kinds FROM pairs_", _PRIMARY),
    "assign_teams": sql("SELECT match_id, number, kit, team FROM assigned", _ASSIGN),
    "tracks_inherit": sql("SELECT n.match_id, n.track_id, n.number, a.team FROM named n JOIN assigned a ON a.match_id = n.match_id AND a.number = n.number", _ASSIGN),
    "id_remap": sql("SELECT o.match_id, o.track_id, count(*) AS seen, coalesce(any_value(k.number), o.track_id) AS who FROM color_obs o LEFT JOIN tlock k ON k.match_id = o.match_id AND k.track_id = o.track_id GROUP BY o.match_id, o.track_id", _LOCK),
    "jersey_consolidate": sql("SELECT match_id, number, coalesce(arg_min(team, struct_pack(w := -w, t := team)) FILTER (WHERE ok), 'Unknown') AS team, CAST(sum(w) AS BIGINT) AS weight, CAST(sum(n) AS BIGINT) AS fragments FROM (SELECT m.match_id, m.number, c.color AS team, sum(m.samples) AS w, count(*) AS n, max(CASE WHEN k.color IS NOT NULL THEN 1 ELSE 0 END) = 1 AS ok FROM named m JOIN majority_colors c ON c.match_id = m.match_id AND c.track_id = m.track_id LEFT JOIN kits k ON k.match_id = m.match_id AND k.color = c.color GROUP BY m.match_id, m.number, c.color) t GROUP BY match_id, number", _PLAYERS | _KITS | {"majority_colors": _MAJ.format(v="color", t="color_obs")}),
    "legacy_top2_teams": sql("SELECT p.match_id, p.number, p.color, CAST(c.place AS INT) AS place FROM players p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY n DESC, color) AS place FROM (SELECT match_id, color, count(*) AS n FROM players GROUP BY match_id, color) t) c ON c.match_id = p.match_id AND c.color = p.color AND c.place <= 2", _PLAYERS),
}
