"""Queries on jersey numbers, kits and rosters."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchflow.operators import identity as op
from pitchflow.plans import fixture
from pitchflow.plans.fixture import debounced, sql

TRACK = ["match_id", "track_id"]
#: Numbers 10 to 20 belong to Red and 19 to 29 to White; 15 and 25 are left off.
ROSTER = [("Red", n) for n in range(10, 21) if n != 15] + [("White", n) for n in range(19, 30) if n != 25]


def _roster(s):
    return s.createDataFrame(ROSTER, "team string, number int")


def majority_vote(s, d):
    return op.majority(fixture.reads(s, d), "number", TRACK)


def majority_color(s, d):
    return op.majority(fixture.color_obs(s, d).filter("color <> 'Unknown'"), "color", TRACK)


def vote_scores(s, d):
    return op.scores(fixture.reads(s, d)).select(*TRACK, "number", F.round("score", 4).alias("score"), "tally", "place", F.round("second", 4).alias("second"))


def weighted_vote(s, d):
    return op.weighted_vote(fixture.reads(s, d)).select(*TRACK, "number", F.round("share", 4).alias("share"))


def vote_recovery(s, d):
    return op.vote_recovery(fixture.reads(s, d))


def first_lock(s, d):
    return op.first_lock(fixture.reads(s, d))


def dirichlet_lock(s, d):
    return op.dirichlet_lock(fixture.reads(s, d))


def tier_lock(s, d):
    return op.tier_lock(fixture.reads(s, d))


def finalize_bindings(s, d):
    reads = fixture.reads(s, d)
    locks = op.tier_lock(reads)
    return op.finalize_bindings(reads, locks, locks).select(*TRACK, "number", F.round("score", 4).alias("score"))


def rolling_vote(s, d):
    return op.rolling_vote(fixture.reads(s, d)).select(*TRACK, "frame_idx", "number", F.round("share", 4).alias("share"))


def run_of_three(s, d):
    return op.run_of_three(fixture.reads(s, d))


def lock_changes(s, d):
    return op.lock_changes(fixture.reads(s, d))


def merge_conflicts(s, d):
    return op.merge_conflicts(fixture.reads(s, d), floor=0.6)


def first_reader(s, d):
    return op.first_reader(fixture.reads(s, d), fixture.color_obs(s, d))


def raw_read_recovery(s, d):
    reads = fixture.reads(s, d)
    return op.raw_read_recovery(reads, op.tier_lock(reads))


def track_to_jersey(s, d):
    reads = fixture.reads(s, d)
    return op.track_to_jersey(reads)


def _mapped(s, d):
    return op.majority(fixture.reads(s, d), "number", TRACK).select(*TRACK, "number").join(fixture.teams(s, d), TRACK)


def roster_snap(s, d):
    numbers = fixture.reads(s, d).select(*TRACK, "number").distinct().join(fixture.teams(s, d), TRACK)
    return op.roster_snap(numbers, _roster(s))


def roster_reconcile(s, d):
    return op.roster_reconcile(_mapped(s, d), fixture.reads(s, d), _roster(s))


def color_settle_lock(s, d):
    return op.color_settle(fixture.color_obs(s, d))


def kit_discovery(s, d):
    return op.kit_discovery(fixture.color_obs(s, d))


def team_colors_top2(s, d):
    return op.team_colors(fixture.color_obs(s, d))


def cadence_throttle(s, d):
    return op.throttle(fixture.color_obs(s, d), 25)


def every_nth_capped(s, d):
    return op.every_nth(fixture.detections(s, d).filter("track_id is not null")).select(*TRACK, "frame_idx", "k")


def best_crop(s, d):
    boxes = fixture.detections(s, d).filter("track_id is not null")
    return boxes.groupBy(*TRACK).agg(F.max_by("frame_idx", F.struct(((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("a"), F.col("conf"), -F.col("frame_idx"))).alias("frame_idx"))


def _rated(s, d):
    return op.majority(fixture.reads(s, d), "number", TRACK).join(fixture.teams(s, d), TRACK)


def unique_team_jersey(s, d):
    return op.unique_per_team(_rated(s, d), F.desc("votes"), F.desc("samples"), F.col("track_id")).select(*TRACK, "team", "number", "votes")


def revoke_lower_conf(s, d):
    return op.revoke_lower(_rated(s, d), F.desc("votes"), F.col("track_id")).select(*TRACK, "team", "number")


def collision_winner(s, d):
    active = fixture.detections(s, d).filter("cls in (1, 2)").select("match_id", "frame_idx", "track_id")
    named = op.majority(fixture.reads(s, d), "number", TRACK).select(*TRACK, "number", (F.col("votes") >= 20).alias("locked"))
    return op.collisions(active.hint("merge").join(named, TRACK))


def first_seen_registry(s, d):
    return op.first_seen_registry(fixture.reads(s, d), fixture.teams(s, d))


def resolve_root(s, d):
    edges = fixture.teams(s, d).selectExpr("match_id", "track_id as child", "track_id - 1 as parent")
    known = fixture.teams(s, d).selectExpr("match_id", "track_id as parent")
    return op.resolve_roots(edges.join(known, ["match_id", "parent"], "left_semi").select("match_id", "child", "parent"))


QUERIES = {f.__name__: f for f in (majority_vote, majority_color, vote_scores, weighted_vote, vote_recovery, first_lock, dirichlet_lock, tier_lock, finalize_bindings, rolling_vote, run_of_three, lock_changes, merge_conflicts, first_reader, raw_read_recovery, track_to_jersey, roster_snap, roster_reconcile, color_settle_lock, kit_discovery, team_colors_top2, cadence_throttle, every_nth_capped, best_crop, unique_team_jersey, revoke_lower_conf, collision_winner, first_seen_registry, resolve_root)}

_MAJ = "SELECT match_id, track_id, {v}, votes, CAST(samples AS BIGINT) AS samples FROM (SELECT *, sum(votes) OVER (PARTITION BY match_id, track_id) AS samples, row_number() OVER (PARTITION BY match_id, track_id ORDER BY votes DESC, seen, {v}) AS rn FROM (SELECT match_id, track_id, {v}, count(*) AS votes, min(frame_idx) AS seen FROM {t} GROUP BY match_id, track_id, {v}) t) t WHERE rn = 1"
_S = {"scored_": "SELECT *, row_number() OVER w AS place, coalesce(lead(score) OVER w, 0) AS second FROM (SELECT match_id, track_id, number, round(sum(confidence), 6) AS score, count(*) AS tally FROM reads WHERE confidence >= 0.4 GROUP BY match_id, track_id, number) t WINDOW w AS (PARTITION BY match_id, track_id ORDER BY score DESC, CAST(number AS VARCHAR) DESC)"}
_TIER = "CASE WHEN confidence >= 0.8 THEN 3 WHEN confidence >= 0.5 THEN 2 ELSE 1 END"
_T = {"tiers": f"SELECT *, max(own) OVER (PARTITION BY match_id, track_id ORDER BY frame_idx) AS most FROM (SELECT *, sum({_TIER}) OVER (PARTITION BY match_id, track_id, number ORDER BY frame_idx) AS own FROM reads) t", "tlock": "SELECT match_id, track_id, arg_min(number, frame_idx) AS number, min(frame_idx) AS frame_idx FROM tiers WHERE own >= 6 AND own >= most GROUP BY match_id, track_id"}
_V = _S | {"voted": "SELECT match_id, track_id, number FROM scored_ WHERE place = 1 AND tally >= 2 AND score - second >= 0.3 AND score >= 0.5"}
_RAW = "SELECT match_id, arg_min(track_id, struct_pack(a := -n, b := track_id)) AS track_id, number, CAST(sum(n) AS BIGINT) AS reads FROM (SELECT match_id, number, track_id, count(*) AS n FROM reads GROUP BY match_id, number, track_id) t WHERE NOT EXISTS (SELECT 1 FROM {f} f WHERE f.match_id = t.match_id AND f.number = t.number) GROUP BY match_id, number HAVING sum(n) >= 20"
_PAIRS = "[" + ", ".join(f"'{q}'" for p in ("17", "38", "39", "89", "08", "06", "68", "56", "59", "27", "49", "58") for q in (p, p[::-1])) + "]"
_MIS = "(len({a}) = len({b}) AND ((len({a}) = 1 AND list_contains(" + _PAIRS + ", {a} || {b})) OR (len({a}) = 2 AND (({a}[1] <> {b}[1] AND {a}[2] = {b}[2] AND list_contains(" + _PAIRS + ", {a}[1] || {b}[1])) OR ({a}[1] = {b}[1] AND {a}[2] <> {b}[2] AND list_contains(" + _PAIRS + ", {a}[2] || {b}[2])))))) "
_ROSTER = "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {n})" for t, n in ROSTER) + ") r(team, number)"
_AS = "CAST({x} AS VARCHAR)"
_RATED = {"rated": "SELECT m.*, t.team FROM (" + _MAJ.format(v="number", t="reads") + ") m JOIN teams t USING (match_id, track_id)"}
ORACLE = {
    "majority_vote": sql(_MAJ.format(v="number", t="reads")),
    "majority_color": sql(_MAJ.format(v="color", t="(SELECT * FROM color_obs WHERE color <> 'Unknown')")),
    "vote_scores": sql("SELECT match_id, track_id, number, round(score, 4) AS score, tally, CAST(place AS INT) AS place, round(second, 4) AS second FROM scored_", _S),
    "weighted_vote": sql(f"SELECT match_id, track_id, number, round(w / total, 4) AS share FROM (SELECT *, sum(w) OVER (PARTITION BY match_id, track_id) AS total, row_number() OVER (PARTITION BY match_id, track_id ORDER BY w DESC, number) AS rn FROM (SELECT match_id, track_id, number, sum({_TIER}) AS w FROM reads GROUP BY match_id, track_id, number) t) t WHERE rn = 1"),
    "vote_recovery": sql("SELECT * FROM voted", _V),
    "first_lock": sql("SELECT match_id, track_id, arg_min(number, frame_idx) AS number, min(frame_idx) AS frame_idx FROM reads WHERE confidence >= 0.15 GROUP BY match_id, track_id"),
    "dirichlet_lock": sql("SELECT match_id, track_id, arg_min(number, frame_idx) AS number, min(frame_idx) AS frame_idx FROM (SELECT r.*, (SELECT count(DISTINCT number) FROM reads q WHERE q.match_id = r.match_id AND q.track_id = r.track_id AND q.frame_idx <= r.frame_idx) AS numbers FROM (SELECT *, sum(confidence) OVER (PARTITION BY match_id, track_id, number ORDER BY frame_idx) AS score, sum(confidence) OVER (PARTITION BY match_id, track_id ORDER BY frame_idx) AS total FROM reads) r) t WHERE score > 2.5 AND (score + 1) / (total + numbers) > 0.7 GROUP BY match_id, track_id"),
    "tier_lock": sql("SELECT * FROM tlock", _T),
    "finalize_bindings": sql("SELECT match_id, track_id, number, round(score, 4) AS score FROM scored_ s WHERE place = 1 AND NOT EXISTS (SELECT 1 FROM tlock k WHERE k.match_id = s.match_id AND k.track_id = s.track_id) AND (score > 1 OR (score > 0.5 AND EXISTS (SELECT 1 FROM tlock k WHERE k.match_id = s.match_id AND k.number = s.number)))", _S | _T),
    "rolling_vote": sql("SELECT match_id, track_id, frame_idx, number, round(len(list_filter(l, lambda x: x = number)) / len(l), 4) AS share FROM (SELECT *, list(number) OVER (PARTITION BY match_id, track_id ORDER BY frame_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l FROM reads) t"),
    "run_of_three": sql("SELECT *, number IN (11, 19, 29) OR confidence < 0.8 AS review FROM (SELECT match_id, track_id, coalesce(steady, latest) AS number, CASE WHEN steady IS NOT NULL THEN 0.99e0 ELSE confidence END AS confidence FROM (SELECT match_id, track_id, arg_min(number, frame_idx) FILTER (WHERE third) AS steady, arg_max(number, frame_idx) AS latest, arg_max(confidence, frame_idx) AS confidence FROM (SELECT *, lag(number) OVER w = number AND lag(number, 2) OVER w = number AS third FROM reads WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame_idx)) t GROUP BY match_id, track_id) t) t"),
    "lock_changes": sql("SELECT match_id, track_id, CAST(coalesce(sum(c), 0) AS BIGINT) AS changes FROM (SELECT *, CASE WHEN lag(number) OVER (PARTITION BY match_id, track_id ORDER BY frame_idx) <> number THEN 1 ELSE 0 END AS c FROM reads) t GROUP BY match_id, track_id"),
    "merge_conflicts": sql("SELECT match_id, track_id, count(*) AS numbers, CAST(sum(n) AS BIGINT) AS reads FROM (SELECT match_id, track_id, number, count(*) AS n FROM reads WHERE confidence > 0.6 GROUP BY match_id, track_id, number HAVING count(*) >= 3) t GROUP BY match_id, track_id HAVING count(*) >= 2"),
    "first_reader": sql("SELECT f.*, (SELECT arg_max(color, c.frame_idx) FROM color_obs c WHERE c.match_id = f.match_id AND c.track_id = f.track_id AND c.frame_idx <= f.frame_idx) AS color FROM (SELECT match_id, number, frame_idx, track_id FROM (SELECT *, row_number() OVER (PARTITION BY match_id, number ORDER BY frame_idx, track_id) AS rn FROM reads) t WHERE rn = 1) f"),
    "raw_read_recovery": sql(_RAW.format(f="tlock"), _T),
    "track_to_jersey": sql("SELECT match_id, track_id, arg_min(number, struct_pack(a := source, b := number)) AS number, min(source) AS source FROM (SELECT match_id, track_id, number, 1 AS source FROM tlock UNION ALL SELECT match_id, track_id, number, 2 FROM registered UNION ALL SELECT match_id, track_id, number, 3 FROM voted UNION ALL SELECT match_id, track_id, number, 4 FROM rawrec) t GROUP BY match_id, track_id", _T | _V | {"registered": "SELECT match_id, number, arg_min(track_id, struct_pack(a := frame_idx, b := track_id)) AS track_id FROM reads WHERE confidence >= 0.5 GROUP BY match_id, number", "held": "SELECT match_id, number FROM tlock UNION SELECT match_id, number FROM registered UNION SELECT match_id, number FROM voted", "rawrec": _RAW.format(f="held")}),
    "roster_snap": sql(f"SELECT match_id, track_id, team, number, CASE WHEN on_ THEN number ELSE coalesce(r, number) END AS mapped, CASE WHEN on_ THEN 'on_roster' WHEN r IS NOT NULL THEN 'snapped' ELSE 'off_roster' END AS status FROM (SELECT n.*, EXISTS (SELECT 1 FROM roster q WHERE q.number = n.number) AS on_, (SELECT arg_min(q.number, struct_pack(a := CASE WHEN q.team <> n.team THEN 1 ELSE 0 END, b := abs(q.number - n.number), c := q.number)) FROM roster q WHERE {_MIS.format(a=_AS.format(x='n.number'), b=_AS.format(x='q.number'))}) AS r FROM (SELECT DISTINCT match_id, track_id, number, team FROM reads JOIN teams USING (match_id, track_id)) n) t", {"roster": _ROSTER}),
    "roster_reconcile": sql(f"SELECT match_id, track_id, number FROM rated WHERE number IN (SELECT number FROM roster) UNION ALL SELECT match_id, track_id, arg_min(r, struct_pack(a := -s, b := r)) AS number FROM (SELECT m.match_id, m.track_id, q.number AS r, sum(CASE WHEN c.number = q.number THEN c.n WHEN {_MIS.format(a=_AS.format(x='c.number'), b=_AS.format(x='q.number'))} THEN 0.5e0 * c.n ELSE 0 END) AS s FROM rated m JOIN (SELECT match_id, track_id, number, count(*) AS n FROM reads GROUP BY match_id, track_id, number) c USING (match_id, track_id) JOIN roster q ON q.team = m.team WHERE m.number NOT IN (SELECT number FROM roster) GROUP BY m.match_id, m.track_id, q.number) t WHERE s >= 1 GROUP BY match_id, track_id", {"roster": _ROSTER} | _RATED),
    "color_settle_lock": sql("SELECT match_id, track_id, arg_max(color, k) AS color FROM (SELECT *, row_number() OVER (PARTITION BY match_id, track_id ORDER BY frame_idx) AS k FROM color_obs WHERE cls <> 3 AND color <> 'Unknown') t WHERE k = 1 OR (k = 10 AND cls <> 1) GROUP BY match_id, track_id"),
    "kit_discovery": sql("SELECT match_id, color, n, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY n DESC, color) AS place FROM ranked r WHERE cls = 2 AND k <= 4 AND NOT EXISTS (SELECT 1 FROM ranked f WHERE f.cls = 3 AND f.k = 1 AND f.match_id = r.match_id AND f.color = r.color AND NOT EXISTS (SELECT 1 FROM ranked g WHERE g.cls = 1 AND g.k <= 2 AND g.match_id = f.match_id AND g.color = f.color))) t WHERE place <= 2", {"ranked": "SELECT *, row_number() OVER (PARTITION BY match_id, cls ORDER BY n DESC, color) AS k FROM (SELECT match_id, cls, color, count(*) AS n FROM color_obs WHERE color <> 'Unknown' GROUP BY match_id, cls, color) t"}),
    "team_colors_top2": sql("SELECT match_id, color, n, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY n DESC, color DESC) AS place FROM (SELECT match_id, color, count(*) AS n FROM color_obs WHERE color NOT IN ('Unknown', 'Gray') GROUP BY match_id, color) t) t WHERE place <= 2"),
    "cadence_throttle": sql("SELECT match_id, track_id, frame_idx FROM paced", debounced("paced", "color_obs", "match_id, track_id", 25, strict=False)),
    "every_nth_capped": sql("SELECT match_id, track_id, frame_idx, CAST(k AS INT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY match_id, track_id ORDER BY frame_idx) AS k FROM boxes) t WHERE k % 30 = 1 AND k <= 300"),
    "best_crop": sql("SELECT match_id, track_id, frame_idx FROM (SELECT *, row_number() OVER (PARTITION BY match_id, track_id ORDER BY (x2-x1)*(y2-y1) DESC, conf DESC, frame_idx) AS rn FROM detections WHERE track_id IS NOT NULL) t WHERE rn = 1"),
    "unique_team_jersey": sql("SELECT match_id, track_id, team, number, votes FROM (SELECT *, row_number() OVER (PARTITION BY match_id, team, number ORDER BY votes DESC, samples DESC, track_id) AS rn2 FROM rated) t WHERE rn2 = 1", _RATED),
    "revoke_lower_conf": sql("SELECT match_id, track_id, team, CASE WHEN row_number() OVER (PARTITION BY match_id, team, number ORDER BY votes DESC, track_id) = 1 THEN number END AS number FROM rated", _RATED),
    "collision_winner": sql("SELECT match_id, track_id, count(*) AS frames FROM (SELECT d.match_id, d.track_id, row_number() OVER (PARTITION BY d.match_id, d.frame_idx, r.number ORDER BY CASE WHEN r.votes >= 20 THEN 0 ELSE 1 END, d.track_id) AS rn FROM detections d JOIN rated r ON r.match_id = d.match_id AND r.track_id = d.track_id WHERE d.cls IN (1,2)) t WHERE rn > 1 GROUP BY match_id, track_id", _RATED),
    "first_seen_registry": sql("SELECT match_id, track_id, team, number, first_value(track_id) OVER (PARTITION BY match_id, team, number ORDER BY frame_idx, track_id) AS root FROM (SELECT match_id, track_id, arg_min(number, frame_idx) AS number, min(frame_idx) AS frame_idx FROM reads WHERE confidence >= 0.5 GROUP BY match_id, track_id) f JOIN teams USING (match_id, track_id)"),
    "resolve_root": sql("SELECT match_id, child, min(root) AS root FROM walk GROUP BY match_id, child", {"walk": "SELECT t.match_id, t.track_id AS child, p.track_id AS root FROM teams t JOIN teams p ON p.match_id = t.match_id AND p.track_id = t.track_id - 1 UNION ALL SELECT w.match_id, w.child, p.track_id FROM walk w JOIN teams p ON p.match_id = w.match_id AND p.track_id = w.root - 1"}),
}
