"""Queries on clean tracks, gates, running statistics and output filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchflow.functions import geometry as g
from pitchflow.functions import labels as l
from pitchflow.functions import palette
from pitchflow.operators import hygiene as op
from pitchflow.operators import identity, votes
from pitchflow.plans import fixture
from pitchflow.plans import report
from pitchflow.plans.fixture import sql
from pitchflow.plans.identity import _MAJ, _S, _T

TRACK, FRAME = ["match_id", "track_id"], ["match_id", "frame_idx"]


def _boxes(s, d):
    return fixture.detections(s, d).filter("track_id is not null")


def _balls(s, d):
    return fixture.detections(s, d).filter("cls = 32")


def _first(s, d):
    return op.with_age(_boxes(s, d)).filter("age = 0 and frame_idx > 0")


def _last(s, d):
    boxes = _boxes(s, d)
    return boxes.join(boxes.groupBy(*TRACK).agg(F.max("frame_idx").alias("frame_idx")), [*TRACK, "frame_idx"])


def duplicate_tracks(s, d):
    aged = op.with_age(_boxes(s, d))
    return op.duplicates(aged.filter("track_id div 100 <= 11"), aged.filter("track_id div 100 > 11"), 0.6)


def rescue_pairs(s, d):
    return op.rescue_pairs(_last(s, d), _first(s, d), distance=0.05).withColumn("apart", F.round("apart", 4))


def near_miss_spawns(s, d):
    return op.near_misses(_first(s, d).withColumn("conf", F.expr("conf - (track_id % 3) * 0.2")).withColumn("y1", F.expr("y1 + (track_id % 4) * 15")), _boxes(s, d))


def ghost_merge(s, d):
    named = identity.majority(fixture.reads(s, d), "number", TRACK).select(*TRACK, "number")
    x, y = g.center("x1", "y1", "x2", "y2")
    return op.ghost_merge(_first(s, d), _last(s, d).join(named, TRACK).select(*FRAME, "number", "track_id", x.alias("x"), y.alias("y"))).withColumn("d", F.round("d", 4))


def _vectors(s, d):
    return s.read.parquet(f"{d}/embeddings.parquet").select(F.expr("CAST(vec_id DIV 1000 AS INT) AS match_id"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _neighbours(s, d):
    from pitchflow.operators.tracks import dot, normalized

    v = _vectors(s, d).select("match_id", "vec_id", normalized(F.col("v")).alias("v"))
    other = v.select("match_id", F.col("v").alias("w"), (F.col("vec_id") - 1).alias("vec_id"))
    return v.join(other, ["match_id", "vec_id"], "left").select("match_id", "vec_id", dot(F.col("v"), F.col("w")).alias("cosine"))


def gallery_consistent(s, d):
    keyed = _neighbours(s, d).withColumn("crop", F.expr("vec_id DIV 3"))
    return op.gallery_consistent(keyed, ["match_id", "crop"], 0.1).withColumn("similarity", F.round("similarity", 4))


def appearance_gate(s, d):
    pairs = _neighbours(s, d).filter("cosine is not null").selectExpr("*", "(vec_id % 10) / 10.0D AS iou", "vec_id % 7 = 0 AS close")
    return op.appearance_gate(pairs, 0.52, 0.48).select("vec_id", F.round("cost", 4).alias("cost"))


def running_quantile(s, d):
    return op.running_quantile(_balls(s, d), "conf").withColumn("threshold", F.round("threshold", 4))


def aerial_balls(s, d):
    return op.aerial_balls(_balls(s, d).withColumn("x2", F.expr("x2 + frame_idx % 9")), 0.9).select(*FRAME, F.round("area", 4).alias("area"), F.round("speed", 4).alias("speed"))


def scene_cuts(s, d):
    return op.scene_cuts(_vectors(s, d), "vec_id", "v", 0.05).withColumn("correlation", F.round("correlation", 4))


def rolling_color_mode(s, d):
    return op.rolling_mode(fixture.color_obs(s, d), "color", 30).withColumn("share", F.round("share", 4))


def rolling_number_mode(s, d):
    return op.rolling_mode(fixture.reads(s, d), "number", 5).withColumn("share", F.round("share", 4))


def agreed_reads(s, d):
    return op.agreed_reads(fixture.reads(s, d)).withColumn("confidence", F.round("confidence", 4))


def lock_metrics(s, d):
    reads = fixture.reads(s, d)
    return op.lock_metrics(reads, identity.tier_lock(reads)).withColumn("locked_percent", F.round("locked_percent", 4))


def best_crops(s, d):
    return op.best_crops(_boxes(s, d).withColumn("y1", F.expr("y1 - (frame_idx * 7 + track_id) % 31")))


def systematic_sample(s, d):
    return op.systematic_sample(fixture.frames(s, d), 400)


def batch_scores(s, d):
    import numpy as np
    import pandas as pd

    def predict(batch):
        v = np.stack(batch["v"].to_numpy())
        best = v.argmax(axis=1)
        return pd.DataFrame({"vec_id": batch["vec_id"], "best": best, "score": v[np.arange(len(v)), best].round(6)})

    return op.score_batches(_vectors(s, d).select("vec_id", "v"), predict, "vec_id long, best int, score double")


def verifier_cascade(s, d):
    reads = fixture.reads(s, d)
    second = identity.majority(reads, "number", TRACK).select(*TRACK, F.col("number").alias("second"))
    return op.verify(identity.run_of_three(reads), second, TRACK)


def output_filter(s, d):
    reads = fixture.reads(s, d)
    named = identity.majority(reads, "number", TRACK).join(fixture.teams(s, d), TRACK)
    recovered = identity.vote_recovery(reads).select(*TRACK, F.lit(True).alias("r"))
    stats = named.join(recovered, TRACK, "left").select(*TRACK, "team", F.when(F.col("track_id") % 13 != 0, F.col("number")).alias("number"), F.col("samples").alias("observations"), (F.col("votes") / F.col("samples")).alias("confidence"), F.coalesce("r", F.lit(False)).alias("recovered"))
    return op.output_filter(stats).withColumn("confidence", F.round("confidence", 4))


def accuracy_by_player(s, d):
    return op.flat_rows(report._stats(report.Match(s, d, keep=True), ["passes_total", "passes_complete", "tackles", "xg", "goals"]))


def vote_locks(s, d):
    return votes.vote_locks(fixture.reads(s, d), fixture.teams(s, d)).withColumn("score", F.round("score", 4))


def nearest_owner_px(s, d):
    return op.nearest_owner_px(_balls(s, d), _boxes(s, d)).withColumn("d", F.round("d", 4))


def under_pressure_px(s, d):
    return op.under_pressure_px(op.nearest_owner_px(_balls(s, d), _boxes(s, d)).withColumnRenamed("owner", "track_id"), _boxes(s, d), fixture.teams(s, d))


def ball_near_feet(s, d):
    return op.ball_near_feet(_balls(s, d), _boxes(s, d))


def named_colors(s, d):
    part = s.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey", "p_partkey * 7 % 256 AS b", "p_partkey * 13 % 256 AS g", "p_partkey * 29 % 256 AS r")
    b, gr, r = F.col("b"), F.col("g"), F.col("r")
    return palette.nearest_names(part).select("p_partkey", "name", l.nearer_reference(b, gr, r, (40, 40, 200), (220, 220, 220), ("home", "away")).alias("side"))


QUERIES = {f.__name__: f for f in (duplicate_tracks, rescue_pairs, near_miss_spawns, ghost_merge, gallery_consistent, appearance_gate, running_quantile, aerial_balls, scene_cuts, rolling_color_mode, rolling_number_mode, agreed_reads, lock_metrics, best_crops, systematic_sample, batch_scores, verifier_cascade, output_filter, accuracy_by_player, vote_locks, nearest_owner_px, under_pressure_px, ball_near_feet, named_colors)}

_TRACKED = {
    "tracked": "SELECT * FROM detections WHERE track_id IS NOT NULL",
    "aged": "SELECT *, frame_idx - min(frame_idx) OVER (PARTITION BY match_id, track_id) AS age FROM tracked",
    "first_": "SELECT * FROM aged WHERE age = 0 AND frame_idx > 0",
    "last_": "SELECT * FROM (SELECT *, max(frame_idx) OVER (PARTITION BY match_id, track_id) AS end_ FROM tracked) t WHERE frame_idx = end_",
}
_IW = "greatest(0, least(a.x2,b.x2)-greatest(a.x1,b.x1)) * greatest(0, least(a.y2,b.y2)-greatest(a.y1,b.y1))"
_IOU = f"{_IW} / ((a.x2-a.x1)*(a.y2-a.y1) + (b.x2-b.x1)*(b.y2-b.y1) - {_IW} + 1e-6)"
_C = "sqrt(((a.x1+a.x2)/2-(b.x1+b.x2)/2)*((a.x1+a.x2)/2-(b.x1+b.x2)/2) + ((a.y1+a.y2)/2-(b.y1+b.y2)/2)*((a.y1+a.y2)/2-(b.y1+b.y2)/2))"
_IN = "({p}.x1 >= {q}.x1 AND {p}.y1 >= {q}.y1 AND {p}.x2 <= {q}.x2 AND {p}.y2 <= {q}.y2)"
_NAMED = {"named": _MAJ.format(v="number", t="reads")}
_COS = {"unit": "SELECT vec_id // 1000 AS match_id, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings", "near_": "SELECT a.match_id, a.vec_id, CASE WHEN b.v IS NOT NULL THEN list_cosine_similarity(a.v, b.v) END AS cosine FROM unit a LEFT JOIN unit b ON b.match_id = a.match_id AND b.vec_id = a.vec_id + 1"}
_MODE = "SELECT match_id, track_id, frame_idx, m.v AS {v}, round(m.n / len(l), 4) AS share FROM (SELECT *, list_sort(list_transform(l, lambda x: struct_pack(n := len(list_filter(l, lambda y: y = x)), p := -list_position(l, x), v := x)), 'DESC')[1] AS m FROM (SELECT match_id, track_id, frame_idx, list({v}) OVER (PARTITION BY match_id, track_id ORDER BY frame_idx ROWS BETWEEN {n} PRECEDING AND CURRENT ROW) AS l FROM {t}) t) t"
_OWN_PX = {"first_ball": "SELECT * FROM (SELECT match_id, frame_idx, (x1+x2)/2 AS x, (y1+y2)/2 AS y, row_number() OVER (PARTITION BY match_id, frame_idx ORDER BY box_idx) AS rn FROM detections WHERE cls = 32) t WHERE rn = 1", "own_px": "SELECT match_id, frame_idx, track_id AS owner, d FROM (SELECT *, row_number() OVER (PARTITION BY match_id, frame_idx ORDER BY d, box_idx) AS rn FROM (SELECT a.match_id, a.frame_idx, a.track_id, a.box_idx, sqrt(((a.x1+a.x2)/2-b.x)*((a.x1+a.x2)/2-b.x) + ((a.y1+a.y2)/2-b.y)*((a.y1+a.y2)/2-b.y)) AS d FROM tracked a JOIN first_ball b ON b.match_id = a.match_id AND b.frame_idx = a.frame_idx WHERE a.cls IN (1,2,3)) t WHERE d < 80) t WHERE rn = 1"}
_ORD = lambda ref: " + ".join(f"({c}-{x})*({c}-{x})" for c, x in zip("bgr", ref))
_WINDOW1000 = "list(conf) OVER (PARTITION BY match_id ORDER BY frame_idx ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)"
# a fold over a match's claims in time; the state has the claims' own fields, and lists of what is held, locked, registered and told
_OWNER = "list_filter(s.held, lambda h: h.team = x.team AND h.number = x.number)"
_FREE = "NOT list_contains(s.locked, x.track)"
_REG = f"({_FREE} AND x.score >= 0.6 AND NOT list_contains(s.registered, x.number))"
_GETS = f"({_FREE} AND x.may AND (len({_OWNER}) = 0 OR x.score > {_OWNER}[1].score + 3))"
_TOLD = "struct_pack(event := '{e}', track := x.track, team := x.team, number := x.number, frame := x.frame, score := x.score, stolen := {f}, ok := {ok})"
_VOTES = {
    "vread": "SELECT r.match_id, r.frame_idx, r.track_id, coalesce(t.team, 'Unknown') AS team, list(struct_pack(n := number, c := confidence)) OVER (PARTITION BY r.match_id, r.track_id ORDER BY r.frame_idx) AS l FROM reads r LEFT JOIN teams t ON t.match_id = r.match_id AND t.track_id = r.track_id WHERE confidence >= 0.40",
    "vrank": "SELECT *, list_sort(list_transform(list_distinct(list_transform(l, lambda x: x.n)), lambda n: struct_pack(total := round(list_sum(list_transform(list_filter(l, lambda x: x.n = n), lambda x: x.c)), 9), s := CAST(n AS VARCHAR), n := n)), 'DESC') AS ranked, list_transform(l[-10:], lambda x: x.n) AS w FROM vread",
    "vclaim": "SELECT match_id, frame_idx, track_id, team, ranked[1].n AS leader, ranked[1].total AS best, round(ranked[1].total - coalesce(ranked[2].total, 0), 9) >= 0.5 AND (len(w) < 5 OR len(list_filter(w, lambda y: y = ranked[1].n)) >= 0.5 * len(w)) AS may FROM vrank",
    "vlist": "SELECT match_id, list(struct_pack(track := track_id, team := team, number := leader, frame := frame_idx, score := best, may := may, held := CAST([] AS STRUCT(team VARCHAR, number INT, track INT, score DOUBLE)[]), locked := CAST([] AS INT[]), registered := CAST([] AS INT[]), told := CAST([] AS STRUCT(event VARCHAR, track INT, team VARCHAR, number INT, frame INT, score DOUBLE, stolen INT, ok BOOLEAN)[])) ORDER BY frame_idx, track_id) AS rows FROM vclaim WHERE may OR best >= 0.6 GROUP BY match_id",
    "vfold": f"SELECT match_id, list_reduce(list_prepend(rows[1], rows), lambda s, x: struct_pack(track := x.track, team := x.team, number := x.number, frame := x.frame, score := x.score, may := x.may, held := CASE WHEN {_GETS} THEN list_append(list_filter(s.held, lambda h: NOT (h.team = x.team AND h.number = x.number)), struct_pack(team := x.team, number := x.number, track := x.track, score := x.score)) ELSE s.held END, locked := CASE WHEN {_GETS} THEN list_append(s.locked, x.track) ELSE s.locked END, registered := CASE WHEN {_REG} THEN list_append(s.registered, x.number) ELSE s.registered END, told := list_concat(s.told, list_filter([{_TOLD.format(e='registered', f='CAST(NULL AS INT)', ok=_REG)}, {_TOLD.format(e='locked', f=_OWNER + '[1].track', ok=_GETS)}], lambda e: e.ok)))) AS s FROM vlist",
}
ORACLE = {
    "vote_locks": sql("SELECT match_id, e.event AS event, e.track AS track_id, e.team AS team, e.number AS number, e.frame AS frame_idx, round(e.score, 4) AS score, e.stolen AS stolen_from FROM (SELECT match_id, unnest(s.told) AS e FROM vfold) t", _VOTES),
    "duplicate_tracks": sql(f"SELECT DISTINCT a.match_id, a.frame_idx, CASE WHEN a.age > b.age THEN b.track_id ELSE a.track_id END AS track_id FROM aged a JOIN aged b ON b.match_id = a.match_id AND b.frame_idx = a.frame_idx WHERE a.track_id // 100 <= 11 AND b.track_id // 100 > 11 AND 1 - {_IOU} < 0.6", _TRACKED),
    "rescue_pairs": sql(f"SELECT b.match_id, b.frame_idx, a.track_id AS a_id, b.track_id AS b_id, b.frame_idx - a.frame_idx AS gap, round({_C} / greatest(1, b.x2-b.x1, b.y2-b.y1), 4) AS apart FROM last_ a JOIN first_ b ON b.match_id = a.match_id AND b.frame_idx - a.frame_idx BETWEEN 1 AND 45 AND a.track_id <> b.track_id WHERE 1 - {_IOU} > 0.05 AND NOT {_IN.format(p='a', q='b')} AND NOT {_IN.format(p='b', q='a')} AND {_C} / greatest(1, b.x2-b.x1, b.y2-b.y1) <= 0.7", _TRACKED),
    "near_miss_spawns": sql(f"SELECT DISTINCT a.match_id, a.frame_idx, a.track_id FROM spawned a JOIN tracked b ON b.match_id = a.match_id AND b.frame_idx = a.frame_idx AND b.track_id <> a.track_id WHERE {_C} < CAST(0.6 AS DOUBLE) * (b.x2-b.x1) UNION SELECT match_id, frame_idx, track_id FROM spawned WHERE conf < 0.5 AND y2 - y1 < 40", _TRACKED | {"spawned": "SELECT * REPLACE (conf - (track_id % 3) * CAST(0.2 AS DOUBLE) AS conf, y1 + (track_id % 4) * 15 AS y1) FROM first_"}),
    "ghost_merge": sql(f"SELECT match_id, track_id, frame_idx, number, round(d, 4) AS d FROM (SELECT *, row_number() OVER (PARTITION BY match_id, track_id, frame_idx ORDER BY d, seen_at DESC, number) AS rn FROM (SELECT b.match_id, b.track_id, b.frame_idx, n.number, a.frame_idx AS seen_at, {_C} AS d FROM last_ a JOIN named n ON n.match_id = a.match_id AND n.track_id = a.track_id JOIN first_ b ON b.match_id = a.match_id AND b.frame_idx - a.frame_idx BETWEEN 1 AND 30 AND b.track_id <> a.track_id) t WHERE d < 50) t WHERE rn = 1", _TRACKED | _NAMED),
    "gallery_consistent": sql("SELECT CAST(match_id AS INT) AS match_id, crop, coalesce(best >= 0.1, TRUE) AS fits, round(coalesce(best, 1), 4) AS similarity FROM (SELECT match_id, vec_id // 3 AS crop, max(cosine) AS best FROM near_ GROUP BY match_id, crop) t", _COS),
    "appearance_gate": sql("SELECT vec_id, round(CASE WHEN look > CASE WHEN iou > 0.2 OR vec_id % 7 = 0 THEN 0.52 ELSE 0.48 END THEN 1 ELSE least(1 - iou, look) END, 4) AS cost FROM (SELECT vec_id, (1 - cosine) / 2 AS look, CAST(vec_id % 10 AS DOUBLE) / 10 AS iou FROM near_ WHERE cosine IS NOT NULL) t", _COS),
    "running_quantile": sql(f"SELECT match_id, CAST(n AS INT) AS n, round(CASE WHEN n < 500 THEN 0.28 ELSE list_aggregate(l, 'quantile_cont', 0.05) END, 4) AS threshold FROM (SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY frame_idx) AS n, {_WINDOW1000} AS l FROM detections WHERE cls = 32) t WHERE n % 100 = 0"),
    "aerial_balls": sql("SELECT match_id, frame_idx, round(area, 4) AS area, round(speed, 4) AS speed FROM (SELECT s.*, CASE WHEN lag(frame_idx) OVER w = frame_idx - 1 THEN sqrt((x - lag(x) OVER w)*(x - lag(x) OVER w) + (y - lag(y) OVER w)*(y - lag(y) OVER w)) END AS speed, median(CASE WHEN k <= 100 THEN area END) OVER (PARTITION BY match_id) AS usual FROM sized s WINDOW w AS (PARTITION BY match_id ORDER BY frame_idx)) t WHERE area < CAST(0.9 AS DOUBLE) * usual AND speed > 5", {"sized": "SELECT match_id, frame_idx, (x2 + frame_idx % 9 - x1) * (y2 - y1) AS area, (x1 + x2 + frame_idx % 9) / 2 AS x, (y1 + y2) / 2 AS y, row_number() OVER (PARTITION BY match_id ORDER BY frame_idx) AS k FROM detections WHERE cls = 32"}),
    "scene_cuts": sql("SELECT CAST(match_id AS INT) AS match_id, vec_id, round(r, 4) AS correlation FROM (SELECT match_id, vec_id, list_cosine_similarity(list_transform(v, lambda x: x - list_avg(v)), list_transform(w, lambda x: x - list_avg(w))) AS r FROM (SELECT *, lag(v) OVER (PARTITION BY match_id ORDER BY vec_id) AS w FROM unit) t WHERE w IS NOT NULL) t WHERE r < 0.05", _COS),
    "rolling_color_mode": sql(_MODE.format(v="color", n=29, t="color_obs")),
    "rolling_number_mode": sql(_MODE.format(v="number", n=4, t="reads")),
    "agreed_reads": sql("SELECT match_id, track_id, frame_idx, CASE WHEN m.n >= 2 THEN m.v ELSE number END AS number, round(CASE WHEN m.n >= 2 THEN least(0.99, confidence + 0.1) ELSE confidence END, 4) AS confidence FROM (SELECT *, list_sort(list_transform(l, lambda x: struct_pack(n := len(list_filter(l, lambda y: y = x)), p := -list_position(l, x), v := x)), 'DESC')[1] AS m FROM (SELECT match_id, track_id, frame_idx, number, confidence, list(number) OVER (PARTITION BY match_id, track_id ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS l FROM reads) t) t"),
    "lock_metrics": sql("SELECT match_id, round(100 * count(k) / count(*), 4) AS locked_percent, CAST(sum(changes) AS BIGINT) AS changes, median(k - f) AS median_frames FROM (SELECT c.match_id, c.track_id, c.changes, c.f, t.frame_idx AS k FROM (SELECT match_id, track_id, sum(x) AS changes, min(frame_idx) AS f FROM (SELECT *, CASE WHEN lag(number) OVER (PARTITION BY match_id, track_id ORDER BY frame_idx) <> number THEN 1 ELSE 0 END AS x FROM reads) t GROUP BY match_id, track_id) c LEFT JOIN tlock t ON t.match_id = c.match_id AND t.track_id = c.track_id) t GROUP BY match_id", _T),
    "best_crops": sql("SELECT match_id, track_id, frame_idx, h, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY match_id, track_id ORDER BY h DESC, frame_idx) AS place FROM (SELECT match_id, track_id, frame_idx, y2 - (y1 - (frame_idx * 7 + track_id) % 31) AS h FROM tracked) t) t WHERE place <= 10", _TRACKED),
    "systematic_sample": sql("SELECT match_id, frame_idx FROM (SELECT *, greatest(1, count(*) OVER (PARTITION BY match_id) // 400) AS step FROM frames) t WHERE frame_idx % step = 0"),
    "batch_scores": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS best, round(CAST(list_max(embedding) AS DOUBLE), 6) AS score FROM embeddings",
    "verifier_cascade": sql("SELECT r.match_id, r.track_id, CASE WHEN fix THEN n.number ELSE r.number END AS number, fix AS corrected FROM (SELECT r.*, coalesce((r.number IN (11, 19, 29) OR confidence < 0.8) AND n.number <> r.number AND n.number <> 10, FALSE) AS fix FROM threes r LEFT JOIN named n ON n.match_id = r.match_id AND n.track_id = r.track_id) r LEFT JOIN named n ON n.match_id = r.match_id AND n.track_id = r.track_id", _NAMED | {"threes": "SELECT match_id, track_id, coalesce(steady, latest) AS number, CASE WHEN steady IS NOT NULL THEN 0.99e0 ELSE confidence END AS confidence FROM (SELECT match_id, track_id, arg_min(number, frame_idx) FILTER (WHERE third) AS steady, arg_max(number, frame_idx) AS latest, arg_max(confidence, frame_idx) AS confidence FROM (SELECT *, lag(number) OVER w = number AND lag(number, 2) OVER w = number AS third FROM reads WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame_idx)) t GROUP BY match_id, track_id) t"}),
    "output_filter": sql("SELECT match_id, track_id, team, number, observations, round(confidence, 4) AS confidence, recovered FROM (SELECT *, row_number() OVER (PARTITION BY match_id, team, number ORDER BY confidence DESC, observations DESC, track_id) AS rn FROM (SELECT n.match_id, n.track_id, t.team, n.number, n.samples AS observations, n.votes / n.samples AS confidence, v.number IS NOT NULL AS recovered FROM named n JOIN teams t ON t.match_id = n.match_id AND t.track_id = n.track_id LEFT JOIN voted_ v ON v.match_id = n.match_id AND v.track_id = n.track_id WHERE n.track_id % 13 <> 0) s WHERE observations >= 30 OR (recovered AND observations >= 20)) s WHERE rn = 1 AND number BETWEEN 1 AND 99", _NAMED | _S | {"voted_": "SELECT match_id, track_id, number FROM scored_ WHERE place = 1 AND tally >= 2 AND score - second >= 0.3 AND score >= 0.5"}),
    "accuracy_by_player": sql("SELECT match_id, track_id, team, number, passes_total AS passes, CASE WHEN passes_total > 0 THEN round(100 * passes_complete / passes_total, 1) ELSE 0 END AS accuracy, tackles, round(xg, 2) AS xg, goals FROM stats", report._E),
    "nearest_owner_px": sql("SELECT match_id, frame_idx, owner, round(d, 4) AS d FROM own_px", _TRACKED | _OWN_PX),
    "under_pressure_px": sql(f"SELECT DISTINCT a.match_id, a.frame_idx, a.track_id FROM own_px o JOIN tracked a ON a.match_id = o.match_id AND a.frame_idx = o.frame_idx AND a.track_id = o.owner JOIN teams ta ON ta.match_id = a.match_id AND ta.track_id = a.track_id JOIN tracked b ON b.match_id = a.match_id AND b.frame_idx = a.frame_idx JOIN teams tb ON tb.match_id = b.match_id AND tb.track_id = b.track_id WHERE a.cls IN (1,2) AND b.cls IN (1,2) AND ta.team <> tb.team AND {_C} <= 90", _TRACKED | _OWN_PX),
    "ball_near_feet": sql("SELECT DISTINCT a.match_id, a.frame_idx, a.track_id FROM tracked a JOIN detections b ON b.match_id = a.match_id AND b.frame_idx = a.frame_idx AND b.cls = 32 WHERE sqrt(((a.x1+a.x2)/2-(b.x1+b.x2)/2)*((a.x1+a.x2)/2-(b.x1+b.x2)/2) + (a.y2-(b.y1+b.y2)/2)*(a.y2-(b.y1+b.y2)/2)) < greatest(CAST(0.9 AS DOUBLE)*(a.x2-a.x1), CAST(0.25 AS DOUBLE)*(a.y2-a.y1))", _TRACKED),
    "named_colors": "SELECT p_partkey, list_sort([" + ", ".join(f"struct_pack(d := {_ORD(ref)}, k := {k}, n := '{name}')" for k, (name, ref) in enumerate(palette.WEB.items())) + f"])[1].n AS name, CASE WHEN {_ORD((40, 40, 200))} < {_ORD((220, 220, 220))} THEN 'home' ELSE 'away' END AS side FROM (SELECT p_partkey, p_partkey * 7 % 256 AS b, p_partkey * 13 % 256 AS g, p_partkey * 29 % 256 AS r FROM part) t",
}
