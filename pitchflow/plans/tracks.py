"""Queries on track quality, embeddings and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchflow.functions import geometry as g
from pitchflow.operators import identity
from pitchflow.operators import tracks as op
from pitchflow.plans import fixture
from pitchflow.plans.fixture import sql

TRACK = ["match_id", "track_id"]


def _boxes(s, d):
    return fixture.detections(s, d).filter("track_id is not null")


def _lives(s, d):
    return op.lifetimes(_boxes(s, d))


def track_lifetime(s, d):
    return _lives(s, d).select(*TRACK, "first", "last", F.col("from.x").alias("from_x"), F.col("from.y").alias("from_y"), F.col("to.x").alias("to_x"), F.col("to.y").alias("to_y"), "n")


def track_length_stats(s, d):
    return op.length_stats(_lives(s, d)).select("match_id", "tracks", "p10", "median", "p90", F.round("short_share", 4).alias("short_share"), "new_per_1000")


def track_length_histogram(s, d):
    return op.length_histogram(_lives(s, d))


def dropout_rate(s, d):
    return op.dropout(fixture.frames(s, d), _boxes(s, d)).select("match_id", F.round("dropout", 4).alias("dropout"), F.round("mean_tracks", 4).alias("mean_tracks"))


def reason_totals(s, d):
    per_user = fixture.jobs(s, d).groupBy("unique_id", "status").agg(F.count("*").alias("n")).groupBy("unique_id").agg(F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("reasons"))
    return op.map_totals(per_user, "reasons")


def ghost_spawn_suppress(s, d):
    return op.ghost_spawns(_boxes(s, d))


def _pairs(s, d):
    boxes = fixture.detections(s, d).filter("cls in (1, 2)")
    side = lambda p, low: boxes.filter(f"(track_id div 100 <= 11) = {low}").select("match_id", "frame_idx", F.col("track_id").alias(f"{p}id"), *[F.col(c).alias(f"{p}{c}") for c in ("x1", "y1", "x2", "y2")])
    return side("a_", "true").join(side("b_", "false").hint("merge"), ["match_id", "frame_idx"]).withColumn("iou", g.iou("a_", "b_"))


def greedy_iou_match(s, d):
    return op.greedy_match(_pairs(s, d), ["match_id", "frame_idx"], 0.1).select("match_id", "frame_idx", "a_id", "b_id", F.round("iou", 4).alias("iou"))


def stitch_tracks(s, d):
    return op.stitch(_lives(s, d), identity.tier_lock(fixture.reads(s, d))).select(*TRACK, "other", "gap", F.round("d", 4).alias("d"))


def union_keep_first(s, d):
    reads = fixture.reads(s, d)
    return op.keep_first(identity.tier_lock(reads).select(*TRACK, "number"), identity.first_lock(reads).select(*TRACK, "number"), TRACK)


def difference_by_id(s, d):
    return _boxes(s, d).select(*TRACK).distinct().join(fixture.reads(s, d), TRACK, "left_anti")


def union_of_ids(s, d):
    return fixture.reads(s, d).select(*TRACK).union(fixture.color_obs(s, d).select(*TRACK)).distinct()


def top_fragments(s, d):
    return op.top_fragments(_lives(s, d).withColumn("player", (F.col("track_id") / 100).cast("int")), ["match_id", "player"], F.desc("n"), F.col("track_id")).select(*TRACK, "n", "place")


def _vectors(s, d):
    return s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.expr("CAST(vec_id DIV 1000 AS INT)").alias("match_id"), (F.col("vec_id") % 25).alias("track"))


def mean_embedding(s, d):
    means = op.mean_embedding(_vectors(s, d), ["match_id", "track"], "v")
    return means.select("match_id", "track", F.posexplode("mean").alias("i", "x")).select("match_id", "track", "i", F.round("x", 4).alias("x"))


def gallery_top1(s, d):
    v = _vectors(s, d)
    return op.gallery_best(v, op.mean_embedding(v, ["match_id", "track"], "v"), 0.3).select("match_id", "vec_id", "track", F.round("cosine", 4).alias("cosine"), "accepted")


def ema_embedding(s, d):
    return op.ema(_vectors(s, d), ["match_id", "track"], "vec_id", "v").select("match_id", "track", F.posexplode("ema").alias("i", "x")).select("match_id", "track", "i", F.round("x", 4).alias("x"))


def job_upsert(s, d):
    return op.latest_jobs(fixture.jobs(s, d)).drop("updated_at", "created_at").withColumn("size_mb", F.round("size_mb", 4))


def pending_jobs(s, d):
    jobs = op.latest_jobs(fixture.jobs(s, d))
    return op.pending_jobs(jobs, jobs, 5.0, 80.0).select("unique_id", "status")


def health_summary(s, d):
    return op.health(fixture.jobs(s, d)).withColumn("mean_size", F.round("mean_size", 4))


QUERIES = {f.__name__: f for f in (track_lifetime, track_length_stats, track_length_histogram, dropout_rate, reason_totals, ghost_spawn_suppress, greedy_iou_match, stitch_tracks, union_keep_first, difference_by_id, union_of_ids, top_fragments, mean_embedding, gallery_top1, ema_embedding, job_upsert, pending_jobs, health_summary)}

_TIER = "CASE WHEN confidence >= 0.8 THEN 3 WHEN confidence >= 0.5 THEN 2 ELSE 1 END"
_T = {"tiers": f"SELECT *, max(own) OVER (PARTITION BY match_id, track_id ORDER BY frame_idx) AS most FROM (SELECT *, sum({_TIER}) OVER (PARTITION BY match_id, track_id, number ORDER BY frame_idx) AS own FROM reads) t", "tlock": "SELECT match_id, track_id, arg_min(number, frame_idx) AS number FROM tiers WHERE own >= 6 AND own >= most GROUP BY match_id, track_id"}
_L = {"lives": 'SELECT match_id, track_id, min(frame_idx) AS "first", max(frame_idx) AS "last", arg_min((x1+x2)/2, frame_idx) AS from_x, arg_min(y2, frame_idx) AS from_y, arg_max((x1+x2)/2, frame_idx) AS to_x, arg_max(y2, frame_idx) AS to_y, count(*) AS n FROM detections WHERE track_id IS NOT NULL GROUP BY match_id, track_id'}
_IOU = "greatest(0, least(a.x2,b.x2)-greatest(a.x1,b.x1)) * greatest(0, least(a.y2,b.y2)-greatest(a.y1,b.y1))"
_AREA = "(a.x2-a.x1)*(a.y2-a.y1) + (b.x2-b.x1)*(b.y2-b.y1)"
_M = "SELECT match_id, track, i, avg(x) AS x FROM (SELECT CAST(vec_id // 1000 AS INT) AS match_id, vec_id % 25 AS track, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) t GROUP BY match_id, track, i"
_J = {"latest": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY updated_at DESC, task_id DESC) AS rn FROM jobs) t WHERE rn = 1"}
ORACLE = {
    "track_lifetime": sql("SELECT * FROM lives", _L),
    "track_length_stats": sql('SELECT match_id, count(*) AS tracks, quantile_cont(n, 0.1) AS p10, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.9) AS p90, round(avg(CASE WHEN n < 5 THEN 1.0 ELSE 0.0 END), 4) AS short_share, round(1000 * count(*) / (max("last") + 1), 4) AS new_per_1000 FROM lives GROUP BY match_id', _L),
    "track_length_histogram": sql("SELECT match_id, CAST(" + " + ".join(f"CASE WHEN n >= {x} THEN 1 ELSE 0 END" for x in (5, 15, 50, 100, 300, 1000)) + " AS INT) AS bin, count(*) AS tracks FROM lives GROUP BY match_id, bin", _L),
    "dropout_rate": sql("SELECT match_id, round(avg(CASE WHEN t < 16 THEN 1.0 ELSE 0.0 END), 4) AS dropout, round(avg(t), 4) AS mean_tracks FROM (SELECT f.match_id, f.frame_idx, count(DISTINCT track_id) AS t FROM frames f LEFT JOIN boxes b ON b.match_id = f.match_id AND b.frame_idx = f.frame_idx GROUP BY f.match_id, f.frame_idx) t GROUP BY match_id"),
    "reason_totals": sql("SELECT status AS reason, count(*) AS n FROM jobs GROUP BY status"),
    "ghost_spawn_suppress": sql(f"SELECT DISTINCT a.match_id, a.frame_idx, a.track_id FROM aged a JOIN aged b ON a.match_id = b.match_id AND a.frame_idx = b.frame_idx WHERE a.frame_idx - a.born <= 5 AND a.born > 0 AND b.frame_idx - b.born > 5 AND {_IOU} / ({_AREA} - {_IOU} + 1e-6) > 0.15", {"aged": "SELECT *, min(frame_idx) OVER (PARTITION BY match_id, track_id) AS born FROM detections WHERE track_id IS NOT NULL"}),
    "greedy_iou_match": sql("SELECT match_id, frame_idx, p.a_id, p.b_id, round(p.iou, 4) AS iou FROM (SELECT match_id, frame_idx, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.a_id = x[1].a_id OR y.b_id = x[1].b_id)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS p FROM (SELECT match_id, frame_idx, list([struct_pack(a_id := a_id, b_id := b_id, iou := iou)] ORDER BY iou DESC, a_id, b_id) AS l FROM (SELECT a.match_id, a.frame_idx, a.track_id AS a_id, b.track_id AS b_id, " + f"{_IOU} / ({_AREA} - {_IOU} + 1e-6) AS iou FROM detections a JOIN detections b ON a.match_id = b.match_id AND a.frame_idx = b.frame_idx WHERE a.cls IN (1,2) AND b.cls IN (1,2) AND a.track_id // 100 <= 11 AND b.track_id // 100 > 11) t WHERE iou > 0.1 GROUP BY match_id, frame_idx) t) t"),
    "stitch_tracks": sql('SELECT match_id, track_id, other, gap, round(d, 4) AS d FROM (SELECT *, row_number() OVER (PARTITION BY match_id, track_id ORDER BY gap, d, other) AS rn FROM (SELECT u.match_id, u.track_id, k.track_id AS other, u."first" - k."last" AS gap, sqrt((u.from_x-k.to_x)*(u.from_x-k.to_x) + (u.from_y-k.to_y)*(u.from_y-k.to_y)) AS d FROM unknown_ u JOIN known_ k ON u.match_id = k.match_id UNION ALL SELECT u.match_id, u.track_id, k.track_id, k."first" - u."last", sqrt((u.to_x-k.from_x)*(u.to_x-k.from_x) + (u.to_y-k.from_y)*(u.to_y-k.from_y)) FROM unknown_ u JOIN known_ k ON u.match_id = k.match_id) t WHERE gap > 0 AND gap < 60 AND d < 300) t WHERE rn = 1', _L | _T | {"known_": "SELECT l.* FROM lives l JOIN tlock USING (match_id, track_id)", "unknown_": "SELECT l.* FROM lives l ANTI JOIN tlock USING (match_id, track_id)"}),
    "union_keep_first": sql("SELECT match_id, track_id, number FROM tlock UNION ALL SELECT f.* FROM (SELECT match_id, track_id, arg_min(number, frame_idx) AS number FROM reads WHERE confidence >= 0.15 GROUP BY match_id, track_id) f ANTI JOIN tlock USING (match_id, track_id)", _T),
    "difference_by_id": sql("SELECT DISTINCT match_id, track_id FROM boxes EXCEPT SELECT match_id, track_id FROM reads"),
    "union_of_ids": sql("SELECT match_id, track_id FROM reads UNION SELECT match_id, track_id FROM color_obs"),
    "top_fragments": sql("SELECT match_id, track_id, n, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY match_id, track_id // 100 ORDER BY n DESC, track_id) AS place FROM lives) t WHERE place <= 20", _L),
    "mean_embedding": f"SELECT match_id, track, CAST(i AS INT) AS i, round(x, 4) AS x FROM ({_M}) t",
    "gallery_top1": f"WITH m AS (SELECT match_id, track, list(x ORDER BY i) AS m FROM ({_M}) t GROUP BY match_id, track), q AS (SELECT CAST(vec_id // 1000 AS INT) AS match_id, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), c AS (SELECT match_id, vec_id, track, list_cosine_similarity(v, m) AS cosine FROM q JOIN m USING (match_id)) SELECT match_id, vec_id, track, round(cosine, 4) AS cosine, cosine >= 0.3 AS accepted FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, track) AS rn FROM c) t WHERE rn = 1",
    "ema_embedding": "WITH RECURSIVE v AS (SELECT CAST(vec_id // 1000 AS INT) AS match_id, vec_id % 25 AS track, row_number() OVER (PARTITION BY vec_id // 1000, vec_id % 25 ORDER BY vec_id) AS rn, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS v FROM embeddings), e AS (SELECT match_id, track, rn, v FROM v WHERE rn = 1 UNION ALL SELECT e.match_id, e.track, n.rn, list_transform(w.u, lambda x: x / sqrt(list_sum(list_transform(w.u, lambda y: y * y)))) FROM e JOIN v n ON n.match_id = e.match_id AND n.track = e.track AND n.rn = e.rn + 1, LATERAL (SELECT list_transform(list_zip(e.v, n.v), lambda p: CAST(0.9 AS DOUBLE) * p[1] + (1 - CAST(0.9 AS DOUBLE)) * p[2]) AS u) w) SELECT match_id, track, CAST(i AS INT) AS i, round(x, 4) AS x FROM (SELECT match_id, track, unnest(range(0, len(v))) AS i, unnest(v) AS x FROM (SELECT *, max(rn) OVER (PARTITION BY match_id, track) AS m FROM e) t WHERE rn = m) t",
    "job_upsert": sql("SELECT unique_id, task_id, status, round(size_mb, 4) AS size_mb FROM latest", _J),
    "pending_jobs": sql("SELECT unique_id, status FROM latest WHERE size_mb BETWEEN 5 AND 80 AND status NOT IN ('finished', 'running', 'failed')", _J),
    "health_summary": sql("SELECT *, CASE WHEN failed / greatest(1, finished + failed) > 0.5 THEN 'unhealthy' WHEN failed / greatest(1, finished + failed) > 0.2 THEN 'degraded' ELSE 'healthy' END AS state FROM (SELECT count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'finished') AS finished, count(*) FILTER (WHERE status = 'failed') AS failed FROM jobs) c, (SELECT round(avg(size_mb), 4) AS mean_size, count(*) AS recent FROM (SELECT * FROM jobs WHERE status = 'finished' ORDER BY updated_at DESC, task_id DESC LIMIT 100) t) r"),
}
