"""Queries on a moving camera, window locks, shots of possessions, tackles at changes of owner, samples and job merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchflow import sources
from pitchflow.functions import geometry as g
from pitchflow.operators import events as op
from pitchflow.operators import identity, play, reid, tracks
from pitchflow.plans import fixture
from pitchflow.plans.fixture import debounced, sql
from pitchflow.plans.play import _DRIB, _KEPT, _NEAR, Match

TRACK, FRAME = ["match_id", "track_id"], ["match_id", "frame_idx"]
# a matrix every 60 frames, the first after 30
_H = ["105e0/1920 * (1 + frame_idx % 7 * 0.01e0)", "0.001e0", "frame_idx % 5 + 0.00001234567e0", "0.0005e0", "68e0/1080", "0.1e0 * (frame_idx % 3) + 0.00002345678e0", "0.0001e0 * (1 + frame_idx % 4)", "0e0", "1e0"]
# a read in every frame: of a track's life of 400 frames the middle part shows another number
_Q = "((frame_idx + track_id // 100 * 37) % 400)"
_WNUM = f"(track_id // 100 + CASE WHEN {_Q} BETWEEN 120 AND 199 THEN 30 ELSE 5 END)"
_WCONF = "(80 + (frame_idx * 13 + track_id) % 20) / 100e0"
_WIOU = "((frame_idx * 7 + track_id) % 20) / 20e0"
_WCOS = "1 - ((frame_idx * 3 + track_id) % 21) / 40e0"


def _spark(expression: str) -> str:
    return expression.replace("//", "DIV")


def project_moving(s, d):
    x, y = g.center("x1", "y1", "x2", "y2")
    points = fixture.detections(s, d).select(*FRAME, "box_idx", x.alias("x"), y.alias("y"))
    matrices = fixture.frames(s, d).filter("frame_idx % 60 = 30").select(*FRAME, F.array(*[F.expr(h) for h in _H]).alias("h"))
    found = op.project_moving(points, matrices)
    return found.select(*FRAME, "box_idx", F.round("mx", 4).alias("mx"), F.round("my", 4).alias("my"))


def ocr_window_lock(s, d):
    seen = fixture.detections(s, d).filter("cls in (1, 2)")
    rows = seen.select(*TRACK, "frame_idx", *[F.expr(_spark(e)).alias(n) for n, e in (("number", f"CAST({_WNUM} AS INT)"), ("confidence", _WCONF), ("iou", _WIOU), ("cosine", _WCOS))])
    return op.window_locks(op.window_votes(rows))


def segment_peak_shot(s, d):
    m = Match(s, d)
    x, y = g.center("x1", "y1", "x2", "y2")
    placed = m.detections.select(*FRAME, "box_idx", "track_id", "cls", x.alias("x"), y.alias("y"))
    found = op.segment_shots(m.segs, placed.filter("cls = 32"), placed.filter("track_id is not null"), m.teams)
    return found.select(*FRAME, "track_id", F.round("speed", 4).alias("speed"), "pressed", F.round("xg", 4).alias("xg"))


def transition_tackle(s, d):
    m = Match(s, d, keep=True)
    return op.transition_tackles(m.segs, m.ball, m.boxes, m.teams, play.tackles(m.dribbles), reach=12.0, least=0.2)


def random_frames(s, d):
    return op.random_sample(fixture.frames(s, d), "frame_idx", 50, seed=7)


def first_jobs(s, d):
    return op.first_jobs(fixture.jobs(s, d), 25).select("task_id", "unique_id", "status")


def status_upsert(s, d):
    """A third of all changes merged into the rest."""
    jobs = fixture.jobs(s, d).select("unique_id", "task_id", "status", "size_mb", "updated_at", F.col("updated_at").alias("created_at"))
    changes = F.col("task_id") % 3 == 1
    out = sources.upsert(jobs.filter(~changes), jobs.filter(changes))
    return out.select("unique_id", "task_id", "status", F.round("size_mb", 4).alias("size_mb"), F.unix_micros("updated_at").alias("updated_us"), F.unix_micros("created_at").alias("created_us"))


def _seen(s, d):
    """Each vector is a track; one in three holds a number, one in seven has no colour."""
    rows = s.read.parquet(f"{d}/embeddings.parquet")
    return rows.select(F.expr("CAST(vec_id DIV 100 AS INT)").alias("match_id"), F.col("vec_id").alias("track_id"), F.col("vec_id").alias("born"), F.expr("CASE WHEN vec_id % 7 = 3 THEN 'Unknown' WHEN label % 2 = 0 THEN 'Red' ELSE 'White' END").alias("color"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _bound(tracks):
    return tracks.filter("track_id % 3 = 0").select(*TRACK, F.expr("CAST(track_id % 29 AS INT) AS number"))


def reid_by_look(s, d):
    tracks = _seen(s, d)
    return reid.reid_by_look(tracks, _bound(tracks), 0.25)


def reid_by_color(s, d):
    tracks = _seen(s, d)
    bound = _bound(tracks)
    registered = bound.join(tracks.select(*TRACK, "color", F.col("born").alias("frame_idx")), TRACK)
    return reid.reid_by_color(tracks, bound, registered)


def forced_kits(s, d):
    """Matches of which the kits are given beforehand (every third), and all others."""
    forced = fixture.frames(s, d).filter("match_id % 3 = 1").select("match_id").distinct().select("match_id", F.explode(F.array(F.struct(F.lit("White").alias("color"), F.lit(1).alias("place")), F.struct(F.lit("Purple").alias("color"), F.lit(2).alias("place")))).alias("k")).select("match_id", "k.*")
    return identity.kit_discovery(fixture.color_obs(s, d), forced)


def processing_state(s, d):
    log = s.read.parquet(f"{d}/events.parquet")
    kind = "CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' ELSE CASE WHEN value > 90 THEN 'db_error' WHEN value > 50 THEN 'api_error' ELSE 'call' END END"
    return tracks.monitor(log.select(F.col("user_id").alias("video_id"), F.expr(kind).alias("event"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("seq"), F.expr("event_id % 50 * 100").alias("frames")))


QUERIES = {f.__name__: f for f in (project_moving, ocr_window_lock, segment_peak_shot, transition_tackle, random_frames, first_jobs, status_upsert, reid_by_look, reid_by_color, forced_kits, processing_state)}

_LOCK = {
    "voted": f"SELECT match_id, track_id, frame_idx, list(struct_pack(n := number, c := confidence)) FILTER (WHERE confidence >= 0.85 AND iou >= 0.2 AND 1 - cosine <= 0.45) OVER (PARTITION BY match_id, track_id ORDER BY frame_idx RANGE BETWEEN 30 PRECEDING AND CURRENT ROW) AS l FROM (SELECT match_id, track_id, frame_idx, CAST({_WNUM} AS INT) AS number, {_WCONF} AS confidence, {_WIOU} AS iou, {_WCOS} AS cosine FROM detections WHERE cls IN (1, 2)) t",
    "led": "SELECT match_id, track_id, frame_idx, len(v) AS seen, list_sort(list_transform(list_distinct(list_transform(v, lambda x: x.n)), lambda n: struct_pack(votes := len(list_filter(v, lambda x: x.n = n)), first := -list_position(list_transform(v, lambda x: x.n), n), number := n, mean := list_avg(list_transform(list_filter(v, lambda x: x.n = n), lambda x: x.c)))), 'DESC')[1] AS t FROM (SELECT *, l[-30:] AS v FROM voted) t WHERE len(l) > 0",
    "may": "SELECT match_id, track_id, list(struct_pack(number := t.number, first_number := t.number, locked_at := frame_idx, changed_at := 0, flips := 0, refused := 0, frame := frame_idx, strong := t.votes >= 16 AND round(t.mean, 9) >= 0.85) ORDER BY frame_idx) AS rows FROM led WHERE t.votes >= 8 AND seen >= 8 AND t.votes / seen >= 0.6 AND round(t.mean, 9) >= 0.80 GROUP BY ALL",
    # the first row is a lock; the others confirm, challenge or take over
    "folded": "SELECT match_id, track_id, list_reduce(rows, lambda s, x: CASE WHEN s.number <> x.number AND x.strong AND x.frame - s.changed_at >= 150 THEN struct_pack(number := x.number, first_number := s.first_number, locked_at := s.locked_at, changed_at := x.frame, flips := s.flips + 1, refused := s.refused, frame := x.frame, strong := x.strong) WHEN s.number <> x.number AND x.strong THEN struct_pack(number := s.number, first_number := s.first_number, locked_at := s.locked_at, changed_at := s.changed_at, flips := s.flips, refused := s.refused + 1, frame := x.frame, strong := x.strong) ELSE s END) AS s FROM may",
}
_PEAK = {
    "pball": "SELECT * FROM (SELECT match_id, frame_idx, (x1+x2)/2 AS x, (y1+y2)/2 AS y, row_number() OVER (PARTITION BY match_id, frame_idx ORDER BY box_idx) AS rn FROM detections WHERE cls = 32) t WHERE rn = 1",
    "pfast": "SELECT *, CASE WHEN lag(frame_idx) OVER w = frame_idx - 1 THEN sqrt((x - lag(x) OVER w)*(x - lag(x) OVER w) + (y - lag(y) OVER w)*(y - lag(y) OVER w)) ELSE 0 END AS v FROM pball WINDOW w AS (PARTITION BY match_id ORDER BY frame_idx)",
    "peaks": 'SELECT * FROM (SELECT s.match_id, s.owner AS track_id, s."start", f.frame_idx, f.v, f.x, f.y, row_number() OVER (PARTITION BY s.match_id, s.owner, s."start" ORDER BY f.v DESC, f.frame_idx) AS rn FROM segs s JOIN pfast f ON f.match_id = s.match_id AND f.frame_idx BETWEEN greatest(s."start", 1) AND s."end" + 3 WHERE s.owner IS NOT NULL) t WHERE rn = 1',
    "pshots": "SELECT *, sqrt((l-x)*(l-x) + (540-y)*(540-y)) AS n1, sqrt((r-x)*(r-x) + (540-y)*(540-y)) AS n2, (l-x)*(r-x) + (540-y)*(540-y) AS dot FROM (SELECT *, 0.12e0*1920 AS l, 0.88e0*1920 AS r FROM peaks WHERE v >= 0.015e0*1920) t",
    "centred": "SELECT d.match_id, frame_idx, d.track_id, cls, (x1+x2)/2 AS x, (y1+y2)/2 AS y, team FROM detections d LEFT JOIN teams t ON t.match_id = d.match_id AND t.track_id = d.track_id WHERE d.track_id IS NOT NULL",
    "ppress": "SELECT DISTINCT s.match_id, s.frame_idx, s.track_id FROM pshots s JOIN centred a ON a.match_id = s.match_id AND a.frame_idx = s.frame_idx AND a.track_id = s.track_id JOIN centred b ON b.match_id = s.match_id AND b.frame_idx = s.frame_idx AND b.track_id <> s.track_id AND b.cls IN (1, 2) WHERE a.team IS DISTINCT FROM b.team AND sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) <= 90",
}
_TURN = _DRIB | _KEPT | {"failed": "SELECT match_id, frame_idx, opponent AS track_id, track_id AS on_track FROM drib WHERE NOT retained"} | debounced("won", "failed", "match_id, track_id", 500, order="frame_idx, on_track") | {
    "turns": 'SELECT * FROM (SELECT match_id, owner AS track_id, "start", "end" AS frame_idx, lead(owner) OVER (PARTITION BY match_id ORDER BY "start") AS b FROM segs) t WHERE track_id <> b AND frame_idx - "start" >= 20',
    "reacts": "SELECT match_id, frame_idx FROM (SELECT match_id, frame_idx, mx - lag(mx, 2) OVER w AS x1, my - lag(my, 2) OVER w AS y1, lead(mx, 2) OVER w - mx AS x2, lead(my, 2) OVER w - my AS y2 FROM ball WINDOW w AS (PARTITION BY match_id ORDER BY frame_idx)) t WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND sqrt(x1*x1 + y1*y1) > 0.2e0 AND (sqrt(x2*x2 + y2*y2) < 0.5e0 * sqrt(x1*x1 + y1*y1) OR x1*x2 + y1*y2 < 0)",
    "tnear": _NEAR.format(asked="turns").replace("< 3)", "< 12)"),
    "turned": "SELECT t.match_id, t.frame_idx, t.b AS track_id, t.track_id AS on_track FROM turns t JOIN reacts r ON r.match_id = t.match_id AND r.frame_idx = t.frame_idx JOIN tnear n ON n.match_id = t.match_id AND n.frame_idx = t.frame_idx AND n.track_id = t.track_id LEFT JOIN teams x ON x.match_id = t.match_id AND x.track_id = t.track_id LEFT JOIN teams y ON y.match_id = t.match_id AND y.track_id = t.b WHERE NOT coalesce(x.team = y.team, FALSE) AND NOT EXISTS (SELECT 1 FROM won w WHERE w.match_id = t.match_id AND abs(w.frame_idx - t.frame_idx) < 25e0/3)",
} | debounced("tturn", "turned", "match_id, track_id", 375, strict=False)
_SEEN = {
    "etracks": "SELECT CAST(vec_id // 100 AS INT) AS match_id, vec_id AS track_id, CASE WHEN vec_id % 7 = 3 THEN NULL WHEN label % 2 = 0 THEN 'Red' ELSE 'White' END AS color, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, CASE WHEN vec_id % 3 = 0 THEN CAST(vec_id % 29 AS INT) END AS number FROM embeddings",
    "elike": "SELECT match_id, track_id, color, number, other FROM (SELECT a.*, b.track_id AS other, row_number() OVER (PARTITION BY a.match_id, a.track_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.track_id) AS rn FROM etracks a JOIN etracks b ON b.match_id = a.match_id AND b.track_id < a.track_id WHERE round(list_cosine_similarity(a.v, b.v), 9) >= 0.25) t WHERE rn = 1",
    "eroot": "SELECT match_id, track_id, track_id AS root, number, color, CAST(NULL AS VARCHAR) AS rejected FROM etracks e WHERE NOT EXISTS (SELECT 1 FROM elike k WHERE k.match_id = e.match_id AND k.track_id = e.track_id) UNION ALL SELECT match_id, track_id, CASE WHEN why IS NULL THEN r_root ELSE track_id END, CASE WHEN why IS NULL THEN r_number ELSE number END, CASE WHEN why IS NULL THEN r_color ELSE color END, why FROM (SELECT k.*, r.root AS r_root, r.number AS r_number, r.color AS r_color, CASE WHEN r.number IS NULL THEN 'number' WHEN k.color <> r.color THEN 'color' END AS why FROM elike k JOIN eroot r ON r.match_id = k.match_id AND r.track_id = k.other) t",
}
_MON = {
    "mlog": "SELECT user_id AS video_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' ELSE CASE WHEN value > 90 THEN 'db_error' WHEN value > 50 THEN 'api_error' ELSE 'call' END END AS event, epoch_us(ts) / 1e6 AS tm, event_id AS seq, event_id % 50 * 100 AS frames FROM events",
    "mlife": "SELECT *, was = 'start' AND event <> 'start' AS ended FROM (SELECT *, lag(event) OVER w AS was, lag(tm) OVER w AS since FROM mlog WHERE event IN ('start', 'complete', 'failed') WINDOW w AS (PARTITION BY video_id ORDER BY tm, seq)) t",
    "mrecent": "SELECT round(avg(tm - since), 2) AS mean_duration_s, round(avg(CASE WHEN frames > 0 AND tm > since THEN frames / (tm - since) END), 2) AS mean_frame_rate FROM (SELECT * FROM mlife WHERE ended AND event = 'complete' ORDER BY tm DESC, seq DESC LIMIT 100) t",
    "mtotal": "SELECT count(*) FILTER (WHERE ended AND event = 'complete') AS processed, count(*) FILTER (WHERE ended AND event = 'failed') AS failed, count(*) FILTER (WHERE event = 'start') - count(*) FILTER (WHERE ended) AS running FROM mlife",
    "merrors": "SELECT count(*) FILTER (WHERE event = 'db_error') AS db_errors, count(*) FILTER (WHERE event = 'api_error') AS api_errors FROM mlog",
}
_KITS = {
    "kcount": "SELECT match_id, cls, color, count(*) AS n FROM color_obs WHERE color <> 'Unknown' GROUP BY ALL",
    "krank": "SELECT *, row_number() OVER (PARTITION BY match_id, cls ORDER BY n DESC, color) AS k FROM kcount",
    "kref": "SELECT match_id, color FROM krank r WHERE cls = 3 AND k = 1 AND NOT EXISTS (SELECT 1 FROM krank g WHERE g.match_id = r.match_id AND g.cls = 1 AND g.k <= 2 AND g.color = r.color)",
    "kleft": "SELECT match_id, color, n, row_number() OVER (PARTITION BY match_id ORDER BY n DESC, color) AS place FROM krank r WHERE cls = 2 AND k <= 4 AND NOT EXISTS (SELECT 1 FROM kref f WHERE f.match_id = r.match_id AND f.color = r.color)",
    "kgiven": "SELECT DISTINCT match_id, color, place FROM frames, (VALUES ('White', 1), ('Purple', 2)) v(color, place) WHERE match_id % 3 = 1",
}
ORACLE = {
    "forced_kits": sql("SELECT match_id, color, n, CAST(place AS INT) AS place FROM kleft WHERE place <= 2 AND match_id % 3 <> 1 UNION ALL SELECT g.match_id, g.color, coalesce(c.n, 0) AS n, g.place FROM kgiven g LEFT JOIN kcount c ON c.match_id = g.match_id AND c.color = g.color AND c.cls = 2", _KITS),
    "processing_state": sql("SELECT *, CASE WHEN running > 10 THEN 'degraded' WHEN db_errors > 5 THEN 'unhealthy' WHEN failed > processed THEN 'unhealthy' ELSE 'healthy' END AS state FROM mtotal, merrors, mrecent", _MON),
    "reid_by_look": sql("SELECT match_id, track_id, root, number, rejected FROM eroot", _SEEN),
    "reid_by_color": sql("SELECT match_id, track_id, root, number FROM (SELECT e.match_id, e.track_id, f.track_id AS root, f.number, row_number() OVER (PARTITION BY e.match_id, e.track_id ORDER BY f.track_id) AS rn FROM etracks e JOIN etracks f ON f.match_id = e.match_id AND f.color = e.color AND f.number IS NOT NULL WHERE e.number IS NULL) t WHERE rn = 1", _SEEN),
    "project_moving": sql("SELECT p.match_id, p.frame_idx, box_idx, round(CASE WHEN m.frame_idx IS NULL THEN x * (105e0/1920) ELSE (x*h0 + y*h1 + h2) / (x*h6 + y*h7 + h8) END, 4) AS mx, round(CASE WHEN m.frame_idx IS NULL THEN y * (68e0/1080) ELSE (x*h3 + y*h4 + h5) / (x*h6 + y*h7 + h8) END, 4) AS my FROM pts p ASOF LEFT JOIN mats m ON m.match_id = p.match_id AND m.frame_idx <= p.frame_idx", {"pts": "SELECT match_id, frame_idx, box_idx, (x1+x2)/2 AS x, (y1+y2)/2 AS y FROM detections", "mats": "SELECT match_id, frame_idx, " + ", ".join(f"{h} AS h{i}" for i, h in enumerate(_H)) + " FROM frames WHERE frame_idx % 60 = 30"}),
    "ocr_window_lock": sql("SELECT match_id, track_id, s.number AS number, s.first_number AS first_number, s.locked_at AS locked_at, s.changed_at AS changed_at, s.flips AS flips, s.refused AS refused FROM folded", _LOCK),
    "segment_peak_shot": sql("SELECT s.match_id, s.frame_idx, s.track_id, round(v, 4) AS speed, p.track_id IS NOT NULL AS pressed, round(greatest(0.02, least(0.75, CASE WHEN p.track_id IS NOT NULL THEN 0.75e0 ELSE 1e0 END / (1 + exp(-(-3.2 + 4.8*(1 - greatest(0, least(1, least(n1, n2) / (0.6e0*1920)))) + 1.8 * (acos(greatest(-1, least(1, dot/(n1*n2)))) / pi())))))), 4) AS xg FROM pshots s LEFT JOIN ppress p ON p.match_id = s.match_id AND p.frame_idx = s.frame_idx AND p.track_id = s.track_id WHERE least(n1, n2) <= 0.5e0 * 1920", _PEAK),
    "transition_tackle": sql("SELECT match_id, frame_idx, track_id, on_track FROM tturn", _TURN),
    "random_frames": sql("SELECT match_id, frame_idx FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY md5(match_id || '-' || frame_idx || '-7'), frame_idx) AS rn FROM frames) t WHERE rn <= 50"),
    "first_jobs": sql("SELECT task_id, unique_id, status FROM jobs ORDER BY updated_at, task_id LIMIT 25"),
    "status_upsert": sql("SELECT unique_id, arg_max(task_id, k) AS task_id, arg_max(status, k) AS status, round(arg_max(size_mb, k), 4) AS size_mb, epoch_us(max(updated_at)) AS updated_us, epoch_us(min(updated_at)) AS created_us FROM (SELECT *, struct_pack(a := updated_at, b := task_id) AS k FROM jobs) t GROUP BY unique_id"),
}
