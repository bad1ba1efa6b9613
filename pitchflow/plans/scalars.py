"""Queries on expressions over single rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pitchflow.functions import geometry as g
from pitchflow.functions import labels as l
from pitchflow.operators import hygiene as op
from pitchflow.operators import play
from pitchflow.params import DEFAULT
from pitchflow.plans import fixture
from pitchflow.plans.fixture import sql

_ID = ["match_id", "frame_idx", "box_idx"]


def _boxes(s, d):
    return play.players(fixture.detections(s, d))


def bbox_geometry(s, d):
    x, y = g.center("x1", "y1", "x2", "y2")
    fx, fy = g.foot("x1", "y2", "x2")
    return fixture.detections(s, d).select(*_ID, x.alias("cx"), y.alias("cy"), fx.alias("foot_x"), fy.alias("foot_y"))


def project_point(s, d):
    x, y = g.center("x1", "y1", "x2", "y2")
    h = [DEFAULT.pitch_x / DEFAULT.width, 0.0, 0.0, 0.0, DEFAULT.pitch_y / DEFAULT.height, 0.0, 0.0001, 0.0, 1.0]
    mx, my = g.project(x, y, h)
    return fixture.detections(s, d).select(*_ID, F.round(mx, 4).alias("mx"), F.round(my, 4).alias("my"))


def pitch_zones(s, d):
    x, y = F.col("px"), F.col("py")
    n = lambda c, name: F.count_if(c).alias(name)
    return _boxes(s, d).groupBy("match_id", "track_id").agg(n(g.in_penalty_box(x, y), "in_penalty_box"), n(g.in_box_strict(x, y), "in_box"), n(g.side_channel(y), "in_side_channel"), n(g.in_zone(x, y, 35.0, 17.0, 70.0, 51.0), "in_middle"))


def shot_geometry(s, d):
    x, y = F.col("px"), F.col("py")
    r = lambda c, name: F.round(c, 4).alias(name)
    rows = _boxes(s, d)
    return rows.select("match_id", "frame_idx", "track_id", r(g.shot_cone(x, y), "cone"), r(g.goal_distance(x, y), "goal_distance"), r(g.angle_between(-x, 34 - y, 105 - x, 34 - y), "between_goals"), r(g.xg(x, y), "xg"), r(g.xg(x, y, header=F.lit(True), pressed=F.col("track_id") % 2 == 0), "header_xg"))


def pixel_xg(s, d):
    x, y = g.center("x1", "y1", "x2", "y2")
    return fixture.detections(s, d).filter("cls <> 32").select(*_ID, F.round(g.pixel_xg(x, y), 4).alias("xg"))


def box_filters(s, d):
    n = lambda c, name: F.count_if(c).alias(name)
    return fixture.detections(s, d).groupBy("match_id", "cls").agg(F.count("*").alias("boxes"), n(g.valid_box(), "valid"), n(g.strict_box(), "strict"), n(F.col("conf") >= 0.45, "high"), n((F.col("conf") > 0.08) & (F.col("conf") < 0.45), "low"), n((F.col("cls") == 32) & (F.col("conf") >= 0.15), "ball"))


def frame_sampling(s, d):
    return fixture.detections(s, d).filter((F.col("frame_idx") % 3 == 0) & (F.col("frame_idx") <= 900)).groupBy("match_id").agg(F.count("*").alias("boxes"), F.countDistinct("frame_idx").alias("frames"))


def box_pairs(s, d):
    return op.overlapping(fixture.detections(s, d).filter("cls <> 32")).withColumn("iou", F.round("iou", 4)).withColumn("apart", F.round("apart", 4))


def _hsv(s, d):
    part = s.read.parquet(f"{d}/part.parquet").select("p_partkey")
    return part.selectExpr("p_partkey", "p_partkey * 7 % 181 AS h", "p_partkey * 13 % 256 AS s", "p_partkey * 29 % 256 AS v")


def color_labels(s, d):
    h, sat, v = F.col("h"), F.col("s"), F.col("v")
    return _hsv(s, d).select("p_partkey", l.kit_color(h, sat, v).alias("kit"), l.describe_color(h, sat / 255, v / 255).alias("described"), l.rgb_label(h, sat, v).alias("rgb"), F.when(((h < 15) | (h > 165)) & (sat > 50), "Red").otherwise("White").alias("red_or_white"))


def hue_feature(s, d):
    angle = F.col("h") * (math.pi / 90)
    return _hsv(s, d).select("p_partkey", F.round(F.cos(angle), 4).alias("cos_h"), F.round(F.sin(angle), 4).alias("sin_h"))


_NAMES = ("maroon", " Pink", "RED", "navy", "Sky", "lime", "gold", "gray", "White", "black", "", "teal")


def canonical_color(s, d):
    at = lambda k: F.element_at(F.array(*map(F.lit, _NAMES)), (k % len(_NAMES) + 1).cast("int"))
    a, b = at(F.col("p_partkey")), at(F.col("p_partkey") / 12)
    return _hsv(s, d).select("p_partkey", l.canonical_color(a).alias("canonical"), l.hue_distance(F.trim(a), F.trim(b)).cast("int").alias("apart"), l.nearest_kit(F.initcap(F.trim(a)), F.array(F.lit("Red"), F.lit("Green"))).alias("kit"))


def jersey_from_text(s, d):
    return s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", l.digits_number(F.col("text")).alias("digits"), l.first_number(F.col("text")).alias("first"), F.length(F.regexp_replace("text", "[^0-9]", "")).alias("n_digits"))


def plausible_misread(s, d):
    read = fixture.reads(s, d).select("number").distinct()
    pairs = read.select(F.col("number").alias("a")).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(99))))
    return pairs.filter(l.plausible_misread(F.col("a"), F.col("b")))


def confidence_tiers(s, d):
    c = F.col("confidence")
    return fixture.reads(s, d).groupBy("match_id", l.confidence_tier(c).alias("tier")).agg(F.count("*").alias("n"), F.round(F.sum(l.tier_score(F.when(c >= 0.8, "high").when(c >= 0.5, "medium").otherwise("low"))), 4).alias("score"))


def class_decision(s, d):
    raw = F.transform("embedding", lambda x: F.exp(x.cast("double") * 20))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    rows = s.read.parquet(f"{d}/embeddings.parquet").withColumn("raw", raw).withColumn("total", total)
    rows = rows.withColumn("d", l.class_decision(F.transform("raw", lambda x: x / F.col("total"))))
    return rows.select("vec_id", "d.number", F.round("d.confidence", 4).alias("confidence"), F.round("d.entropy", 4).alias("entropy"), "d.status")


def url_key(s, d):
    url = F.col("url")
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", l.url_key(url).alias("key"), l.owner_of_path(F.regexp_replace(url, "^https?://", "")).alias("owner"))


def size_range(s, d):
    jobs = fixture.jobs(s, d)
    return jobs.filter((F.col("size_mb") * 1048576 / 1048576).between(5.0, 50.0)).groupBy("status").agg(F.count("*").alias("n"))


def crop_gates(s, d):
    w, h, sharp = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("conf") * 100
    n = lambda c, name: F.count_if(c).alias(name)
    return fixture.detections(s, d).groupBy("match_id", "cls").agg(n((h >= 20) & (w >= 10) & (sharp >= 20), "plain"), n((h >= 30) & (sharp >= 50), "strict"), n((h >= 30) & (w >= 20) & (sharp >= 20) & (F.col("conf") >= 0.65), "legible"))


QUERIES = {f.__name__: f for f in (bbox_geometry, project_point, pitch_zones, shot_geometry, pixel_xg, box_filters, frame_sampling, box_pairs, color_labels, hue_feature, canonical_color, jersey_from_text, plausible_misread, confidence_tiers, class_decision, url_key, size_range, crop_gates)}

_B = "boxes"
_XG = "SELECT *, CASE WHEN a0 < 0 THEN a0 + pi() ELSE a0 END AS an FROM (SELECT *, atan2(CAST(7.32 AS DOUBLE)*gx, gx*gx + gc*gc - CAST(3.66 AS DOUBLE)*CAST(3.66 AS DOUBLE)) AS a0 FROM (SELECT *, greatest(abs(px - CASE WHEN abs(px-105) < abs(px) THEN 105e0 ELSE 0e0 END), 0.5) AS gx, abs(py-34) AS gc, CASE WHEN px > 52.5 THEN 105e0 ELSE 0e0 END AS sx FROM boxes) t) t"
_ODDS = "1 / (1 + exp(-(0.5103 + 0.6338*an - 0.2798*sqrt(gx*gx+gc*gc) + 0.1243*gx - 0.03*gc + 0.0014*gx*gx + 0.0041*gc*gc - 0.1251*an*gx)))"
_RANGES = " ".join(f"WHEN h BETWEEN {a} AND {b} AND s BETWEEN {c} AND {e} AND v BETWEEN {f} AND {k} THEN '{l.KIT_MERGE.get(n, n)}'" for n, (a, b, c, e, f, k) in l.HSV_RANGES)
_FALL = " ".join(f"WHEN h < {a} THEN '{n}'" for a, n in l.HUE_FALLBACK)
_BASIC = "CASE " + " ".join(f"WHEN h < {a} THEN '{n}'" for a, n in l.BASIC_HUES) + " ELSE 'red' END"
_COLORS = "(SELECT p_partkey, p_partkey * 7 % 181 AS h, p_partkey * 13 % 256 AS s, p_partkey * 29 % 256 AS v FROM part) t"
_SYN = "CASE lower(trim(a)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in l.SYNONYMS.items()) + " ELSE upper(trim(a)[1]) || lower(trim(a))[2:] END"
_HUE = "CASE lower(trim({c})) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in l.REFERENCE_HUES.items()) + " END"
_LIST = "[" + ", ".join(f"'{x}'" for x in _NAMES) + "]"
_APART = "least(abs(ha-hb), 180-abs(ha-hb))"
_F = "count(*) FILTER (WHERE {c}) AS {n}"


def _counts(pairs: dict[str, str]) -> str:
    return ", ".join(_F.format(c=c, n=n) for n, c in pairs.items())


ORACLE = {
    "bbox_geometry": sql("SELECT match_id, frame_idx, box_idx, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy, (x1+x2)/2 AS foot_x, y2 AS foot_y FROM detections"),
    "project_point": sql("SELECT match_id, frame_idx, box_idx, round(x * (105e0/1920) / (x*0.0001 + 1), 4) AS mx, round(y * (68e0/1080) / (x*0.0001 + 1), 4) AS my FROM (SELECT *, (x1+x2)/2 AS x, (y1+y2)/2 AS y FROM detections) t"),
    "pitch_zones": sql("SELECT match_id, track_id, " + _counts({"in_penalty_box": "(px BETWEEN 0 AND 16.5 OR px BETWEEN 88.5 AND 105) AND py BETWEEN 34 - 20.15e0 AND 34 + 20.15e0", "in_box": "(px < 16.5 OR px > 88.5) AND py > 13.84 AND py < 54.16", "in_side_channel": "py < 68e0*0.15e0 OR py > 68e0*0.85e0", "in_middle": "px BETWEEN 35 AND 70 AND py BETWEEN 17 AND 51"}) + " FROM boxes GROUP BY match_id, track_id"),
    "shot_geometry": sql(f"SELECT match_id, frame_idx, track_id, round(degrees(acos(greatest(-1, least(1, ((sx-px)*(sx-px) + (30.34e0-py)*(37.66e0-py)) / (sqrt((sx-px)*(sx-px) + (30.34e0-py)*(30.34e0-py)) * sqrt((sx-px)*(sx-px) + (37.66e0-py)*(37.66e0-py))))))), 4) AS cone, round(least(sqrt(px*px + (py-34)*(py-34)), sqrt((px-105)*(px-105) + (py-34)*(py-34))), 4) AS goal_distance, round(acos(greatest(-1, least(1, ((-px)*(105-px) + (34-py)*(34-py)) / (sqrt(px*px + (34-py)*(34-py)) * sqrt((105-px)*(105-px) + (34-py)*(34-py)))))), 4) AS between_goals, round(least(0.95, greatest(0.01, {_ODDS})), 4) AS xg, round(least(0.95, greatest(0.01, {_ODDS} * 0.6e0 * CASE WHEN track_id % 2 = 0 THEN 0.75e0 ELSE 1e0 END)), 4) AS header_xg FROM q", {"q": _XG}),
    "pixel_xg": sql("SELECT match_id, frame_idx, box_idx, round(greatest(0.02, least(0.75, 1 / (1 + exp(-(-3.2 + 4.8*(1 - greatest(0, least(1, least(n1, n2) / (0.6e0*1920)))) + 1.8 * (acos(greatest(-1, least(1, dot/(n1*n2)))) / pi())))))), 4) AS xg FROM (SELECT *, sqrt((l-x)*(l-x) + (540-y)*(540-y)) AS n1, sqrt((r-x)*(r-x) + (540-y)*(540-y)) AS n2, (l-x)*(r-x) + (540-y)*(540-y) AS dot FROM (SELECT *, (x1+x2)/2 AS x, (y1+y2)/2 AS y, 0.12e0*1920 AS l, 0.88e0*1920 AS r FROM detections WHERE cls <> 32) t) t"),
    "box_filters": sql("SELECT match_id, cls, count(*) AS boxes, " + _counts({"valid": "x1 >= 0 AND x1 < x2 AND x2 <= 1920 AND y1 >= 0 AND y1 < y2 AND y2 <= 1080", "strict": "x2 > x1 AND y2 > y1 AND x1 >= 30 AND y1 >= 30 AND x2 <= 1890 AND y2 <= 1050 AND (x2-x1)/(y2-y1) BETWEEN 0.2 AND 4", "high": "conf >= 0.45", "low": "conf > 0.08 AND conf < 0.45", "ball": "cls = 32 AND conf >= 0.15"}) + " FROM detections GROUP BY match_id, cls"),
    "frame_sampling": sql("SELECT match_id, count(*) AS boxes, count(DISTINCT frame_idx) AS frames FROM detections WHERE frame_idx % 3 = 0 AND frame_idx <= 900 GROUP BY match_id"),
    "box_pairs": sql("SELECT match_id, frame_idx, a_id, b_id, round(iou, 4) AS iou, inside, round(apart, 4) AS apart FROM (SELECT *, iw*ih / (aa + ba - iw*ih + 1e-6) AS iou FROM (SELECT a.match_id, a.frame_idx, a.track_id AS a_id, b.track_id AS b_id, least(a.x2,b.x2)-greatest(a.x1,b.x1) AS iw, least(a.y2,b.y2)-greatest(a.y1,b.y1) AS ih, (a.x2-a.x1)*(a.y2-a.y1) AS aa, (b.x2-b.x1)*(b.y2-b.y1) AS ba, a.x1 >= b.x1 AND a.y1 >= b.y1 AND a.x2 <= b.x2 AND a.y2 <= b.y2 AS inside, sqrt(((a.x1+a.x2)/2-(b.x1+b.x2)/2)*((a.x1+a.x2)/2-(b.x1+b.x2)/2) + ((a.y1+a.y2)/2-(b.y1+b.y2)/2)*((a.y1+a.y2)/2-(b.y1+b.y2)/2)) / greatest(1, b.x2-b.x1, b.y2-b.y1) AS apart FROM celled a JOIN celled b ON a.match_id = b.match_id AND a.frame_idx = b.frame_idx AND a.cell = b.cell AND a.track_id < b.track_id AND a.cell = greatest(a.low, b.low) WHERE least(a.x2,b.x2) > greatest(a.x1,b.x1) AND least(a.y2,b.y2) > greatest(a.y1,b.y1)) t) t WHERE iou > 0.05", {"celled": "SELECT *, unnest(range(low, CAST(floor(x2 / 64) AS BIGINT) + 1)) AS cell FROM (SELECT *, CAST(floor(x1 / 64) AS BIGINT) AS low FROM detections WHERE cls <> 32) t"}),
    "color_labels": f"SELECT p_partkey, CASE WHEN s <= 70 AND v > 150 THEN 'White' WHEN s <= 70 AND v < 80 THEN 'Black' WHEN s <= 70 THEN 'White' {_RANGES} WHEN h > 165 THEN 'Red' {_FALL} ELSE 'Red' END AS kit, CASE WHEN s/255.0 < 0.25 THEN CASE WHEN v/255.0 > 0.75 THEN 'white' WHEN v/255.0 < 0.35 THEN 'black' ELSE 'gray' END WHEN v/255.0 > 0.8 THEN 'light_' || {_BASIC} WHEN v/255.0 < 0.35 THEN 'dark_' || {_BASIC} ELSE {_BASIC} END AS described, CASE WHEN h > 200 AND s > 200 AND v > 200 THEN 'White' WHEN h < 50 AND s < 50 AND v < 50 THEN 'Black' WHEN h > 150 AND s < 100 AND v < 100 THEN 'Red' WHEN v > 150 AND h < 100 AND s < 100 THEN 'Blue' WHEN h > 200 AND s > 200 AND v < 100 THEN 'Yellow' WHEN s > 150 AND h < 100 AND v < 100 THEN 'Green' ELSE 'Unknown' END AS rgb, CASE WHEN (h < 15 OR h > 165) AND s > 50 THEN 'Red' ELSE 'White' END AS red_or_white FROM {_COLORS}",
    "hue_feature": f"SELECT p_partkey, round(cos(h * (pi()/90)), 4) AS cos_h, round(sin(h * (pi()/90)), 4) AS sin_h FROM {_COLORS}",
    "canonical_color": f"SELECT p_partkey, CASE WHEN trim(a) <> '' THEN {_SYN} END AS canonical, coalesce({_APART}, 180) AS apart, CASE WHEN i IN ('Red', 'Green') THEN i WHEN least(ha, 180-ha) <= 30 AND least(ha, 180-ha) <= abs(ha-60) THEN 'Red' WHEN least(abs(ha-60), 180-abs(ha-60)) <= 30 THEN 'Green' ELSE i END AS kit FROM (SELECT *, upper(trim(a)[1]) || lower(trim(a))[2:] AS i, {_HUE.format(c='a')} AS ha, {_HUE.format(c='b')} AS hb FROM (SELECT p_partkey, {_LIST}[p_partkey % 12 + 1] AS a, {_LIST}[CAST(floor(p_partkey / 12.0 % 12 + 1) AS INT)] AS b FROM part) t) t",
    "jersey_from_text": "SELECT conv_id, turn, CASE WHEN len(dg) BETWEEN 1 AND 2 AND TRY_CAST(dg AS INT) BETWEEN 1 AND 99 THEN TRY_CAST(dg AS INT) END AS digits, CASE WHEN len(fr) BETWEEN 1 AND 9 AND TRY_CAST(fr AS INT) BETWEEN 1 AND 99 THEN TRY_CAST(fr AS INT) END AS first, CAST(len(dg) AS INT) AS n_digits FROM (SELECT *, regexp_replace(text, '[^0-9]', '', 'g') AS dg, regexp_extract(text, '[0-9]+') AS fr FROM conversations) t",
    "plausible_misread": sql("SELECT a, b FROM (SELECT *, CAST(a AS VARCHAR) AS x, CAST(b AS VARCHAR) AS y FROM (SELECT DISTINCT number AS a FROM reads) r, (SELECT CAST(range AS INT) AS b FROM range(1, 100)) n) t WHERE len(x) = len(y) AND ((len(x) = 1 AND x <> y AND list_contains(ps, x || y)) OR (len(x) = 2 AND ((x[1] <> y[1] AND x[2] = y[2] AND list_contains(ps, x[1] || y[1])) OR (x[1] = y[1] AND x[2] <> y[2] AND list_contains(ps, x[2] || y[2])))))".replace("ps,", "[" + ", ".join(f"'{q}'" for p in l.CONFUSABLE for q in (p, p[::-1])) + "],")),
    "confidence_tiers": sql("SELECT match_id, CASE WHEN confidence >= 0.8 THEN 3 WHEN confidence >= 0.5 THEN 2 ELSE 1 END AS tier, count(*) AS n, round(sum(CASE WHEN confidence >= 0.8 THEN 0.9e0 WHEN confidence >= 0.5 THEN 0.6e0 ELSE 0.3e0 END), 4) AS score FROM reads GROUP BY match_id, tier"),
    "class_decision": "SELECT vec_id, CASE WHEN ok THEN number END AS number, round(CASE WHEN ok THEN c ELSE 0 END, 4) AS confidence, round(entropy, 4) AS entropy, CASE WHEN ok THEN 'valid' ELSE 'unknown' END AS status FROM (SELECT *, c >= 0.2 AND entropy <= 4 AS ok FROM (SELECT *, list_max(p) * CASE WHEN number = 1 THEN 0.9e0 ELSE 1e0 END AS c, -list_sum(list_transform(p, lambda x: x * ln(x + 1e-10))) AS entropy FROM (SELECT *, CAST(list_position(p, list_max(p)) - 1 AS INT) AS number FROM (SELECT vec_id, list_transform(raw, lambda x: x / list_sum(raw)) AS p FROM (SELECT vec_id, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) * 20)) AS raw FROM embeddings) t) t) t) t) t",
    "url_key": "SELECT page_id, sha1(CASE WHEN starts_with(url, 'http') THEN regexp_replace(url, '[?#].*$', '') ELSE url END) AS key, CASE WHEN split_part(u, '/', 2) <> '' THEN split_part(u, '/', 2) WHEN contains(u, '_') THEN split_part(u, '_', 1) ELSE 'unknown' END AS owner FROM (SELECT *, regexp_replace(url, '^https?://', '') AS u FROM pages) t",
    "size_range": sql("SELECT status, count(*) AS n FROM jobs WHERE size_mb * 1048576 / 1048576 BETWEEN 5 AND 50 GROUP BY status"),
    "crop_gates": sql("SELECT match_id, cls, " + _counts({"plain": "y2-y1 >= 20 AND x2-x1 >= 10 AND conf*100 >= 20", "strict": "y2-y1 >= 30 AND conf*100 >= 50", "legible": "y2-y1 >= 30 AND x2-x1 >= 20 AND conf*100 >= 20 AND conf >= 0.65"}) + " FROM detections GROUP BY match_id, cls"),
}
