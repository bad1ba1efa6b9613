"""Detections of many matches derived from the orders table, in Spark and as SQL for the comparison.

One match is 1,500 frames. 22 players and a referee move on zigzags, player 11 in a corner of the left end; the ball is
held, passed (by player 11 within a frame) and shot."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_REACH = "(CASE WHEN {p} IN (1,11,12) THEN 30 ELSE 150 END)"
_CX = (
    "(CASE WHEN {p}=1 THEN 120 WHEN {p}=12 THEN 1800 WHEN {p}=11 THEN 100 ELSE 250+(({p}*137) % 1400) END"
    " + abs((frame_idx*(2+{p}%5)+{p}*53+match_id*17) % (4*" + _REACH + ") - 2*" + _REACH + ") - " + _REACH + ")"
)
_CY = "(CASE WHEN {p} IN (1,12) THEN 540 WHEN {p}=11 THEN 90 ELSE 140+(({p}*211) % 800) END + abs((frame_idx*(1+{p}%4)+{p}*29+match_id*11) % 200 - 100) - 50)"


def _x(p: str) -> str:
    return _CX.format(p=p)


def _y(p: str) -> str:
    return _CY.format(p=p)


_BX = f"CASE WHEN j < 28 OR o = 11 THEN {_x('o')} + 8 WHEN k % 6 = 5 THEN {_x('o')} + 8 + (CASE WHEN {_x('o')} >= 960 THEN 1910 ELSE 10 END - {_x('o')} - 8) * least(j-27, 6) / 6e0 ELSE {_x('o')} + 8 + ({_x('n')} - {_x('o')}) * (j-27) / 13e0 END"
_BY = f"CASE WHEN j < 28 OR o = 11 THEN {_y('o')} WHEN k % 6 = 5 THEN {_y('o')} + (540 - {_y('o')}) * least(j-27, 6) / 6e0 ELSE {_y('o')} + ({_y('n')} - {_y('o')}) * (j-27) / 13e0 END"
_SEEN = "NOT (k % 6 <> 5 AND j BETWEEN 31 AND 34) AND NOT (k % 6 = 5 AND j > 35) AND NOT (k % 12 = 6 AND j < 36)"
_NUM = "CASE WHEN p <= 11 THEN p + 9 ELSE p + 7 END"
_READ = "CASE WHEN (frame_idx + p) % 9 <> 0 THEN num WHEN num % 10 = 1 THEN num + 6 WHEN num % 10 = 8 THEN num - 5 WHEN num < 20 THEN num + 60 ELSE num + 50 END"
_COLOR = "CASE WHEN (frame_idx + p*5) % 11 = 0 THEN CASE WHEN p % 2 = 0 THEN 'Orange' ELSE 'Unknown' END WHEN cls = 3 THEN 'Black' WHEN cls = 1 THEN CASE WHEN p = 1 THEN 'Yellow' ELSE 'Green' END WHEN p <= 11 THEN 'Red' ELSE 'White' END"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.selectExpr("CAST(o_orderkey DIV 1500 AS INT) AS match_id", "CAST(o_orderkey % 1500 AS INT) AS frame_idx")


#: Frames of a task; with their boxes about 100 MB, which sorts in memory.
FRAMES = 48_000


@lru_cache(maxsize=64)
def _tasks(application: str, sf_dir: str) -> int:
    return -(-frames(SparkSession.active(), sf_dir).count() // FRAMES)


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks share the matches: they grow with the table, a task doesn't. The count reads footers only."""
    return max(spark.sparkContext.defaultParallelism, _tasks(spark.sparkContext.applicationId, sf_dir))


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames dealt out by match. What is derived from them stays where it is: groups and windows within a match need no
    other shuffle, and joins of two such tables none either, once Spark may join by a part of the keys."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return frames(spark, sf_dir).repartition(tasks(spark, sf_dir), "match_id")


def men(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of players and referees. A narrow row becomes 23 wide ones, so the rows are dealt out, by match, before they
    grow."""
    men = spine(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(1), F.lit(23))).alias("p")).selectExpr("match_id", "frame_idx", "p", f"{_x('p')} AS cx", f"{_y('p')} AS cy")
    return men.selectExpr(
        "match_id", "frame_idx", "p - 1 AS box_idx", "CASE WHEN p=23 THEN 3 WHEN p IN (1,12) THEN 1 ELSE 2 END AS cls", "CAST(p*100 + (frame_idx + p*37) DIV 400 AS INT) AS track_id",
        "CAST(cx-15 AS DOUBLE) AS x1", "CAST(cy-40 AS DOUBLE) AS y1", "CAST(cx+15 AS DOUBLE) AS x2", "CAST(cy+40 AS DOUBLE) AS y2", "CAST(60+(p*7+frame_idx)%40 AS DOUBLE)/100 AS conf")


def balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of the ball, one in a frame at most."""
    turns = "CAST(1 + ((frame_idx DIV 40{d})*(frame_idx DIV 40{d})*3 + (frame_idx DIV 40{d})*7 + match_id*5) % 22 AS INT)"
    own = spine(spark, sf_dir).selectExpr("*", "frame_idx % 40 AS j", "frame_idx DIV 40 AS k", turns.format(d="") + " AS o", turns.format(d=" + 1") + " AS n")
    ball = own.filter(_SEEN).selectExpr("match_id", "frame_idx", f"{_BX} AS bx", f"{_BY} AS by_")
    return ball.selectExpr("match_id", "frame_idx", "23 AS box_idx", "32 AS cls", "CAST(NULL AS INT) AS track_id", "CAST(bx-6 AS DOUBLE) AS x1", "CAST(by_-6 AS DOUBLE) AS y1", "CAST(bx+6 AS DOUBLE) AS x2", "CAST(by_+6 AS DOUBLE) AS y2", "CAST(20+frame_idx%70 AS DOUBLE)/100 AS conf")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of all frames. Spark takes their size for that of the narrow rows that they come from and would send them to
    the driver and all tasks, hence the hint."""
    return men(spark, sf_dir).unionByName(balls(spark, sf_dir)).hint("merge")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = men(spark, sf_dir).filter("cls IN (1,2)").selectExpr("match_id", "frame_idx", "track_id", "track_id DIV 100 AS p").filter("(frame_idx + p*3) % 12 = 0")
    return rows.selectExpr("*", f"{_NUM} AS num").selectExpr("match_id", "frame_idx", "track_id", f"CAST({_READ} AS INT) AS number", "CAST(30 + (frame_idx*13 + p*7) % 65 AS DOUBLE)/100 AS confidence")


def color_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = men(spark, sf_dir).filter("cls IN (1,2,3)").selectExpr("match_id", "frame_idx", "track_id", "cls", "track_id DIV 100 AS p").filter("(frame_idx + p) % 10 = 0")
    return rows.selectExpr("match_id", "frame_idx", "track_id", "cls", f"{_COLOR} AS color")


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worn(men(spark, sf_dir).filter("cls IN (1,2)").select("match_id", "track_id").distinct())


def worn(tracks: DataFrame) -> DataFrame:
    """The teams of these tracks of players and keepers."""
    return tracks.selectExpr("match_id", "track_id", "CASE WHEN track_id DIV 100 <= 11 THEN 'Red' ELSE 'White' END AS team")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    status = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'finished' ELSE 'failed' END"
    return events.selectExpr("CAST(user_id AS STRING) AS unique_id", "event_id AS task_id", f"{status} AS status", "value AS size_mb", "props AS analysis", "CAST(ts AS TIMESTAMP) AS updated_at")


_PX, _PY = "CAST(105.0 AS DOUBLE) / 1920", "CAST(68.0 AS DOUBLE) / 1080"
#: The same tables, and those that the operators build, for DuckDB.
CTE = {
    "frames": "SELECT CAST(o_orderkey // 1500 AS INT) AS match_id, CAST(o_orderkey % 1500 AS INT) AS frame_idx FROM orders",
    "men": f"SELECT match_id, frame_idx, p, {_x('p')} AS cx, {_y('p')} AS cy FROM frames, (SELECT CAST(range AS INT) AS p FROM range(1, 24)) r",
    "own": "SELECT match_id, frame_idx, frame_idx % 40 AS j, frame_idx // 40 AS k, CAST(1 + ((frame_idx // 40)*(frame_idx // 40)*3 + (frame_idx // 40)*7 + match_id*5) % 22 AS INT) AS o, CAST(1 + ((frame_idx // 40 + 1)*(frame_idx // 40 + 1)*3 + (frame_idx // 40 + 1)*7 + match_id*5) % 22 AS INT) AS n FROM frames",
    "flight": f"SELECT match_id, frame_idx, {_BX} AS bx, {_BY} AS by_ FROM own WHERE {_SEEN}",
    "detections": "SELECT match_id, frame_idx, p - 1 AS box_idx, CASE WHEN p=23 THEN 3 WHEN p IN (1,12) THEN 1 ELSE 2 END AS cls, CAST(p*100 + (frame_idx + p*37) // 400 AS INT) AS track_id, CAST(cx-15 AS DOUBLE) AS x1, CAST(cy-40 AS DOUBLE) AS y1, CAST(cx+15 AS DOUBLE) AS x2, CAST(cy+40 AS DOUBLE) AS y2, CAST(60+(p*7+frame_idx)%40 AS DOUBLE)/100 AS conf FROM men UNION ALL SELECT match_id, frame_idx, 23, 32, NULL, CAST(bx-6 AS DOUBLE), CAST(by_-6 AS DOUBLE), CAST(bx+6 AS DOUBLE), CAST(by_+6 AS DOUBLE), CAST(20+frame_idx%70 AS DOUBLE)/100 FROM flight",
    "reads": f"SELECT match_id, frame_idx, track_id, CAST({_READ} AS INT) AS number, CAST(30 + (frame_idx*13 + p*7) % 65 AS DOUBLE)/100 AS confidence FROM (SELECT *, {_NUM} AS num FROM (SELECT match_id, frame_idx, track_id, track_id // 100 AS p FROM detections WHERE cls IN (1,2)) t WHERE (frame_idx + p*3) % 12 = 0) t",
    "color_obs": f"SELECT match_id, frame_idx, track_id, cls, {_COLOR} AS color FROM (SELECT match_id, frame_idx, track_id, cls, track_id // 100 AS p FROM detections WHERE cls IN (1,2,3)) t WHERE (frame_idx + p) % 10 = 0",
    "teams": "SELECT DISTINCT match_id, track_id, CASE WHEN track_id // 100 <= 11 THEN 'Red' ELSE 'White' END AS team FROM detections WHERE cls IN (1,2)",
    "jobs": "SELECT CAST(user_id AS VARCHAR) AS unique_id, event_id AS task_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'finished' ELSE 'failed' END AS status, value AS size_mb, props AS analysis, ts AS updated_at FROM events",
    "best_ball": "SELECT match_id, frame_idx, (x1+x2)/2 AS bx, (y1+y2)/2 AS by_ FROM (SELECT *, row_number() OVER (PARTITION BY match_id, frame_idx ORDER BY conf DESC, box_idx) AS rn FROM detections WHERE cls IN (0,32)) t WHERE rn = 1",
    "known": "SELECT f.match_id, f.frame_idx, b.bx, b.by_, last_value(CASE WHEN b.bx IS NOT NULL THEN f.frame_idx END IGNORE NULLS) OVER w AS fa, last_value(b.bx IGNORE NULLS) OVER w AS xa, last_value(b.by_ IGNORE NULLS) OVER w AS ya, first_value(CASE WHEN b.bx IS NOT NULL THEN f.frame_idx END IGNORE NULLS) OVER v AS fb, first_value(b.bx IGNORE NULLS) OVER v AS xb, first_value(b.by_ IGNORE NULLS) OVER v AS yb FROM frames f LEFT JOIN best_ball b USING (match_id, frame_idx) WINDOW w AS (PARTITION BY f.match_id ORDER BY f.frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY f.match_id ORDER BY f.frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
    "ball_px": "SELECT match_id, frame_idx, bx IS NOT NULL AS is_raw, CASE WHEN bx IS NOT NULL THEN bx WHEN fb - fa <= 30 THEN xa + (xb - xa) / (fb - fa) * (frame_idx - fa) END AS bx, CASE WHEN bx IS NOT NULL THEN by_ WHEN fb - fa <= 30 THEN ya + (yb - ya) / (fb - fa) * (frame_idx - fa) END AS by_ FROM known",
    "ball": f"SELECT *, bx * ({_PX}) AS mx, by_ * ({_PY}) AS my FROM ball_px",
    "boxes": f"SELECT match_id, frame_idx, box_idx, cls, track_id, (x1+x2)/2 * ({_PX}) AS px, (y1+y2)/2 * ({_PY}) AS py FROM detections WHERE track_id IS NOT NULL",
    "owners": "SELECT match_id, frame_idx, track_id AS owner, d FROM (SELECT *, row_number() OVER (PARTITION BY match_id, frame_idx ORDER BY d, box_idx) AS rn FROM (SELECT b.match_id, b.frame_idx, b.box_idx, b.track_id, sqrt((px-mx)*(px-mx) + (py-my)*(py-my)) AS d FROM boxes b JOIN ball USING (match_id, frame_idx) WHERE mx IS NOT NULL) t WHERE d <= 5) t WHERE rn = 1",
    "owned": "SELECT match_id, frame_idx, CASE WHEN frame_idx - lf <= 20 THEN lo END AS owner FROM (SELECT f.match_id, f.frame_idx, last_value(CASE WHEN o.owner IS NOT NULL THEN f.frame_idx END IGNORE NULLS) OVER w AS lf, last_value(o.owner IGNORE NULLS) OVER w AS lo FROM frames f LEFT JOIN owners o USING (match_id, frame_idx) WINDOW w AS (PARTITION BY f.match_id ORDER BY f.frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) t",
    "segs": 'SELECT match_id, seg_id, min(owner) AS owner, min(frame_idx) AS "start", max(frame_idx) AS "end" FROM (SELECT *, sum(c) OVER (PARTITION BY match_id ORDER BY frame_idx) AS seg_id FROM (SELECT *, CASE WHEN row_number() OVER w = 1 OR owner IS DISTINCT FROM lag(owner) OVER w THEN 1 ELSE 0 END AS c FROM owned WINDOW w AS (PARTITION BY match_id ORDER BY frame_idx)) t) t GROUP BY match_id, seg_id',
    "pairs": 'SELECT * FROM (SELECT match_id, owner AS a, "start" AS a_start, "end" AS a_end, lead(owner) OVER w AS b, lead("start") OVER w AS b_start, lead("end") OVER w AS b_end FROM segs WHERE owner IS NOT NULL WINDOW w AS (PARTITION BY match_id ORDER BY "start")) t WHERE a <> b AND a_end - a_start >= 3',
    "sides": "SELECT q.*, (SELECT arg_max(struct_pack(mx := l.mx, my := l.my), l.frame_idx) FROM ball l WHERE l.match_id = q.match_id AND l.mx IS NOT NULL AND l.frame_idx BETWEEN greatest(a_end - 7, a_start) AND a_end) AS s, (SELECT arg_min(struct_pack(mx := l.mx, my := l.my), l.frame_idx) FROM ball l WHERE l.match_id = q.match_id AND l.mx IS NOT NULL AND l.frame_idx BETWEEN b_start AND least(b_start + 7, b_end)) AS e, sqrt((x.px-y.px)*(x.px-y.px) + (x.py-y.py)*(x.py-y.py)) AS apart, ta.team AS a_team, tb.team AS b_team FROM pairs q LEFT JOIN boxes x ON x.match_id = q.match_id AND x.frame_idx = q.a_end AND x.track_id = q.a LEFT JOIN boxes y ON y.match_id = q.match_id AND y.frame_idx = q.a_end AND y.track_id = q.b LEFT JOIN teams ta ON ta.match_id = q.match_id AND ta.track_id = q.a LEFT JOIN teams tb ON tb.match_id = q.match_id AND tb.track_id = q.b",
    "trans": "SELECT *, CASE WHEN b_start - a_end > 25 THEN 'gap' WHEN apart < 0.8 THEN 'contact' WHEN distance IS NULL THEN 'no_ball' WHEN distance <= 3 THEN 'short' ELSE 'counted' END AS status, NOT coalesce(a_team <> b_team, FALSE) AS complete, coalesce(abs(s.my - 34) > 25 AND (e.mx > 88.5 OR e.mx < 16.5) AND abs(e.my - 34) < 20.15, FALSE) AS is_cross, CASE WHEN distance <= 16 THEN 'short' WHEN distance <= 30 THEN 'medium' ELSE 'long' END AS reach FROM (SELECT *, sqrt((s.mx-e.mx)*(s.mx-e.mx) + (s.my-e.my)*(s.my-e.my)) AS distance FROM sides) t",
    "classes": "SELECT match_id, track_id, cls AS dominant_class FROM (SELECT match_id, track_id, cls, row_number() OVER (PARTITION BY match_id, track_id ORDER BY count(*) DESC, min(frame_idx)) AS rn FROM boxes GROUP BY match_id, track_id, cls) t WHERE rn = 1",
    "resident": "SELECT match_id, track_id, count(*) FILTER (WHERE (px < 16.5 OR px > 88.5) AND py > 13.84 AND py < 54.16) AS frames_in_box, count(*) AS n, avg(px) AS avg_x, avg(py) AS avg_y FROM boxes GROUP BY match_id, track_id",
    "directions": "SELECT match_id, team, team_x, CASE WHEN k = 1 THEN 105.0 ELSE 0.0 END AS attacks_x FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY team_x, team) AS k, count(*) OVER (PARTITION BY match_id) AS teams FROM (SELECT r.match_id, team, avg(avg_x) AS team_x FROM resident r JOIN teams t ON r.match_id = t.match_id AND r.track_id = t.track_id WHERE n > 10 GROUP BY r.match_id, team) t) t WHERE teams >= 2 AND k <= 2",
    "fast": "SELECT match_id, frame_idx, x1, y1, x2, y2, sqrt((x1-x2)*(x1-x2) + (y1-y2)*(y1-y2)) / (2.0 / (25e0/3)) AS speed FROM (SELECT match_id, frame_idx, is_raw AND lag(is_raw, 2) OVER w AS raw, lag(mx, 2) OVER w AS x1, lag(my, 2) OVER w AS y1, mx AS x2, my AS y2 FROM ball WINDOW w AS (PARTITION BY match_id ORDER BY frame_idx)) t WHERE raw AND sqrt((x1-x2)*(x1-x2) + (y1-y2)*(y1-y2)) / (2.0 / (25e0/3)) > 16",
    "aimed": "SELECT f.*, CASE WHEN o.owner IS NOT NULL THEN o.owner ELSE o5.owner END AS track_id FROM (SELECT *, (y2-y1)/(x2-x1) AS slope FROM (SELECT *, CASE WHEN x2 > x1 THEN 105e0 WHEN x2 < x1 THEN 0e0 END AS goal_x FROM fast) t WHERE goal_x IS NOT NULL AND abs(x2-goal_x) <= 35 AND abs(x2-x1) > 0.1) f JOIN owned o ON o.match_id = f.match_id AND o.frame_idx = f.frame_idx LEFT JOIN owned o5 ON o5.match_id = f.match_id AND o5.frame_idx = f.frame_idx - 5 WHERE y2 + slope*(goal_x-x2) > 30.34 AND y2 + slope*(goal_x-x2) < 37.66",
    "tries": "SELECT a.* FROM aimed a JOIN classes c ON c.match_id = a.match_id AND c.track_id = a.track_id WHERE dominant_class <> 1",
}


def debounced(name: str, source: str, keys: str, gap: float, strict: bool = True, order: str = "frame_idx") -> dict[str, str]:
    """CTEs <name>: rows of source accepted one after another for each of keys."""
    op, ks = (">" if strict else ">="), [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"s.{k} IS NOT DISTINCT FROM a.{k}" for k in ks)
    own = ", ".join(f"s.{k}" for k in ks)
    return {
        f"{name}_n": f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source}",
        f"{name}_a": f"SELECT {keys}, rn, frame_idx AS last, TRUE AS ok FROM {name}_n WHERE rn = 1 UNION ALL SELECT {own}, s.rn, CASE WHEN s.frame_idx - a.last {op} {gap} THEN s.frame_idx ELSE a.last END, s.frame_idx - a.last {op} {gap} FROM {name}_a a JOIN {name}_n s ON {same} AND s.rn = a.rn + 1",
        name: f"SELECT s.* FROM {name}_n s JOIN {name}_a a ON {same} AND a.rn = s.rn WHERE a.ok",
    }


def sql(query: str, more: dict[str, str] | None = None) -> str:
    """query with the CTEs that it uses before it; those that several others read are computed once."""
    every, used, waiting = CTE | (more or {}), set(), [query]
    while waiting:
        words = set(re.findall(r"\w+", waiting.pop()))
        found = {k for k in every if k in words} - used
        used |= found
        waiting += [every[k] for k in found]
    if not used:
        return query
    once = {"detections", "ball", "boxes", "owned", "segs", "reads"}
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS {'MATERIALIZED ' if k in once else ''}({v})" for k, v in every.items() if k in used) + "\n" + query
