"""Track quality, stitching and pair operators; gallery search on embeddings; job tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchflow.functions import geometry as g

FRAME, TRACK = ["match_id", "frame_idx"], ["match_id", "track_id"]


def lifetimes(boxes: DataFrame) -> DataFrame:
    """First and last frame and foot position of each track."""
    x, y = (F.col("x1") + F.col("x2")) / 2, F.col("y2")
    at = F.struct(x.alias("x"), y.alias("y"))
    return boxes.groupBy(*TRACK).agg(F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last"), F.min_by(at, "frame_idx").alias("from"), F.max_by(at, "frame_idx").alias("to"), F.count("*").alias("n"))


def length_stats(lives: DataFrame) -> DataFrame:
    p = lambda q, name: F.percentile("n", F.lit(q)).alias(name)
    return lives.groupBy("match_id").agg(F.count("*").alias("tracks"), p(0.1, "p10"), p(0.5, "median"), p(0.9, "p90"), F.avg((F.col("n") < 5).cast("double")).alias("short_share"), F.round(1000 * F.count("*") / (F.max("last") + 1), 4).alias("new_per_1000"))


def length_histogram(lives: DataFrame, limits: tuple[int, ...] = (5, 15, 50, 100, 300, 1000)) -> DataFrame:
    bin_ = F.lit(0)
    for limit in limits:
        bin_ = bin_ + (F.col("n") >= limit).cast("int")
    return lives.groupBy("match_id", bin_.alias("bin")).agg(F.count("*").alias("tracks"))


def dropout(frames: DataFrame, boxes: DataFrame, expected: int = 16) -> DataFrame:
    """Share of all frames with fewer than expected tracks, and mean tracks of a frame; frames without a box have none."""
    found = boxes.groupBy(*FRAME).agg(F.count_distinct("track_id").alias("tracks"))
    per_frame = frames.select(*FRAME).join(found, FRAME, "left").fillna(0, ["tracks"])
    return per_frame.groupBy("match_id").agg(F.avg((F.col("tracks") < expected).cast("double")).alias("dropout"), F.avg("tracks").alias("mean_tracks"))


def map_totals(rows: DataFrame, column: str) -> DataFrame:
    """Sum of each key of a map column."""
    return rows.select(F.explode(column).alias("reason", "n")).groupBy("reason").agg(F.sum("n").alias("n"))


def _pair(boxes: DataFrame, prefix: str) -> DataFrame:
    return boxes.select(*FRAME, F.col("track_id").alias(f"{prefix}id"), *[F.col(c).alias(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")])


def ghost_spawns(boxes: DataFrame, age: int = 5, overlap: float = 0.15) -> DataFrame:
    """Boxes of tracks of at most age frames that overlap an older track's box."""
    born = boxes.groupBy(*TRACK).agg(F.min("frame_idx").alias("born"))
    aged = boxes.join(born, TRACK).withColumn("young", F.col("frame_idx") - F.col("born") <= age)
    new, old = aged.filter("young and born > 0"), aged.filter("not young")
    pairs = _pair(new, "a_").join(_pair(old, "b_").hint("merge"), FRAME).filter(g.iou("a_", "b_") > overlap)
    return pairs.select(*FRAME, F.col("a_id").alias("track_id")).distinct()


def greedy_match(pairs: DataFrame, keys: list[str], least: float = 0.3) -> DataFrame:
    """pairs(keys, a_id, b_id, iou): again and again the largest pair whose sides are both free. A fold over a frame's
    sorted candidates, of which there are few."""
    listed = pairs.filter(F.col("iou") > least).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("k"), "a_id", "b_id"))).alias("all"))
    fold = "aggregate(slice(all, 2, size(all)), slice(all, 1, 1), (acc, x) -> CASE WHEN exists(acc, y -> y.a_id = x.a_id OR y.b_id = x.b_id) THEN acc ELSE array_append(acc, x) END)"
    return listed.select(*keys, F.expr(f"inline({fold})")).select(*keys, "a_id", "b_id", (-F.col("k")).alias("iou"))


def stitch(lives: DataFrame, known: DataFrame, gap: int = 60, reach: float = 300.0) -> DataFrame:
    """Each unknown track's best identified neighbour in time, before or after: smallest gap, then distance.

    Frames fall into buckets of gap frames, and a track meets only the same and the next bucket."""
    bucket = lambda c: (F.col(c) / gap).cast("int")
    named = lives.join(known.select(*TRACK), TRACK, "left_semi").select("match_id", F.col("track_id").alias("other"), F.col("first").alias("o_first"), F.col("last").alias("o_last"), F.col("from").alias("o_from"), F.col("to").alias("o_to"))
    lost = lives.join(known.select(*TRACK), TRACK, "left_anti")
    near = lambda c: F.explode(F.array(*[bucket(c) + i for i in (-1, 0, 1)])).alias("bucket")
    after = lost.select("*", near("first")).join(named.withColumn("bucket", bucket("o_last")), ["match_id", "bucket"])
    after = after.withColumn("gap", F.col("first") - F.col("o_last")).withColumn("d", g.distance(F.col("from.x"), F.col("from.y"), F.col("o_to.x"), F.col("o_to.y")))
    before = lost.select("*", near("last")).join(named.withColumn("bucket", bucket("o_first")), ["match_id", "bucket"])
    before = before.withColumn("gap", F.col("o_first") - F.col("last")).withColumn("d", g.distance(F.col("to.x"), F.col("to.y"), F.col("o_from.x"), F.col("o_from.y")))
    both = after.select(*TRACK, "other", "gap", "d").unionByName(before.select(*TRACK, "other", "gap", "d")).filter((F.col("gap") > 0) & (F.col("gap") < gap) & (F.col("d") < reach))
    return both.groupBy(*TRACK).agg(F.min(F.struct("gap", "d", "other")).alias("b")).select(*TRACK, "b.other", "b.gap", "b.d")


def top_fragments(rows: DataFrame, keys: list[str], *best: Column, most: int = 20) -> DataFrame:
    """The best rows of each key, so many at most, with their places."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).filter(F.col("place") <= most)


def keep_first(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Union by key; rows of first win."""
    return first.unionByName(second.join(first.select(*keys), keys, "left_anti"))


# --- embeddings


def mean_embedding(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Element-wise mean of each key's vectors, summed up before anything is shuffled."""
    mean = Summarizer.mean(array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return rows.groupBy(*keys).agg(vector_to_array(mean).alias("mean"))


def let(value: Column, body) -> Column:
    """Bind value once inside an expression: a lambda variable is never inlined and evaluated again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalized(v: Column) -> Column:
    norm = lambda w: F.sqrt(F.aggregate(w, F.lit(0.0), lambda a, x: a + x * x))
    return let(v, lambda w: let(norm(w), lambda n: F.transform(w, lambda x: x / n)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def gallery_best(queries: DataFrame, gallery: DataFrame, least: float) -> DataFrame:
    """Nearest mean of the query's own match by cosine, if near enough. gallery(match_id, track, mean): one vector for each
    track, an array for each match. queries(match_id, vec_id, v)."""
    whole = gallery.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("track", normalized(F.col("mean")).alias("m")))).alias("gallery"))
    scored = queries.select("match_id", "vec_id", normalized(F.col("v")).alias("v")).join(whole, "match_id")
    best = F.array_max(F.transform("gallery", lambda e: F.struct(dot(e.m, F.col("v")).alias("cosine"), (-e.track).alias("t"))))
    found = scored.select("match_id", "vec_id", best.alias("b")).select("match_id", "vec_id", (-F.col("b.t")).alias("track"), F.col("b.cosine").alias("cosine"))
    return found.withColumn("accepted", F.col("cosine") >= least)


def ema(rows: DataFrame, keys: list[str], order: str, vector: str, alpha: float = 0.9) -> DataFrame:
    """Exponential mean of the vectors of a match's track in order, normalised again after each step."""
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, F.transform(vector, lambda x: x.cast("double")).alias("v")))).alias("all"))
    first = normalized(F.element_at("all", 1).v)
    fold = F.aggregate(F.slice("all", 2, F.size("all")), first, lambda acc, e: normalized(F.zip_with(acc, normalized(e.v), lambda a, x: alpha * a + (1 - alpha) * x)))
    return listed.select(*keys, fold.alias("ema"))


# --- jobs


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """One row for each job: the latest update, with the time of the first."""
    return jobs.groupBy("unique_id").agg(F.max(F.struct("updated_at", "task_id", "status", "size_mb")).alias("l"), F.min("updated_at").alias("created_at")).select("unique_id", "l.task_id", "l.status", "l.size_mb", "l.updated_at", "created_at")


def pending_jobs(listing: DataFrame, status: DataFrame, low: float, high: float) -> DataFrame:
    """Listed sources in the size range that no job has taken up."""
    taken = status.filter(F.col("status").isin("finished", "running", "failed")).select("unique_id")
    return listing.filter(F.col("size_mb").between(low, high)).join(taken, "unique_id", "left_anti")


def health(jobs: DataFrame, last: int = 100) -> DataFrame:
    """Counts by status and the mean size of the last finished jobs."""
    counts = jobs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("queued", "running", "finished", "failed")])
    recent = jobs.filter("status = 'finished'").orderBy(F.desc("updated_at"), F.desc("task_id")).limit(last).agg(F.avg("size_mb").alias("mean_size"), F.count("*").alias("recent"))
    share = F.col("failed") / F.greatest(F.lit(1), F.col("finished") + F.col("failed"))
    state = F.when(share > 0.5, "unhealthy").when(share > 0.2, "degraded").otherwise("healthy")
    return counts.join(recent, F.lit(True)).withColumn("state", state)


def monitor(log: DataFrame, last: int = 100, most_running: int = 10, most_db_errors: int = 5) -> DataFrame:
    """The state of all processing, one row. log(video_id, event, at, seq, frames): event is start, complete, failed,
    db_error or api_error; at in seconds; seq orders equal times. An end counts if the video's last event before it is a
    start, from which it also lasts; of the last ends, durations and frame rates are averaged."""
    ends = F.col("event").isin("complete", "failed")
    w = Window.partitionBy("video_id").orderBy("at", "seq")
    of_video = log.filter(ends | (F.col("event") == "start")).withColumn("was", F.lag("event").over(w)).withColumn("since", F.lag("at").over(w))
    counted = of_video.withColumn("ended", ends & (F.col("was") == "start"))
    n = lambda test, name: F.count_if(test).alias(name)
    totals = counted.agg(n(F.col("ended") & (F.col("event") == "complete"), "processed"), n(F.col("ended") & (F.col("event") == "failed"), "failed"), (F.count_if(F.col("event") == "start") - F.count_if("ended")).alias("running"))
    errors = log.agg(n(F.col("event") == "db_error", "db_errors"), n(F.col("event") == "api_error", "api_errors"))
    # each task keeps the latest ends
    recent = counted.filter(F.col("ended") & (F.col("event") == "complete")).orderBy(F.desc("at"), F.desc("seq")).limit(last)
    lasted = F.col("at") - F.col("since")
    means = recent.agg(F.coalesce(F.round(F.avg(lasted), 2), F.lit(0.0)).alias("mean_duration_s"), F.coalesce(F.round(F.avg(F.when((F.col("frames") > 0) & (lasted > 0), F.col("frames") / lasted)), 2), F.lit(0.0)).alias("mean_frame_rate"))
    state = F.when(F.col("running") > most_running, "degraded").when(F.col("db_errors") > most_db_errors, "unhealthy").when(F.col("failed") > F.col("processed"), "unhealthy").otherwise("healthy")
    return totals.join(errors, F.lit(True)).join(means, F.lit(True)).withColumn("state", state)
