"""Streams that wait for their rows equal the batch operators, in whatever batches and order the rows come."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pitchflow.operators import play, votes
from pitchflow.plans import fixture
from pitchflow.streaming import live, queue

SMALL = "/root/testdata/sf0.001"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LAST = 260


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield
    spark.conf.set(name, before)


def timed(rows):
    """A frame every 120 ms."""
    return rows.withColumn("ts", F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("frame_idx") * 120))


def batches(rows, folder, shift, seed):
    """Files in which rows come up to shift frames out of order, and one much later row that drives the watermark."""
    rng = random.Random(seed)
    part = {f: (f + rng.randint(0, shift)) // 40 for f in range(LAST + 1)}
    kept = rows.filter(F.col("frame_idx") <= LAST).collect()
    rng.shuffle(kept)
    schema = rows.schema
    spark = rows.sparkSession
    for k in sorted(set(part.values())):
        own = [r for r in kept if part[r.frame_idx] == k]
        if own:
            timed(spark.createDataFrame(own, schema)).coalesce(1).write.mode("append").parquet(folder)
    return timed(spark.createDataFrame([kept[0]], schema).withColumn("match_id", F.lit(99)).withColumn("frame_idx", F.lit(10_000)))


def run(spark, folder, name, step, stops=()):
    """All rows of the stream; stopped and started again after each number of files in stops."""
    schema = spark.read.parquet(f"{folder}/in").schema

    def start():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        return step(source).writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state").outputMode("append").trigger(availableNow=True).start()

    for _ in range(1 + len(stops)):
        q = start()
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    return spark.read.parquet(f"{folder}/{name}")


def drive(last, folder):
    """Two more files: one moves the watermark past all matches, one lets the operators see that."""
    for _ in range(2):
        last.coalesce(1).write.mode("append").parquet(folder)


def rounded(rows, *columns):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows.filter("match_id <> 99").select(*columns).collect())


@pytest.mark.parametrize("shift, seed", [(0, 1), (25, 2)])
def test_live_play_and_distance(spark, tmp_path, shift, seed):
    frames = fixture.frames(spark, SMALL).filter(F.col("match_id") == 0).filter(F.col("frame_idx") <= LAST)
    boxes = fixture.detections(spark, SMALL).filter(F.col("match_id") == 0).filter(F.col("frame_idx") <= LAST)
    last = batches(boxes, f"{tmp_path}/in", shift, seed)
    first = run(spark, tmp_path, "play", lambda s: live.live_play(s, idle_ms=30_000))
    early = first.count()
    drive(last, f"{tmp_path}/in")  # the stream goes on from its checkpoint
    got = run(spark, tmp_path, "play", lambda s: live.live_play(s, idle_ms=30_000))
    assert 0 < early < got.filter("match_id <> 99").count() == LAST + 1
    track, people = play.ball_track(frames, boxes), play.players(boxes)
    owned = play.ownership(frames, play.nearest_owner(track, people))
    want = track.join(owned, ["match_id", "frame_idx"])
    columns = ("match_id", "frame_idx", "is_raw", "mx", "my", "owner")
    assert rounded(got, *columns) == rounded(want, *columns)
    gone = run(spark, tmp_path, "gone", lambda s: live.live_distance(s, idle_ms=30_000))
    total = gone.groupBy("match_id", "track_id").agg(F.max_by("distance_m", "frame_idx").alias("distance_m"))
    assert rounded(total, "match_id", "track_id", "distance_m") == rounded(play.distance_covered(people), "match_id", "track_id", "distance_m")


def test_late_rows_are_left_out(spark, tmp_path):
    """A ball that comes after its frame was told changes nothing; frames without boxes are told too."""
    schema = "match_id int, frame_idx int, box_idx int, cls int, track_id int, x1 double, y1 double, x2 double, y2 double, conf double"
    at = lambda f, x, cls=32, track=None: (0, f, 0, cls, track, x, 500.0, x + 10, 510.0, 0.9)
    files = [[at(0, 100.0), at(4, 200.0)], [at(100, 300.0)], [at(101, 300.0)], [at(2, 900.0)], [(99, *at(9_000, 1.0)[1:])], [(99, *at(9_001, 1.0)[1:])]]
    for rows in files:
        timed(spark.createDataFrame(rows, schema)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = {r.frame_idx: r for r in run(spark, tmp_path, "play", lambda s: live.live_play(s, idle_ms=5_000)).filter("match_id = 0").collect()}
    assert sorted(got) == list(range(102)) and not got[2].is_raw
    assert round(got[2].mx, 6) == round(155 * 105 / 1920, 6) and got[50].mx is None


@pytest.mark.parametrize("shift, seed", [(0, 3), (25, 4)])
def test_live_locks_equal_vote_locks(spark, tmp_path, shift, seed):
    rng = random.Random(seed)
    truth = {1: 7, 2: 7, 3: 9, 4: 10, 5: 7, 6: 9}
    rows = [(m, f, t, n if rng.random() < 0.7 else rng.choice([7, 9, 10, 17]), round(rng.uniform(0.3, 0.95), 2)) for m in (0, 1) for f in range(LAST) for t, n in truth.items() if (f + t) % 9 == 0 and (t < 5 or f > 120)]
    reads = spark.createDataFrame(rows, "match_id int, frame_idx int, track_id int, number int, confidence double")
    teams = spark.createDataFrame([(m, t, "Red" if t in (1, 2, 3, 5) else "White") for m in (0, 1) for t in (1, 2, 3, 4, 5)], "match_id int, track_id int, team string")
    drive(batches(reads, f"{tmp_path}/in", shift, seed), f"{tmp_path}/in")
    got = run(spark, tmp_path, "locks", lambda s: live.live_locks(s, teams, idle_ms=30_000))
    columns = ("match_id", "event", "track_id", "team", "number", "frame_idx", "score", "stolen_from")
    key = lambda rows: sorted(rows, key=str)
    want = key(rounded(votes.vote_locks(reads, teams).fillna(-1, ["stolen_from"]), *columns))
    assert key(rounded(got.fillna(-1, ["stolen_from"]), *columns)) == want
    assert {r[1] for r in want} == {"locked", "registered"} and any(r[-1] > 0 for r in want)


def test_status_table_survives_replays(spark, tmp_path):
    rng = random.Random(7)
    at = lambda k: F.timestamp_seconds(F.lit(1_700_000_000) + F.col(k))
    raw = [(f"job{rng.randint(0, 40)}", k, rng.choice(["queued", "running", "finished"]), float(k), rng.randint(0, 10_000)) for k in range(300)]
    jobs = spark.createDataFrame(raw, "unique_id string, task_id long, status string, size_mb double, s long").select("unique_id", "task_id", "status", "size_mb", at("s").alias("updated_at"), at("s").alias("created_at"))
    table = queue.StatusTable(spark, f"{tmp_path}/table", buckets=8)
    assert table.read().count() == 0
    part = lambda k: jobs.filter(F.col("task_id") % 5 == k)
    rows = lambda: sorted(map(tuple, table.read().collect()))
    for k in range(4):
        table.merge(part(k), k)
    before = rows()
    table.merge(part(3), 3)  # the last batch once more
    assert rows() == before
    # a batch that failed before it was noted leaves nothing to be seen, and runs again
    noted = table.notes
    table.notes = f"{tmp_path}/elsewhere"
    table.merge(part(4), 4)
    table.notes = noted
    assert rows() == before
    table.merge(part(4), 4)
    best, first = {}, {}
    for r in jobs.collect():
        best[r.unique_id] = max(best.get(r.unique_id, ()), (r.updated_at, r.task_id, r.status, r.size_mb))
        first[r.unique_id] = min(first.get(r.unique_id, r.created_at), r.created_at)
    assert rows() == sorted((u, t, s, m, at_, first[u]) for u, (at_, t, s, m) in best.items())


def test_listings_become_jobs(spark, tmp_path):
    """Files of listings that overlap: each job is queued once, and the stream ends where it began when it runs again."""
    for k in range(3):
        spark.range(k * 5, k * 5 + 10).select(F.concat(F.lit("f"), F.col("id")).alias("unique_id"), F.col("id").alias("task_id"), (F.col("id") * 1.5).alias("size_mb"), F.timestamp_seconds(F.lit(1_700_000_000 + 60 * k)).alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table = queue.StatusTable(spark, f"{tmp_path}/table", buckets=4)
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    for _ in range(2):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = queue.keep_status(queue.listed_jobs(source), table, f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        got = table.read().collect()
        assert sorted(r.task_id for r in got) == list(range(20)) and {r.status for r in got} == {"queued"}
