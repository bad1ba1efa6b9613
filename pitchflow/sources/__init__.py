"""Readers and writers of frame dumps, rosters, logs, reports and job listings, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX = T.StructType([T.StructField("xyxy", T.ArrayType(T.DoubleType())), T.StructField("id", T.LongType()), T.StructField("conf", T.DoubleType()), T.StructField("cls", T.IntegerType()), T.StructField("color", T.StringType())])
FRAME_DUMP = T.StructType([T.StructField("boxes", T.ArrayType(BOX))])
TRACKING_DUMP = T.StructType([T.StructField("frame_idx", T.IntegerType()), T.StructField("boxes", T.ArrayType(BOX))])
ROSTER = T.StructType(
    [
        T.StructField("teams", T.MapType(T.StringType(), T.StructType([T.StructField("color", T.StringType()), T.StructField("roster", T.ArrayType(T.StringType()))]))),
        T.StructField("known_stats", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))),
    ]
)
LOG = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("frame_idx", "det_count", "active_track_count", "locked_track_count", "new_tracks_count", "matched_pairs")]
    + [T.StructField("unmatched_reasons", T.MapType(T.StringType(), T.IntegerType())), T.StructField("active_ids", T.ArrayType(T.LongType()))]
)
LISTING = T.StructType([T.StructField("items", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("id", "filename", "fileLocation")] + [T.StructField("fileSize", T.LongType())]))), T.StructField("pages", T.IntegerType())])


def _match_id(pattern: str = r"(\d+)[^/]*$"):
    """The number in the file's name; one file holds one match."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).cast("int").alias("match_id")


def explode_boxes(frames: DataFrame) -> DataFrame:
    """(match_id, frame_idx, boxes) to one row for each box, in the order of the array; empty frames give none."""
    rows = frames.select("match_id", "frame_idx", F.posexplode("boxes").alias("box_idx", "b"))
    at = lambda i, n: F.element_at("b.xyxy", i).alias(n)
    return rows.select("match_id", "frame_idx", "box_idx", "b.cls", F.col("b.id").alias("track_id"), at(1, "x1"), at(2, "y1"), at(3, "x2"), at(4, "y2"), F.coalesce("b.conf", F.lit(0.0)).alias("conf"), F.col("b.color").alias("color"))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of frames for each match; the place in the array is the time."""
    text = spark.read.text(path, wholetext=True).select(_match_id(), F.from_json("value", T.ArrayType(FRAME_DUMP)).alias("frames"))
    return text.select("match_id", F.posexplode("frames").alias("frame_idx", "f")).select("match_id", "frame_idx", "f.boxes")


def read_tracking(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of frames that carry their own index."""
    return spark.read.schema(TRACKING_DUMP).json(path, multiLine=True).select(_match_id(), "frame_idx", "boxes")


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """(team, color, number); entries that are no number are left out."""
    rows = spark.read.schema(ROSTER).json(path, multiLine=True).select(F.explode("teams").alias("team", "t"))
    rows = rows.select("team", "t.color", F.explode("t.roster").alias("n"))
    return rows.select("team", "color", F.expr("try_cast(n AS INT)").alias("number")).filter("number is not null")


def read_known_stats(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(ROSTER).json(path, multiLine=True).select(F.explode("known_stats").alias("metric", "s"))
    return rows.select("metric", F.explode("s").alias("team", "value"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).json(path)


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").json(path)


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Job listings, one page a file."""
    rows = spark.read.schema(LISTING).json(path, multiLine=True).select(F.explode("items").alias("i"))
    return rows.select(F.col("i.id").alias("unique_id"), "i.filename", F.col("i.fileLocation").alias("location"), (F.col("i.fileSize") / 1048576).alias("size_mb"))


def write_player_stats(players: DataFrame, path: str) -> None:
    """Player documents, a folder for each match."""
    players.write.mode("overwrite").partitionBy("match_id").json(path)


def write_events(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").partitionBy("match_id").parquet(path)


def write_flat_report(players: DataFrame, path: str, kind: str = "csv") -> None:
    """A row for each player, as csv with a header or as json."""
    players.write.mode("overwrite").option("header", True).format(kind).save(path)


def match_reports(players: DataFrame, teams: DataFrame, events: DataFrame) -> DataFrame:
    """A document for each match: players_flat (their rows in the order of their ids, with the share of accurate passes),
    team_labels, and events in time. players(match_id, track_id, team, number, passes, accurate, ...); teams(match_id, team,
    label); events(match_id, frame_idx, type, by). A match without events or labels has empty lists."""
    label = teams.select("match_id", "team", "label")
    rate = F.when(F.col("passes") > 0, 100.0 * F.col("accurate") / F.col("passes")).otherwise(0.0)
    rows = players.join(label, ["match_id", "team"], "left").withColumn("team", F.coalesce("label", F.lit("unknown"))).withColumn("accurate_passes_percent", rate).drop("label", "accurate")
    listed = lambda df, name, first: df.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct(first, *[c for c in df.columns if c not in ("match_id", first)]))).alias(name))
    both = listed(rows, "players_flat", "track_id").join(listed(label, "team_labels", "team"), "match_id", "left").join(listed(events, "events", "frame_idx"), "match_id", "left")
    none = lambda name: F.coalesce(name, F.array().cast(both.schema[name].dataType)).alias(name)
    return both.select("match_id", "players_flat", none("team_labels"), none("events"))


def write_match_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").partitionBy("match_id").json(path)


def write_kits(kits: DataFrame, path: str) -> None:
    """kits(match_id, color, place): a document for each match, kits in order."""
    listed = kits.groupBy("match_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "color"))), lambda k: k.color).alias("players"))
    listed.write.mode("overwrite").partitionBy("match_id").json(path)


def write_accuracy(report: DataFrame, path: str) -> None:
    """Rows of the accuracy report (metric, team, truth, found, accuracy), a document for each metric."""
    listed = report.groupBy("metric").agg(F.array_sort(F.collect_list(F.struct("team", "truth", "found", "accuracy"))).alias("teams"))
    listed.write.mode("overwrite").json(path)


def upsert(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest row of each unique_id over both, with the earliest created_at."""
    both = current.unionByName(changes)
    rest = [c for c in both.columns if c not in ("unique_id", "created_at", "updated_at")]
    last = both.groupBy("unique_id").agg(F.max(F.struct("updated_at", *rest)).alias("l"), F.min("created_at").alias("created_at"))
    return last.select("unique_id", *[F.col(f"l.{c}").alias(c) for c in rest], "l.updated_at", "created_at").select(current.columns)
