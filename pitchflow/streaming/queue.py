"""The job queue as a stream: new files become jobs, and changes of jobs are merged into a status table, each once.

The table lies in hash buckets. A batch rewrites the buckets that it touches, under its own number, and then notes them; a
reader takes each bucket as its latest noted batch wrote it. A batch that runs again (a stream replays its last batch after
a failure) reads only what batches before it noted, and so writes the same rows under the same number: nothing changes,
however often it runs, and whatever was left half-written is written over."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pitchflow.sources import upsert
from pitchflow.streaming import new_jobs

JOB = "unique_id string, task_id long, status string, size_mb double, updated_at timestamp, created_at timestamp"


class StatusTable:
    """Jobs by unique_id in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 32, schema: str = JOB):
        self.spark, self.rows, self.notes, self.buckets, self.schema = spark, f"{folder}/rows", f"{folder}/notes", buckets, schema

    def _noted(self) -> DataFrame:
        try:
            return self.spark.read.schema("bucket int, batch long").parquet(self.notes)
        except AnalysisException:  # no batch yet
            return self.spark.createDataFrame([], "bucket int, batch long")

    def read(self, before: int | None = None) -> DataFrame:
        """All jobs, or all as they were before a batch."""
        noted = self._noted() if before is None else self._noted().filter(F.col("batch") < before)
        latest = noted.groupBy("bucket").agg(F.max("batch").alias("batch"))
        try:
            every = self.spark.read.schema(f"{self.schema}, batch long, bucket int").parquet(self.rows)
        except AnalysisException:
            return self.spark.createDataFrame([], self.schema)
        # a row for each bucket; partitions of other batches are pruned
        return every.join(F.broadcast(latest), ["batch", "bucket"], "left_semi").drop("batch", "bucket")

    def merge(self, changes: DataFrame, batch: int) -> None:
        """changes: jobs, in any number and order; the same batch may be merged again."""
        bucket = F.pmod(F.hash("unique_id"), F.lit(self.buckets)).alias("bucket")
        changes = changes.select(*self.read(batch).columns)
        touched = changes.select(bucket).distinct()
        before = self.read(batch).withColumn("bucket", bucket).join(F.broadcast(touched), "bucket", "left_semi").drop("bucket")
        merged = upsert(before, changes).withColumn("batch", F.lit(batch).cast("long")).withColumn("bucket", bucket)
        merged.repartition(self.buckets, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(self.rows)
        noted = touched.withColumn("batch", F.lit(batch).cast("long"))
        noted.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.notes)


def keep_status(changes: DataFrame, table: StatusTable, checkpoint: str) -> DataStreamWriter:
    """A stream of changes merged batch by batch; start() it."""
    return changes.writeStream.foreachBatch(lambda rows, batch: table.merge(rows, batch)).option("checkpointLocation", checkpoint)


def listed_jobs(listing: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of listings(unique_id, task_id, size_mb, ts) as new jobs, each queued once."""
    fresh = new_jobs(listing, late)
    return fresh.select("unique_id", "task_id", F.lit("queued").alias("status"), "size_mb", F.col("ts").alias("updated_at"), F.col("ts").alias("created_at"))
