"""Cutting lineage in iterative operators, and sharing tables between the branches of a plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of the tables that shared() wrote in this process, by application.
_WRITTEN: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; a temporary one only where none is named and all runs on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pitchflow-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared(df: DataFrame, buckets: int | None = None) -> DataFrame:
    """Written once as Parquet into the shared folder and read back: columns are pruned, filters pushed down, and the
    size is known, so that a small table is broadcast and a large one isn't. Row groups are small, for the next plan may be
    heavier for each byte than a scan. With buckets rows are kept by match: what was dealt out so before stays so after. There
    the match has another name in the file: a union knows its parts as dealt out alike only by columns that can't be null, as
    renamed ones are where they are joined by, and those of a scan aren't."""
    spark = df.sparkSession
    name = f"match_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    if buckets is None:
        df.write.option("parquet.block.size", 8 << 20).parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    writer = df.withColumnRenamed("match_id", "dealt_by").write.option("parquet.block.size", 8 << 20)
    writer.option("path", path).bucketBy(buckets, "dealt_by").saveAsTable(name)
    return spark.table(name).withColumnRenamed("dealt_by", "match_id")


def release(spark: SparkSession) -> int:
    """Delete the tables that shared() wrote for this application; their number. Call it when the results that read them
    have been written or collected: a DataFrame can't know whether it will be asked again."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        spark.sql(f"DROP TABLE IF EXISTS {path.rsplit('/', 1)[1]}")
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    return len(paths)
