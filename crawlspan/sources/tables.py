"""Reading of the Parquet tables and the session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, base: str, name: str, *columns: str) -> DataFrame:
    """Table `name` below `base`, with `columns` only if given, so that the scan is pruned whatever follows."""
    df = spark.read.parquet(f"{base}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(spark: SparkSession, per_slot: int = 2) -> int:
    """Number of partitions for an explicit repartitioning: the session's shuffle partitions, and no fewer than the slots."""
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffle, per_slot * spark.sparkContext.defaultParallelism)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Only where none is set and all runs on this machine (as in tests) a
    local one; a cluster without one is an error, as its executors would each write to their own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")

        named = tempfile.mkdtemp(prefix="crawlspan-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def evenly(df: DataFrame) -> DataFrame:
    """The rows over all slots. A table with fewer splits than slots, which makes it a small one, is dealt out; others stay as they are."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df
