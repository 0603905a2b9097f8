"""Cutting lineage in loops."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint of df in spark.checkpoint.dir; a local folder of our own only where that is unset."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or "/tmp/checkpoints/lodestone")
    return df.checkpoint()


#: Bytes of a table a core up to which a scan may be too few tasks.
SPREAD_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one of our own only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "/tmp/checkpoints/lodestone"
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a columnar table in the shared folder: later plans prune its columns and read it instead of
    computing it."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by columns into as many partitions as spark.sql.shuffle.partitions says, which stay apart. Rows of a few
    numbers shrink to a small part when they are packed; tasks merged by their packed size would sort many times that.
    What is joined with df by these columns keeps to its partitions: deal the right side of a semi or anti join, as Spark
    moves such a join below a deal of the left one, and drops that as repeated."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt over the cores if it is so small that it may be one task, as a file of one row group is not
    split; a larger table, or one of many files, has tasks enough and stays as it is."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if "AdaptiveSparkPlan" in plan.executedPlan().toString():  # no scan, but joins or aggregates
        return df
    if plan.optimizedPlan().stats().sizeInBytes() >= cores * SPREAD_BYTES:
        return df
    return df.repartition(cores) if plan.toRdd().getNumPartitions() <= 4 * cores else df
