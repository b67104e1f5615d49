"""Cutting lineage where every executor can read the result."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh(spark: SparkSession) -> str:
    """A new path in the cluster's ``spark.checkpoint.dir``; in a folder of our own only where none is configured and all runs on one machine."""
    if spark.sparkContext.getCheckpointDir() is None:
        known = spark.conf.get("spark.checkpoint.dir", None)
        if known is None and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(known or tempfile.mkdtemp(prefix="strata-checkpoint-"))
    return f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"


def parts(spark: SparkSession, rows: int, each: int = 1 << 20) -> int:
    """How many partitions give a task about ``each`` rows. Sequences of places shrink to a tenth in a shuffle, so what a shuffle's bytes say of a task's memory is far too little."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def cut(df: DataFrame) -> DataFrame:
    """The rows as a compressed table in a fresh path.

    A checkpoint runs its last stage twice and writes whole rows without compression; a table is written once and read by the columns that are asked for.
    """
    path, kind = fresh(df.sparkSession), df.schema.simpleString()
    if not df.columns or ":void" in kind or "<void" in kind or "interval" in kind:  # what a table can't hold
        return df.checkpoint(eager=True)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """For a join: rows that are never broadcast, so the driver doesn't hold them. Spark judges a table by its compressed files, which can be a hundredth of its rows."""
    return df.hint("merge")
