"""Materialising intermediate results where every executor can read them."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); one of our own only where none is configured and all runs on one machine."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known is None:
        known = spark.conf.get("spark.checkpoint.dir", None)
        if known is None and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = known or tempfile.mkdtemp(prefix="strata-checkpoint-")
        sc.setCheckpointDir(known)
    return spark.conf.get("spark.checkpoint.dir", None) or known


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are computed once and survive the loss of an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """The rows as a compressed table in the shared folder, computed once: for results too wide for a checkpoint, which isn't compressed.

    What led to them can go: collecting the driver's garbage lets Spark drop the shuffle files behind them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strata-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table that ``kept`` wrote for ``df``, once nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


NO_ID, SALT, TABLE_LOG2 = -(1 << 63), 16, 23


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two columns that tell rows apart, whatever their doc_id: __id (``NO_ID`` for null) and __key, a hash of the text."""
    return [F.coalesce(doc_id, F.lit(NO_ID)).alias("__id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("__key")]


def salted(many: DataFrame, few: DataFrame, on: list[str], how: str = "inner", salt: int = SALT) -> DataFrame:
    """A join in which one frequent key of ``many`` is spread over ``salt`` tasks; ``few`` is repeated so often."""
    left = many.withColumn("__salt", F.pmod(F.xxhash64(*many.columns), F.lit(salt)).cast("int"))
    right = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def bit_table(keys: DataFrame, column: str, most: int = TABLE_LOG2) -> Callable[[Column], Column]:
    """A filter that every value of ``keys`` passes and few others: a literal bit table of about 16 bits a key.

    The table has at most 2**``most`` bits (1 MB); with more keys than it has room for, more values pass, and what follows decides exactly.
    """
    log2 = int(min(most, max(12, (16 * keys.count()).bit_length())))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << log2))
    own = keys.select(slot(F.col(column)).alias("slot"))
    rows = own.select(F.shiftright("slot", 6).cast("int").alias("w"), F.expr("shiftleft(1L, int(slot & 63))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    table = [0] * (1 << (log2 - 6))
    for r in rows.collect():  # at most 2**(log2 - 6) rows
        table[r.w] = r.b
    literal = F.from_json(F.lit(str(table)), "array<bigint>")
    return lambda c: F.getbit(F.get(literal, F.shiftright(slot(c), 6).cast("int")), slot(c).bitwiseAND(F.lit(63)).cast("int")) == 1
