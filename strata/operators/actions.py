"""Normalising yields and applying actions to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapse(rows: DataFrame, value: str, position: str) -> DataFrame:
    """Adjacent equal values become the first of them."""
    before = F.lag(value).over(Window.partitionBy("doc").orderBy(position))
    first = F.row_number().over(Window.partitionBy("doc").orderBy(position)) == 1
    return rows.withColumn("__new", first | ~F.col(value).eqNullSafe(before)).where("__new").drop("__new")


def unique(rows: DataFrame, value: str, position: str) -> DataFrame:
    """The first occurrence of each value."""
    turn = F.row_number().over(Window.partitionBy("doc", value).orderBy(position))
    return rows.withColumn("__turn", turn).where("__turn = 1").drop("__turn")


def reorder(rows: DataFrame, value: str, position: str) -> DataFrame:
    """Adds ``place``: order by canonical JSON text of the value, then position."""
    text = F.to_json(F.struct(F.col(value).alias("v")), {"ignoreNullFields": "false"})
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy(text, position)).cast("bigint") - 1)


def act(rows: DataFrame, aggregate: Column) -> DataFrame:
    """The whole yield at once: an action that is an aggregate."""
    return rows.groupBy("doc").agg(aggregate.alias("result"))


def act_one_by_one(rows: DataFrame, value: str, position: str, zero: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """The carrier goes through the coordinates one at a time, in position order."""
    gathered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), F.col(value).alias("v"))))
    return rows.groupBy("doc").agg(gathered.alias("x")).select("doc", F.aggregate("x", zero, lambda a, x: step(a, x.v)).alias("result"))


def distributes(batch: DataFrame, single: DataFrame) -> DataFrame:
    """The documents on which the two ways differ; empty is the certificate."""
    other = single.withColumnRenamed("result", "other")
    return batch.join(other, "doc", "full_outer").where("NOT (result <=> other)").select("doc")
