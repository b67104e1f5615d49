"""The construction machine: an ordered edit log and its set-oriented replay.

A log has doc, seq, op and the columns an op needs. Replay is one reduction: ordinals are ranks by seq, promotions keep the first id, and a
refusal is the smallest seq among violations. A state ``as of`` a step is the log's prefix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_REPEAT, MAX_OPCODES = 10_000, 2_000_000


def replay_items(log: DataFrame) -> DataFrame:
    """doc, tier, idx, durable_id, seq of the items that the log adds; ``add_item`` has tier and id, ``promote_item`` tier, index and id."""
    added = log.where("op = 'add_item'").select("doc", "seq", "tier", F.col("id").alias("given"), (F.row_number().over(Window.partitionBy("doc", "tier").orderBy("seq")).cast("bigint") - 1).alias("idx"))
    promoted = log.where("op = 'promote_item'").groupBy("doc", "tier", F.col("index").alias("idx")).agg(F.min_by("id", "seq").alias("promoted"))
    return added.join(promoted, ["doc", "tier", "idx"], "left").select("doc", "tier", "idx", F.coalesce("given", "promoted").alias("durable_id"), "seq")


def replay_edges(log: DataFrame) -> DataFrame:
    rel = log.where("op = 'relate'")
    ord_ = F.row_number().over(Window.partitionBy("doc", "rel").orderBy("seq")).cast("bigint") - 1
    return rel.select("doc", "rel", ord_.alias("ord"), "l", "r", "seq")


def replay_values(log: DataFrame) -> DataFrame:
    """Attached values; of repeated ones the first stands, the others are refusals."""
    own = Window.partitionBy("doc", "tier", "index", "name").orderBy("seq")
    return log.where("op = 'attach_value'").select("doc", "tier", F.col("index").alias("idx"), "name", "lexical", "seq", F.row_number().over(own).alias("turn"))


def as_of(log: DataFrame, seq: int) -> DataFrame:
    return log.where(F.col("seq") <= seq)


def refusals(log: DataFrame) -> DataFrame:
    """doc, seq, reason of every op that the machine refuses: an item that isn't there yet, or a value attached twice."""
    items = replay_items(log).select("doc", "tier", F.col("idx").alias("index"), F.col("seq").alias("born"))
    uses = log.where("op IN ('attach_value', 'promote_item')").select("doc", "tier", "index", "seq")
    missing = uses.join(items, ["doc", "tier", "index"], "left").where("born IS NULL OR born > seq").select("doc", "seq", F.lit("no such item").alias("reason"))
    twice = replay_values(log).where("turn > 1").select("doc", "seq", F.lit("value attached twice").alias("reason"))
    return missing.unionByName(twice)


def first_refusal(log: DataFrame) -> DataFrame:
    bad = refusals(log)
    return bad.groupBy("doc").agg(F.min(F.struct("seq", "reason")).alias("x")).select("doc", "x.seq", "x.reason")


@dataclass(frozen=True)
class Repeat:
    """A finite macro: the body, ops or further repeats, ``count`` times."""

    count: int
    body: tuple


def expansion(program: tuple) -> int:
    """The number of primitive ops, refused beyond the machine's limits before anything is made."""
    total = 0
    for op in program:
        if isinstance(op, Repeat):
            if not 0 <= op.count <= MAX_REPEAT:
                raise ValueError("repeat count out of range")
            total += op.count * expansion(op.body)
        else:
            total += 1
        if total > MAX_OPCODES:
            raise ValueError("too many opcodes")
    return total


def flatten(program: tuple) -> list:
    expansion(program)
    out: list = []
    stack = [iter(program)]
    while stack:
        for op in stack[-1]:
            if isinstance(op, Repeat):
                stack.extend(iter(op.body) for _ in range(op.count))
                break
            out.append(op)
        else:
            stack.pop()
    return out


def expand_counts(ops: DataFrame, times: Column) -> DataFrame:
    """Each row ``times`` times, in order: adds ``turn``."""
    return ops.withColumn("turn", F.explode(F.when(times > 0, F.sequence(F.lit(0), (times - 1).cast("int")))))


def fingerprint(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """doc, sha256 of each document's rows as compact JSON in order; NULL fields are written."""
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    joined = F.array_sort(F.collect_list(F.struct(*order, text.alias("__json"))))
    whole = F.concat(F.lit("["), F.array_join(F.transform("x", lambda r: r["__json"]), ","), F.lit("]"))
    return rows.groupBy("doc").agg(joined.alias("x")).select("doc", F.sha2(whole, 256).alias("sha256"))
