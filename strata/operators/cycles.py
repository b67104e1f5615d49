"""Cycles of directed edges: which edges lie on one, and the first edge that closes one.

A group of edges (one document's relation) that fits a task is settled in it, by a search over the prefixes of its edges. Larger groups go through joins: edges outside of any
cycle are trimmed from both ends, all groups at once, and the search runs over all groups in lockstep, so the number of rounds doesn't depend on the number of groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from strata.plans.stage import cut, dealt

GATHERED = 200_000  # edges of a group that one task may hold


def trimmed(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The edges (``keys``, l, r and others) between nodes that have both an edge in and an edge out, again and again until none goes: what lies on cycles or between
    them. Tails before and behind cycles go."""
    rest = cut(edges)
    n = rest.count()
    while n:
        ins = rest.select(*keys, F.col("r").alias("l")).distinct()
        outs = rest.select(*keys, F.col("l").alias("r")).distinct()
        rest = cut(rest.join(ins, [*keys, "l"], "left_semi").join(outs, [*keys, "r"], "left_semi"))
        left = rest.count()
        if left == n:
            break
        n = left
    return rest


def _acyclic(l: list[int], r: list[int], nodes: int) -> bool:
    return not _left(l, r, nodes)


def first_closing(l: list[int], r: list[int], nodes: int) -> int | None:
    """The place of the first edge with which the edges so far hold a cycle."""
    if _acyclic(l, r, nodes):
        return None
    low, high = 0, len(l) - 1  # the first ``low`` edges hold none, the first ``high + 1`` do
    while low < high:
        middle = (low + high) // 2
        if _acyclic(l[: middle + 1], r[: middle + 1], nodes):
            low = middle + 1
        else:
            high = middle
    return low


def _in_tasks(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The same for each group, gathered: ``keys`` and place, a row for each group with a cycle."""
    gathered = edges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "l", "r"))).alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in range(batch.num_rows):  # one group at a time: a batch of them as Python objects is twenty times its size
                group = batch.column("e")[k].values
                ends = pa.concat_arrays([group.field("l"), group.field("r")]).dictionary_encode()
                number = ends.indices.to_pylist()
                at = first_closing(number[: len(group)], number[len(group) :], len(ends.dictionary))
                found.append(None if at is None else group.field("place")[at].as_py())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(found, pa.int64())], [*keys, "place"])

    schema = ", ".join(f"`{k}` {gathered.schema[k].dataType.simpleString()}" for k in keys)
    return gathered.mapInArrow(run, f"{schema}, place bigint").where("place IS NOT NULL")


def _in_lockstep(edges: DataFrame, keys: list[str]) -> DataFrame:
    """By halving, all groups at once: a round trims the edges up to each group's middle place."""
    core = trimmed(edges, keys)
    range_ = cut(core.groupBy(*keys).agg(F.min("place").alias("low"), F.max("place").alias("high")))
    while True:
        middle = range_.withColumn("middle", F.floor((F.col("low") + F.col("high")) / 2).cast("bigint"))
        part = trimmed(core.join(middle, keys).where("place <= middle AND low < high").select(*core.columns), keys)
        cyclic = part.select(*keys).distinct().withColumn("hit", F.lit(True))
        moved = middle.join(cyclic, keys, "left").select(*keys, F.when(F.col("hit").isNotNull() | (F.col("low") >= F.col("high")), F.col("low")).otherwise(F.col("middle") + 1).alias("low"), F.when(F.col("hit").isNotNull(), F.col("middle")).otherwise(F.col("high")).alias("high"))
        range_ = cut(moved)
        if range_.where("low < high").isEmpty():
            return range_.select(*keys, F.col("low").alias("place"))


def closing(edges: DataFrame, keys: list[str], gathered: int = GATHERED) -> DataFrame:
    """``keys`` and at: for each group the least ``at`` such that the edges up to it hold a cycle. ``edges`` has ``keys``, at (anything that orders), l, r. Groups without cycles give no row.

    What the edge closes is decided by order alone, so the answer is the place in a log at which a graph stops being acyclic; of a document read whole, the first
    instance that completes a cycle of instances before it.
    """
    # equal places (the pairs of one polyadic instance) count together
    own = edges.withColumn("place", F.dense_rank().over(Window.partitionBy(*keys).orderBy("at")).cast("bigint"))
    text = lambda c: F.col(c).cast("string") if not isinstance(edges.schema[c].dataType, (ArrayType, MapType, StructType)) else F.to_json(c)
    own = cut(own.select(*keys, "at", "place", text("l").alias("l"), text("r").alias("r")))
    size = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    large = size.where(F.col("__n") > gathered).select(*keys)
    small = own.join(large, keys, "left_anti").select(*keys, "place", "l", "r")
    found = _in_tasks(small, keys)
    if not large.isEmpty():
        found = found.unionByName(_in_lockstep(own.join(large, keys, "left_semi").select(*keys, "place", "l", "r"), keys))
    return own.select(*keys, "at", "place").join(dealt(found), [*keys, "place"]).select(*keys, "at").distinct()


def on_or_below(edges: DataFrame, keys: list[str], gathered: int = GATHERED) -> DataFrame:
    """The edges (``keys``, l, r) that stay when nodes without edges in are taken away again and again."""
    edges = cut(edges.select(*keys, "l", "r"))
    large = cut(edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > gathered).select(*keys))
    kind = ", ".join(f"`{c}` {edges.schema[c].dataType.simpleString()}" for c in edges.columns)
    rows = edges.join(large, keys, "left_anti").groupBy(*keys).agg(F.collect_list(F.struct("l", "r")).alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                group, number = batch.column("e")[k].as_py(), {}
                l, r = ([number.setdefault(str(x[c]), len(number)) for x in group] for c in ("l", "r"))
                left = pa.array(_left(l, r, len(number)), pa.int64())
                ends = batch.column("e")[k].values.take(left)
                own = [batch.column(c).take(pa.array([k] * len(left), pa.int64())) for c in keys]
                yield pa.RecordBatch.from_arrays([*own, ends.field("l"), ends.field("r")], edges_columns)

    edges_columns = [*keys, "l", "r"]
    found = rows.mapInArrow(run, kind)
    if large.isEmpty():
        return found
    rest = cut(edges.join(large, keys, "left_semi"))
    n = rest.count()
    while n:
        rest = cut(rest.join(rest.select(*keys, F.col("r").alias("l")).distinct(), [*keys, "l"], "left_semi"))
        left = rest.count()
        if left == n:
            break
        n = left
    return found.unionByName(rest)


def _left(l: list[int], r: list[int], nodes: int) -> list[int]:
    """The places of the edges whose tail is never without an edge in."""
    into, out = [0] * nodes, [[] for _ in range(nodes)]
    for a, b in zip(l, r):
        into[b] += 1
        out[a].append(b)
    free = [v for v in range(nodes) if not into[v]]
    gone = set()
    while free:
        v = free.pop()
        gone.add(v)
        for w in out[v]:
            into[w] -= 1
            if not into[w]:
                free.append(w)
    return [k for k, a in enumerate(l) if a not in gone]
