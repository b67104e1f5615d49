"""Folds: semiring aggregation over dependency graphs whose nodes combine children by OR (sum) or AND (product).

Three strategies, chosen by what is declared and by size:

* ``unrolled``: levels known from the tiers; each level is one join and one aggregation with partial sums, in one plan, no loop;
* ``per_document``: many documents of bounded size; a document's nodes are gathered once, in dependency order, and one higher-order
  ``aggregate`` evaluates them, each node once;
* ``by_level``: any size; one join and one aggregation for each height, over all documents at once, of the nodes and edges of that height only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators import reach
from strata.operators.semiring import COUNTING, Semiring
from strata.plans.stage import cut, fresh

OR, AND = "or", "and"
GATHERED = 400  # the most nodes of a document that ``per_document`` takes; it copies its values at every node


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes (doc, node) that are nobody's child."""
    return nodes.select("doc", "node").join(edges.select("doc", F.col("r").alias("node")).distinct(), ["doc", "node"], "left_anti")


def admitted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes; parallel edges stay."""
    own = nodes.select("doc", "node")
    out = edges.join(own.withColumnRenamed("node", "l"), ["doc", "l"], "left_semi")
    return out.join(own.withColumnRenamed("node", "r"), ["doc", "r"], "left_semi").select("doc", "l", "r")


def combine(semiring: Semiring, how: str, values: Column) -> Column:
    if how not in (OR, AND):
        raise ValueError(f"unknown combination {how}")
    return F.aggregate(values, semiring.zero() if how == OR else semiring.one(), semiring.add if how == OR else semiring.mul)


def per_document(nodes: DataFrame, edges: DataFrame, semiring: Semiring, lift: Callable[[Column, Column], Column], how: str = OR) -> DataFrame:
    """doc, node, value of every node. ``nodes`` has doc, node, value, label; children must follow their parents in canonical order.

    A node without children is its lifted value; a relation without children in a node is passed over.
    """
    inside = admitted(nodes, edges)
    children = inside.groupBy("doc", F.col("l").alias("node")).agg(F.array_sort(F.collect_list("r")).alias("children"))
    rows = nodes.join(children, ["doc", "node"], "left")
    gathered = rows.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("node", "value", "label", "children")), asc=False).alias("x"))
    gathered = gathered.withColumn("place", F.transform("x", lambda n: n.node))
    pair = f"struct<node:struct<t:int,i:bigint>,v:{semiring.type}>"
    empty = F.array().cast(f"array<{pair}>")

    def step(done: Column, x: Column) -> Column:
        own = lift(x.value, x.label)
        below = F.transform(x.children, lambda c: F.get(done, F.array_position(F.col("place"), c).cast("int") - 1).v)
        value = F.when(x.children.isNull(), own).otherwise(semiring.mul(own, combine(semiring, how, below)))
        return F.concat(done, F.array(F.struct(x.node.alias("node"), value.cast(semiring.type).alias("v"))).cast(f"array<{pair}>"))

    out = gathered.select("doc", F.explode(F.aggregate("x", empty, step)).alias("y"))
    return out.select("doc", "y.node", F.col("y.v").alias("value"))


def by_level(nodes: DataFrame, edges: DataFrame, semiring: Semiring, lift: Callable[[Column, Column], Column], how: str = OR) -> DataFrame:
    """The same for any graph without cycles and of any size; raises where a cycle keeps nodes from being evaluated.

    Nodes and edges are laid out by height first, so a round reads those of its height, the values of the heights that its edges lead to, and writes its own: each edge is joined once.
    """
    spark = nodes.sparkSession
    shape = nodes.select("doc", "node", F.lit(None).cast(semiring.type).alias("value")).schema
    graded = cut(reach.graded(admitted(nodes, edges)))
    tall = graded.select("doc", F.col("l").alias("node"), F.col("lh").alias("h")).distinct()
    own = nodes.select("doc", "node", lift(F.col("value"), F.col("label")).cast(semiring.type).alias("own")).join(tall, ["doc", "node"], "left").withColumn("h", F.coalesce("h", F.lit(0)))
    own, graded = cut(cut(own).repartitionByRange("h", "doc")), cut(graded.repartitionByRange("lh", "doc"))
    below: dict[int, list[int]] = {0: []}
    for r in graded.select("lh", "rh").distinct().collect():
        below.setdefault(r.lh, []).append(r.rh)
    base = fresh(spark)
    read = lambda heights: spark.read.schema(shape).parquet(*(f"{base}/h{h}" for h in heights))
    for h in range(max(below) + 1):
        mine = own.where(F.col("h") == h)
        if h:
            child = read(below[h]).withColumnRenamed("node", "r")
            met = graded.where(F.col("lh") == h).join(child, ["doc", "r"]).groupBy("doc", F.col("l").alias("node"))
            if how == OR and semiring.total is not None:
                gathered = semiring.total(F.col("value"))
            else:
                gathered = combine(semiring, how, F.transform(F.array_sort(F.collect_list(F.struct("r", F.col("value").alias("v")))), lambda x: x.v))
            mine = mine.join(met.agg(gathered.alias("below")), ["doc", "node"]).withColumn("own", semiring.mul(F.col("own"), F.col("below")))
        mine.select("doc", "node", F.col("own").cast(semiring.type).alias("value")).write.parquet(f"{base}/h{h}")
    return read(range(max(below) + 1))


def unrolled(levels: list[tuple[DataFrame, str | None, str]], semiring: Semiring, lift: Callable[[Column], Column], how: str = OR) -> DataFrame:
    """A hierarchy of known depth, bottom up. ``levels``, from the leaves: (rows with key and value, the parent's key column, the key column).

    Below each join stands an aggregation with partial sums, so only one row for each parent is moved.
    """
    if how != OR or semiring.total is None:
        raise ValueError("the unrolled plan needs sums with an aggregate")
    below = None
    for rows, parent, key in levels:
        own = rows.select(F.col(key).alias("k"), *([F.col(parent).alias("p")] if parent else []), lift(F.col("value")).cast(semiring.type).alias("own"))
        if below is None:
            valued = own.withColumnRenamed("own", "v")
        else:
            joined = own.join(below, "k", "left")
            valued = joined.select("k", *(["p"] if parent else []), F.when(F.col("has").isNull(), F.col("own")).otherwise(semiring.mul(F.col("own"), F.col("sum"))).alias("v"))
        if parent is None:
            return valued
        below = valued.groupBy(F.col("p").alias("k")).agg(semiring.total(F.col("v")).alias("sum"), F.lit(True).alias("has"))
    return below


def total(values: DataFrame, root: DataFrame, semiring: Semiring, axes: int = 1) -> DataFrame:
    """doc, value: the sum over the roots and over the coordinates of an index product of ``axes`` points, from zero."""
    at = values.join(root, ["doc", "node"], "left_semi").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("node", F.col("value").alias("v")))).alias("x"))
    spread = F.flatten(F.array_repeat(F.transform("x", lambda r: r.v), axes))
    return at.select("doc", F.aggregate(spread, semiring.zero(), semiring.add).alias("value"))


def states(values: DataFrame, axes: DataFrame) -> DataFrame:
    """One value for each node and coordinate; ``axes`` (coordinate) is a declared, bounded index product."""
    return values.crossJoin(F.broadcast(axes))


def cost_account(nodes: DataFrame, edges: DataFrame, axes: int = 1, how: str = OR) -> DataFrame:
    """doc, size, incidence, additions, multiplications: from the topology in closed form."""
    inside = admitted(nodes, edges)
    kids = inside.groupBy("doc", "l").agg(F.count(F.lit(1)).alias("k")).groupBy("doc").agg(F.count(F.lit(1)).alias("inner"), F.sum("k").alias("edges"))
    size = nodes.groupBy("doc").agg(F.count(F.lit(1)).alias("size"))
    n_roots = roots(nodes, inside).groupBy("doc").agg(F.count(F.lit(1)).alias("n_roots"))
    out = size.join(kids, "doc", "left").join(n_roots, "doc", "left").fillna(0)
    adds = (F.col("edges") - F.col("inner") if how == OR else F.lit(0)) + F.col("n_roots")
    muls = F.col("size") + (F.col("edges") if how == AND else F.lit(0))
    return out.select("doc", "size", F.col("edges").alias("incidence"), (adds * axes).cast("bigint").alias("additions"), (muls * axes).cast("bigint").alias("multiplications"))


def homomorphic(a: DataFrame, b: DataFrame, mapping: Callable[[Column], Column]) -> DataFrame:
    """The nodes where mapping the first fold's value doesn't give the second's; empty if the mapping is a homomorphism here."""
    joined = a.join(b.withColumnRenamed("value", "other"), ["doc", "node"])
    return joined.where(~mapping(F.col("value")).eqNullSafe(F.col("other"))).select("doc", "node")


def paths(values: DataFrame, root: DataFrame, cap: int) -> DataFrame:
    """doc, cost, path, truncated: the first ``cap`` of each root's tied best paths (values of the path semiring)."""
    at = values.join(root, ["doc", "node"], "left_semi")
    return at.select("doc", F.col("value.a").alias("cost"), F.posexplode(F.slice("value.b", 1, cap)).alias("rank", "path"), (F.size("value.b") > cap).alias("truncated"))


def derivations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc, node, value: how many derivations each node has, before any pruning."""
    return per_document(nodes, edges, COUNTING, lambda v, n: COUNTING.one())
