"""Traversal: bounded reachability, ordered polyadic steps and containment."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.model import Polyadic, Relation
from strata.operators import cycles, reach
from strata.plans.stage import cut, parts

FORWARD, INVERSE = "forward", "inverse"


def _pairs(relation: Relation, direction: str) -> DataFrame:
    if direction not in (FORWARD, INVERSE):
        raise ValueError(f"unknown direction {direction}")
    a, b = ("l", "r") if direction == FORWARD else ("r", "l")
    return relation.edges.select("doc", F.col(a).alias("node"), F.col(b).alias("next"))


def walk(source: DataFrame, relation: Relation, direction: str = FORWARD, cap: int | None = None, gathered: int = reach.GATHERED) -> tuple[DataFrame, DataFrame]:
    """(reached, truncated): the nodes reachable from ``source`` (doc, node) in at most ``cap`` steps, without the source, and the documents
    whose frontier wasn't empty at the cap. The plan follows the documents' sizes, see ``reach``."""
    if cap is None and not relation.acyclic:
        raise ValueError("an unbounded walk needs a relation that is declared acyclic")
    if cap is not None and cap < 0:
        raise ValueError("the cap must not be negative")
    steps = cut(reach.distances(source, _pairs(relation, direction), cap, gathered))
    return steps.where("steps > 0").select("doc", "node"), steps.where(F.lit(False) if cap is None else F.col("steps") == cap).select("doc").distinct()


def opposite(relation: Polyadic, inverse: bool = False) -> DataFrame:
    """doc, node, next with the places (ord, own, other) that order them: for each node the opposite sides of its instances, repeats kept."""
    a, b = ("targets", "sources") if inverse else ("sources", "targets")
    one = relation.rows.select("doc", "ord", F.posexplode(a).alias("own", "node"), b)
    return one.select("doc", "ord", "own", "node", F.posexplode(b).alias("other", "next"))


def _single(relation: Polyadic) -> bool:
    """Whether a source stands in one instance only: sources are unique, and one each."""
    return relation.unique_sources and relation.rows.where(F.size("sources") > 1).isEmpty()


def adjacency(relation: Polyadic, inverse: bool = False) -> DataFrame:
    """doc, node, next, rank: for each node the opposite sides of its instances, in instance and endpoint order, repeats kept. Where sources are unique and
    one each, a node's children stand in one instance, and their places there are their ranks."""
    both = opposite(relation, inverse)
    if not inverse and _single(relation):
        return both.select("doc", "node", "next", (F.col("other") + 1).cast("bigint").alias("rank"))
    rank = F.row_number().over(Window.partitionBy("doc", "node").orderBy("ord", "own", "other"))
    return both.select("doc", "node", "next", rank.cast("bigint").alias("rank"))


def direct(origin: DataFrame, relation: Polyadic) -> DataFrame:
    """One ordered step from ``origin`` (doc, node): doc, node, seq, next."""
    origin = cut(origin)
    steps = adjacency(relation).where(F.col("node.t").isin(reach.tiers(origin, "node")))
    return origin.join(steps, ["doc", "node"]).select("doc", "node", (F.col("rank") - 1).alias("seq"), "next")


def _below(origin: DataFrame, steps: DataFrame) -> DataFrame:
    """doc, origin, node, path of everything below each origin, by rounds; a round joins the tiers that the level has and that have children."""
    inner = set(reach.tiers(steps, "node"))
    level = cut(origin.select("doc", F.col("node").alias("origin"), "node", F.array().cast("array<bigint>").alias("path")))
    found = level.where("false")
    while here := [t for t in reach.tiers(level, "node") if t in inner]:
        own, below = level.where(F.col("node.t").isin(here)), steps.where(F.col("node.t").isin(here))
        n = parts(level.sparkSession, below.count())
        level = cut(own.repartition(n, "doc", "node").join(below.repartition(n, "doc", "node"), ["doc", "node"]).select("doc", "origin", F.col("next").alias("node"), F.concat("path", F.array("rank")).alias("path")))
        found = found.unionByName(level)
    return found


def _in_order(found: DataFrame) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("doc", "origin").orderBy("path")).cast("bigint") - 1
    found = found.repartition(parts(found.sparkSession, found.count()), "doc", "origin")
    return found.select("doc", "origin", seq.alias("seq"), "node")


def transitive(origin: DataFrame, relation: Polyadic) -> DataFrame:
    """Depth-first pre-order below each origin, repeats kept: doc, origin, seq, node. Order comes from the path of ranks."""
    if not relation.acyclic:
        raise ValueError("a transitive walk needs a relation that is declared acyclic")
    return _in_order(_below(origin, cut(adjacency(relation))))


def leaves(origin: DataFrame, relation: Polyadic) -> DataFrame:
    """The nodes without children below each origin, in pre-order; a leaf's own leaf is itself."""
    if not relation.acyclic:
        raise ValueError("a transitive walk needs a relation that is declared acyclic")
    steps = cut(adjacency(relation))
    tiers = reach.tiers(steps, "node")
    own = origin.select("doc", F.col("node").alias("origin"), "node", F.array().cast("array<bigint>").alias("path"))
    found = _below(origin, steps).unionByName(own)
    mixed = found.where(F.col("node.t").isin(tiers)).join(steps.select("doc", "node").distinct(), ["doc", "node"], "left_anti").select(*found.columns)
    return _in_order(mixed.unionByName(found.where(~F.col("node.t").isin(tiers))))


def fiber(origin: DataFrame, relation: Polyadic) -> DataFrame:
    """The distinct nodes that list an origin on the other side: doc, node, source."""
    once = relation.rows.select("doc", "ord", F.array_distinct("sources").alias("sources"), F.array_distinct("targets").alias("targets"))
    pairs = opposite(replace(relation, rows=once), inverse=True).select("doc", "node", F.col("next").alias("source"))
    n = parts(origin.sparkSession, pairs.count())
    found = pairs.repartition(n, "doc", "node").join(origin.select("doc", "node").repartition(n, "doc", "node"), ["doc", "node"], "left_semi").select("doc", "node", "source")
    return found if _single(relation) else found.distinct()


def stored_opposite(relation: Polyadic, ord_: int) -> DataFrame:
    """One instance's targets in order: doc, seq, node."""
    return relation.rows.where(F.col("ord") == ord_).select("doc", F.posexplode("targets").alias("seq", "node"))


def ancestors(origin: DataFrame, relation: Polyadic) -> DataFrame:
    up = opposite(relation, inverse=True).select("doc", F.col("node").alias("l"), F.col("next").alias("r"))
    return walk(origin, Relation(relation.name, up, acyclic=relation.acyclic))[0]


def cyclic(edges: DataFrame) -> DataFrame:
    """The edges (doc, l, r) that peeling leaves: sources without incoming edges go, again and again; what remains lies on or below a cycle."""
    return cycles.on_or_below(edges.select("doc", "l", "r").distinct(), ["doc"])
