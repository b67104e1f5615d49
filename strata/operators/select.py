"""Selection: canonical node sets and their algebra.

A node set has the columns of ``KEY`` and no duplicates. Kinds are numbered in canonical order: document 0, tier 1, item 2,
position 3, relation declaration 4, relation instance 5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.model import Corpus

KEY = ["doc", "kind", "t", "i", "decl", "l", "r", "ord"]
DOCUMENT, TIER, ITEM, POSITION, DECLARATION, INSTANCE = range(6)
DOMAINS = {"document": DOCUMENT, "tier": TIER, "item": ITEM, "position": POSITION, "relation_declaration": DECLARATION, "relation_instance": INSTANCE}
_NONE = {"t": "int", "i": "bigint", "decl": "int", "l": "struct<t:int,i:bigint>", "r": "struct<t:int,i:bigint>", "ord": "bigint"}


def _key(df: DataFrame, kind: int, **columns) -> DataFrame:
    return df.select("doc", F.lit(kind).alias("kind"), *((columns[c].cast(k) if c in columns else F.lit(None).cast(k)).alias(c) for c, k in _NONE.items()))


def tier(corpus: Corpus, name: str) -> DataFrame:
    x = corpus.tier(name)
    return _key(x.rows.select("doc").distinct(), TIER, t=F.lit(x.t))


def items(corpus: Corpus, name: str) -> DataFrame:
    x = corpus.tier(name)
    return _key(x.rows, ITEM, t=F.lit(x.t), i=F.col("idx"))


def of_type(corpus: Corpus, item_type: str) -> DataFrame:
    """Items of every tier that has the type."""
    parts = [items(corpus, x.name) for x in corpus.tiers if x.item_type == item_type]
    if not parts:
        raise KeyError(f"no tier has the type {item_type}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def boundaries(corpus: Corpus, name: str) -> DataFrame:
    x = corpus.tier(name)
    return _key(corpus.positions(name), POSITION, t=F.lit(x.t), i=F.col("pos"))


def item(corpus: Corpus, name: str, index: int) -> DataFrame:
    return items(corpus, name).where(F.col("i") == index)


def durable_item(corpus: Corpus, ids: DataFrame) -> DataFrame:
    """The items with the durable ids of ``ids`` (doc, durable_id)."""
    found = corpus.items().where("durable_id IS NOT NULL").join(ids, ["doc", "durable_id"], "left_semi")
    return _key(found, ITEM, t=F.col("node.t"), i=F.col("node.i"))


def anchored_boundary(corpus: Corpus, anchors: DataFrame) -> DataFrame:
    """Boundaries named by an anchor: ``anchors`` has doc, durable_id (null: the tier), tier, side (before or after)."""
    named = anchors.where("durable_id IS NOT NULL").join(corpus.items().where("durable_id IS NOT NULL"), ["doc", "durable_id"])
    by_item = named.select("doc", F.col("node.t").alias("t"), (F.col("node.i") + F.when(F.col("side") == "after", 1).otherwise(0)).alias("pos"))
    tiers = anchors.where("durable_id IS NULL").join(corpus.tier_rows(), ["doc", "tier"])
    by_tier = tiers.select("doc", "t", F.when(F.col("side") == "after", F.col("n")).otherwise(0).alias("pos"))
    return _key(by_item.unionByName(by_tier).distinct(), POSITION, t=F.col("t"), i=F.col("pos"))


def with_attribute(corpus: Corpus, name: str, domain: str, tier_name: str | None = None, relation: str | None = None) -> DataFrame:
    """Owners that carry the attribute, in one of the six domains; presence, not value."""
    declared = corpus.attributes.get(name)
    if declared is None or declared[0] != domain:
        raise KeyError(f"attribute {name} isn't declared for {domain}")
    kind = DOMAINS[domain]
    if domain == "item":
        parts = [_key(x.rows.where(F.col(name).isNotNull()), ITEM, t=F.lit(x.t), i=F.col("idx")) for x in corpus.tiers if name in x.rows.columns and tier_name in (None, x.name)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    if domain == "relation_instance":
        decl = [x.name for x in corpus.relations].index(relation)
        edges = corpus.relation(relation).edges.where(F.col(name).isNotNull())
        return _key(edges, kind, decl=F.lit(decl), l=F.col("l"), r=F.col("r"), ord=F.col("ord"))
    if domain == "relation_declaration":
        decl = [x.name for x in corpus.relations].index(relation)
        return _key(corpus.relation(relation).edges.select("doc").distinct(), kind, decl=F.lit(decl))
    x = corpus.tier(tier_name or corpus.tiers[0].name)
    rows = x.rows.where(F.col(name).isNotNull()) if name in x.rows.columns else x.rows
    if domain == "position":
        return _key(rows, kind, t=F.lit(x.t), i=F.col("idx"))
    return _key(rows.select("doc").distinct(), kind, **({"t": F.lit(x.t)} if domain == "tier" else {}))


def union(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def in_order(nodes: DataFrame) -> DataFrame:
    """The set in canonical order; order belongs to the output only."""
    return nodes.orderBy(*KEY)
