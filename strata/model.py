"""A corpus of layered documents as DataFrames.

Every table carries ``doc``. A *node* of the item or boundary kind is ``struct<t: int, i: bigint>``: the tier's ordinal and the index
in it. Spark orders structs field by field, so ordering nodes is the canonical, tier-major order.

=============  =================================================================================================
table          columns
=============  =================================================================================================
tiers          doc, t, tier, long_name, item_type (null: untyped), n
items          doc, node, durable_id
attrs          doc, domain, node, owner, ord, name, value_type, lexical
edges          doc, rel, ord, l_kind, l, r_kind, r, durable_id        (binary relation instances; order is data)
hyper          doc, rel, ord, sources, targets                        (polyadic: arrays of nodes; order is data)
=============  =================================================================================================
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE = "struct<t:int,i:bigint>"


def node(t: Column | int, i: Column) -> Column:
    t = F.lit(t) if isinstance(t, int) else t
    return F.struct(t.cast("int").alias("t"), i.cast("bigint").alias("i"))


@dataclass(frozen=True)
class Tier:
    """One ordered tier of every document: its rows, in the order of ``idx``."""

    t: int
    name: str
    rows: DataFrame  # doc, idx and any value columns
    item_type: str | None = None
    long_name: str = ""
    durable: str | None = None  # the column that holds durable ids
    spine: DataFrame | None = None  # doc, idx alone, where they are known without the rows

    @property
    def places(self) -> DataFrame:
        return self.rows if self.spine is None else self.spine


@dataclass(frozen=True)
class Relation:
    """A declared relation: ``edges`` has doc, ord, l, r (nodes); promises are checked by ``operators.validate``."""

    name: str
    edges: DataFrame
    l_kind: str = "item"
    r_kind: str = "item"
    acyclic: bool = False
    single_parent: bool = False
    blocks: DataFrame | None = None  # doc, l, t, start, end: the same edges where they lie in runs, l leads to each place of [start, end) of tier t


@dataclass(frozen=True)
class Polyadic:
    """An ordered hyperedge relation: ``rows`` has doc, ord, sources, targets (arrays of nodes)."""

    name: str
    rows: DataFrame
    acyclic: bool = False
    unique_sources: bool = False


@dataclass(frozen=True)
class Corpus:
    """Tiers and relations that share documents. Immutable: every change is a new value over new plans."""

    tiers: tuple[Tier, ...]
    relations: tuple[Relation, ...] = ()
    polyadic: tuple[Polyadic, ...] = ()
    attributes: dict[str, tuple[str, str]] = field(default_factory=dict)  # column -> (domain, type)
    runs: DataFrame | None = None  # doc, t, start, end: all items, half open, where they are known without the rows

    def tier(self, name: str) -> Tier:
        for x in self.tiers:
            if x.name == name:
                return x
        raise KeyError(f"undeclared tier {name}")

    def relation(self, name: str) -> Relation:
        for x in self.relations:
            if x.name == name:
                return x
        raise KeyError(f"undeclared relation {name}")

    def with_(self, **changes) -> Corpus:
        return replace(self, **changes)

    def items(self) -> DataFrame:
        """doc, node, durable_id of all items."""
        parts = [(x.rows if x.durable else x.places).select("doc", node(x.t, F.col("idx")).alias("node"), (F.col(x.durable).cast("string") if x.durable else F.lit(None).cast("string")).alias("durable_id")) for x in self.tiers]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def tier_rows(self) -> DataFrame:
        """doc, t, tier, item_type, n: a row for each tier that has items in a document."""
        parts = [x.places.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).select("doc", F.lit(x.t).alias("t"), F.lit(x.name).alias("tier"), F.lit(x.item_type).alias("item_type"), "n") for x in self.tiers]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def positions(self, name: str) -> DataFrame:
        """doc, pos, n: the n + 1 boundaries of a tier."""
        counted = self.tier(name).rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
        return counted.select("doc", F.explode(F.sequence(F.lit(0).cast("bigint"), "n")).alias("pos"), "n")


def tier_from(df: DataFrame, t: int, name: str, doc: Column, order_by: list[Column], columns: dict[str, Column], **options) -> Tier:
    """A tier whose items are the rows of ``df``, in a total order inside each document."""
    window = Window.partitionBy("doc").orderBy(*order_by)
    staged = df.withColumn("doc", doc).withColumn("idx", F.row_number().over(window).cast("bigint") - 1)
    return Tier(t, name, staged.select("doc", "idx", *(c.alias(k) for k, c in columns.items())), **options)


def containment(name: str, parents: Tier, children: Tier, key: str, parent_key: str) -> tuple[Relation, Polyadic]:
    """A tree from parents to children by equal keys: as binary edges and as one ordered hyperedge for each parent."""
    p = parents.rows.select("doc", F.col("idx").alias("p"), F.col(parent_key).alias("k"))
    c = children.rows.select("doc", F.col("idx").alias("c"), F.col(key).alias("k"))
    pairs = p.join(c, ["doc", "k"]).select("doc", node(parents.t, F.col("p")).alias("l"), node(children.t, F.col("c")).alias("r"))
    edges = pairs.withColumn("ord", F.row_number().over(Window.partitionBy("doc").orderBy("l", "r")).cast("bigint") - 1)
    grouped = pairs.groupBy("doc", "l").agg(F.array_sort(F.collect_list("r")).alias("targets"))
    rows = grouped.select("doc", F.col("l.i").alias("ord"), F.array("l").alias("sources"), "targets")
    return Relation(name, edges, acyclic=True, single_parent=True), Polyadic(name, rows, acyclic=True, unique_sources=True)
