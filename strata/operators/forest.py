"""Packed parse forests: the rule applications behind every recognised span, as tables beside the chart.

A span (doc, nt, s, e) is an OR node, an application an AND node over its children's spans. Once the chart is complete, all applications of all documents
come from one join for each element of the longest rule: a partial match is a row, extended by the spans that begin where it ends, and the last
element's join has the span's end in its key. ``packed`` then goes down from the root spans, so that only what some derivation uses stays.

The alternatives of a span have ranks from 0: by the rule's place in the grammar, the children's spans from left to right, and the order in which a rule's
nullable holes are left out. Ranks don't depend on weights, on the order of rows, or on other spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.lexical import index, pointer_escape, pointer_segments
from strata.operators.grammar import Rule, variants
from strata.plans.stage import cut

CHILD = "struct<nt:string,s:int,e:int>"
SPAN = ["doc", "nt", "s", "e"]


def applications(tokens: DataFrame, spans: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc, nt, s, e, rank, rule, weight, children: every application of every span of the chart (doc, nt, s, e). ``rule`` is the place in ``rules``."""
    spark, found = tokens.sparkSession, variants(rules)
    table = spark.createDataFrame([(v, n, order, r.left, len(r.pattern), r.weight) for v, (n, order, r) in enumerate(found)], "rid int, rule int, variant int, nt string, size int, weight bigint")
    elements = [(v, at, kind, symbol) for v, (_, _, r) in enumerate(found) for at, (kind, symbol) in enumerate(r.pattern)]
    elements = spark.createDataFrame(elements, "rid int, at int, kind string, symbol string")
    grown = spans.select(*SPAN).join(F.broadcast(table), "nt").where("e - s >= size")  # both sides of the grammar's size are known: its rules
    grown = grown.withColumn("m", F.col("s")).withColumn("children", F.array().cast(f"array<{CHILD}>"))
    whole = spans.select("doc", F.lit("n").alias("kind"), F.col("nt").alias("symbol"), F.col("s").alias("m"), F.col("e").alias("to"))
    units = tokens.select("doc", F.lit("t").alias("kind"), F.col("token").alias("symbol"), F.col("idx").cast("int").alias("m"), (F.col("idx") + 1).cast("int").alias("to")).unionByName(whole)
    done = None
    for at in range(max((len(r.pattern) for _, _, r in found), default=0)):
        here = grown.join(F.broadcast(elements.where(F.col("at") == at).drop("at")), "rid")
        last = here.where(F.col("size") == at + 1).withColumn("to", F.col("e")).join(units, ["doc", "kind", "symbol", "m", "to"])
        longer = here.where(F.col("size") > at + 1).join(units, ["doc", "kind", "symbol", "m"]).where(F.col("to") <= F.col("e") - (F.col("size") - at - 1))
        child = F.when(F.col("kind") == "n", F.array(F.struct(F.col("symbol").alias("nt"), F.col("m").alias("s"), F.col("to").alias("e")))).otherwise(F.array().cast(f"array<{CHILD}>"))
        step = lambda rows: rows.withColumn("children", F.concat("children", child)).withColumn("m", F.col("to")).drop("kind", "symbol", "to")  # noqa: B023, E731
        ended, grown = step(last), step(longer)
        done = ended if done is None else done.unionByName(ended)
    if done is None:
        return grown.select(*SPAN, F.lit(0).cast("bigint").alias("rank"), "rule", "weight", "children").where("false")
    order = Window.partitionBy(*SPAN).orderBy("rule", F.transform("children", lambda c: F.struct(c.s, c.e)), "variant")
    return done.select(*SPAN, (F.row_number().over(order).cast("bigint") - 1).alias("rank"), "rule", "weight", "children")


def arcs(applied: DataFrame) -> DataFrame:
    """doc, span, child: which span an application of which uses."""
    return applied.select("doc", F.struct("nt", "s", "e").alias("span"), F.explode(F.array_distinct("children")).alias("child")).distinct()


def packed(applied: DataFrame, tokens: DataFrame, start: str) -> DataFrame:
    """The applications that some derivation of a document's whole span from ``start`` uses. A round for each level of the deepest derivation; a span is
    expanded once, however many derivations share it."""
    applied = cut(applied)  # read for the arcs and for what is left of it
    size = tokens.groupBy("doc").agg(F.count(F.lit(1)).cast("int").alias("e"))
    below = cut(arcs(applied))
    frontier = cut(size.select("doc", F.struct(F.lit(start).alias("nt"), F.lit(0).alias("s"), "e").alias("span")))
    seen, rounds = frontier, 0
    while True:
        children = frontier.join(below, ["doc", "span"]).select("doc", F.col("child").alias("span")).distinct()
        frontier = cut(children.join(seen, ["doc", "span"], "left_anti"))
        if frontier.isEmpty():
            break
        rounds += 1
        seen = cut(seen.unionByName(frontier)) if rounds % 8 == 0 else seen.unionByName(frontier)
    used = seen.select("doc", "span.nt", "span.s", "span.e")
    return applied.join(used, SPAN, "left_semi")


def sizes(forest: DataFrame) -> DataFrame:
    """doc, spans, applications, arcs: what a packed forest holds, shared parts once."""
    held = forest.groupBy("doc").agg(F.count_distinct(F.struct("nt", "s", "e")).alias("spans"), F.count(F.lit(1)).alias("applications"), F.sum(F.size("children")).alias("arcs"))
    return held


def _by_width(forest: DataFrame) -> DataFrame:
    """All spans of one width are one join and one aggregation."""
    rows = cut(forest.withColumn("a", F.monotonically_increasing_id()).withColumn("width", F.col("e") - F.col("s")))
    known = None
    for width in [r.width for r in rows.select("width").distinct().orderBy("width").collect()]:  # at most as many as tokens
        own = rows.where(F.col("width") == width)
        product = own.select("a", *SPAN, F.lit(1).cast("decimal(38,0)").alias("n"), F.explode_outer("children").alias("c"))
        if known is not None:
            below = known.select("doc", F.struct("nt", "s", "e").alias("c"), F.col("n").alias("below"))
            product = product.join(below, ["doc", "c"], "left")
        else:
            product = product.withColumn("below", F.lit(None).cast("decimal(38,0)"))
        # a product of whole numbers, exact: children are few, so they are gathered
        factor = F.aggregate(F.collect_list(F.when(F.col("c").isNull(), F.lit(1)).otherwise(F.coalesce("below", F.lit(0))).cast("decimal(38,0)")), F.lit(1).cast("decimal(38,0)"), lambda x, y: (x * y).cast("decimal(38,0)"))
        made = cut(product.groupBy("a", *SPAN).agg(factor.alias("n")).groupBy(*SPAN).agg(F.sum("n").cast("decimal(38,0)").alias("n")))
        known = made if known is None else known.unionByName(made)
    return forest.select(*SPAN, F.lit(0).cast("decimal(38,0)").alias("n")).where("false") if known is None else known


GATHERED = 100_000  # applications of a document that one task may hold


def _in_tasks(forest: DataFrame) -> DataFrame:
    """Each document is counted by itself in exact integers."""
    rows = forest.groupBy("doc").agg(F.collect_list(F.struct("nt", "s", "e", "children")).alias("held"))
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda rows: list(zip(*(rows.field(c).to_pylist() for c in ("nt", "s", "e"))))
        for batch in batches:
            sizes, k = batch.column("held").value_lengths().to_pylist(), 0
            while k < batch.num_rows:  # as many documents at once as make a bounded number of Python objects
                start, total = k, 0
                while k < batch.num_rows and (k == start or total + sizes[k] <= 50_000):
                    total, k = total + sizes[k], k + 1
                held = batch.column("held").slice(start, k - start).flatten()
                own, below, first = named(held), named(held.field("children").flatten()), [0, *accumulate(held.field("children").value_lengths().to_pylist())]
                at, spans, values, low = [], [], [], 0
                for doc in range(start, k):
                    n: dict[tuple, int] = {}
                    for i in sorted(range(low, low + sizes[doc]), key=lambda i: own[i][2] - own[i][1]):  # children are narrower  # noqa: B023
                        ways = 1
                        for c in below[first[i] : first[i + 1]]:
                            ways *= n.get(c, 0)
                        n[own[i]] = n.get(own[i], 0) + ways
                    low += sizes[doc]
                    at += [doc] * len(n)
                    spans += n
                    values += n.values()
                if max(values) >= 10**38:
                    raise ValueError("a count of more than 38 digits")
                made = [pa.array(x, kind) for x, kind in zip(zip(*spans), (pa.string(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(at)), *made, pa.array(map(Decimal, values), pa.decimal128(38, 0))], [*SPAN, "n"])

    return rows.mapInArrow(run, f"doc {kind}, nt string, s int, e int, n decimal(38,0)")


def counts(forest: DataFrame, gathered: int = GATHERED) -> DataFrame:
    """doc, nt, s, e, n: derivations of each span, children first. Documents of at most ``gathered`` applications are counted in a task each, all in one pass; larger ones in a round for each width."""
    rows = cut(forest.select(*SPAN, "children"))
    large = cut(rows.groupBy("doc").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > gathered).select("doc"))
    if large.isEmpty():
        return _in_tasks(rows)
    return _in_tasks(rows.join(large, "doc", "left_anti")).unionByName(_by_width(rows.join(large, "doc", "left_semi")))


# --- paths into the chart: /chart/NONTERMINAL/START/END/alternatives/INDEX


def spelled(nt: Column, s: Column, e: Column, rank: Column) -> Column:
    return F.concat(F.lit("/chart/"), pointer_escape(nt), F.lit("/"), s.cast("string"), F.lit("/"), e.cast("string"), F.lit("/alternatives/"), rank.cast("string"))


def resolve(wanted: DataFrame, applied: DataFrame) -> DataFrame:
    """``wanted`` (doc, path) with nt, s, e, rank, rule, children of the application it names, or the code of the refusal. All paths are bound at once, by joins on the chart."""
    at = lambda i: F.get(F.col("__p"), F.lit(i))
    numbers = (2, 3, 5)
    odd = F.coalesce(*[F.when(index(at(i)).isNull(), F.when(at(i).rlike(r"\A\p{Nd}+\z"), "noncanonical_segment").otherwise("invalid_segment")) for i in numbers])
    form = (F.size("__p") == 6) & (at(0) == "chart") & (at(4) == "alternatives")
    early = F.when(F.col("__p").isNull(), "malformed_pointer").when(~form, "unknown_form").otherwise(odd)
    split = wanted.withColumn("__p", pointer_segments(F.col("path")))
    split = split.select(*wanted.columns, early.alias("__code"), at(1).alias("nt"), *(index(at(i)).alias(n) for i, n in zip(numbers, ("s", "e", "rank"))))
    own = applied.select("doc", "nt", F.col("s").cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e"), "rank", "rule", "children")
    known = own.groupBy(*SPAN).agg(F.count(F.lit(1)).alias("__n"))
    found = split.join(known, SPAN, "left").join(own, [*SPAN, "rank"], "left")
    code = F.coalesce("__code", F.when(F.col("__n").isNull(), "profile_refused").when(F.col("rank") >= F.col("__n"), "alternative_out_of_range"))
    kept = lambda c: F.when(code.isNull(), F.col(c)).alias(c)
    return found.select(*wanted.columns, *map(kept, ("nt", "s", "e", "rank", "rule", "children")), code.alias("code"))
