"""Profiles: clocks, ordered roots, choices, JSON values and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.model import Polyadic
from strata.operators import reach
from strata.plans.stage import parts

# --- clock: bindings have doc, pos, tick, gap


def spans(bindings: DataFrame) -> DataFrame:
    """doc, idx, start and end as (tick, gap): an event lies between its boundary and the next."""
    w = Window.partitionBy("doc").orderBy("pos")
    at = F.struct("tick", "gap")
    return bindings.select("doc", F.col("pos").alias("idx"), at.alias("start"), F.lead(at).over(w).alias("end")).where("end IS NOT NULL")


def backward(bindings: DataFrame) -> DataFrame:
    """Boundaries bound before the one in front of them."""
    w = Window.partitionBy("doc").orderBy("pos")
    return bindings.withColumn("before", F.lag(F.struct("tick", "gap")).over(w)).where("before > struct(tick, gap)").select("doc", "pos")


def unbound(positions: DataFrame, bindings: DataFrame) -> DataFrame:
    return positions.select("doc", "pos").join(bindings, ["doc", "pos"], "left_anti")


def timing(spans_: DataFrame, quotient: Column, stored: DataFrame | None = None) -> DataFrame:
    """doc, idx, start_text, duration: stored timings win; ``quotient(tick)`` gives the exact text of a tick count."""
    out = spans_.select("doc", "idx", quotient(F.col("start.tick")).alias("start_text"), quotient(F.col("end.tick") - F.col("start.tick")).alias("duration"))
    if stored is None:
        return out
    own = stored.select("doc", "idx", F.col("start_text").alias("s"), F.col("duration").alias("d"))
    return out.join(own, ["doc", "idx"], "left").select("doc", "idx", F.coalesce("s", "start_text").alias("start_text"), F.coalesce("d", "duration").alias("duration"))


# --- roots and choices


def inferred_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that no edge from another node of ``nodes`` leads to."""
    n = parts(nodes.sparkSession, edges.count())
    inner = nodes.where(F.col("node.t").isin(reach.tiers(edges, "l")))
    inside = edges.select("doc", "l", "r").repartition(n, "doc", "l").join(inner.select("doc", F.col("node").alias("l")).repartition(n, "doc", "l"), ["doc", "l"], "left_semi")
    child = inside.select("doc", F.col("r").alias("node")).repartition(n, "doc", "node")
    return nodes.select("doc", "node").repartition(n, "doc", "node").join(child, ["doc", "node"], "left_anti")


def run_roots(runs: DataFrame, blocks: DataFrame) -> DataFrame:
    """``inferred_roots`` of items that lie in ``runs`` (doc, t, start, end; half open) and edges that lie in ``blocks`` (doc, l, t, start, end: l leads to each place
    of the run). Two sweeps along a document's places: one finds the blocks whose parent lies in a run, one what of the runs no such block covers. A row for each
    run and block is moved, and only the roots become places."""
    n, none = parts(runs.sparkSession, blocks.count()), F.lit(0)
    step = lambda at, d: F.struct(F.col(at).alias("at"), F.lit(d).alias("d"))
    borders = lambda: F.inline(F.array(step("start", 1), step("end", -1)))
    empty = F.lit(None).cast("bigint")
    bounds = runs.where("start < end").select("doc", "t", borders()).select("doc", "t", "at", "d", none.alias("below"), empty.alias("start"), empty.alias("end"))
    parents = blocks.where("start < end AND doc IS NOT NULL").select("doc", F.col("l.t").alias("t"), F.col("l.i").alias("at"), none.alias("d"), F.col("t").alias("below"), "start", "end")
    # at one place runs end and begin before a block asks; all runs of a tier have ended where the next tier begins
    asked = Window.partitionBy("doc").orderBy("t", "at", F.col("start").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    known = bounds.unionByName(parents).repartition(n, "doc").withColumn("open", F.sum("d").over(asked)).where("start IS NULL OR open > 0")
    event = lambda t, at, item, cover: F.struct(F.col(t).alias("t"), F.col(at).alias("at"), item.alias("item"), F.lit(cover).alias("cover"))
    own = F.array(event("t", "at", F.col("d"), 0))
    events = known.select("doc", F.inline(F.when(F.col("start").isNull(), own).otherwise(F.array(event("below", "start", none, 1), event("below", "end", none, -1)))))
    order = Window.partitionBy("doc").orderBy("t", "at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    swept = events.select("doc", "t", "at", F.sum("item").over(upto).alias("items"), F.sum("cover").over(upto).alias("covers"), F.lead("t").over(order).alias("next_t"), F.lead("at").over(order).alias("next"))
    bare = swept.where("items > 0 AND covers = 0 AND next_t = t AND next > at")
    return bare.select("doc", "t", F.explode(F.sequence("at", F.col("next") - 1)).alias("i")).select("doc", F.struct("t", "i").alias("node"))


def not_exhaustive(stored: DataFrame, inferred: DataFrame) -> DataFrame:
    """Parentless items that the stored roots leave out."""
    return inferred.join(stored, ["doc", "node"], "left_anti")


def candidates(alternatives: Polyadic) -> DataFrame:
    return alternatives.rows.select("doc", F.element_at("sources", 1).alias("node"), F.posexplode("targets").alias("seq", "candidate"))


def default(alternatives: Polyadic, chosen: Polyadic) -> DataFrame:
    """doc, node, candidate: the persisted choice, which must be among the alternatives; NULL where there is none."""
    own = chosen.rows.select("doc", "sources", F.element_at("targets", 1).alias("candidate"))
    pairs = alternatives.rows.join(own, ["doc", "sources"], "left")
    return pairs.select("doc", F.element_at("sources", 1).alias("node"), F.when(F.array_contains("targets", F.col("candidate")), F.col("candidate")).alias("candidate"))


# --- JSON objects of scalars as nodes and occurrences


def json_members(df: DataFrame, column: str) -> DataFrame:
    """doc, occurrence, key, kind, value of the members of a flat JSON object, by sorted key."""
    parsed = F.from_json(column, "map<string,string>")
    rows = df.select("doc", F.posexplode(F.array_sort(F.map_entries(parsed))).alias("occurrence", "e"))
    v = F.col("e.value")
    kind = F.when(v.isNull(), "null").when(v.isin("true", "false"), "boolean").when(v.rlike(r"\A-?(0|[1-9][0-9]*)\z"), "integer").when(v.rlike(r"\A-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"), "double").otherwise("string")
    return rows.select("doc", "occurrence", F.col("e.key").alias("key"), kind.alias("kind"), v.alias("value"))


def json_nodes(df: DataFrame, column: str) -> DataFrame:
    """doc, id, kind: pre-order, the object first."""
    members = json_members(df, column)
    return df.select("doc", F.lit(0).alias("id"), F.lit("object").alias("kind")).unionByName(members.select("doc", (F.col("occurrence") + 1).alias("id"), "kind"))


def json_text(members: DataFrame) -> DataFrame:
    """doc, text: the compact object again, keys sorted."""
    quoted = F.when(F.col("kind") == "string", F.to_json(F.array("value")).substr(F.lit(2), F.length(F.to_json(F.array("value"))) - 2)).otherwise(F.coalesce("value", F.lit("null")))
    key = F.to_json(F.array("key")).substr(F.lit(2), F.length(F.to_json(F.array("key"))) - 2)
    pair = F.concat(key, F.lit(":"), quoted)
    joined = F.array_sort(F.collect_list(F.struct("occurrence", pair.alias("p"))))
    return members.groupBy("doc").agg(joined.alias("x")).select("doc", F.concat(F.lit("{"), F.array_join(F.transform("x", lambda r: r.p), ","), F.lit("}")).alias("text"))


# --- spans: base has doc, idx, surface


def offsets(base: DataFrame) -> DataFrame:
    """doc, idx, char_start, char_end by the lengths of what stands before."""
    w = Window.partitionBy("doc").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("surface")).over(w)
    return base.select("doc", "idx", (end - F.length("surface")).alias("char_start"), end.alias("char_end"))


def span_view(covered: DataFrame, base: DataFrame) -> DataFrame:
    """doc, span, start, end, char_start, char_end, contiguous. ``covered`` has doc, span, idx: the base items that a span covers."""
    at = covered.join(offsets(base), ["doc", "idx"])
    out = at.groupBy("doc", "span").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("end"), F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.count_distinct("idx").alias("width"))
    return out.select("doc", "span", "start", "end", "char_start", "char_end", (F.col("width") == F.col("end") - F.col("start")).alias("contiguous"))


def run_view(runs: DataFrame) -> DataFrame:
    """The view of spans that lie one behind the other and cover the base together. ``runs`` has doc, span, width, chars: how many base items and characters each piece of a
    span has; pieces of one span are one. What stands before tells where a span begins, so a row for each span is moved and no base item."""
    whole = runs.groupBy("doc", "span").agg(F.sum("width").alias("width"), F.sum("chars").alias("chars"))
    w = Window.partitionBy("doc").orderBy("span").rowsBetween(Window.unboundedPreceding, 0)
    at = whole.where("width > 0").select("doc", "span", "width", "chars", F.sum("width").over(w).alias("end"), F.sum("chars").over(w).alias("char_end"))
    return at.select("doc", "span", (F.col("end") - F.col("width")).alias("start"), "end", (F.col("char_end") - F.col("chars")).alias("char_start"), "char_end", F.lit(True).alias("contiguous"))


def overlapping(view: DataFrame) -> DataFrame:
    """Spans that begin before the one in front of them ends."""
    w = Window.partitionBy("doc").orderBy("start", "end", "span")
    return view.withColumn("before", F.lag("end").over(w)).where("before > start").select("doc", "span")


def crossings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs that overlap without one holding the other: doc, a, b. Spans are ordered covers, so a crossing begins or ends strictly inside;
    each span meets only those that share a base item with it: the equi-join is on (doc, base item) of the boundary inside."""
    inside = a.select("doc", F.col("span").alias("a"), F.col("start").alias("s1"), F.col("end").alias("e1"))
    other = b.select("doc", F.col("span").alias("b"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    cells = inside.withColumn("at", F.explode(F.sequence("s1", F.col("e1") - 1)))
    edges = other.withColumn("at", F.explode(F.array_distinct(F.array(F.col("s2"), F.col("e2") - 1))))
    met = cells.join(edges, ["doc", "at"]).where("(s1 < s2 AND s2 < e1 AND e1 < e2) OR (s2 < s1 AND s1 < e2 AND e2 < e1)")
    return met.select("doc", "a", "b").distinct()


def ranked(alternatives: DataFrame) -> DataFrame:
    """Adds ``rank``: scored first, higher scores first, then by path. Has doc, span, path, score."""
    w = Window.partitionBy("doc", "span").orderBy(F.col("score").desc_nulls_last(), "path")
    return alternatives.withColumn("rank", F.row_number().over(w).cast("bigint") - 1)


def span_jsonl(view: DataFrame) -> DataFrame:
    """doc, line: one record for each document with its spans in order."""
    one = F.struct("start", "end", "span", "char_start", "char_end")
    gathered = view.groupBy("doc").agg(F.array_sort(F.collect_list(one)).alias("x"))
    shown = F.transform("x", lambda s: F.struct(s.char_end.alias("char_end"), s.char_start.alias("char_start"), s["end"].alias("end"), s.span.alias("label"), s.start.alias("start")))
    return gathered.select("doc", F.to_json(F.struct(shown.alias("spans"))).alias("line"))
