"""Recognition: a chart over every span of every document's tokens, built by width, all documents at once.

Rules are tables: a rule has a left side, a weight and a source pattern of terminals (one token) and holes (a nonterminal over at least one
token). Nullable holes and unit rules are rewritten on the driver, the rules being few. Each chart row carries whether it is recognised, the
number of derivations and the cheapest ones, so those need no forest; ``operators.forest`` makes one where the applications themselves are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.plans.stage import cut


@dataclass(frozen=True)
class Rule:
    left: str
    pattern: tuple[tuple[str, str], ...]  # ("t", text) or ("n", nonterminal)
    weight: int = 1


def nullable(rules: list[Rule]) -> set[str]:
    found: set[str] = set()
    while True:
        more = {r.left for r in rules if all(k == "n" and v in found for k, v in r.pattern)} - found
        if not more:
            return found
        found |= more


def is_unit(rule: Rule) -> bool:
    return len(rule.pattern) == 1 and rule.pattern[0][0] == "n"


def variants(rules: list[Rule]) -> list[tuple[int, int, Rule]]:
    """(original rule, variant, rule) without empty and unit rules: every subset of nullable holes left out, unit chains followed. A rule's variants
    are numbered by the holes they keep, a later hole weighing more; equal patterns of a rule are one variant."""
    empty = nullable(rules)
    out: dict[tuple[int, str, tuple], tuple[int, Rule]] = {}
    for n, r in enumerate(rules):
        holes = [i for i, (k, v) in enumerate(r.pattern) if k == "n" and v in empty]
        for kept in range(1 << len(holes)):
            gone = {i for j, i in enumerate(holes) if not kept >> j & 1}
            pattern = tuple(x for i, x in enumerate(r.pattern) if i not in gone)
            if pattern:
                out.setdefault((n, r.left, pattern), (kept, Rule(r.left, pattern, r.weight)))
    units = {(r.left, r.pattern[0][1]) for _, r in out.values() if is_unit(r)}
    while True:
        more = {(a, d) for a, b in units for c, d in units if b == c} - units
        if not more:
            break
        units |= more
    full = {k: x for k, x in out.items() if not is_unit(x[1])}
    for above, below in units:
        for (n, left, pattern), (kept, r) in list(full.items()):
            if left == below:
                full.setdefault((n, above, pattern), (kept, Rule(above, pattern, r.weight)))
    return [(k[0], kept, r) for k, (kept, r) in sorted(full.items())]


def expanded(rules: list[Rule]) -> list[tuple[int, Rule]]:
    return [(n, r) for n, _, r in variants(rules)]


def counted(rules: list[Rule]) -> None:
    """Counting and ranking refuse rules that could derive a span in endlessly many ways."""
    if nullable(rules) or any(is_unit(r) for r in rules):
        raise ValueError("counting needs a grammar without unit and nullable rules")


COST = "array<struct<v:bigint,p:array<int>>>"


def longest(tokens: DataFrame, most: int | None = None) -> int:
    """The tokens of the longest document; more than ``most`` are refused."""
    found = tokens.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first().n or 0
    if most is not None and found > most:
        raise ValueError(f"a document has {found} tokens, more than {most}")
    return max(1, found)


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chart(tokens: DataFrame, rules: list[Rule], most: int | None = None, k: int = 1) -> DataFrame:
    """doc, nt, s, e, n, best of each recognised span, half open. ``tokens`` has doc, idx, token; the chart is as wide as the longest document, and
    one of more than ``most`` tokens is refused.

    A rule's pattern is matched element by element: partial matches are rows (rule, elements matched, start, end) and the chart joins them on the
    document and the place where the next element begins. ``best`` holds the ``k`` cheapest derivations as (cost, rules used, in order).
    """
    ids = {}
    for n, r in expanded(rules):
        ids.setdefault((n, r.left, r.pattern), len(ids))
    flat = [(ids[(n, r.left, r.pattern)], n, r.left, i, kind, v, r.weight, len(r.pattern)) for n, r in expanded(rules) for i, (kind, v) in enumerate(r.pattern)]
    spark = tokens.sparkSession
    elements = F.broadcast(spark.createDataFrame(flat, "rid int, rule int, nt string, at int, kind string, symbol string, weight bigint, size int"))  # the grammar
    prune = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k)
    join = lambda a, b: F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct((x.v + y.v).alias("v"), F.concat(x.p, y.p).alias("p")))))
    one = F.array(F.struct(F.lit(0).cast("bigint").alias("v"), F.array().cast("array<int>").alias("p"))).cast(COST)
    terminals = cut(tokens.select("doc", F.col("idx").cast("int").alias("s"), (F.col("idx") + 1).cast("int").alias("e"), F.lit("t").alias("kind"), F.col("token").alias("symbol"), F.lit(1).cast("decimal(38,0)").alias("n"), one.alias("best")))
    known, partials = [terminals], []  # spans, and matches (doc, rid, at, s, e, n, best) of elements 0..at over [s, e): a part for each width
    results = []
    for width in range(1, longest(tokens, most) + 1):
        # an element that ends at the right place completes a match of this width: the end is part of the join's key
        first = terminals.where(F.lit(width == 1)).join(elements.where("at = 0"), ["kind", "symbol"]).select("doc", "rid", "rule", "nt", "at", "s", "e", "weight", "size", "n", "best")
        grown = first
        if partials:
            right = union_all(known).select("doc", F.col("s").alias("m"), F.col("e").alias("e2"), "kind", "symbol", F.col("n").alias("n2"), F.col("best").alias("best2"))
            nexts = elements.select(F.col("rid").alias("rid2"), F.col("at").alias("at2"), F.col("kind").alias("kind2"), F.col("symbol").alias("symbol2"))
            left = union_all(partials).select("doc", "rid", "rule", "nt", "at", "s", F.col("e").alias("e1"), (F.col("s") + width).alias("e2"), "weight", "size", "n", "best").join(nexts, F.expr("rid = rid2 AND at2 = at + 1"))
            left = left.withColumnsRenamed({"kind2": "kind", "symbol2": "symbol", "e1": "m"})
            more = left.join(right, ["doc", "kind", "symbol", "m", "e2"])
            longer = more.select("doc", "rid", "rule", "nt", F.col("at2").alias("at"), "s", F.col("e2").alias("e"), "weight", "size", (F.col("n") * F.col("n2")).cast("decimal(38,0)").alias("n"), prune(join(F.col("best"), F.col("best2"))).alias("best"))
            grown = first.unionByName(longer)
        grown = grown.groupBy("doc", "rid", "rule", "nt", "at", "s", "e", "weight", "size").agg(F.sum("n").cast("decimal(38,0)").alias("n"), prune(F.flatten(F.collect_list("best"))).alias("best"))
        grown = cut(grown)
        whole = grown.where("at = size - 1").withColumn("best", F.transform("best", lambda x: F.struct((x.v + F.col("weight")).alias("v"), F.concat(F.array("rule"), x.p).alias("p"))))
        spans = whole.groupBy("doc", "nt", "s", "e").agg(F.sum("n").cast("decimal(38,0)").alias("n"), prune(F.flatten(F.collect_list("best"))).alias("best"))
        spans = cut(spans)
        again = spans.select("doc", "s", "e", F.lit("n").alias("kind"), F.col("nt").alias("symbol"), "n", "best")
        # a hole as the first element of a longer rule: a span of this width starts further partial matches
        starts = again.join(elements.where("at = 0"), ["kind", "symbol"]).select("doc", "rid", "rule", "nt", "at", "s", "e", "weight", "size", "n", "best")
        partials.append(cut(grown.where("at < size - 1").unionByName(starts.where("size > 1"))))
        known.append(again)
        results.append(spans)
    return union_all(results)


def spans(tokens: DataFrame, rules: list[Rule], most: int | None = None) -> DataFrame:
    """doc, nt, s, e of each recognised span: ``chart`` where neither counts nor derivations are asked for, so a round moves places only. What a width adds is one table
    of spans (nt) and partial matches (rid, at); a span that begins a rule is such a match too and isn't written again. ``tokens`` is read in each round."""
    flat = [(rid, left, at, kind, v, len(pattern)) for rid, (left, pattern) in enumerate(sorted({(r.left, r.pattern) for _, r in expanded(rules)})) for at, (kind, v) in enumerate(pattern)]
    elements = F.broadcast(tokens.sparkSession.createDataFrame(flat, "rid int, left string, at int, kind string, symbol string, size int"))  # the grammar
    units = tokens.select("doc", F.lit("t").alias("kind"), F.col("token").alias("symbol"), F.col("idx").cast("int").alias("s"), (F.col("idx") + 1).cast("int").alias("e"))
    begun = lambda rows: rows.join(elements.where("at = 0"), ["kind", "symbol"]).select("doc", "rid", "left", "at", "size", "s", "e")
    last, made = F.col("at") == F.col("size") - 1, []
    for width in range(1, longest(tokens, most) + 1):
        if width == 1:
            grown = begun(units)
        else:
            known = union_all(made)
            whole = known.where("nt IS NOT NULL").select("doc", F.lit("n").alias("kind"), F.col("nt").alias("symbol"), "s", "e")
            partial = known.where("nt IS NULL").select("doc", "rid", "at", "s", "e").unionByName(begun(whole).select("doc", "rid", "at", "s", "e"))
            # an element that ends at the right place completes a match of this width: the end is part of the join's key
            nexts = partial.select("doc", "rid", (F.col("at") + 1).alias("at"), "s", F.col("e").alias("m"), (F.col("s") + width).alias("e")).join(elements, ["rid", "at"])
            right = units.unionByName(whole).withColumnRenamed("s", "m")
            grown = nexts.join(right, ["doc", "kind", "symbol", "m", "e"]).select("doc", "rid", "left", "at", "size", "s", "e")
        made.append(cut(grown.select("doc", F.when(last, F.col("left")).alias("nt"), F.when(~last, F.col("rid")).alias("rid"), F.when(~last, F.col("at")).alias("at"), "s", "e").distinct()))
    return union_all(made).where("nt IS NOT NULL").select("doc", "nt", "s", "e")


def recognised(tokens: DataFrame, rules: list[Rule], start: str, most: int | None = None, k: int = 1) -> DataFrame:
    """doc, n_tokens, recognised, n, best of each document's whole span."""
    size = tokens.groupBy("doc").agg(F.count(F.lit(1)).cast("int").alias("n_tokens"))
    top = chart(tokens, rules, most, k).where((F.col("nt") == start) & (F.col("s") == 0))
    found = size.join(top.withColumnRenamed("e", "n_tokens"), ["doc", "n_tokens"], "left").select("doc", "n_tokens", F.col("n").isNotNull().alias("recognised"), F.coalesce("n", F.lit(0)).cast("decimal(38,0)").alias("n"), "best")
    return found


def count(tokens: DataFrame, rules: list[Rule], start: str, most: int | None = None) -> DataFrame:
    counted(rules)
    return recognised(tokens, rules, start, most).select("doc", "n_tokens", "n")


def cheapest(tokens: DataFrame, rules: list[Rule], start: str, most: int | None, k: int) -> DataFrame:
    """doc, rank, cost, rules: the ``k`` cheapest derivations."""
    counted(rules)
    best = recognised(tokens, rules, start, most, k).select("doc", F.posexplode("best").alias("rank", "x"))
    return best.select("doc", "rank", F.col("x.v").alias("cost"), F.col("x.p").alias("rules"))
