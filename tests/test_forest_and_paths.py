"""Parse forests, chart paths, walks by every plan, and listed paths, against plain versions."""

import random
from itertools import product

import pytest

from strata.model import Relation
from strata.operators import forest, grammar, reach, traverse
from strata.operators.grammar import Rule

DIAMOND = [Rule("S", (("n", "A"), ("n", "B")), 2), Rule("A", (("t", "x"),), 4), Rule("A", (("t", "x"),), 8), Rule("B", (("t", "y"),), 1)]
UNIT = [Rule("S", (("n", "A"),)), Rule("A", (("n", "S"),)), Rule("A", (("t", "x"),))]
GAPS = [Rule("S", (("n", "A"), ("t", "x"), ("n", "A"))), Rule("A", ()), Rule("A", (("n", "A"), ("n", "A"))), Rule("A", (("t", "x"),))]


def tokens(spark, texts):
    return spark.createDataFrame([(d, i, c) for d, t in texts.items() for i, c in enumerate(t)], "doc string, idx int, token string")


def plain_forest(text, rules, start):
    """Applications below the root: {(nt, s, e): {(rule, children, variant)}} by trying every cut."""
    found = grammar.variants(rules)

    def cuts(pattern, s, e):
        if not pattern:
            return [()] if s == e else []
        (kind, symbol), rest = pattern[0], pattern[1:]
        if kind == "t":
            return cuts(rest, s + 1, e) if s < e and text[s] == symbol else []
        return [((symbol, s, m), *more) for m in range(s + 1, e + 1) for more in cuts(rest, m, e)]

    chart = {}
    for width in range(1, len(text) + 1):
        for s in range(len(text) - width + 1):
            for n, variant, r in found:
                for children in cuts(r.pattern, s, s + width):
                    if all(c in chart for c in children):
                        chart.setdefault((r.left, s, s + width), []).append((n, [c[1:] for c in children], variant, children))
    held, todo = {}, [(start, 0, len(text))]
    while todo:
        span = todo.pop()
        if span in chart and span not in held:
            held[span] = sorted(chart[span])
            todo += [c for _, _, _, children in chart[span] for c in children]
    return {(*span, rank, n, tuple(children)) for span, apps in held.items() for rank, (n, _, _, children) in enumerate(apps)}


@pytest.mark.parametrize("rules, texts", [(DIAMOND, ["xy", "x", "yx"]), (UNIT, ["x", "xx"]), (GAPS, ["x", "xx", "xxx", "xxxx", "xy"]), ([Rule("S", (("n", "S"), ("n", "S"))), Rule("S", (("t", "x"),)), Rule("S", (("t", "y"), ("n", "S"), ("t", "y")))], ["xxxx", "yxyx", "yyxxyy", "y"])])
def test_forests(spark, rules, texts):
    df = tokens(spark, {t: t for t in texts})
    applied = forest.applications(df, grammar.chart(df, rules).select("doc", "nt", "s", "e"), rules)
    got = {}
    for r in forest.packed(applied, df, "S").collect():
        got.setdefault(r.doc, set()).add((r.nt, r.s, r.e, r["rank"], r.rule, tuple(tuple(c) for c in r.children)))
    for t in texts:
        assert got.get(t, set()) == plain_forest(t, rules, "S"), t


def test_counts_and_sizes_of_a_packed_forest(spark):
    rules = [Rule("S", (("n", "S"), ("n", "S"))), Rule("S", (("t", "x"),))]
    df = tokens(spark, {"a": "x" * 7, "b": "x"})
    held = forest.packed(forest.applications(df, grammar.chart(df, rules).select("doc", "nt", "s", "e"), rules), df, "S").cache()
    n = {(r.doc, r.s, r.e): int(r.n) for r in forest.counts(held).collect()}
    assert n[("a", 0, 7)] == 132 and n[("a", 2, 6)] == 5 and n[("b", 0, 1)] == 1
    size = {r.doc: (r.spans, r.applications, r.arcs) for r in forest.sizes(held).collect()}
    assert size == {"a": (28, 63, 112), "b": (1, 1, 0)}


@pytest.mark.parametrize("gathered", [10**6, 60, 0])
def test_counts_by_every_plan(spark, monkeypatch, gathered):
    """Counts of documents in tasks and by widths; where all fit a task, longer documents take no more tables."""
    rules = [Rule("S", (("n", "S"), ("n", "S"))), Rule("S", (("t", "x"),)), Rule("S", (("t", "x"),), 5), Rule("S", (("t", "y"), ("n", "S"), ("t", "y")))]
    texts = ["x" * 8, "xx", "x", "yxyx", "yyxxyyx", "y", "yxyxxy"]
    df = tokens(spark, {t: t for t in texts})
    held = forest.packed(forest.applications(df, grammar.spans(df, rules), rules), df, "S").cache()
    want = {}
    for t in texts:
        apps, n = sorted(plain_forest(t, rules, "S"), key=lambda a: a[2] - a[1]), {}
        for nt, s, e, _, _, children in apps:
            ways = 1
            for c in children:
                ways *= n[c]
            n[(nt, s, e)] = n.get((nt, s, e), 0) + ways
        want |= {(t, *span): ways for span, ways in n.items()}
    cuts = []
    monkeypatch.setattr(forest, "cut", lambda x, cut=forest.cut: cuts.append(1) or cut(x))
    assert {(r.doc, r.nt, r.s, r.e): int(r.n) for r in forest.counts(held, gathered).collect()} == want
    assert gathered < 10**6 or len(cuts) == 2


def test_counts_past_38_digits_are_refused(spark):
    one = [("d", "S", i, i + 1, r, []) for i in range(40) for r in range(10)] + [("d", "S", 0, e, 0, [("S", 0, e - 1), ("S", e - 1, e)]) for e in range(2, 41)]
    with pytest.raises(Exception, match="38 digits"):
        forest.counts(spark.createDataFrame(one, "doc string, nt string, s int, e int, rank bigint, children array<struct<nt:string,s:int,e:int>>")).collect()


@pytest.mark.parametrize("rules", [DIAMOND, UNIT, GAPS])
def test_spans_are_those_of_the_chart(spark, monkeypatch, rules):
    """Recognition alone takes one table for each width."""
    df = tokens(spark, {t: t for t in ("xy", "x", "yx", "xxx", "xxxx", "xxyxx")})
    want = sorted(tuple(r) for r in grammar.chart(df, rules).select("doc", "nt", "s", "e").collect())
    cuts = []
    monkeypatch.setattr(grammar, "cut", lambda x, cut=grammar.cut: cuts.append(1) or cut(x))
    assert sorted(tuple(r) for r in grammar.spans(df, rules).collect()) == want and len(cuts) == 5


def test_ranks_do_not_follow_weights_and_rows(spark):
    df = tokens(spark, {"d": "xy"})
    ranks = []
    for rules in (DIAMOND, [*DIAMOND[:1], Rule("A", (("t", "x"),), 9), *DIAMOND[2:]]):
        applied = forest.applications(df.repartition(3), grammar.chart(df, rules).select("doc", "nt", "s", "e"), rules)
        ranks.append(sorted((r.nt, r.s, r.e, r["rank"], r.rule) for r in applied.collect()))
    assert ranks[0] == ranks[1] == [("A", 0, 1, 0, 1), ("A", 0, 1, 1, 2), ("B", 1, 2, 0, 3), ("S", 0, 2, 0, 0)]


def test_chart_paths_and_their_refusals(spark):
    df = tokens(spark, {"d": "xy"})
    rules = [Rule("S", (("n", "a/b~"), ("n", "B"))), Rule("a/b~", (("t", "x"),)), Rule("B", (("t", "y"),)), Rule("a/b~", (("t", "x"),))]
    applied = forest.applications(df, grammar.chart(df, rules).select("doc", "nt", "s", "e"), rules)
    cases = {
        "/chart/a~1b~0/0/1/alternatives/1": (3, None), "/chart/S/0/2/alternatives/0": (0, None), "/chart/S/0/2/alternatives/1": (None, "alternative_out_of_range"), "/chart/S/0/1/alternatives/0": (None, "profile_refused"),
        "/chart/S/00/2/alternatives/0": (None, "noncanonical_segment"), "/chart/S/0/x/alternatives/0": (None, "invalid_segment"), "/chart/S/0/2/alternatives/": (None, "invalid_segment"), "/chart/S/0/2/alternatives": (None, "unknown_form"), "/items/S/0/2/alternatives/0": (None, "unknown_form"), "chart": (None, "malformed_pointer"), "/chart/~2/0/1/alternatives/0": (None, "malformed_pointer"), "/chart/S/0/2/alternatives/-1": (None, "invalid_segment"),
    }
    got = {r.path: (r.rule, r.code) for r in forest.resolve(spark.createDataFrame([("d", p) for p in cases], "doc string, path string"), applied).collect()}
    assert got == cases
    spelled = applied.select(forest.spelled(applied.nt, applied.s, applied.e, applied["rank"]).alias("p"))
    assert {r.p for r in spelled.collect()} >= {"/chart/a~1b~0/0/1/alternatives/0", "/chart/a~1b~0/0/1/alternatives/1"}


def edges(spark, rows):
    return spark.createDataFrame([(d, (0, a), (0, b)) for d, a, b in rows], "doc string, l struct<t:int,i:bigint>, r struct<t:int,i:bigint>")


def plain_steps(rows, starts, cap):
    out = {}
    for d, a, b in rows:
        out.setdefault((d, a), []).append(b)
    found = {}
    for d, s in starts:
        found[(d, s)] = 0
    frontier = list(found)
    while frontier:
        nxt = []
        for d, v in frontier:
            for w in out.get((d, v), ()):
                if (d, w) not in found and (cap is None or found[(d, v)] < cap):
                    found[(d, w)] = found[(d, v)] + 1
                    nxt.append((d, w))
        frontier = nxt
    return found


@pytest.mark.parametrize("gathered, cap", list(product([1000, 10, 0], [None, 0, 3])))
def test_walks_by_every_plan(spark, gathered, cap):
    """Gathered, contracted, and both: chains, skips, rings, rings nothing leads into, a source inside a chain, repeated edges."""
    rng = random.Random(6)
    rows = [("chain", i, i + 1) for i in range(40)] + [("ring", i, (i + 1) % 9) for i in range(9)] + [("ring", 100 + i, 100 + (i + 1) % 5) for i in range(5)] + [("skip", i, i + k) for i in range(12) for k in (1, 2)]
    rows += [("mixed", 0, 1), ("mixed", 1, 2), ("mixed", 1, 2), ("mixed", 2, 3), ("mixed", 3, 1), ("mixed", 3, 4), ("mixed", 4, 5), ("small", 1, 2)]
    rows += [("random", rng.randint(0, 25), rng.randint(0, 25)) for _ in range(40)]
    starts = [("chain", 4), ("ring", 3), ("skip", 2), ("mixed", 0), ("mixed", 4), ("random", 1), ("random", 2), ("small", 1), ("alone", 7)]
    df = edges(spark, rows).repartition(3)
    source = spark.createDataFrame([(d, (0, i)) for d, i in starts], "doc string, node struct<t:int,i:bigint>")
    pairs = df.selectExpr("doc", "l AS node", "r AS next")
    got = {(r.doc, r.node.i): r.steps for r in reach.distances(source, pairs, cap, gathered).collect()}
    assert got == plain_steps(rows, starts, cap)
    reached, truncated = traverse.walk(source, Relation("e", df, acyclic=True), cap=cap, gathered=gathered)
    assert {(r.doc, r.node.i) for r in reached.collect()} == {k for k, n in got.items() if n}
    assert {r.doc for r in truncated.collect()} == ({d for (d, _), n in got.items() if n == cap} if cap is not None else set())


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rows = [("a", i, i + 1) for i in range(3000)]
    calls = []
    monkeypatch.setattr(reach, "cut", lambda df, cut=reach.cut: calls.append(1) or cut(df))
    source = spark.createDataFrame([("a", (0, 0))], "doc string, node struct<t:int,i:bigint>")
    got = reach.distances(source, edges(spark, rows).selectExpr("doc", "l AS node", "r AS next"), None, 0)
    assert got.selectExpr("max(steps)", "count(*)").first()[:] == (3000, 3001) and len(calls) < 40


@pytest.mark.parametrize("cap", [0, 3, 100])
def test_listed_paths(spark, cap):
    """Parallel edges are paths of their own; above the cap nothing is listed but the first path left out."""
    graphs = {"diamond": [(0, 1), (0, 2), (1, 3), (2, 3)], "parallel": [(0, 1), (0, 1), (1, 2), (1, 2), (1, 3)], "one": [(0, 1)], "tails": [(0, 1), (0, 4), (1, 2), (4, 2), (4, 5), (9, 0)]}
    rows = [(d, k, (0, a), (0, b), f"{d[0]}{k}") for d, es in graphs.items() for k, (a, b) in enumerate(es)]
    df = spark.createDataFrame(rows, "doc string, ord int, l struct<t:int,i:bigint>, r struct<t:int,i:bigint>, name string").repartition(3)
    origins = spark.createDataFrame([(d, (0, 0)) for d in graphs], "doc string, node struct<t:int,i:bigint>")

    def listed(d):
        es, out = graphs[d], []

        def visit(v, path):
            own = [(k, b) for k, (a, b) in enumerate(es) if a == v]
            if not own:
                out.append(path)
            for k, b in own:
                visit(b, [*path, f"{d[0]}{k}"])

        visit(0, [])
        return out

    want = set()
    for d in graphs:
        every = listed(d)
        want |= {(d, k, tuple(p), False) for k, p in enumerate(every)} if len(every) <= cap else {(d, cap, tuple(every[cap]), True)}
    assert {(r.doc, r["rank"], tuple(r.path), r.refused) for r in reach.paths(df, origins, cap).collect()} == want


def test_paths_are_refused_on_cycles(spark):
    df = edges(spark, [("a", 0, 1), ("a", 1, 0)])
    with pytest.raises(ValueError, match="acyclic"):
        reach.path_counts(df)
    with pytest.raises(ValueError, match="negative"):
        reach.paths(df, df, -1)


def test_exact_quotients_of_large_numbers(spark):
    from pyspark.sql import functions as F

    from strata.functions import lexical

    n = spark.createDataFrame([(9007199254740993,), (9223372036854775807,), (-7,), (-9007199254740993,), (0,)], "n bigint")
    assert [r.v for r in n.select(lexical.exact_quotient(F.col("n"), 2).alias("v")).collect()] == ["4503599627370496.5", "4611686018427387903.5", "-3.5", "-4503599627370496.5", "0.0"]
    assert [r.v for r in n.select(lexical.exact_quotient(F.col("n"), 1).alias("v")).collect()] == ["9007199254740993.0", "9223372036854775807.0", "-7.0", "-9007199254740993.0", "0.0"]
