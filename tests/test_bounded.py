"""Work that grows no faster than the input: what is moved, computed once, and read by a round."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strata.functions import lexical as L
from strata.operators import declared as D
from strata.operators import fold, profiles, reach
from strata.operators import semiring as S
from strata.plans import corpora as C

SF = "/root/testdata/sf0.001"
N = "struct<t:int,i:bigint>"


def test_lexical_forms_are_computed_once(spark):
    for made in (L.double(F.col("x")), L.exact_quotient(F.col("x"), 2)):
        assert str(made).count("x") < 400


def test_lines_as_runs(spark, tmp_path):
    docs = [(1, "a bb\n\n  ccc  d\nlast"), (1, "x\ny yy\nz"), (2, ""), (3, None), (4, "\n \nonly")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    base = C.words(spark, str(tmp_path))
    want = profiles.span_view(base.select("doc", F.col("line").alias("span"), "idx"), base)
    got = profiles.run_view(C.word_lines(spark, str(tmp_path)))
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_structure_needs_counts_of_lines_only(spark):
    corpus, poly = C.order_hypergraph(spark, SF)
    for df in (corpus.items(), corpus.relation("contains").edges, poly.rows):
        assert "l_partkey" not in df._jdf.queryExecution().toString()


def test_roots_of_runs(spark):
    """Only roots become places: a run of 10^15 covered places is no work. Runs overlap, touch and leave out parents; blocks overlap, are empty, cover their own parent or lead to another tier."""
    rng, runs, blocks = random.Random(5), [("far", 0, 0, 1), ("far", 1, 0, 10**15), (None, 0, 3, 5)], [("far", (0, 0), 1, 1, 10**15), (None, (0, 3), 0, 4, 5)]
    for d in map(str, range(60)):
        low = lambda: rng.randint(0, 9)
        runs += [(d, rng.randint(0, 2), a, a + rng.randint(0, 4)) for a in (low() for _ in range(rng.randint(0, 6)))]
        blocks += [(d, (rng.randint(0, 2), low()), rng.randint(0, 2), a, a + rng.randint(0, 3)) for a in (low() for _ in range(rng.randint(0, 5)))]
    want = {("far", 0, 0), ("far", 1, 0), (None, 0, 3), (None, 0, 4)}
    for d in map(str, range(60)):
        items = {(t, i) for x, t, a, b in runs if x == d for i in range(a, b)}
        want |= {(d, *i) for i in items - {(t, i) for x, l, t, a, b in blocks if x == d and l in items for i in range(a, b)}}
    got = profiles.run_roots(spark.createDataFrame(runs, "doc string, t int, start bigint, end bigint"), spark.createDataFrame(blocks, f"doc string, l {N}, t int, start bigint, end bigint"))
    assert sorted(map(str, ((r.doc, r.node.t, r.node.i) for r in got.collect()))) == sorted(map(str, want))


def test_runs_and_blocks_are_the_items_and_edges(spark, tmp_path):
    """Orders without customer, key or lines, keys of several orders and customers, lines of no order."""
    table = lambda name, cast: spark.read.parquet(f"{SF}/{name}.parquet").limit(400).selectExpr(*cast)
    odd = ["CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 11 ELSE o_orderkey END AS o_orderkey", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey % 20 END AS o_custkey", "o_totalprice"]
    table("orders", odd).write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    table("lineitem", ["CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 2 THEN 11 ELSE l_orderkey END AS l_orderkey", *lines.columns[1:]]).write.parquet(f"{tmp_path}/lineitem.parquet")
    corpus, _ = C.order_hypergraph(spark, str(tmp_path))
    edges, blocks, place = corpus.relation("contains").edges, corpus.relation("contains").blocks, F.explode(F.sequence("start", F.col("end") - 1))
    shown = lambda df: sorted(map(str, df.collect()))
    assert shown(corpus.runs.select("doc", "t", place.alias("i"))) == shown(corpus.items().select("doc", "node.t", "node.i"))
    assert shown(blocks.select("doc", "l", "t", place.alias("i")).selectExpr("doc", "l", "struct(t, i) AS r")) == shown(edges.select("doc", "l", "r"))
    roots = profiles.run_roots(corpus.runs, blocks)
    assert shown(roots) == shown(profiles.inferred_roots(corpus.items(), edges)) and roots.where("doc IS NULL").count() > 1
    held = corpus.tier("order").rows.groupBy("doc", F.col("orderkey").alias("k")).agg(F.min("idx").alias("parent"), F.count(F.lit(1)).alias("parents")).where("doc IS NOT NULL")
    assert shown(corpus.tier("line").rows.where("doc IS NOT NULL").selectExpr("doc", "orderkey AS k", "parent", "parents").distinct()) == shown(held.join(corpus.tier("line").rows.selectExpr("doc", "orderkey AS k").distinct(), ["doc", "k"]).select("doc", "k", "parent", "parents"))


@pytest.mark.parametrize("gathered", [100, 0])
def test_heights(spark, gathered):
    edges = spark.createDataFrame([("d", (0, a), (0, b)) for a, b in ((0, 1), (1, 2), (0, 2), (3, 2), (0, 1))], f"doc string, l {N}, r {N}")
    got = Counter((r.l.i, r.r.i, r.lh, r.rh) for r in reach.graded(edges, gathered).collect())
    assert got == {(0, 1, 2, 1): 2, (1, 2, 1, 0): 1, (0, 2, 2, 0): 1, (3, 2, 1, 0): 1}
    ring = edges.unionByName(edges.where("l.i = 1").selectExpr("doc", "r as l", "l as r"))
    with pytest.raises(ValueError, match="cycle"):
        reach.graded(ring, gathered)


@pytest.mark.parametrize("how, want", [(fold.OR, [3, 1, 1, 1, 1]), (fold.AND, [1, 1, 1, 1, 1])])
def test_by_level(spark, how, want):
    nodes = spark.createDataFrame([("d", (0, i), i, str(i)) for i in range(5)], f"doc string, node {N}, value bigint, label string")
    edges = spark.createDataFrame([("d", (0, a), (0, b)) for a, b in ((0, 1), (1, 2), (0, 2), (3, 2), (0, 1))], f"doc string, l {N}, r {N}")
    got = {r.node.i: int(r.value) for r in fold.by_level(nodes, edges, S.COUNTING, lambda v, n: S.COUNTING.one(), how).collect()}
    assert [got[i] for i in range(5)] == want


@pytest.mark.parametrize("most", [400, 0])
def test_roots_come_with_the_states(spark, most):
    nodes = spark.createDataFrame([("d", (0, 0), "x", 1, "a"), ("d", (0, 1), "x", 1, "b"), ("d", (0, 2), "x", 1, "c"), ("d", (1, 0), "y", 1, "z")], f"doc string, node {N}, tier string, value bigint, label string")
    edges = spark.createDataFrame([("d", "r", (0, 0), (0, 1)), ("d", "r", (0, 0), (1, 0)), ("d", "q", (0, 1), (0, 2))], f"doc string, rel string, l {N}, r {N}")
    f = D.Fold("n", ("x",), (D.Transition("r", "or"),), S.COUNTING, lambda v, _: S.COUNTING.one())
    assert {(r.node.i, r.root) for r in D.evaluate(f, nodes, edges, most).collect()} == {(0, True), (1, False), (2, True)}


def test_only_nodes_with_children_are_evaluated(spark):
    nodes = spark.createDataFrame([("d", (0, 0), 1, "a"), ("d", (1, 0), 5, "b"), ("d", (1, 1), 2, "c"), ("d", (2, 0), 7, "e"), ("d", (2, 1), 8, "f"), ("x", (1, 3), 4, "g")], f"doc string, node {N}, value bigint, label string")
    edges = spark.createDataFrame([("d", 0, (0, 0), (1, 0)), ("d", 0, (0, 0), (1, 1)), ("d", 1, (1, 1), (2, 0)), ("d", 1, (1, 1), (2, 1)), ("d", 1, (1, 1), (9, 9)), ("d", 1, (9, 9), (1, 0))], f"doc string, t int, l {N}, r {N}")
    f = D.Fold("n", ("x",), (D.Transition("r", "or"), D.Transition("q", "and")), S.TROPICAL, lambda v, _: v, ties=D.ALL, cap=1, ranked=True)
    made = D.gathered(f, nodes, edges)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan and "cast(concat" not in plan  # no comparison in a lambda, and no copy of all states for each node
    got = {(r.doc, r.node.t, r.node.i): (r.s.v, ["".join(k.p) for k in r.s.k], int(r.s.n), r.root) for r in made.collect()}
    assert got == {("d", 0, 0): (6, ["ab"], 2, True), ("d", 1, 0): (5, ["b"], 1, False), ("d", 1, 1): (17, ["cef"], 1, False), ("d", 2, 0): (7, ["e"], 1, False), ("d", 2, 1): (8, ["f"], 1, False), ("x", 1, 3): (4, ["g"], 1, True)}


@pytest.mark.parametrize("gathered", [100, 4, 0])
def test_paths_of_small_documents_take_one_pass(spark, monkeypatch, gathered):
    rows = [("a", k, (0, a), (0, b), f"e{k}") for k, (a, b) in enumerate([(i, i + 1 + j) for i in range(12) for j in (0, 1)])] + [("b", 0, (0, 0), (0, 1), "e0"), ("b", 0, (0, 0), (0, 2), "e1"), ("n", 0, (0, 5), (0, 6), "x")]
    df = spark.createDataFrame(rows, f"doc string, ord int, l {N}, r {N}, name string")
    origins = spark.createDataFrame([("a", (0, 0)), ("a", (0, 9)), ("b", (0, 0)), ("c", (7, 7))], f"doc string, node {N}")
    cuts = []
    monkeypatch.setattr(reach, "cut", lambda x, cut=reach.cut: cuts.append(1) or cut(x))
    got = {(r.doc, r.origin.i, r["rank"], "".join(r.path), r.refused) for r in reach.paths(df, origins, 20, gathered).collect()}
    late = "e18e20e22 e18e20e23 e18e21 e19e22 e19e23".split()
    every, todo = [], [(0, "")]
    while todo:
        v, path = todo.pop()
        every.append(path) if v >= 12 else todo.extend((v + 1 + j, f"{path}e{2 * v + j}") for j in (1, 0))
    assert got == {("a", 0, 20, every[20], True), *(("a", 9, k, p, False) for k, p in enumerate(late)), ("b", 0, 0, "e0", False), ("b", 0, 1, "e1", False), ("c", 7, 0, "", False)}
    assert gathered < 100 or len(cuts) < 4
    ring = spark.createDataFrame([("a", k, (0, k), (0, 1 - k), "e") for k in (0, 1)], df.schema)
    with pytest.raises(Exception, match="acyclic"):
        reach.paths(ring, origins, 3, gathered).collect()
