"""Page-sized fixtures with listed answers."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from strata.functions import lexical
from strata.model import Polyadic, Relation, node
from strata.operators import actions, fold, grammar, machine, profiles, select, semiring, traverse, validate
from strata.sources import schema, wire

N = "struct<t:int,i:bigint>"


def edges_of(spark, pairs):
    return spark.createDataFrame([(0, a, b) for a, b in pairs], "doc int, a bigint, b bigint").select("doc", node(0, F.col("a")).alias("l"), node(0, F.col("b")).alias("r"))


def nodes_of(spark, values):
    return spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "doc int, i bigint, value bigint").select("doc", node(0, F.col("i")).alias("node"), "value", F.col("i").alias("label"))


DIAMOND = [(0, 1), (0, 2), (1, 3), (2, 3)]


def at_root(spark, values, ring, lift, how=fold.OR, strategy=fold.per_document):
    nodes, edges = nodes_of(spark, values), edges_of(spark, DIAMOND)
    return fold.total(strategy(nodes, edges, ring, lift, how), fold.roots(nodes, edges), ring).first().value


@pytest.mark.parametrize("strategy", [fold.per_document, fold.by_level])
def test_diamond(spark, strategy):
    assert at_root(spark, [0, 2, 1, 3], semiring.TROPICAL, lambda v, n: v, strategy=strategy) == 4
    assert at_root(spark, [0, 2, 1, 3], semiring.ARCTIC, lambda v, n: v, strategy=strategy) == 5
    assert at_root(spark, [0, 2, 1, 3], semiring.COUNTING, lambda v, n: semiring.COUNTING.one(), strategy=strategy) == 2
    assert at_root(spark, [0, 2, 1, 3], semiring.COUNTING, lambda v, n: semiring.COUNTING.one(), fold.AND, strategy) == 1


def test_diamond_ties_give_both_witnesses(spark):
    ring = semiring.PATH
    got = at_root(spark, [0, 0, 0, 0], ring, lambda v, n: F.struct(v.alias("a"), F.array(F.array(n)).alias("b")))
    assert got.a == 0 and got.b == [[0, 1, 3], [0, 2, 3]]


def test_cost_account(spark):
    got = fold.cost_account(nodes_of(spark, [1, 2, 5, 1]), edges_of(spark, DIAMOND)).first()
    assert (got["size"], got.incidence, got.additions, got.multiplications) == (4, 4, 2, 4)  # six carrier operations


def test_cycles_are_refused(spark):
    nodes, edges = nodes_of(spark, [1, 1, 1]), edges_of(spark, [(0, 1), (1, 2), (2, 1)])
    with pytest.raises(ValueError, match="cycle"):
        fold.by_level(nodes, edges, semiring.COUNTING, lambda v, n: semiring.COUNTING.one())
    assert {(r.l.i, r.r.i) for r in traverse.cyclic(edges).collect()} == {(1, 2), (2, 1)}
    assert traverse.cyclic(edges_of(spark, DIAMOND)).isEmpty()


RINGS = [semiring.BOOLEAN, semiring.COUNTING, semiring.TROPICAL, semiring.ARCTIC, semiring.expectation(semiring.COUNTING), semiring.PATH_WITNESSES]
SAMPLES = {
    "boolean": ["true", "false"], "counting": ["0", "1", "2", "7"], "tropical": ["NULL", "0", "3", "5"], "arctic": ["NULL", "0", "3", "5"],
    "expectation of counting": ["struct(0, 0)", "struct(1, 0)", "struct(2, 3)", "struct(1, 5)"], "path witnesses": ["array()", "array(array())", "array(array(1L))", "array(array(1L), array(2L, 3L))"],
}


def laws(spark, ring):
    values = spark.sql(" UNION ALL ".join(f"SELECT cast({v} AS {ring.type}) AS v" for v in SAMPLES[ring.name]))
    trip = values.select(F.col("v").alias("a")).crossJoin(values.select(F.col("v").alias("b"))).crossJoin(values.select(F.col("v").alias("c")))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    x, y = ring.add, ring.mul
    checks = {
        "add associates": (x(x(a, b), c), x(a, x(b, c))), "add commutes": (x(a, b), x(b, a)), "multiply associates": (y(y(a, b), c), y(a, y(b, c))),
        "left distributes": (y(a, x(b, c)), x(y(a, b), y(a, c))), "right distributes": (y(x(a, b), c), x(y(a, c), y(b, c))),
        "zero is neutral": (x(a, ring.zero()), a), "one is neutral": (y(a, ring.one()), a), "zero annihilates": (y(a, ring.zero()), ring.zero()),
    }
    out = trip.select(*(F.bool_and(p.cast("string").eqNullSafe(q.cast("string"))).alias(k) for k, (p, q) in checks.items())).first()
    return [k for k in checks if not out[k]]


@pytest.mark.parametrize("ring", RINGS, ids=lambda r: r.name)
def test_semiring_laws(spark, ring):
    assert laws(spark, ring) == []


def test_a_broken_semiring_fails_its_laws(spark):
    from dataclasses import replace

    assert "add associates" in laws(spark, replace(semiring.COUNTING, add=lambda a, b: (a + b + a * 0 + F.when(a > b, 1).otherwise(0)).cast(semiring.COUNT)))


def test_walks(spark):
    acyclic, cyclic = edges_of(spark, DIAMOND), edges_of(spark, [*DIAMOND, (3, 0)])
    at = lambda i: nodes_of(spark, [0] * 4).where(F.col("node.i") == i)
    got = lambda w: ({r.node.i for r in w[0].collect()}, not w[1].isEmpty())
    assert got(traverse.walk(at(0), Relation("c", acyclic, acyclic=True))) == ({1, 2, 3}, False)
    assert got(traverse.walk(at(3), Relation("c", acyclic), traverse.INVERSE, 1)) == ({1, 2}, True)
    assert got(traverse.walk(at(0), Relation("c", cyclic), cap=2)) == ({1, 2, 3}, True)
    assert got(traverse.walk(at(0), Relation("c", cyclic), cap=4)) == ({1, 2, 3}, False)
    assert got(traverse.walk(at(0), Relation("c", cyclic), cap=0)) == (set(), True)
    with pytest.raises(ValueError):
        traverse.walk(at(0), Relation("c", cyclic))


def test_ordered_containment(spark):
    # tier 0: root, branch; tier 1: a, b, c. root lists b, branch, b; branch lists c, a
    rows = spark.createDataFrame([(0, 0, [(0, 0)], [(1, 1), (0, 1), (1, 1)]), (0, 1, [(0, 1)], [(1, 2), (1, 0)])], f"doc int, ord bigint, sources array<{N}>, targets array<{N}>")
    contains = Polyadic("contains", rows, acyclic=True, unique_sources=True)
    one = lambda t, i: spark.createDataFrame([(0, (t, i))], f"doc int, node {N}")
    names = {(0, 0): "root", (0, 1): "branch", (1, 0): "a", (1, 1): "b", (1, 2): "c"}
    said = lambda df: [names[tuple(r.node)] for r in df.orderBy("seq").collect()]
    assert said(traverse.transitive(one(0, 0), contains)) == ["b", "branch", "c", "a", "b"]
    assert said(traverse.leaves(one(0, 0), contains)) == ["b", "c", "a", "b"]
    assert said(traverse.leaves(one(1, 2), contains)) == ["c"]
    assert {names[tuple(r.source)] for r in traverse.fiber(one(1, 1), contains).collect()} == {"root"}
    assert {names[tuple(r.node)] for r in traverse.ancestors(one(1, 2), contains).collect()} == {"root", "branch"}


def test_polyadic_promises(spark):
    rows = spark.createDataFrame([(0, 0, [(0, 0)], [(1, 0), (1, 1)]), (0, 1, [(0, 1)], [(1, 2), (1, 2)]), (0, 2, [(0, 0)], [(1, 0)]), (0, 3, [], [(1, 1)])], f"doc int, ord bigint, sources array<{N}>, targets array<{N}>")
    assert [r.subject for r in validate.distinct_targets(rows).collect()] == ["1"]
    assert [r.subject for r in validate.unique_sources(rows).collect()] == ["0"]
    assert [r.subject for r in validate.arity(rows, "sources", 1, 2, False).collect()] == ["3"]
    assert validate.arity(rows, "sources", 1, 2, True).isEmpty()
    assert {r.subject for r in validate.single_parent_polyadic(rows).collect()} == {"1:1"}
    with pytest.raises(ValueError, match="distinct targets"):
        validate.strict(validate.distinct_targets(rows))
    validate.strict(validate.distinct_targets(rows.where("ord <> 1")))


def test_lexical_table(spark):
    table = {
        "integer": {"+007": "7", "-0": "0", " 12\n": "12", "1.0": None, "12\n3": None, "9" * 40: "9" * 40},
        "decimal": {"1": "1.0", ".50": "0.5", "-0": "0.0", "007.250": "7.25", "1e3": None, "5.": "5.0"},
        "boolean": {"1": "true", " false ": "false", "yes": None, "t": None},
        "double": {"0.1": "1.0E-1", "-0": "-0.0E0", "12345.678": "1.2345678E4", "+INF": "INF", "-INF": "-INF", "NaN": "NaN", "1e400": "INF", "inf": None, "1e10": "1.0E10", "5e-7": "5.0E-7"},
    }
    for kind, cases in table.items():
        df = spark.createDataFrame([(k,) for k in cases], "s string")
        assert {r.s: r.v for r in df.select("s", lexical.canonical(kind, F.col("s")).alias("v")).collect()} == cases


def test_pointers_quotes_and_quotients(spark):
    df = spark.createDataFrame([("/a~1b/~0c",), ("/x/~2",), ("plain",), ("",)], "s string")
    assert [r.v for r in df.select(lexical.pointer_segments(F.col("s")).alias("v")).collect()] == [["a/b", "~c"], None, None, []]
    quoted = spark.createDataFrame([('a"b\\c\nd',), ("bad\x07",)], "s string").select(lexical.dot_quote(F.col("s")).alias("v")).collect()
    assert [r.v for r in quoted] == ['"a\\"b\\\\c\\nd"', None]
    n = spark.createDataFrame([(0,), (7,), (30,)], "n bigint")
    assert [r.v for r in n.select(lexical.exact_quotient(F.col("n"), 8).alias("v")).collect()] == ["0.0", "0.875", "3.75"]
    assert [r.v for r in n.select(lexical.exact_quotient(F.col("n"), 30).alias("v")).collect()] == ["0.0", None, "1.0"]


def tokens(spark, text):
    return spark.createDataFrame([(0, i, t) for i, t in enumerate(text)], "doc int, idx int, token string")


def test_ambiguous_grammar(spark):
    rules = [grammar.Rule("S", (("n", "A"), ("n", "B")), 2), grammar.Rule("A", (("t", "x"),), 4), grammar.Rule("A", (("t", "x"),), 8), grammar.Rule("B", (("t", "y"),), 1)]
    got = grammar.recognised(tokens(spark, "xy"), rules, "S", 2, 3).first()
    assert got.recognised and got.n == Decimal(2) and [x.v for x in got.best] == [7, 11]
    assert not grammar.recognised(tokens(spark, "yx"), rules, "S", 2).first().recognised


def test_charts_are_as_wide_as_the_longest_document(spark):
    long = spark.createDataFrame([(0, i, "x") for i in range(11)] + [(1, 0, "x"), (2, 0, "y")], "doc int, idx int, token string")
    rules = [grammar.Rule("S", (("n", "S"), ("n", "S"))), grammar.Rule("S", (("t", "x"),))]
    assert {r.doc: (r.n_tokens, int(r.n)) for r in grammar.count(long, rules, "S").collect()} == {0: (11, 16796), 1: (1, 1), 2: (1, 0)}
    with pytest.raises(ValueError):
        grammar.recognised(long, rules, "S", 3)


def test_unit_and_nullable_rules(spark):
    cycle = [grammar.Rule("S", (("n", "A"),)), grammar.Rule("A", (("n", "S"),)), grammar.Rule("A", (("t", "x"),))]
    assert grammar.recognised(tokens(spark, "x"), cycle, "S", 1).first().recognised
    empty = [grammar.Rule("S", (("n", "A"), ("t", "x"), ("n", "A"))), grammar.Rule("A", ()), grammar.Rule("A", (("t", "y"),))]
    assert grammar.recognised(tokens(spark, "xy"), empty, "S", 2).first().recognised
    for rules in (cycle, empty):
        with pytest.raises(ValueError):
            grammar.count(tokens(spark, "x"), rules, "S", 1)


def test_uniform_clock(spark):
    bound = spark.createDataFrame([(0, 0, 1, 0), (0, 1, 2, 0), (0, 2, 3, 0)], "doc int, pos bigint, tick bigint, gap bigint")
    spans = profiles.spans(bound)
    assert [(r.start.tick, r.end.tick) for r in spans.orderBy("idx").collect()] == [(1, 2), (2, 3)]
    assert [(r.start_text, r.duration) for r in profiles.timing(spans, lambda t: lexical.exact_quotient(t, 10)).orderBy("idx").collect()] == [("0.1", "0.1"), ("0.2", "0.1")]
    assert profiles.backward(bound).isEmpty()
    assert [r.pos for r in profiles.backward(bound.withColumn("tick", F.when(F.col("pos") == 1, 9).otherwise(F.col("tick")))).collect()] == [2]


def test_span_offsets_and_order(spark):
    base = spark.createDataFrame([(0, 0, "Hi"), (0, 1, " "), (0, 2, "<x>&")], "doc int, idx bigint, surface string")
    covered = spark.createDataFrame([(0, "a", 0), (0, "a", 1), (0, "b", 2)], "doc int, span string, idx bigint")
    view = profiles.span_view(covered, base)
    assert [(r.start, r.end, r.char_start, r.char_end, r.contiguous) for r in view.orderBy("span").collect()] == [(0, 2, 0, 3, True), (2, 3, 3, 7, True)]
    gap = profiles.span_view(covered.where("idx <> 1").unionByName(spark.createDataFrame([(0, "a", 2)], covered.schema)), base)
    assert not gap.where("span = 'a'").first().contiguous and [r.span for r in profiles.overlapping(gap).collect()] == ["b"]
    ranked = profiles.ranked(spark.createDataFrame([(0, "a", "p1", None), (0, "a", "p2", 1), (0, "a", "p3", 5)], "doc int, span string, path string, score int"))
    assert [r.path for r in ranked.orderBy("rank").collect()] == ["p3", "p2", "p1"]


def test_actions(spark):
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate("aabba")], "doc int, at int, v string")
    assert [r["at"] for r in actions.collapse(rows, "v", "at").orderBy("at").collect()] == [0, 2, 4]
    assert [r["at"] for r in actions.unique(rows, "v", "at").orderBy("at").collect()] == [0, 2]
    assert [r["at"] for r in actions.reorder(rows, "v", "at").orderBy("place").collect()] == [0, 1, 4, 2, 3]


def test_programs():
    program = ("a", machine.Repeat(2, ("b", machine.Repeat(3, ("c",)))), "d")
    assert machine.flatten(program) == ["a", "b", "c", "c", "c", "b", "c", "c", "c", "d"]
    assert machine.expansion(program) == 10
    with pytest.raises(ValueError):
        machine.expansion((machine.Repeat(10_000, (machine.Repeat(10_000, ("x",)),)),))
    with pytest.raises(ValueError):
        machine.expansion((machine.Repeat(10_001, ("x",)),))


def test_streaming_counts_equal_the_batch(spark, tmp_path):
    from strata.plans import corpora
    from strata.streaming import edits

    log = corpora.edit_log(spark, "/root/testdata/sf0.001").select("doc", "seq", "op", "tier")
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    q = edits.item_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("counts").collect()) == sorted(edits.item_counts(log).collect())


def test_selectors_refuse_what_is_undeclared(spark):
    from strata.plans import corpora

    corpus = corpora.timeline(spark, "/root/testdata/sf0.001")
    with pytest.raises(KeyError):
        select.tier(corpus, "none")
    with pytest.raises(KeyError):
        select.with_attribute(corpus, "cents", "tier")
    with pytest.raises(KeyError):
        select.of_type(corpus, "none")


def test_nested_json_round_trip(spark):
    import json

    from strata.operators import jsonvalue

    cases = {0: '{"b":[1,{"x":null,"a":"q\\"uote"}],"a":true,"c":{}}', 1: "[]", 2: '"just text"', 3: '{"n":-2.5,"m":[[["deep"]]]}'}
    df = spark.createDataFrame(list(cases.items()), "doc int, j string")
    tree = jsonvalue.nodes(df, "j")
    got = [(r.id, r.parent, r.key, r.kind) for r in tree.where("doc = 0").orderBy("id").collect()]
    assert got == [(0, None, None, "object"), (1, 0, "a", "boolean"), (2, 0, "b", "array"), (3, 2, None, "integer"), (4, 2, None, "object"), (5, 4, "a", "string"), (6, 4, "x", "null"), (7, 0, "c", "object")]
    back = {r.doc: r.json for r in jsonvalue.text(tree).collect()}
    assert back == {k: json.dumps(json.loads(v), sort_keys=True, separators=(",", ":")) for k, v in cases.items()}


def test_dot_of_polyadic_relations(spark):
    from strata.model import Corpus, Tier
    from strata.sources import render

    items = spark.createDataFrame([(0, 0), (0, 1)], "doc int, idx bigint")
    rows = spark.createDataFrame([(0, 0, [(0, 0)], [(0, 1), (0, 0)])], f"doc int, ord bigint, sources array<{N}>, targets array<{N}>")
    text = render.whole(render.dot_lines(Corpus((Tier(0, "x", items),), polyadic=(Polyadic("p", rows),)))).first().text
    assert text.splitlines() == ["digraph strata {", '  n0_0 [shape=box, label="0"];', '  n0_1 [shape=box, label="1"];', "  n0_0 -> n0_1 [color=gray];", "  n0_0 -> n0_1 [style=dashed, label=p];", "  n0_0 -> n0_0 [style=dashed, label=p];", "}"]
