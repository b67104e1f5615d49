"""Declared folds against a plain evaluation, by both plans; refusals of declarations and roots."""

import random
from functools import cmp_to_key
from itertools import product

import pytest
from pyspark.sql import functions as F

from strata.operators import declared as D
from strata.operators import semiring as S
from strata.operators.declared import Declared, Fold, Transition

HOW = {"r": "or", "a": "and", "b": "or"}
NODES = "doc string, node struct<t:int,i:bigint>, tier string, value bigint, label string"
EDGES = "doc string, rel string, l struct<t:int,i:bigint>, r struct<t:int,i:bigint>"


def graphs():
    """Forward graphs, one with edges against canonical order, parallel edges, ties in values, and a node outside of the domain."""
    rng, nodes, edges = random.Random(5), [], []
    for doc, n, back in (("f", 9, False), ("g", 12, False), ("h", 8, True), ("one", 1, False)):
        for i in range(n):
            nodes.append((doc, (0, i), "x", rng.randint(1, 3), f"n{i:02}"))
        nodes.append((doc, (1, 0), "y", 1, "out"))
        edges.append((doc, "r", (0, 0), (1, 0)))
        for _ in range(n + 4 if n > 1 else 0):
            a, b = sorted(rng.sample(range(n), 2))
            edges.append((doc, rng.choice("rab"), (0, b) if back else (0, a), (0, a) if back else (0, b)))
    return nodes, edges


def plain(nodes, edges, doc, zero, one, add, mul, lift, order=None, ties=None, cap=1, ranked=False, better=None):
    own = {n[1]: n for n in nodes if n[0] == doc and n[2] == "x"}
    kids = {n: {k: sorted(e[3] for e in edges if e[0] == doc and e[1] == k and e[2] == n and e[3] in own) for k in "rab"} for n in own}
    below = {c for k in kids.values() for cs in k.values() for c in cs}

    def best(pairs):
        compare = lambda x, y: (x[1] > y[1]) - (x[1] < y[1]) if x[0] == y[0] else (-1 if better(x[0], y[0]) else 1)
        return sorted(set(pairs), key=cmp_to_key(compare))[:cap]

    def either(states):
        v, won = zero, states[0]
        for s in states:
            v = add(v, s[0])
        if order:
            top = min((s[0] for s in states), key=cmp_to_key(order))
            tied = [s for s in states if order(s[0], top) == 0]
            paths = list(dict.fromkeys(p for s in (tied if ties == "all" else tied[:1]) for p in s[1]))
        else:
            paths = won[1]
        return v, paths, best([x for s in states for x in s[2]]) if ranked else [], sum(s[3] for s in states)

    def times(a, b):
        return mul(a[0], b[0]), [p + q for p, q in product(a[1], b[1])], best([(mul(x, y), p + q) for (x, p), (y, q) in product(a[2], b[2])]) if ranked else [], a[3] * b[3]

    memo = {}

    def visit(n):
        if n not in memo:
            v, path = lift(own[n][3]), (own[n][4],)
            out = (v, [path], [(v, path)] if ranked else [], 1)
            for k in "rab":
                if kids[n][k]:
                    states = [visit(c) for c in kids[n][k]]
                    if HOW[k] == "or":
                        part = either(states)
                    else:
                        part = (one, [()], [(one, ())] if ranked else [], 1)
                        for s in states:
                            part = times(part, s)
                    out = times(out, part)
            memo[n] = out
        return memo[n]

    values = {n: visit(n)[0] for n in own}
    return values, either([visit(n) for n in sorted(own) if n not in below])


def both(spark, fold, most):
    nodes, edges = graphs()
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    states = D.evaluate(fold, n, e, most).cache()
    values = {(r.doc, tuple(r.node)): r.s.v for r in states.collect()}
    return values, {r.doc: r for r in D.result(fold, states, D.roots(fold, n, e)).collect()}


RELATIONS = tuple(Transition(k, h) for k, h in HOW.items())


@pytest.mark.parametrize("most", [400, 9, 0])
@pytest.mark.parametrize("ties, cap, least", [("all", 2, False), ("choose-first", 3, True), ("all", 50, True)])
def test_order_and_ties(spark, monkeypatch, most, ties, cap, least):
    monkeypatch.setattr(D, "CHUNK", 2)
    sign = 1 if least else -1
    order = lambda a, b: F.when(sign * a < sign * b, -1).when(sign * a > sign * b, 1).otherwise(0)
    fold = Fold("count", ("x",), RELATIONS, S.COUNTING, lambda v, _: v.cast(S.COUNT), order=order, ties=ties, cap=cap)
    values, got = both(spark, fold, most)
    nodes, edges = graphs()
    for doc in ("f", "g", "h", "one"):
        want, (v, paths, _, _) = plain(nodes, edges, doc, 0, 1, lambda a, b: a + b, lambda a, b: a * b, int, lambda a, b: sign * ((a > b) - (a < b)), ties, cap)
        assert {k[1]: int(x) for k, x in values.items() if k[0] == doc} == want
        assert int(got[doc].value) == v and [tuple(p) for p in got[doc].paths] == paths[:cap] and got[doc].truncated == (len(paths) > cap), doc


@pytest.mark.parametrize("most", [400, 0])
@pytest.mark.parametrize("semiring, better", [(S.TROPICAL, lambda a, b: a < b), (S.ARCTIC, lambda a, b: a > b)])
def test_ranked(spark, monkeypatch, most, semiring, better):
    monkeypatch.setattr(D, "CHUNK", 2)
    fold = Fold("best", ("x",), RELATIONS, semiring, lambda v, _: v, ties="all", cap=3, ranked=True)
    values, got = both(spark, fold, most)
    nodes, edges = graphs()
    pick = lambda a, b: b if a is None else a if better(a, b) else b
    for doc in ("f", "g", "h", "one"):
        want, (v, _, ranked, n) = plain(nodes, edges, doc, None, 0, pick, lambda a, b: a + b, int, cap=3, ranked=True, better=better)
        assert {k[1]: x for k, x in values.items() if k[0] == doc} == want
        assert got[doc].value == v and [(r.v, tuple(r.p)) for r in got[doc].ranked] == ranked and int(got[doc].n) == n and got[doc].truncated == (n > len(ranked))


def test_plan_by_shape(spark):
    nodes, edges = graphs()
    fold = Fold("n", ("x",), RELATIONS, S.COUNTING, lambda v, _: S.COUNTING.one())
    inside, kept = D.domain(fold, spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))
    assert sorted(r.doc for r in D.small(inside, kept, 13).collect()) == ["f", "one"]  # g has 16 edges, h leads backwards


def test_cycles_are_refused(spark):
    nodes = spark.createDataFrame([("d", (0, i), "x", 1, str(i)) for i in range(3)], NODES)
    edges = spark.createDataFrame([("d", "r", (0, 1), (0, 2)), ("d", "a", (0, 2), (0, 1))], EDGES)
    fold = Fold("n", ("x",), RELATIONS, S.COUNTING, lambda v, _: S.COUNTING.one())
    with pytest.raises(ValueError, match="cycle"):
        D.evaluate(fold, nodes, edges).collect()


def test_index_product_and_empty_tables(spark):
    nodes, edges = spark.createDataFrame([("d", (0, 0), "x", 5, "a")], NODES), spark.createDataFrame([], EDGES)
    fold = Fold("n", ("x",), RELATIONS, S.COUNTING, lambda v, _: v.cast(S.COUNT), axes=(("p", "q"), ("1", "2", "3")))
    assert [int(r.value) for r in D.result(fold, D.evaluate(fold, nodes, edges), D.roots(fold, nodes, edges)).collect()] == [30]
    assert D.evaluate(fold, nodes.where("false"), edges).count() == 0


def test_refusals():
    graph = Declared(("x",), {"r": True, "a": True, "b": False}, {"w": ("item", "double"), "z": ("tier", "integer")})
    good = dict(name="f", tiers=("x",), transitions=(Transition("r", "or"),), semiring=S.TROPICAL, lift=lambda v, _: v)
    order = lambda a, b: a - b
    assert D.refusals(Fold(**good), graph) == []
    for change, code in [
        ({"name": ""}, "empty_name"),
        ({"cap": 0}, "cap_not_positive"),
        ({"cost": 0}, "cost_not_positive"),
        ({"order": order}, "no_tie_policy"),
        ({"ranked": True}, "no_tie_policy"),
        ({"ranked": True, "order": order, "ties": "all"}, "ranked_with_order"),
        ({"ranked": True, "ties": "all", "semiring": S.COUNTING}, "order_not_preserved"),
        ({"ties": "all"}, "tie_policy_without_witnesses"),
        ({"ties": "some", "order": order}, "unknown_tie_policy"),
        ({"tiers": ()}, "empty_domain"),
        ({"tiers": ("x", "x")}, "duplicate_tier"),
        ({"tiers": ("q",)}, "undeclared_tier"),
        ({"transitions": (Transition("r", "xor"),)}, "unknown_combination"),
        ({"axes": ((),)}, "empty_axis"),
        ({"axes": (("p", "p"),)}, "duplicate_coordinate"),
        ({"transitions": ()}, "no_relation"),
        ({"transitions": (Transition("r", "or"), Transition("r", "and"))}, "duplicate_relation"),
        ({"transitions": (Transition("s", "or"),)}, "undeclared_relation"),
        ({"transitions": (Transition("b", "or"),)}, "relation_not_acyclic"),
        ({"attribute": "v"}, "undeclared_attribute"),
        ({"attribute": "z"}, "attribute_domain"),
        ({"attribute": "w"}, "exact_over_double"),
    ]:
        assert [c for c, _ in D.refusals(Fold(**(good | change)), graph)] == [code], code


def test_fractions(spark):
    from fractions import Fraction

    rng = random.Random(8)
    pairs = [(0, 1, 0, 1), (1, 3, -1, 3), (-7, 1, 1, 7), (10**37, 3, 3, 10**37), (1, 2**60, 1, 2**61)]
    fib = [1, 1]
    while len(fib) < 180:
        fib.append(fib[-1] + fib[-2])
    pairs.append((fib[178], fib[179], 1, 1))
    pairs += [(2 * (10**37 + 1), 6, 3, 1), (7 * (10**36 + 3), 7 * 10**5, 1, 1), (10**37 + 2 * 10**6, 10**6, 1, 1), (-3 * (10**36 + 9), 3, 1, 1)]
    pairs += [tuple(rng.choice((-1, 1)) ** (i % 2 == 0) * rng.randint(1, 10**9) for i in range(4)) for _ in range(40)]
    cast = lambda c: F.col(c).cast("decimal(38,0)")
    df = spark.createDataFrame([tuple(map(str, p)) for p in pairs], "a string, b string, c string, d string")
    df = df.select(*("a b c d".split()), S.fraction(cast("a"), cast("b")).alias("x"), S.fraction(cast("c"), cast("d")).alias("y"))
    small = (F.length("b") < 25) & (F.length("d") < 25)
    got = df.select("a", "b", "c", "d", S.fraction_text(F.col("x")).alias("v"), F.when(small, S.fraction_text(S.PROBABILITY.add(F.col("x"), F.col("y")))).alias("s"), S.fraction_text(S.PROBABILITY.mul(F.col("x"), F.col("y"))).alias("p")).collect()
    for r in got:
        x, y = Fraction(int(r.a), int(r.b)), Fraction(int(r.c), int(r.d))
        assert r.v == str(x) and r.p == str(x * y) and r.s in (None, str(x + y))
    texts = spark.createDataFrame([("2/4",), ("1/2",), ("-3",), ("0",), ("0/5",), ("1/0",), ("x",), ("3/1",), ("-0",), ("",), (None,)], "t string")
    assert {r.t for r in texts.where(S.fraction_of(F.col("t")).isNotNull()).collect()} == {"1/2", "-3", "0"}


def test_products_are_compared_exactly(spark):
    from strata.functions import lexical as L

    most = (1 << 63) - 1
    rows = [(most, most, most, most - 1), (-most - 1, -most - 1, most, most), (3, 4, 2, 6), (most, -2, -most, 2), (None, 1, 1, 1)]
    got = [r.s for r in spark.createDataFrame(rows, "a bigint, b bigint, c bigint, d bigint").select(L.compare_products(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("s")).collect()]
    assert got == [None if None in (a, b, c, d) else (a * b > c * d) - (a * b < c * d) for a, b, c, d in rows]
