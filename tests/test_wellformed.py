"""Graph rules over documents and logs, cycles and their closing edges, against plain versions."""

import json
import random

import pytest
from test_wire import GOOD, name, ref, value

from strata.operators import cycles, wellformed
from strata.plans import stage
from strata.sources import program, wire

ITEM_SIDE = {"endpoint_kinds": ["item"], "tiers": [], "minimum": 1, "maximum": -1, "allow_empty": False}


def poly(local, **more):
    base = {"kind": "polyadic", "name": name(local), "sources": ITEM_SIDE, "targets": ITEM_SIDE, "unique_sources": False, "distinct_targets": False, "single_parent": False, "acyclic": False, "targets_subset_of": [], "attributes": []}
    return base | more


def binary(local, **more):
    return {"kind": "bipartite", "name": name(local), "left_type": name("w"), "right_type": name("w"), "left_endpoint": "item", "right_endpoint": "item", "single_parent": False, "acyclic": False, "attributes": []} | more


def edge(local, left, right, durable=None):
    return {"declaration": name(local), "left": left, "right": right, "durable_id": durable, "attributes": []}


def hyper(local, sources, targets, durable=None):
    return {"declaration": name(local), "sources": sources, "targets": targets, "durable_id": durable, "attributes": []}


def anchor(side, tier=None, durable=None):
    return {"anchor": {"kind": "tier", "tier": name(tier)} if tier else {"kind": "item", "durable_id": durable}, "side": side}


def graph(d):
    return d["graph"]


def declare(*relations):
    return lambda d: graph(d)["relation_declarations"].extend(relations)


def both(*changes):
    return lambda d: [c(d) for c in changes]


def relate(*instances):
    return lambda d: graph(d)["relations"].extend(instances)


def attr(local, domain, kind="string"):
    return lambda d: graph(d)["attribute_declarations"].append({"name": name(local), "domain": domain, "value_type": kind})


BROKEN = {
    "index 99": (lambda d: graph(d)["relations"][0].update(left=ref(99)), "endpoint range"),
    "undeclared relation": (relate(edge("other", ref(0), ref(1))), "declared relation"),
    "binary as polyadic": (relate(edge("has", ref(0), ref(1))), "declared relation"),
    "four": (lambda d: graph(d)["tiers"][0]["items"][0]["attributes"].__setitem__(0, value("cost", "four", "integer")), "lexical form"),
    "prefix": (lambda d: graph(d)["namespaces"].append({"prefix": "p", "namespace": "v"}), "unique prefix"),
    "uri": (lambda d: graph(d)["namespaces"].append({"prefix": "q", "namespace": "u"}), "unique namespace"),
    "tier twice": (lambda d: graph(d)["tiers"].append({"declaration": {"name": name("t"), "long_name": ""}, "items": [], "attributes": []}), "unique tier"),
    "relation twice": (declare(poly("has")), "unique relation"),
    "attribute twice": (attr("cost", "item"), "unique attribute"),
    "value twice": (lambda d: graph(d)["attributes"].append(value("title", "U")), "unique value"),
    "namespace": (lambda d: graph(d)["tiers"].append({"declaration": {"name": name("n", "other"), "long_name": ""}, "items": [], "attributes": []}), "declared namespace"),
    "namespace of a type": (declare(binary("b", left_type=name("w", "other"))), "declared namespace"),
    "namespace of a side's tier": (declare(poly("b", sources=ITEM_SIDE | {"tiers": [name("t", "other")]})), "declared namespace"),
    "simple without tier": (declare({"kind": "simple", "name": name("is2"), "tier": name("gone"), "item_type": name("w"), "attributes": []}), "declared tier"),
    "two types": (declare({"kind": "simple", "name": name("is2"), "tier": name("t"), "item_type": name("v"), "attributes": []}), "one type for a tier"),
    "undeclared attribute": (lambda d: graph(d)["attributes"].append(value("more", "x")), "declared attribute"),
    "domain": (lambda d: graph(d)["attributes"].append(value("sort", "x")), "attribute domain"),
    "type": (lambda d: graph(d)["tiers"][0]["items"][1]["attributes"].append(value("cost", "4")), "attribute type"),
    "kind of end": (relate(edge("link", ref(0), ref(1))), "endpoint kind"),
    "tier of end": (lambda d: graph(d)["relations"][0].update(left=ref(0, "gone")), "endpoint range"),
    "anchor gone": (lambda d: graph(d)["relations"][0].update(right=anchor("after", durable="gone")), "endpoint range"),
    "anchor tier gone": (lambda d: graph(d)["relations"][0].update(right=anchor("after", tier="gone")), "endpoint range"),
    "untyped": (both(lambda d: graph(d)["tiers"].append({"declaration": {"name": name("bare"), "long_name": ""}, "items": [{"durable_id": None, "attributes": []}], "attributes": []}), relate(edge("link", ref(0, "bare"), anchor("after", durable="x")))), "typed tier"),
    "other type": (both(declare(binary("b", left_type=name("v"))), relate(edge("b", ref(0), ref(1)))), "endpoint type"),
    "side's tier": (both(declare(poly("b", targets=ITEM_SIDE | {"tiers": [name("is")]})), relate(hyper("b", [ref(0)], [ref(1)]))), "endpoint tier"),
    "side's kind": (both(declare(poly("b")), relate(hyper("b", [ref(0)], [anchor("before", tier="t")]))), "endpoint kind"),
    "empty side": (relate(hyper("has", [ref(1)], [])), "arity"),
    "too many": (both(declare(poly("b", targets=ITEM_SIDE | {"maximum": 1})), relate(hyper("b", [ref(0)], [ref(0), ref(1)]))), "arity"),
    "too few": (both(declare(poly("b", targets=ITEM_SIDE | {"minimum": 2})), relate(hyper("b", [ref(0)], [ref(1)]))), "arity"),
    "no kinds": (declare(poly("b", sources=ITEM_SIDE | {"endpoint_kinds": []})), "relation side"),
    "bounds crossed": (declare(poly("b", sources=ITEM_SIDE | {"minimum": 3, "maximum": 2})), "relation side"),
    "position outside": (lambda d: graph(d)["position_values"].append({"reference": ref(3), "attributes": [value("at", "2", "decimal")]}), "position range"),
    "position empty": (lambda d: graph(d)["position_values"].append({"reference": ref(1), "attributes": []}), "position values"),
    "position twice": (lambda d: graph(d)["position_values"].append({"reference": anchor("after", tier="t"), "attributes": [value("at", "2", "decimal")]}), "one position"),
    "id twice": (lambda d: graph(d)["tiers"][0]["items"][1].update(durable_id="r"), "unique id"),
    "second parent": (both(declare(binary("b", single_parent=True)), relate(edge("b", ref(0), ref(1)), edge("b", ref(1), ref(1)))), "single parent"),
    "second parent sequence": (both(declare(poly("b", single_parent=True)), relate(hyper("b", [ref(0)], [ref(1)]), hyper("b", [ref(0), ref(1)], [ref(1)]))), "single parent"),
    "source twice": (relate(hyper("has", [ref(0)], [ref(1)])), "unique sources"),
    "source twice in one": (relate(hyper("has", [ref(1), ref(1)], [ref(1)])), "unique sources"),
    "target twice": (both(declare(poly("b", distinct_targets=True)), relate(hyper("b", [ref(0)], [ref(1), ref(1)]))), "distinct targets"),
    "no base": (declare(poly("b", targets_subset_of=[name("gone")])), "declared base"),
    "no membership": (both(declare(poly("b", targets_subset_of=[name("has")])), relate(hyper("b", [ref(1)], [ref(1)]))), "membership"),
    "not a member": (both(declare(poly("b", targets_subset_of=[name("has")])), relate(hyper("b", [ref(0)], [ref(0)]))), "targets subset"),
    "cycle": (both(declare(binary("b", acyclic=True)), relate(edge("b", ref(0), ref(1)), edge("b", ref(1), ref(0)))), "acyclic"),
    "polyadic cycle": (both(declare(poly("b", acyclic=True)), relate(hyper("b", [ref(0)], [ref(1)]), hyper("b", [ref(1)], [ref(1), ref(0)]))), "acyclic"),
}
FINE = {
    "same": lambda d: None,
    "repeated edge is one parent": both(declare(binary("b", single_parent=True, acyclic=True)), relate(edge("b", ref(0), ref(1)), edge("b", ref(0), ref(1)))),
    "two boundaries that meet": both(declare(binary("b", right_endpoint="boundary", single_parent=True)), relate(edge("b", ref(0), anchor("before", tier="t")), edge("b", ref(1), anchor("after", tier="t")))),
    "a member": both(declare(poly("b", targets_subset_of=[name("has")])), relate(hyper("b", [ref(0)], [ref(1)]))),
    "a side that may be empty": both(declare(poly("b", targets=ITEM_SIDE | {"allow_empty": True, "minimum": 2})), relate(hyper("b", [ref(0)], []))),
    "another spelling": lambda d: graph(d)["tiers"][0]["items"][0]["attributes"].__setitem__(0, value("cost", " +04 ", "integer")),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = []
    for k, change in ({k: c for k, (c, _) in BROKEN.items()} | FINE).items():
        copy = json.loads(json.dumps(GOOD))
        change(copy)
        rows.append((k, json.dumps(copy)))
    rows += [("empty name", json.dumps(GOOD).replace('"local_name": "t"', '"local_name": ""', 1)), ("index -1", json.dumps(GOOD).replace('"index": 0', '"index": -1', 1))]
    out = {}
    for r in wire.violations(spark.createDataFrame(rows, "doc string, raw string")).collect():
        out.setdefault(r.doc, []).append((r.path, r.message))
    return out


def test_every_rule_refuses(found):
    for k, (_, rule) in BROKEN.items():
        assert rule in {m.split(":")[0] for _, m in found[k]}, (k, found[k])
    assert found["empty name"][0][1] == "must not be empty" and found["index -1"][0][1] == "must not be negative"


def test_nothing_else_is_refused(found):
    assert not set(FINE) & set(found), {k: found.get(k) for k in FINE}
    alone = {k: {m.split(":")[0] for _, m in found[k]} for k in BROKEN}
    assert {k for k, rules in alone.items() if len(rules) > 1} <= {"value twice", "type", "namespace", "tier twice", "relation twice", "attribute twice", "two types", "second parent sequence", "untyped", "binary as polyadic", "no membership", "no kinds"}, alone


def op(kind, **more):
    return {"opcode": kind} | more


def start():
    return [
        op("declare_namespace", declaration={"prefix": "p", "namespace": "u"}),
        op("declare_tier", declaration={"name": name("t"), "long_name": ""}),
        op("declare_relation", declaration={"kind": "simple", "name": name("is"), "tier": name("t"), "item_type": name("w"), "attributes": []}),
    ]


def add():
    return op("add_item", tier=name("t"), item={"durable_id": None, "attributes": []})


LOGS = {
    "clean": ([add(), add(), op("declare_relation", declaration=binary("b", acyclic=True)), op("relate", relation=edge("b", ref(0), ref(1)))], None),
    "cycle": ([op("declare_relation", declaration=binary("b", acyclic=True)), add(), add(), add(), *(op("relate", relation=edge("b", ref(i), ref((i + 1) % 3))) for i in range(3)), add()], (9, "acyclic")),
    "relation before item": ([op("declare_relation", declaration=binary("b")), add(), op("relate", relation=edge("b", ref(0), ref(1))), add()], (5, "endpoint range")),
    "type too late": ([op("declare_tier", declaration={"name": name("v"), "long_name": ""}), op("add_item", tier=name("v"), item={"durable_id": None, "attributes": []}), op("declare_relation", declaration=binary("b")), op("relate", relation=edge("b", ref(0, "v"), ref(0, "v"))), op("declare_relation", declaration={"kind": "simple", "name": name("is2"), "tier": name("v"), "item_type": name("w"), "attributes": []})], (6, "typed tier")),
    "anchor promoted too late": ([add(), op("declare_relation", declaration=binary("b", right_endpoint="boundary")), op("relate", relation=edge("b", ref(0), anchor("after", durable="x"))), op("promote_item", reference=ref(0), durable_id="x")], (5, "endpoint range")),
    "anchor promoted in time": ([add(), op("declare_relation", declaration=binary("b", right_endpoint="boundary")), op("promote_item", reference=ref(0), durable_id="x"), op("relate", relation=edge("b", ref(0), anchor("after", durable="x")))], None),
    # the end of the tier meets the boundary after x only until an item comes between: both are there when the second edge comes
    "end meets": ([add(), add(), op("promote_item", reference=ref(0), durable_id="x"), op("promote_item", reference=ref(1), durable_id="y"), op("declare_relation", declaration=binary("b", right_endpoint="boundary", single_parent=True)), op("relate", relation=edge("b", ref(0), anchor("after", tier="t"))), op("relate", relation=edge("b", ref(1), anchor("after", durable="y"))), add()], (9, "single parent")),
    "end moved on": ([add(), op("promote_item", reference=ref(0), durable_id="x"), op("declare_relation", declaration=binary("b", right_endpoint="boundary", single_parent=True)), op("relate", relation=edge("b", ref(0), anchor("after", tier="t"))), add(), op("relate", relation=edge("b", ref(1), anchor("after", durable="x")))], None),
    "id twice": ([add(), add(), op("promote_item", reference=ref(0), durable_id="x"), op("promote_item", reference=ref(1), durable_id="x")], (6, "unique id")),
    "value of another type": ([add(), op("declare_attribute", declaration={"name": name("c"), "domain": "item", "value_type": "integer"}), op("attach_value", domain="item", target=ref(0), value=value("c", "x", "integer"))], (5, "lexical form")),
}


def test_logs_stop_where_the_graph_breaks(spark):
    rows = [(k, i, o["opcode"], json.dumps(o)) for k, (ops, _) in LOGS.items() for i, o in enumerate(start() + ops)]
    log = spark.createDataFrame(rows, "doc string, seq int, op string, j string")
    got = {r.doc: (r.seq, r.reason.split(":")[0]) for r in program.first_refusal(log).collect()}
    assert got == {k: v for k, (_, v) in LOGS.items() if v}, got


def test_logs_agree_with_the_documents_that_their_prefixes_build(spark):
    """The least place at which a log breaks a rule is the first prefix whose document breaks it."""
    for k in ("cycle", "id twice", "relation before item"):
        ops = start() + LOGS[k][0]
        rows = [(f"{n}", i, o["opcode"], json.dumps(o)) for n in range(1, len(ops) + 1) for i, o in enumerate(ops[:n])]
        built = program.replay(spark.createDataFrame(rows, "doc string, seq int, op string, j string")).selectExpr("doc", "text AS raw")
        broken = {int(r.doc) for r in wire.violations(built).collect()}
        assert min(broken) == LOGS[k][1][0] + 1


def plain_closing(edges):
    """The first edge whose head reached its tail before it came."""
    out = {}
    for i, (a, b) in enumerate(edges):
        out.setdefault(a, set()).add(b)
        seen, todo = set(), [b]
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += out.get(v, ())
        if a in seen:
            return i
    return None


@pytest.mark.parametrize("gathered", [1000, 3])
def test_closing_edges(spark, gathered):
    rng = random.Random(4)
    groups = {g: [(rng.randint(0, 8), rng.randint(0, 8)) for _ in range(rng.randint(1, 14))] for g in range(30)} | {90: [(i, i + 1) for i in range(12)], 91: [(i, i + 1) for i in range(12)] + [(7, 5), (3, 3)], 92: [(1, 1)]}
    rows = [(g, i, str(a), str(b)) for g, es in groups.items() for i, (a, b) in enumerate(es)]
    df = spark.createDataFrame(rows, "doc int, at int, l string, r string").repartition(4)
    got = {r.doc: r.at for r in cycles.closing(df, ["doc"], gathered).collect()}
    assert got == {g: at for g, es in groups.items() if (at := plain_closing(es)) is not None}


def test_tails_are_trimmed(spark):
    rows = [("a", x, y) for x, y in ("01", "12", "21", "23", "34", "45", "54", "56")] + [("b", "0", "1")]
    left = cycles.trimmed(spark.createDataFrame(rows, "doc string, l string, r string"), ["doc"])
    assert sorted(r.l + r.r for r in left.collect()) == ["12", "21", "23", "34", "45", "54"]


def test_empty_documents(spark):
    assert wellformed.check(wire.parts(wire.parsed_graphs(spark.createDataFrame([], "doc string, raw string")))).isEmpty()


def test_no_rule_gathers_its_rows_in_the_driver(spark, monkeypatch):
    """Tables that were cut look small to Spark (12 million endpoints in 8 MB of files), so joins must not be left to their sizes, nor all rules to one job."""
    from strata.plans import corpora

    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage.cut(df)

    monkeypatch.setattr(wellformed, "cut", kept)
    monkeypatch.setattr(cycles, "cut", kept)
    found = wellformed.check(corpora.event_graph_log(spark, "/root/testdata/sf0.001"))
    joins = [line for plan in plans for line in plan.split("\n") if "Join" in line]
    gathered = [line for line in joins if "Broadcast" in line and "LeftAnti" not in line]  # only the groups over ``cycles.GATHERED`` edges may be, which are few
    assert not gathered
    assert len(joins) > 20
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # the rules were run, some at a time
