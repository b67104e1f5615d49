"""Documents and edit programs: shapes, refusals with their paths, replay and the command line."""

import hashlib
import json

import pytest

from strata.sources import program, schema, wire


def name(local, namespace="u"):
    return {"namespace": namespace, "local_name": local}


def value(local, lexical, kind="string"):
    return {"name": name(local), "value_type": kind, "lexical": lexical}


def item(durable=None, *values):
    return {"durable_id": durable, "attributes": list(values)}


def ref(index, tier="t"):
    return {"tier": name(tier), "index": index}


LINK = {"kind": "bipartite", "name": name("link"), "left_type": name("w"), "right_type": name("w"), "left_endpoint": "item", "right_endpoint": "boundary", "single_parent": False, "acyclic": True, "attributes": []}
SIMPLE = {"kind": "simple", "name": name("is"), "tier": name("t"), "item_type": name("w"), "attributes": []}
SIDE = {"endpoint_kinds": ["item", "boundary"], "tiers": [], "minimum": 1, "maximum": -1, "allow_empty": False}
POLY = {"kind": "polyadic", "name": name("has"), "sources": SIDE, "targets": SIDE, "unique_sources": True, "distinct_targets": False, "single_parent": False, "acyclic": False, "targets_subset_of": [], "attributes": []}
GOOD = {
    "format_version": "5",
    "graph": {
        "namespaces": [{"prefix": "p", "namespace": "u"}],
        "tiers": [{"declaration": {"name": name("t"), "long_name": "Tier"}, "items": [item("x", value("cost", "4", "integer")), item()], "attributes": [value("sort", "a")]}],
        "relation_declarations": [SIMPLE, LINK, POLY],
        "relations": [
            {"declaration": name("link"), "left": ref(0), "right": {"anchor": {"kind": "item", "durable_id": "x"}, "side": "after"}, "durable_id": None, "attributes": []},
            {"declaration": name("has"), "sources": [ref(0)], "targets": [ref(1), {"anchor": {"kind": "tier", "tier": name("t")}, "side": "before"}], "durable_id": "r", "attributes": [value("why", "é\n\"")]},
        ],
        "attribute_declarations": [{"name": name(n), "domain": d, "value_type": k} for n, d, k in (("cost", "item", "integer"), ("sort", "tier", "string"), ("why", "relation_instance", "string"), ("at", "position", "decimal"), ("title", "document", "string"))],
        "position_values": [{"reference": ref(2), "attributes": [value("at", "1", "decimal")]}],
        "attributes": [value("title", "T")],
    },
}


def changed(change):
    copy = json.loads(json.dumps(GOOD))
    change(copy)
    return json.dumps(copy)


BAD = {
    "old": (lambda d: d.update(format_version="4"), ("format_version", 'has unsupported value "4"')),
    "extra": (lambda d: d["graph"].update(more=1), ("graph", "has unknown field more")),
    "less": (lambda d: d.pop("graph"), ("", "is missing field graph")),
    "item": (lambda d: d["graph"]["tiers"][0]["items"][1].pop("durable_id"), ("tiers[0].items[1]", "is missing field durable_id")),
    "kind": (lambda d: d["graph"]["relation_declarations"][1].update(kind="other"), ("relation_declarations[1]", "has an unknown kind")),
    "enum": (lambda d: d["graph"]["attribute_declarations"][0].update(domain="world"), ("attribute_declarations[0].domain", 'has unsupported value "world"')),
    "index": (lambda d: d["graph"]["relations"][0]["left"].update(index=1.5), ("relations[0].left.index", "must be an integer")),
    "boolean": (lambda d: d["graph"]["relation_declarations"][1].update(acyclic="yes"), ("relation_declarations[1].acyclic", "must be a boolean")),
    "array": (lambda d: d["graph"].update(tiers={}), ("tiers", "must be an array")),
    "string": (lambda d: d["graph"]["namespaces"][0].update(prefix=None), ("namespaces[0].prefix", "must be a string")),
    "anchor": (lambda d: d["graph"]["relations"][0]["right"]["anchor"].update(kind="x"), ("relations[0].right.anchor", "has an unknown kind")),
}


@pytest.fixture(scope="module")
def documents(spark):
    rows = [("good", json.dumps(GOOD)), ("broken", "{"), ("deep", "[" * 300 + "]" * 300)] + [(k, changed(f)) for k, (f, _) in BAD.items()]
    return spark.createDataFrame(rows, "doc string, raw string")


def test_each_refusal_has_its_path(documents):
    found = {}
    for r in wire.violations(documents).collect():
        found.setdefault(r.doc, []).append((r.path, r.message))
    assert found == {"broken": [("", "not JSON")], "deep": [("", "nesting too deep")]} | {k: [want] for k, (_, want) in BAD.items()}


def test_tables_and_canonical_text(documents):
    good = documents.where("doc = 'good'")
    parsed = wire.parse(good)
    assert [(r.idx, r.durable_id) for r in wire.items(parsed).orderBy("idx").collect()] == [(0, "x"), (1, None)]
    assert [(r.tier.local_name, r.long_name, r.n) for r in wire.tiers(parsed).collect()] == [("t", "Tier", 2)]
    assert sorted((r.domain, r.name.local_name, r.lexical) for r in wire.attributes(parsed).collect()) == [("document", "title", "T"), ("item", "cost", "4"), ("position", "at", "1"), ("relation_instance", "why", 'é\n"'), ("tier", "sort", "a")]
    assert [(r.ord, r.polyadic) for r in wire.relations(parsed).orderBy("ord").collect()] == [(0, False), (1, True)]
    assert [r.kind for r in wire.declarations(parsed).orderBy("decl").collect()] == ["simple", "bipartite", "polyadic"]
    assert wire.namespaces(parsed).first().prefix == "p" and wire.attribute_declarations(parsed).first().value_type == "integer"
    compact = wire.dumps(good)
    assert compact.first().text == json.dumps(GOOD, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    assert wire.pretty(compact).first().text == json.dumps(GOOD, sort_keys=True, ensure_ascii=False, indent=2) + "\n"
    lines = [r.line for r in wire.inspect(parsed).orderBy("ord").collect()]
    assert lines[0] == "format version: 5" and "items: 2" in lines and "polyadic relation instances: 1" in lines and lines[-1] == "relation: {u}has | kind=polyadic"


def test_schema_agrees(documents):
    assert schema.validation_errors(GOOD) == []
    for k in BAD:
        assert schema.validation_errors(json.loads(changed(BAD[k][0]))), k
    assert schema.shape_hash() == schema.shape_hash() and len(schema.json_schema()["$defs"]) > 15


def op(kind, **fields):
    return {"opcode": kind, **fields}


FLAT = LINK | {"right_endpoint": "item"}
HELD = (("cost", "item", "integer"), ("w", "item", "string"), ("size", "tier", "string"), ("note", "relation_declaration", "string"), ("title", "document", "string"), ("at", "position", "string"), ("why", "relation_instance", "string"))
PROGRAM = [
    op("declare_namespace", declaration={"prefix": "p", "namespace": "u"}),
    op("declare_tier", declaration={"name": name("t"), "long_name": "Tier"}),
    op("declare_relation", declaration=SIMPLE),
    op("declare_relation", declaration=FLAT),
    op("declare_relation", declaration=POLY),
    *(op("declare_attribute", declaration={"name": name(n), "domain": d, "value_type": k}) for n, d, k in HELD),
    op("repeat", count=2, body=[op("add_item", tier=name("t"), item=item()), op("repeat", count=1, body=[op("add_item", tier=name("t"), item=item(None, value("w", "a,}\"")))])]),
    op("promote_item", reference=ref(1), durable_id="one"),
    op("promote_item", reference=ref(1), durable_id="again"),
    op("attach_value", domain="item", target=ref(0), value=value("cost", "4", "integer")),
    op("attach_value", domain="item", target={"durable_id": "one"}, value=value("cost", "5", "integer")),
    op("attach_value", domain="tier", target=name("t"), value=value("size", "6")),
    op("attach_value", domain="relation_declaration", target=name("link"), value=value("note", "7")),
    op("attach_value", domain="document", target=None, value=value("title", "8")),
    op("attach_value", domain="position", target=ref(2), value=value("at", "9")),
    op("attach_value", domain="position", target=ref(0), value=value("at", "10")),
    op("attach_value", domain="position", target=ref(3), value=value("at", "11")),
    op("promote_position", reference=ref(2), durable_id="two"),
    op("promote_position", reference=ref(0), durable_id="none"),
    op("relate", relation={"declaration": name("has"), "sources": [ref(0)], "targets": [ref(1)], "durable_id": "h", "attributes": []}),
    op("relate", relation={"declaration": name("link"), "left": ref(0), "right": ref(1), "durable_id": None, "attributes": []}),
    op("attach_value", domain="relation_instance", target={"durable_id": "h"}, value=value("why", "12")),
]


def text(ops, header='{"machine_version":"1"}'):
    return "\n".join([header, *map(json.dumps, ops)]) + "\n"


def built():
    link = FLAT | {"attributes": [value("note", "7")]}
    two = item(None, value("w", "a,}\""))
    items = [item(None, value("cost", "4", "integer")), item("one", value("w", "a,}\""), value("cost", "5", "integer")), item("two"), two]
    return {
        "format_version": "5",
        "graph": {
            "namespaces": [{"prefix": "p", "namespace": "u"}],
            "tiers": [{"declaration": {"name": name("t"), "long_name": "Tier"}, "items": items, "attributes": [value("size", "6")]}],
            "relation_declarations": [SIMPLE, link, POLY],
            "relations": [
                {"declaration": name("link"), "left": ref(0), "right": ref(1), "durable_id": None, "attributes": []},
                {"declaration": name("has"), "sources": [ref(0)], "targets": [ref(1)], "durable_id": "h", "attributes": [value("why", "12")]},
            ],
            "attribute_declarations": [{"name": name(n), "domain": d, "value_type": k} for n, d, k in HELD],
            "position_values": [
                {"reference": {"anchor": {"kind": "item", "durable_id": "two"}, "side": "before"}, "attributes": [value("at", "9")]},
                {"reference": {"anchor": {"kind": "tier", "tier": name("t")}, "side": "before"}, "attributes": [value("at", "10")]},
                {"reference": ref(3), "attributes": [value("at", "11")]},
            ],
            "attributes": [value("title", "8")],
        },
    }


def test_programs_build_documents(spark):
    docs = spark.createDataFrame([("a", text(PROGRAM)), ("b", text(PROGRAM[:2]))], "doc string, raw string")
    assert program.violations(docs).count() == 0
    ops = program.flattened(docs)
    assert ops.where("doc = 'a'").count() == 31 and program.refusals(ops).count() == 0
    texts = {r.doc: r.text for r in program.replay(ops).collect()}
    assert json.loads(texts["a"]) == built()
    assert texts["a"] == json.dumps(built(), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    assert json.loads(texts["b"])["graph"]["tiers"][0]["items"] == []
    prints = {r.doc: r.sha256 for r in program.fingerprint(program.replay(ops)).collect()}
    assert prints["a"] == hashlib.sha256(texts["a"].encode()).hexdigest()
    stored = spark.createDataFrame([("a", texts["a"]), ("b", texts["a"])], "doc string, text string")
    assert [r.doc for r in program.not_as_built(stored, ops).collect()] == ["b"]
    few = program.flattened(docs.where("doc = 'b'"))
    assert [(r.seq, r.op, len(json.loads(r.text)["graph"]["tiers"])) for r in program.steps(few).orderBy("seq").collect()] == [(0, "declare_namespace", 0), (1, "declare_tier", 1)]


def test_programs_are_refused(spark):
    bad = {
        "blank": text([]) + "\n",
        "header": text([], '{"machine_version":"2"}'),
        "opcode": text([op("other")]),
        "field": text([op("declare_tier", declaration={"name": name("t")})]),
        "nested": text([op("repeat", count=1, body=[op("add_item", tier=name("t"))])]),
    }
    docs = spark.createDataFrame(list(bad.items()), "doc string, raw string")
    found = {(r.doc, r.path, r.message) for r in program.violations(docs).collect()}
    assert found == {
        ("blank", "line 2", "is blank"),
        ("header", "line 1", "isn't the header of this version"),
        ("opcode", "line 2", "has an unknown kind"),
        ("field", "line 2.declaration", "is missing field long_name"),
        ("nested", "line 2.body[0]", "is missing field item"),
    }
    space, tier, size = PROGRAM[0], PROGRAM[1], op("declare_attribute", declaration={"name": name("size"), "domain": "tier", "value_type": "string"})
    stops = {
        "twice": ([space, tier, tier], (2, "declared twice")),
        "unknown": ([space, op("add_item", tier=name("t"), item=item())], (1, "not declared")),
        "place": ([space, tier, op("promote_item", reference=ref(0), durable_id="x")], (2, "no such place")),
        "value": ([space, tier, size, *(op("attach_value", domain="tier", target=name("t"), value=value("size", x)) for x in "12")], (4, "attached twice")),
        "space": ([tier], (0, "declared namespace: {u}t")),
    }
    ops = program.flattened(spark.createDataFrame([(k, text(p)) for k, (p, _) in stops.items()], "doc string, raw string"))
    assert {r.doc: (r.seq, r.reason) for r in program.first_refusal(ops).collect()} == {k: want for k, (_, want) in stops.items()}
    with pytest.raises(ValueError):
        program.flattened(spark.createDataFrame([("a", text([op("repeat", count=10_001, body=[])]))], "doc string, raw string"))
    with pytest.raises(ValueError):
        program.flattened(spark.createDataFrame([("a", text([op("repeat", count=10_000, body=[op("repeat", count=10_000, body=[tier])])]))], "doc string, raw string"))


def test_command_line(spark, tmp_path, capsys):
    from strata import cli

    (tmp_path / "good.json").write_text(json.dumps(GOOD))
    (tmp_path / "bad.json").write_text(changed(BAD["less"][0]))
    (tmp_path / "p.jsonl").write_text(text(PROGRAM))
    assert cli.main(["schema"]) == 0 and json.loads(capsys.readouterr().out) == schema.json_schema()
    assert cli.main(["validate", str(tmp_path / "bad.json")]) == 1 and "is missing field graph" in capsys.readouterr().err
    assert cli.main(["inspect", str(tmp_path / "good.json")]) == 0 and "tier: {u}t | Tier | items=2 | attributes=1" in capsys.readouterr().out
    assert cli.main(["convert", str(tmp_path / "good.json"), "-o", str(tmp_path / "out.json")]) == 0
    assert json.loads((tmp_path / "out.json").read_text()) == GOOD
    assert cli.main(["convert", str(tmp_path / "good.json"), "-o", str(tmp_path / "good.json")]) == 3
    assert cli.main(["validate", str(tmp_path / "none.json")]) == 3
    capsys.readouterr()
    assert cli.main(["run", str(tmp_path / "p.jsonl"), "--to", "json-compact"]) == 0 and json.loads(capsys.readouterr().out) == built()
    (tmp_path / "q.jsonl").write_text(text(PROGRAM[:3]))
    assert cli.main(["step", str(tmp_path / "q.jsonl")]) == 0 and [json.loads(x)["opcode"] for x in capsys.readouterr().out.splitlines()] == ["declare_namespace", "declare_tier", "declare_relation"]
    assert cli.main(["render", str(tmp_path / "good.json")]) == 0 and capsys.readouterr().out.startswith("digraph")
