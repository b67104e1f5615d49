"""Documents on the wire: canonical JSON, strict and versioned, read, checked and written in bulk.

``SHAPES`` says what each part of a document is made of. Checking walks all documents at once, one nesting level a step: a row is a JSON value with
its path and the shape it must have; its fields are compared with the shape's, and its children are the next level's rows. Every
refusal is a row (doc, path, message), so one pass lists all of them. Nothing is migrated.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import lexical
from strata.model import Corpus, Polyadic, Relation, Tier, node
from strata.operators import wellformed
from strata.plans.stage import cut

FORMAT_VERSION, MACHINE_VERSION = "5", "1"
MAX_DOCUMENT_BYTES, MAX_LINE_BYTES, MAX_JSON_DEPTH = 16 * 1024 * 1024, 1024 * 1024, 256

# The fields of each part and what they hold. [x is an array of x, x? may be null, filled is a string that must not be empty, natural an integer from 0.
SHAPES: dict[str, dict[str, str]] = {
    "document": {"format_version": "version", "graph": "graph"},
    "graph": {"namespaces": "[namespace", "tiers": "[tier", "relation_declarations": "[relation_declaration", "relations": "[relation", "attribute_declarations": "[attribute_declaration", "position_values": "[position", "attributes": "[attribute"},
    "namespace": {"prefix": "filled", "namespace": "filled"},
    "name": {"namespace": "filled", "local_name": "filled"},
    "tier": {"declaration": "tier_declaration", "items": "[item", "attributes": "[attribute"},
    "tier_declaration": {"name": "name", "long_name": "string"},
    "item": {"durable_id": "filled?", "attributes": "[attribute"},
    "attribute": {"name": "name", "value_type": "value_type", "lexical": "string"},
    "attribute_declaration": {"name": "name", "domain": "domain", "value_type": "value_type"},
    "simple": {"kind": "string", "name": "name", "tier": "name", "item_type": "name", "attributes": "[attribute"},
    "bipartite": {"kind": "string", "name": "name", "left_type": "name", "right_type": "name", "left_endpoint": "endpoint_kind", "right_endpoint": "endpoint_kind", "single_parent": "boolean", "acyclic": "boolean", "attributes": "[attribute"},
    "polyadic": {"kind": "string", "name": "name", "sources": "side", "targets": "side", "unique_sources": "boolean", "distinct_targets": "boolean", "single_parent": "boolean", "acyclic": "boolean", "targets_subset_of": "[name", "attributes": "[attribute"},
    "side": {"endpoint_kinds": "[endpoint_kind", "tiers": "[name", "minimum": "natural", "maximum": "integer", "allow_empty": "boolean"},
    "binary_instance": {"declaration": "name", "left": "endpoint", "right": "endpoint", "durable_id": "filled?", "attributes": "[attribute"},
    "polyadic_instance": {"declaration": "name", "sources": "[endpoint", "targets": "[endpoint", "durable_id": "filled?", "attributes": "[attribute"},
    "item_reference": {"tier": "name", "index": "natural"},
    "durable_item": {"durable_id": "filled"},
    "durable_position": {"anchor": "anchor", "side": "boundary_side"},
    "item_anchor": {"kind": "string", "durable_id": "filled"},
    "tier_anchor": {"kind": "string", "tier": "name"},
    "position": {"reference": "endpoint", "attributes": "[attribute"},
    "declare_namespace": {"opcode": "string", "declaration": "namespace"},
    "declare_tier": {"opcode": "string", "declaration": "tier_declaration"},
    "declare_relation": {"opcode": "string", "declaration": "relation_declaration"},
    "declare_attribute": {"opcode": "string", "declaration": "attribute_declaration"},
    "add_item": {"opcode": "string", "tier": "name", "item": "item"},
    "promote_item": {"opcode": "string", "reference": "item_reference", "durable_id": "string"},
    "promote_position": {"opcode": "string", "reference": "item_reference", "durable_id": "string"},
    "relate": {"opcode": "string", "relation": "relation"},
    "attach_value": {"opcode": "string", "domain": "domain", "target": "any", "value": "attribute"},
    "repeat": {"opcode": "string", "count": "integer", "body": "[opcode"},
}
# The spellings that an enumerated string may have.
_SPELLINGS = {
    "version": (FORMAT_VERSION,),
    "value_type": ("string", "boolean", "integer", "decimal", "double"),
    "domain": ("item", "tier", "relation_declaration", "relation_instance", "position", "document"),
    "endpoint_kind": ("item", "boundary"),
    "boundary_side": ("before", "after"),
}
DECLARATIONS = ("simple", "bipartite", "polyadic")
OPCODES = tuple(name for name, fields in SHAPES.items() if "opcode" in fields)

_NAME = "struct<local_name:string,namespace:string>"
_ATTRIBUTES = f"array<struct<lexical:string,name:{_NAME},value_type:string>>"
_REFERENCE = f"struct<anchor:struct<durable_id:string,kind:string,tier:{_NAME}>,durable_id:string,index:bigint,side:string,tier:{_NAME}>"
_SIDE = f"struct<allow_empty:boolean,endpoint_kinds:array<string>,maximum:bigint,minimum:bigint,tiers:array<{_NAME}>>"
_DECLARED = f"array<struct<acyclic:boolean,attributes:{_ATTRIBUTES},distinct_targets:boolean,item_type:{_NAME},kind:string,left_endpoint:string,left_type:{_NAME},name:{_NAME},right_endpoint:string,right_type:{_NAME},single_parent:boolean,sources:{_SIDE},targets:{_SIDE},targets_subset_of:array<{_NAME}>,tier:{_NAME},unique_sources:boolean>>"
_INSTANCES = f"array<struct<attributes:{_ATTRIBUTES},declaration:{_NAME},durable_id:string,left:{_REFERENCE},right:{_REFERENCE},sources:array<{_REFERENCE}>,targets:array<{_REFERENCE}>>>"
_TIERS = f"array<struct<attributes:{_ATTRIBUTES},declaration:struct<long_name:string,name:{_NAME}>,items:array<struct<attributes:{_ATTRIBUTES},durable_id:string>>>>"
GRAPH = f"""attribute_declarations array<struct<domain:string,name:{_NAME},value_type:string>>, attributes {_ATTRIBUTES}, namespaces array<struct<namespace:string,prefix:string>>,
position_values array<struct<attributes:{_ATTRIBUTES},reference:{_REFERENCE}>>, relation_declarations {_DECLARED}, relations {_INSTANCES}, tiers {_TIERS}"""


def depth(text: Column) -> Column:
    """The deepest nesting of brackets outside of strings."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', "")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    step = lambda a, c: F.struct((a.now + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"), F.greatest(a.most, a.now + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most"))
    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a.most)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc (the file), raw: one row for each document of a folder or pattern."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), F.col("value").alias("raw"))


def unreadable(documents: DataFrame, most: int = MAX_DOCUMENT_BYTES) -> DataFrame:
    """doc, path, message: texts that are too large, too deep or not JSON, in that order."""
    message = F.when(F.octet_length("raw") > most, "too large").when(depth(F.col("raw")) > MAX_JSON_DEPTH, "nesting too deep").when(F.expr("try_parse_json(raw)").isNull(), "not JSON")
    return documents.select("doc", F.lit("").alias("path"), message.alias("message")).where("message IS NOT NULL")


def _resolved() -> Column:
    """The shape of a value where its own fields decide between several."""
    keys = F.json_object_keys("j")
    kind = F.get_json_object("j", "$.kind")
    endpoint = F.when(F.array_contains(keys, "anchor"), "durable_position").when((F.col("shape") == "program_endpoint") & F.array_contains(keys, "durable_id"), "durable_item").otherwise("item_reference")
    return (
        F.when(F.col("shape") == "relation_declaration", F.when(kind.isin(*DECLARATIONS), kind))
        .when(F.col("shape") == "relation", F.when(F.array_contains(keys, "sources"), "polyadic_instance").otherwise("binary_instance"))
        .when(F.col("shape").isin("endpoint", "program_endpoint"), endpoint)
        .when(F.col("shape") == "anchor", F.when(kind.isin("item", "tier"), F.concat(kind, F.lit("_anchor"))))
        .when(F.col("shape") == "opcode", F.when(F.get_json_object("j", "$.opcode").isin(*OPCODES), F.get_json_object("j", "$.opcode")))
        .otherwise(F.col("shape"))
    )


def _map(entries: dict[str, Column]) -> Column:
    return F.create_map(*(x for k, v in entries.items() for x in (F.lit(k), v)))


def shape_errors(values: DataFrame) -> DataFrame:
    """doc, path, message of all that ``values`` (doc, path, shape, j) do otherwise than their shapes; ``j`` is JSON text."""
    fields = _map({name: _map({k: F.lit(v) for k, v in f.items()}) for name, f in SHAPES.items()})
    spellings = _map({k: F.array(*map(F.lit, v)) for k, v in _SPELLINGS.items()})
    schema = "doc string, path string, message string"
    out = values.sparkSession.createDataFrame([], schema)
    level = cut(values.select(F.col("doc").cast("string").alias("doc"), "path", "shape", "j"))
    for _ in range(MAX_JSON_DEPTH + 1):
        first = F.substring("j", 1, 1)
        kind = F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(F.col("j").isin("true", "false"), "boolean").when(F.col("j") == "null", "null").when(F.col("j").rlike(r"\A-?[0-9]+\z"), "integer").otherwise("number")
        typed = level.withColumn("kind", kind).withColumn("is", F.when(F.col("kind") == "object", _resolved()).otherwise(F.col("shape")))
        array = F.col("shape").startswith("[")
        composite = F.col("shape").isin(*SHAPES, "relation_declaration", "relation", "endpoint", "program_endpoint", "anchor", "opcode")
        wanted = F.map_keys(F.element_at(fields, F.col("is")))
        keys = F.json_object_keys("j")
        missing, extra = F.array_min(F.array_except(wanted, keys)), F.array_min(F.array_except(keys, wanted))
        spelled = F.get_json_object(F.concat(F.lit('{"x":'), "j", F.lit("}")), "$.x")
        allowed = F.element_at(spellings, F.col("shape"))
        plain = F.regexp_replace("shape", r"\?\z", "")
        plain = F.when(plain == "filled", "string").when(plain == "natural", "integer").otherwise(plain)
        optional = F.col("shape").endswith("?") & (F.col("kind") == "null")
        message = (
            F.when(array, F.when(F.col("kind") != "array", "must be an array"))
            .when(F.col("shape") == "any", None)
            .when(composite, F.when(F.col("kind") != "object", "must be an object").when(F.col("is").isNull(), "has an unknown kind").when(missing.isNotNull(), F.concat(F.lit("is missing field "), missing)).when(extra.isNotNull(), F.concat(F.lit("has unknown field "), extra)))
            .when(allowed.isNotNull(), F.when(F.col("kind") != "string", "must be a string").when(~F.array_contains(allowed, spelled), F.concat(F.lit("has unsupported value "), "j")))
            .when(F.col("shape").startswith("filled") & (F.col("j") == '""'), "must not be empty")
            .when((F.col("shape") == "natural") & F.col("j").startswith("-"), "must not be negative")
            .when((F.col("kind") != plain) & ~optional, F.concat(F.lit("must be "), F.when(plain == "integer", "an ").otherwise("a "), plain))
        )
        judged = cut(typed.withColumn("message", message).withColumn("fields", F.element_at(fields, F.col("is"))))
        out = out.unionByName(judged.where("message IS NOT NULL").select("doc", "path", "message"))
        inner = judged.where("kind IN ('object', 'array') AND (message IS NULL OR message LIKE '%field%') AND shape <> 'any'")
        level = level.sparkSession.sql(
            """SELECT doc, CASE WHEN e.key IS NULL THEN concat(path, '[', e.pos, ']') WHEN path IN ('', 'graph') THEN e.key ELSE concat(path, '.', e.key) END AS path,
                CASE WHEN e.key IS NULL THEN substring(shape, 2) ELSE fields[e.key] END AS shape, to_json(e.value) AS j
               FROM {inner} AS x, LATERAL variant_explode(parse_json(x.j)) AS e WHERE e.key IS NULL OR array_contains(map_keys(x.fields), e.key)""",
            inner=inner,
        )
        level = cut(level)
        if level.isEmpty():
            break
    return out


def violations(documents: DataFrame) -> DataFrame:
    """doc, path, message: what is refused of each document (doc, raw). The path is empty where the whole text is; a document of the right shape is held against the graph's rules, with the part that breaks one as path."""
    shaped = cut(shape_violations(documents))
    bad = shaped.select("doc").distinct()
    good = parsed_graphs(documents.withColumn("doc", F.col("doc").cast("string")).join(bad, "doc", "left_anti"))
    broken = wellformed.check(parts(good))
    return cut(shaped.unionByName(broken.select("doc", F.col("subject").alias("path"), F.concat("rule", F.lit(": "), F.coalesce("detail", F.lit(""))).alias("message"))))


def shape_violations(documents: DataFrame) -> DataFrame:
    """doc, path, message of texts that can't be read and of parts of other shapes than theirs."""
    bad = cut(unreadable(documents))
    readable = documents.join(bad.select("doc"), "doc", "left_anti")
    values = readable.select("doc", F.lit("").alias("path"), F.lit("document").alias("shape"), F.to_json(F.parse_json("raw")).alias("j"))
    return bad.withColumn("doc", F.col("doc").cast("string")).unionByName(shape_errors(values))


def parse(documents: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """doc and the graph's parts as nested columns, of the documents without violations."""
    refused = violations(documents) if refused is None else refused
    return parsed_graphs(documents.join(refused.select("doc").distinct(), "doc", "left_anti"))


def parsed_graphs(documents: DataFrame) -> DataFrame:
    """doc and the graph's parts, of documents of the right shape."""
    return documents.select("doc", F.from_json(F.get_json_object("raw", "$.graph"), GRAPH).alias("g")).select("doc", "g.*")


def name_text(c: Column) -> Column:
    """{namespace}local of a name."""
    return F.when(c.isNotNull(), lexical.expanded(c["namespace"], c["local_name"]))


def reference(c: Column, structural: str = "item") -> Column:
    """A reference as ``wellformed.REF``; ``structural`` says whether a tier and index mean an item or a position."""
    anchor = c["anchor"]
    kind = F.when(anchor.isNotNull(), "boundary").otherwise(structural)
    return F.struct(kind.alias("kind"), F.coalesce(name_text(anchor["tier"]), name_text(c["tier"])).alias("tier"), c["index"].alias("i"), F.coalesce(anchor["durable_id"], c["durable_id"]).alias("id"), c["side"].alias("side"))


def declared_side(c: Column) -> Column:
    return F.when(c.isNotNull(), F.struct(c["allow_empty"].alias("allow_empty"), c["endpoint_kinds"].alias("kinds"), c["maximum"].alias("maximum"), c["minimum"].alias("minimum"), F.transform(c["tiers"], name_text).alias("tiers")))


def relation_columns(x: Column) -> list[Column]:
    """A relation declaration as columns of ``wellformed.Parts.relations``."""
    names = [name_text(x[c]).alias(c) for c in ("name", "tier", "item_type", "left_type", "right_type")]
    flags = [F.coalesce(x[c], F.lit(False)).alias(c) for c in ("single_parent", "acyclic", "unique_sources", "distinct_targets")]
    ends = [x["kind"].alias("kind"), x["left_endpoint"].alias("left_kind"), x["right_endpoint"].alias("right_kind")]
    return [*names, *flags, *ends, declared_side(x["sources"]).alias("sources"), declared_side(x["targets"]).alias("targets"), name_text(F.get(x["targets_subset_of"], F.lit(0))).alias("subset_of")]


def instance_columns(x: Column) -> list[Column]:
    many = x["sources"].isNotNull()
    side = lambda c: F.coalesce(F.transform(x[c], lambda r: reference(r)), F.array().cast(f"array<{wellformed.REF}>")).alias(c)
    end = lambda c: F.when(~many, reference(x[c])).alias(c)
    return [many.alias("many"), name_text(x["declaration"]).alias("relation"), end("left"), end("right"), side("sources"), side("targets"), x["durable_id"].alias("id")]


def declared_names(tiers_: DataFrame, relations_: DataFrame, attributes_: DataFrame) -> DataFrame:
    """doc, born, subject, name, namespace: the qualified names that declarations use, from parts with ``own`` as the JSON structure of a name."""
    used = F.array_compact(F.flatten(F.array(F.array(F.col("x")["name"], F.col("x")["item_type"], F.col("x")["left_type"], F.col("x")["right_type"]), *(F.coalesce(c, F.array().cast(f"array<{_NAME}>")) for c in (F.col("x")["sources"]["tiers"], F.col("x")["targets"]["tiers"], F.col("x")["targets_subset_of"])))))
    all_ = tiers_.select("doc", "born", F.col("x").alias("n")).unionByName(attributes_.select("doc", "born", F.col("x").alias("n"))).unionByName(relations_.select("doc", "born", F.explode(used).alias("n")))
    return all_.select("doc", "born", name_text(F.col("n")).alias("subject"), F.col("n.local_name").alias("name"), F.col("n.namespace").alias("namespace")).distinct()


def parts(parsed: DataFrame) -> wellformed.Parts:
    """The documents' parts for ``wellformed.check``: all born at once."""
    parsed = cut(parsed.withColumn("doc", F.col("doc").cast("string")))
    born = F.lit(0).cast("bigint").alias("born")
    own = lambda column, *more: parsed.select("doc", born, F.posexplode(column).alias("ord", "x"), *more)
    t, r, a, n = own("tiers"), own("relation_declarations"), own("attribute_declarations"), own("relations")
    members = t.select("doc", "born", name_text(F.col("x.declaration.name")).alias("tier"), F.posexplode("x.items").alias("i", "y"))
    named = F.when(F.col("y.durable_id").isNotNull(), F.col("born")).alias("named")
    tier_names = t.select("doc", "born", F.col("x.declaration.name").alias("x"))
    places_ = own("position_values")
    at = lambda word, *c: F.concat_ws(" ", F.lit(word), *(x.cast("string") for x in c))
    held = [
        parsed.select("doc", F.lit("document").alias("domain"), F.lit("document").alias("owner"), F.explode("attributes").alias("v")),
        t.select("doc", F.lit("tier").alias("domain"), at("tier", name_text(F.col("x.declaration.name"))).alias("owner"), F.explode("x.attributes").alias("v")),
        members.select("doc", F.lit("item").alias("domain"), at("item", F.col("tier"), F.col("i")).alias("owner"), F.explode("y.attributes").alias("v")),
        r.select("doc", F.lit("relation_declaration").alias("domain"), at("relation", name_text(F.col("x.name"))).alias("owner"), F.explode("x.attributes").alias("v")),
        n.select("doc", F.lit("relation_instance").alias("domain"), at("relation instance", F.col("ord")).alias("owner"), F.explode("x.attributes").alias("v")),
        places_.select("doc", F.lit("position").alias("domain"), at("position", F.col("ord")).alias("owner"), F.explode("x.attributes").alias("v")),
    ]
    values = held[0]
    for more in held[1:]:
        values = values.unionByName(more)
    return wellformed.Parts(
        own("namespaces").select("doc", "born", "ord", "x.prefix", "x.namespace"),
        t.select("doc", "born", "ord", name_text(F.col("x.declaration.name")).alias("tier")),
        cut(members.select("doc", "born", "tier", F.col("i").cast("bigint").alias("i"), F.col("y.durable_id").alias("id"), named)),
        cut(r.select("doc", "born", "ord", *relation_columns(F.col("x")))),
        a.select("doc", "born", "ord", name_text(F.col("x.name")).alias("name"), "x.domain", "x.value_type"),
        cut(n.select("doc", "born", "ord", *instance_columns(F.col("x")))),
        cut(values.select("doc", born, "domain", "owner", name_text(F.col("v.name")).alias("name"), "v.value_type", "v.lexical")),
        places_.select("doc", "born", "ord", reference(F.col("x.reference"), "position").alias("ref"), (F.size("x.attributes") > 0).alias("filled")),
        declared_names(tier_names, r, a.select("doc", "born", F.col("x.name").alias("x"))),
    )


def namespaces(parsed: DataFrame) -> DataFrame:
    """doc, ord, prefix, namespace."""
    return parsed.select("doc", F.posexplode("namespaces").alias("ord", "x")).select("doc", "ord", "x.prefix", "x.namespace")


def tiers(parsed: DataFrame) -> DataFrame:
    """doc, t, tier (name), long_name, n."""
    return parsed.select("doc", F.posexplode("tiers").alias("t", "x")).select("doc", "t", F.col("x.declaration.name").alias("tier"), "x.declaration.long_name", F.size("x.items").alias("n"))


def items(parsed: DataFrame) -> DataFrame:
    """doc, t, tier (name), idx, durable_id."""
    rows = parsed.select("doc", F.posexplode("tiers").alias("t", "tier"))
    return rows.select("doc", "t", F.col("tier.declaration.name").alias("tier"), F.posexplode("tier.items").alias("idx", "item")).select("doc", "t", "tier", "idx", "item.durable_id")


def declarations(parsed: DataFrame) -> DataFrame:
    """doc, decl, and the columns of a relation declaration: those of other kinds are null."""
    return parsed.select("doc", F.posexplode("relation_declarations").alias("decl", "x")).select("doc", "decl", "x.*")


def relations(parsed: DataFrame) -> DataFrame:
    """doc, ord, polyadic, and the columns of an instance."""
    rows = parsed.select("doc", F.posexplode("relations").alias("ord", "x")).select("doc", "ord", "x.*")
    return rows.withColumn("polyadic", F.col("sources").isNotNull())


def attribute_declarations(parsed: DataFrame) -> DataFrame:
    """doc, ord, name, domain, value_type."""
    return parsed.select("doc", F.posexplode("attribute_declarations").alias("ord", "x")).select("doc", "ord", "x.name", "x.domain", "x.value_type")


def attributes(parsed: DataFrame) -> DataFrame:
    """doc, domain, t, i, ref, name, value_type, lexical of every value in the six domains: ``i`` is an item's, a declaration's or an instance's place,
    ``ref`` a position's reference."""
    nothing = F.lit(None).cast("int")
    no_ref = F.lit(None).cast(_REFERENCE)
    rows = parsed.select("doc", F.posexplode("tiers").alias("t", "x"))
    members = rows.select("doc", "t", F.posexplode("x.items").alias("i", "y"))
    parts = [
        parsed.select("doc", F.lit("document").alias("domain"), nothing.alias("t"), nothing.alias("i"), no_ref.alias("ref"), F.explode("attributes").alias("a")),
        rows.select("doc", F.lit("tier").alias("domain"), "t", nothing.alias("i"), no_ref.alias("ref"), F.explode("x.attributes").alias("a")),
        members.select("doc", F.lit("item").alias("domain"), "t", "i", no_ref.alias("ref"), F.explode("y.attributes").alias("a")),
        declarations(parsed).select("doc", F.lit("relation_declaration").alias("domain"), nothing.alias("t"), F.col("decl").alias("i"), no_ref.alias("ref"), F.explode("attributes").alias("a")),
        relations(parsed).select("doc", F.lit("relation_instance").alias("domain"), nothing.alias("t"), F.col("ord").alias("i"), no_ref.alias("ref"), F.explode("attributes").alias("a")),
        parsed.select("doc", F.explode("position_values").alias("x")).select("doc", F.lit("position").alias("domain"), nothing.alias("t"), nothing.alias("i"), F.col("x.reference").alias("ref"), F.explode("x.attributes").alias("a")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("doc", "domain", "t", "i", "ref", "a.name", "a.value_type", "a.lexical")


def corpus(parsed: DataFrame) -> Corpus:
    """One document as a corpus: its tiers, and its relations between items and boundaries that are named by place or by durable id."""
    own = tiers(parsed).orderBy("t").collect()  # the tiers of one document
    members = items(parsed)
    made = tuple(Tier(r.t, r.tier.local_name, members.where(F.col("t") == r.t).select("doc", F.col("idx").cast("bigint").alias("idx"), "durable_id"), long_name=r.long_name, durable="durable_id") for r in own)
    of_name = F.create_map(*(x for r in own for x in (F.lit(f"{{{r.tier.namespace}}}{r.tier.local_name}"), F.lit(r.t)))) if own else F.create_map(F.lit(""), F.lit(0))
    sizes = F.create_map(*(x for r in own for x in (F.lit(r.t), F.lit(r.n)))) if own else F.create_map(F.lit(0), F.lit(0))
    known = members.where("durable_id IS NOT NULL").agg(F.map_from_entries(F.collect_list(F.struct("durable_id", node(F.col("t"), F.col("idx")).alias("n")))).alias("ids")).first().ids or {}
    ids = F.create_map(*(x for k, n in known.items() for x in (F.lit(k), node(n.t, F.lit(n.i))))) if known else F.create_map(F.lit(""), node(0, F.lit(0)))

    def at(c: Column) -> Column:
        key = lambda n: F.concat(F.lit("{"), n["namespace"], F.lit("}"), n["local_name"])
        item = F.element_at(ids, F.coalesce(c["anchor"]["durable_id"], c["durable_id"]))
        tier = F.element_at(of_name, key(c["anchor"]["tier"]))
        after = F.when(c["side"] == "after", 1).otherwise(0)
        return (
            F.when(c["anchor"]["kind"] == "tier", node(tier, F.when(c["side"] == "after", F.element_at(sizes, tier)).otherwise(0)))
            .when(c["anchor"].isNotNull(), node(item["t"], item["i"] + after))
            .otherwise(node(F.element_at(of_name, key(c["tier"])), c["index"]))
        )

    rows = relations(parsed)
    names = sorted({(r.name, r.kind) for r in declarations(parsed).select("name.local_name", "kind").withColumnRenamed("local_name", "name").collect() if r.kind != "simple"})
    binary = tuple(Relation(n, rows.where(~F.col("polyadic") & (F.col("declaration.local_name") == n)).select("doc", F.col("ord").cast("bigint").alias("ord"), at(F.col("left")).alias("l"), at(F.col("right")).alias("r"))) for n, k in names if k == "bipartite")
    many = tuple(Polyadic(n, rows.where(F.col("polyadic") & (F.col("declaration.local_name") == n)).select("doc", F.col("ord").cast("bigint").alias("ord"), F.transform("sources", at).alias("sources"), F.transform("targets", at).alias("targets"))) for n, k in names if k == "polyadic")
    return Corpus(made, binary, many)


def dumps(documents: DataFrame) -> DataFrame:
    """doc, text: compact canonical JSON, keys sorted."""
    return documents.select("doc", F.to_json(F.parse_json("raw")).alias("text"))


def pretty(compact: DataFrame) -> DataFrame:
    """doc, text: the canonical spelling with two spaces a level and a final line feed, from compact texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [json.dumps(json.loads(t), indent=2, sort_keys=True, ensure_ascii=False) + "\n" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(texts, pa.string())], ["doc", "text"])

    return compact.select("doc", "text").mapInArrow(run, compact.select("doc", "text").schema)


def inspect(parsed: DataFrame) -> DataFrame:
    """doc, ord, line: the counts of a document's parts, then its tiers and its relations."""
    n = lambda c: F.size(c).cast("string")
    name = lambda c: F.concat(F.lit("{"), c["namespace"], F.lit("}"), c["local_name"])
    total = F.aggregate("tiers", F.lit(0), lambda a, t: a + F.size(t["items"])).cast("string")
    lines = F.array(
        F.lit(f"format version: {FORMAT_VERSION}"),
        F.concat(F.lit("namespaces: "), n("namespaces")),
        F.concat(F.lit("tiers: "), n("tiers")),
        F.concat(F.lit("items: "), total),
        F.concat(F.lit("relation declarations: "), n("relation_declarations")),
        F.concat(F.lit("binary relation instances: "), n(F.filter("relations", lambda r: r["sources"].isNull()))),
        F.concat(F.lit("polyadic relation instances: "), n(F.filter("relations", lambda r: r["sources"].isNotNull()))),
        F.concat(F.lit("attribute declarations: "), n("attribute_declarations")),
        F.concat(F.lit("populated position values: "), n("position_values")),
        F.concat(F.lit("document attributes: "), n("attributes")),
    )
    of_tiers = F.transform("tiers", lambda t: F.concat(F.lit("tier: "), name(t["declaration"]["name"]), F.lit(" | "), t["declaration"]["long_name"], F.lit(" | items="), n(t["items"]), F.lit(" | attributes="), n(t["attributes"])))
    of_relations = F.transform("relation_declarations", lambda r: F.concat(F.lit("relation: "), name(r["name"]), F.lit(" | kind="), r["kind"]))
    return parsed.select("doc", F.posexplode(F.concat(lines, of_tiers, of_relations)).alias("ord", "line"))
