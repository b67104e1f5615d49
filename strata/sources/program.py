"""Edit programs: JSON lines decoded, flattened and replayed in bulk to documents.

A program's first line is its header, every other line one opcode; a repeat holds opcodes itself. Flattening gives each primitive opcode
the array of its place and turns, which orders them; replay is one reduction of all programs at once. The state after a step is the replay of the
ops up to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators import wellformed
from strata.operators.machine import MAX_OPCODES, MAX_REPEAT
from strata.plans.stage import cut
from strata.sources import wire

NAME = "struct<local_name:string,namespace:string>"


def lines(documents: DataFrame) -> DataFrame:
    """doc, line, text: line numbers come from the file's text; a final line feed ends the last line."""
    return documents.select("doc", F.posexplode(F.split(F.regexp_replace("raw", r"\n\z", ""), "\n")).alias("line", "text"))


def violations(documents: DataFrame) -> DataFrame:
    """doc, path, message: sizes, blank lines, the header, and every opcode that isn't one of the shapes."""
    whole = documents.where(F.octet_length("raw") > wire.MAX_DOCUMENT_BYTES).select(F.col("doc").cast("string").alias("doc"), F.lit("").alias("path"), F.lit("too large").alias("message"))
    all_ = cut(lines(documents))
    at = F.concat(F.lit("line "), (F.col("line") + 1).cast("string"))
    header = F.coalesce(F.to_json(F.expr("try_parse_json(text)")), F.lit(""))
    message = (
        F.when(F.octet_length("text") > wire.MAX_LINE_BYTES, "too large")
        .when(F.col("text").rlike(r"\A\s*\z"), "is blank")
        .when(wire.depth(F.col("text")) > wire.MAX_JSON_DEPTH, "nesting too deep")
        .when(F.expr("try_parse_json(text)").isNull(), "not JSON")
        .when((F.col("line") == 0) & (header != f'{{"machine_version":"{wire.MACHINE_VERSION}"}}'), "isn't the header of this version")
    )
    bad = cut(all_.select(F.col("doc").cast("string").alias("doc"), at.alias("path"), message.alias("message"), "line").where("message IS NOT NULL"))
    good = all_.where("line > 0").withColumn("doc", F.col("doc").cast("string")).join(bad.select("doc", "line"), ["doc", "line"], "left_anti")
    shaped = wire.shape_errors(good.select("doc", at.alias("path"), F.lit("opcode").alias("shape"), F.to_json(F.parse_json("text")).alias("j")))
    return whole.unionByName(bad.drop("line")).unionByName(shaped)


def flattened(documents: DataFrame) -> DataFrame:
    """doc, seq, op, j of each primitive opcode, repeats written out; raises beyond the machine's limits before anything is made."""
    level = lines(documents).where("line > 0").select("doc", F.array(F.col("line").cast("int")).alias("place"), F.to_json(F.parse_json("text")).alias("j"), F.lit(1).cast("decimal(38,0)").alias("times"))
    # first how many there would be, each repeat multiplying its body, then the ops
    sizes, current = None, level
    while True:
        current = cut(current.withColumn("op", F.get_json_object("j", "$.opcode")).withColumn("count", F.get_json_object("j", "$.count").cast("bigint")))
        if not current.where(f"op = 'repeat' AND (count IS NULL OR count < 0 OR count > {MAX_REPEAT})").isEmpty():
            raise ValueError("repeat count out of range")
        here = current.where("op <> 'repeat'").select("doc", "times")
        sizes = here if sizes is None else sizes.unionByName(here)
        inside = current.where("op = 'repeat'")
        if inside.isEmpty():
            break
        current = inside.select("doc", F.least((F.col("times") * F.col("count")).cast("decimal(38,0)"), F.lit(MAX_OPCODES + 1).cast("decimal(38,0)")).alias("times"), F.explode(F.from_json(F.get_json_object("j", "$.body"), "array<string>")).alias("j")).withColumn("place", F.array().cast("array<int>"))
    if not sizes.groupBy("doc").agg(F.sum("times").alias("n")).where(f"n > {MAX_OPCODES}").isEmpty():
        raise ValueError("too many opcodes")
    out, current = None, level.drop("times")
    while True:
        current = cut(current.withColumn("op", F.get_json_object("j", "$.opcode")))
        here = current.where("op <> 'repeat'")
        out = here if out is None else out.unionByName(here)
        inside = current.where("op = 'repeat' AND get_json_object(j, '$.count') > 0")
        if inside.isEmpty():
            break
        turns = inside.select("doc", "place", F.explode(F.sequence(F.lit(1), F.get_json_object("j", "$.count").cast("int"))).alias("turn"), F.from_json(F.get_json_object("j", "$.body"), "array<string>").alias("body"))
        current = turns.select("doc", "place", "turn", F.posexplode("body").alias("at", "j")).select("doc", F.concat("place", F.array("turn", "at")).alias("place"), "j")
    return out.select("doc", (F.row_number().over(Window.partitionBy("doc").orderBy("place")) - 1).alias("seq"), "op", "j")


def _name(path: str) -> Column:
    return F.from_json(F.get_json_object("j", path), NAME)


def _text(path: str) -> Column:
    return F.get_json_object("j", path)


def _array(parts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))


def _in_order(order: str, text: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("x")))), lambda r: r.x)


def _attached(ops: DataFrame) -> DataFrame:
    """doc, seq, domain, target (JSON), value (JSON) of every attached value."""
    rows = ops.where("op = 'attach_value'")
    return rows.select("doc", "seq", _text("$.domain").alias("domain"), _text("$.target").alias("target"), _text("$.value").alias("value"))


def _with_values(rows: DataFrame, values: DataFrame, keys: list[str], own: Column) -> DataFrame:
    """Adds ``attributes``, the JSON of a row's own values and of those attached to it, in order; ``own`` is a JSON array."""
    given = values.groupBy(*keys).agg(_in_order("seq", F.col("value")).alias("__more"))
    inside = F.expr("substring(__own, 2, length(__own) - 2)")
    joined = rows.withColumn("__own", F.coalesce(own, F.lit("[]"))).join(given, keys, "left")
    return joined.withColumn("attributes", F.concat(F.lit("["), F.concat_ws(",", F.when(inside != "", inside), F.when(F.size("__more") > 0, F.array_join("__more", ","))), F.lit("]"))).drop("__own", "__more")


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{name}":'), value)


def _object(*fields: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def _quoted(c: Column) -> Column:
    as_array = F.to_json(F.array(c))
    return F.when(c.isNull(), "null").otherwise(F.substring(as_array, F.lit(2), F.length(as_array) - 2))


def replay(ops: DataFrame) -> DataFrame:
    """doc, text: the compact canonical document that each program's ops (doc, seq, op, j) build. Ops are taken to be valid; ``refusals`` lists those that aren't."""
    ops = cut(ops)
    docs = ops.select("doc").distinct()
    values = cut(_attached(ops))
    target = lambda path: F.from_json(F.get_json_object("target", path), NAME)
    index = F.get_json_object("target", "$.index").cast("bigint")

    by_rank = lambda *keys: F.row_number().over(Window.partitionBy("doc", *keys).orderBy("seq")).cast("bigint") - 1
    tiers = ops.where("op = 'declare_tier'").select("doc", by_rank().alias("t"), _name("$.declaration.name").alias("tier"), _text("$.declaration").alias("declaration"))
    added = ops.where("op = 'add_item'").select("doc", "seq", _name("$.tier").alias("tier"), _text("$.item.durable_id").alias("given"), _text("$.item.attributes").alias("own"))
    added = added.withColumn("i", by_rank("tier"))
    sizes = added.groupBy("doc", "tier").agg(F.count(F.lit(1)).alias("n"))

    named = ops.where("op IN ('promote_item', 'promote_position')").select("doc", "seq", "op", _name("$.reference.tier").alias("tier"), _text("$.reference.index").cast("bigint").alias("i"), _text("$.durable_id").alias("id"))
    # a boundary inside a tier promotes the item to its right, by the tier's size at that step; an outer one nothing
    born = added.select("doc", "tier", "i", F.col("seq").alias("born"))
    inner = named.join(born, ["doc", "tier", "i"]).where("born < seq AND (op = 'promote_item' OR i > 0)")
    promoted = inner.groupBy("doc", "tier", "i").agg(F.min_by("id", "seq").alias("promoted"))
    items = added.join(promoted, ["doc", "tier", "i"], "left").withColumn("durable_id", F.coalesce("given", "promoted"))

    of_items = values.where("domain = 'item' AND get_json_object(target, '$.index') IS NOT NULL").select("doc", "seq", target("$.tier").alias("tier"), index.alias("i"), "value")
    by_id = values.where("domain = 'item' AND get_json_object(target, '$.durable_id') IS NOT NULL").select("doc", "seq", F.get_json_object("target", "$.durable_id").alias("durable_id"), "value")
    of_items = of_items.unionByName(by_id.join(items.select("doc", "tier", "i", "durable_id"), ["doc", "durable_id"]).drop("durable_id"))
    items = _with_values(items, of_items, ["doc", "tier", "i"], F.col("own"))
    item_text = _object(_field("attributes", F.col("attributes")), _field("durable_id", _quoted(F.col("durable_id"))))
    members = items.groupBy("doc", "tier").agg(_in_order("i", item_text).alias("items"))
    of_tiers = values.where("domain = 'tier'").select("doc", "seq", F.from_json("target", NAME).alias("tier"), "value")
    whole = _with_values(tiers.join(members, ["doc", "tier"], "left"), of_tiers, ["doc", "tier"], F.lit("[]"))
    tier_text = _object(_field("attributes", F.col("attributes")), _field("declaration", F.col("declaration")), _field("items", _array(F.coalesce("items", F.array().cast("array<string>")))))
    parts = {"tiers": whole.groupBy("doc").agg(_array(_in_order("t", tier_text)).alias("tiers"))}

    for op, part in (("declare_namespace", "namespaces"), ("declare_attribute", "attribute_declarations")):
        parts[part] = ops.where(F.col("op") == op).groupBy("doc").agg(_array(_in_order("seq", _text("$.declaration"))).alias(part))

    decl = ops.where("op = 'declare_relation'").select("doc", "seq", _name("$.declaration.name").alias("name"), _text("$.declaration").alias("declaration"), _text("$.declaration.attributes").alias("own"))
    of_decl = values.where("domain = 'relation_declaration'").select("doc", "seq", F.from_json("target", NAME).alias("name"), "value")
    decl = _with_values(decl, of_decl, ["doc", "name"], F.col("own"))
    parts["relation_declarations"] = decl.groupBy("doc").agg(_array(_in_order("seq", _replaced("declaration"))).alias("relation_declarations"))

    rel = ops.where("op = 'relate'").select("doc", "seq", _text("$.relation").alias("relation"), _text("$.relation.durable_id").alias("durable_id"), _text("$.relation.attributes").alias("own"), (_text("$.relation.sources").isNotNull()).alias("polyadic"))
    of_rel = values.where("domain = 'relation_instance'").select("doc", "seq", F.get_json_object("target", "$.durable_id").alias("durable_id"), "value")
    rel = _with_values(rel, of_rel, ["doc", "durable_id"], F.col("own"))
    relation_order = F.struct("polyadic", "seq")
    rel = rel.withColumn("at", relation_order)
    parts["relations"] = rel.groupBy("doc").agg(_array(_in_order("at", _replaced("relation"))).alias("relations"))

    of_document = values.where("domain = 'document'")
    parts["attributes"] = of_document.groupBy("doc").agg(_array(_in_order("seq", F.col("value"))).alias("attributes"))

    # positions: a structural reference, re-anchored where a later op promotes its boundary
    placed = values.where("domain = 'position'").withColumn("tier", target("$.tier")).withColumn("i", index)
    sparse = placed.groupBy("doc", "target", "tier", "i").agg(F.min("seq").alias("seq"), _in_order("seq", F.col("value")).alias("held"))
    moved = named.where("op = 'promote_position'").join(sizes, ["doc", "tier"], "left").groupBy("doc", "tier", "i").agg(F.max(F.col("i") >= F.coalesce("n", F.lit(0))).alias("outer"))
    anchored = sparse.join(moved, ["doc", "tier", "i"], "left").join(items.select("doc", "tier", "i", "durable_id"), ["doc", "tier", "i"], "left")
    name_text = lambda c: F.to_json(c)
    tier_anchor = lambda side: _object(_field("anchor", _object(_field("kind", F.lit('"tier"')), _field("tier", name_text(F.col("tier"))))), _field("side", F.lit(f'"{side}"')))
    item_anchor = _object(_field("anchor", _object(_field("durable_id", _quoted(F.col("durable_id"))), _field("kind", F.lit('"item"')))), _field("side", F.lit('"before"')))
    reference = F.when(F.col("outer").isNull(), F.to_json(F.parse_json("target"))).when(F.col("i") == 0, tier_anchor("before")).when(F.col("outer"), tier_anchor("after")).otherwise(item_anchor)
    position_text = _object(_field("attributes", _array(F.col("held"))), _field("reference", reference))
    parts["position_values"] = anchored.groupBy("doc").agg(_array(_in_order("seq", position_text)).alias("position_values"))

    out = docs
    for part in parts.values():
        out = out.join(part, "doc", "left")
    graph = _object(*(_field(k, F.coalesce(F.col(k), F.lit("[]"))) for k in sorted(parts)))
    text = _object(_field("format_version", F.lit(f'"{wire.FORMAT_VERSION}"')), _field("graph", graph))
    return out.select("doc", F.to_json(F.parse_json(text)).alias("text"))


def _replaced(column: str) -> Column:
    """The JSON object in ``column`` with the row's ``attributes`` in place of its own, fields in order."""
    fields = F.filter(F.json_object_keys(column), lambda k: k != "attributes")
    own = F.from_json(column, "map<string,string>")
    raw = F.transform(fields, lambda k: F.struct(k.alias("k"), F.element_at(own, k).alias("v")))
    text = F.transform(raw, lambda x: F.concat(F.lit('"'), x.k, F.lit('":'), F.when(x.v.isNull(), "null").when(x.v.rlike(r"\A(?:[\[{].*|true|false|-?[0-9]+)\z") & ~x.k.isin("durable_id", "kind", "left_endpoint", "right_endpoint"), x.v).otherwise(F.to_json(F.struct(x.v.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(x.v.alias("x")))) - 6))))
    return F.concat(F.lit('{"attributes":'), "attributes", F.when(F.size(text) > 0, ",").otherwise(""), F.array_join(text, ","), F.lit("}"))


def refusals(ops: DataFrame) -> DataFrame:
    """doc, seq, reason of the ops that the machine refuses: names declared twice or used before they are, items that aren't there, values attached twice."""
    ops = cut(ops)
    declared = ops.where("op LIKE 'declare%'").select("doc", "seq", "op", F.coalesce(_text("$.declaration.prefix"), F.to_json(_name("$.declaration.name"))).alias("key"), _text("$.declaration.domain").alias("domain"))
    twice = declared.withColumn("turn", F.row_number().over(Window.partitionBy("doc", "op", "key", "domain").orderBy("seq"))).where("turn > 1").select("doc", "seq", F.lit("declared twice").alias("reason"))
    uses = ops.select(
        "doc", "seq", F.when(F.col("op") == "add_item", "declare_tier").when(F.col("op") == "relate", "declare_relation").when(F.col("op") == "attach_value", "declare_attribute").when(F.col("op").startswith("promote"), "declare_tier").alias("op"),
        F.when(F.col("op") == "add_item", F.to_json(_name("$.tier"))).when(F.col("op") == "relate", F.to_json(_name("$.relation.declaration"))).when(F.col("op") == "attach_value", F.to_json(_name("$.value.name"))).when(F.col("op").startswith("promote"), F.to_json(_name("$.reference.tier"))).alias("key"),
    ).where("op IS NOT NULL")
    first = declared.groupBy("doc", "op", "key").agg(F.min("seq").alias("since"))
    unknown = uses.join(first, ["doc", "op", "key"], "left").where("since IS NULL OR since > seq").select("doc", "seq", F.lit("not declared").alias("reason"))
    added = ops.where("op = 'add_item'").select("doc", "seq", F.to_json(_name("$.tier")).alias("tier"))
    added = added.withColumn("i", F.row_number().over(Window.partitionBy("doc", "tier").orderBy("seq")).cast("bigint") - 1)
    named = ops.where("op IN ('promote_item', 'promote_position')").select("doc", "seq", "op", F.to_json(_name("$.reference.tier")).alias("tier"), _text("$.reference.index").cast("bigint").alias("i"))
    attached = _attached(ops).where("domain IN ('item', 'position') AND get_json_object(target, '$.index') IS NOT NULL")
    named = named.unionByName(attached.select("doc", "seq", F.when(F.col("domain") == "position", "promote_position").otherwise("promote_item").alias("op"), F.to_json(F.from_json(F.get_json_object("target", "$.tier"), NAME)).alias("tier"), F.get_json_object("target", "$.index").cast("bigint").alias("i")))
    # a boundary i is there once the tier has i items; an item i once it has i + 1
    need = named.withColumn("i", F.when(F.col("op") == "promote_position", F.col("i") - 1).otherwise(F.col("i")))
    missing = need.where("i >= 0 OR op = 'promote_item'").join(added.withColumnRenamed("seq", "born"), ["doc", "tier", "i"], "left").where("born IS NULL OR born > seq").select("doc", "seq", F.lit("no such place").alias("reason"))
    again = _attached(ops).withColumn("name", F.get_json_object("value", "$.name")).withColumn("target", F.coalesce(F.to_json(F.expr("try_parse_json(target)")), F.lit("")))
    again = again.withColumn("turn", F.row_number().over(Window.partitionBy("doc", "domain", "target", "name").orderBy("seq"))).where("turn > 1").select("doc", "seq", F.lit("attached twice").alias("reason"))
    return twice.unionByName(unknown).unionByName(missing).unionByName(again)


def parts(ops: DataFrame) -> wellformed.Parts:
    """What the ops build, each part born at its op: for ``wellformed.check``, which finds the first op after which the graph breaks a rule without building any prefix."""
    ops = cut(ops)
    born = F.col("seq").cast("bigint").alias("born")
    json = lambda path, kind: F.from_json(F.get_json_object("j", path), kind)
    declared = lambda op, kind: ops.where(F.col("op") == op).select("doc", born, F.col("seq").alias("ord"), json("$.declaration", kind).alias("x"))
    tier_rows = declared("declare_tier", f"struct<name:{NAME},long_name:string>")
    relation_rows = declared("declare_relation", wire._DECLARED.removeprefix("array<").removesuffix(">"))
    attribute_rows = declared("declare_attribute", f"struct<domain:string,name:{NAME},value_type:string>")
    added = ops.where("op = 'add_item'").select("doc", born, wire.name_text(_name("$.tier")).alias("tier"), json("$.item", f"struct<attributes:{wire._ATTRIBUTES},durable_id:string>").alias("x"))
    added = added.withColumn("i", F.row_number().over(Window.partitionBy("doc", "tier").orderBy("born")).cast("bigint") - 1)
    named = ops.where("op IN ('promote_item', 'promote_position')").select("doc", F.col("seq").alias("promoted"), "op", wire.name_text(_name("$.reference.tier")).alias("tier"), _text("$.reference.index").cast("bigint").alias("i"), _text("$.durable_id").alias("given"))
    inner = named.where("op = 'promote_item' OR i > 0").join(added.select("doc", "tier", "i", "born"), ["doc", "tier", "i"]).where("born < promoted")
    first = inner.groupBy("doc", "tier", "i").agg(F.min(F.struct("promoted", "given")).alias("p"))
    items = added.join(first, ["doc", "tier", "i"], "left").withColumn("id", F.coalesce("x.durable_id", "p.given")).withColumn("named", F.when(F.col("x.durable_id").isNotNull(), F.col("born")).otherwise(F.col("p.promoted")))
    items = cut(items)
    made = ops.where("op = 'relate'").select("doc", born, F.col("seq").alias("ord"), json("$.relation", wire._INSTANCES.removeprefix("array<").removesuffix(">")).alias("x"))
    instances = made.select("doc", "born", "ord", *wire.instance_columns(F.col("x")))
    at = lambda word, *c: F.concat_ws(" ", F.lit(word), *(x.cast("string") for x in c))

    values = _attached(ops).withColumn("born", F.col("seq").cast("bigint")).withColumn("v", F.from_json("value", wire._ATTRIBUTES.removeprefix("array<").removesuffix(">")))
    field = lambda path: F.get_json_object("target", path)
    target = F.from_json(field("$.tier"), NAME)
    values = values.withColumn("tier", wire.name_text(F.when(F.col("domain").isin("item", "position"), target))).withColumn("i", field("$.index").cast("bigint")).withColumn("id", field("$.durable_id"))
    who = items.where("id IS NOT NULL").select("doc", "id", at("item", F.col("tier"), F.col("i")).alias("item")).dropDuplicates(["doc", "id"])
    which = instances.where("id IS NOT NULL").select("doc", "id", at("relation instance", F.col("ord")).alias("instance")).dropDuplicates(["doc", "id"])
    values = values.join(who, ["doc", "id"], "left").join(which, ["doc", "id"], "left")
    of_name = wire.name_text(F.from_json("target", NAME))
    owner = (
        F.when(F.col("domain") == "document", "document").when(F.col("domain") == "tier", at("tier", of_name)).when(F.col("domain") == "relation_declaration", at("relation", of_name))
        .when(F.col("domain") == "relation_instance", F.coalesce("instance", at("relation instance", F.col("id")))).when(F.col("domain") == "position", at("position", F.col("tier"), F.col("i")))
        .otherwise(F.coalesce("item", at("item", F.col("tier"), F.col("i"))))
    )
    held = [values.select("doc", "born", "domain", owner.alias("owner"), "v")]
    held.append(items.select("doc", "born", F.lit("item").alias("domain"), at("item", F.col("tier"), F.col("i")).alias("owner"), F.explode("x.attributes").alias("v")))
    held.append(relation_rows.select("doc", "born", F.lit("relation_declaration").alias("domain"), at("relation", wire.name_text(F.col("x.name"))).alias("owner"), F.explode("x.attributes").alias("v")))
    held.append(made.select("doc", "born", F.lit("relation_instance").alias("domain"), at("relation instance", F.col("ord")).alias("owner"), F.explode("x.attributes").alias("v")))
    all_values = held[0]
    for more in held[1:]:
        all_values = all_values.unionByName(more)
    all_values = cut(all_values)
    nothing = F.lit(None).cast("string")
    boundary = F.struct(F.lit("position").alias("kind"), F.col("tier"), F.col("i"), nothing.alias("id"), nothing.alias("side"))
    positions = values.where("domain = 'position'").groupBy("doc", "tier", "i").agg(F.min("born").alias("born"))
    return wellformed.Parts(
        declared("declare_namespace", "struct<prefix:string,namespace:string>").select("doc", "born", "ord", "x.prefix", "x.namespace"),
        tier_rows.select("doc", "born", "ord", wire.name_text(F.col("x.name")).alias("tier")),
        items.select("doc", "born", "tier", "i", "id", F.col("named").cast("bigint").alias("named")),
        relation_rows.select("doc", "born", "ord", *wire.relation_columns(F.col("x"))),
        attribute_rows.select("doc", "born", "ord", wire.name_text(F.col("x.name")).alias("name"), "x.domain", "x.value_type"),
        instances,
        all_values.select("doc", "born", "domain", "owner", wire.name_text(F.col("v.name")).alias("name"), "v.value_type", "v.lexical"),
        positions.select("doc", "born", F.col("born").alias("ord"), boundary.alias("ref"), F.lit(True).alias("filled")),
        wire.declared_names(tier_rows.select("doc", "born", F.col("x.name").alias("x")), relation_rows, attribute_rows.select("doc", "born", F.col("x.name").alias("x"))),
    )


def graph_refusals(ops: DataFrame) -> DataFrame:
    """doc, seq, reason of the ops after which the graph breaks one of its rules."""
    return wellformed.check(parts(ops)).select("doc", F.col("born").alias("seq"), F.concat("rule", F.lit(": "), "subject").alias("reason"))


def first_refusal(ops: DataFrame) -> DataFrame:
    """doc, seq, reason of the op at which each refused program stops: the machine's own refusals before the graph's at one op."""
    ops = cut(ops)
    both = refusals(ops).select("doc", F.col("seq").cast("bigint").alias("seq"), F.lit(0).alias("level"), "reason").unionByName(graph_refusals(ops).select("doc", "seq", F.lit(1).alias("level"), "reason"))
    return both.groupBy("doc").agg(F.min(F.struct("seq", "level", "reason")).alias("x")).select("doc", "x.seq", "x.reason")


def fingerprint(texts: DataFrame) -> DataFrame:
    """doc, sha256 of the compact canonical document; equal programs are those with equal fingerprints."""
    return texts.select("doc", F.sha2("text", 256).alias("sha256"))


def not_as_built(documents: DataFrame, ops: DataFrame) -> DataFrame:
    """doc of the documents (doc, text) that their own ops don't build again."""
    again = fingerprint(replay(ops)).withColumnRenamed("sha256", "built")
    return fingerprint(documents).join(again, "doc", "left").where("built IS NULL OR built <> sha256").select("doc")


def steps(ops: DataFrame) -> DataFrame:
    """doc, seq, op, text: the document after each op. Every prefix is replayed, so this is for programs that a person steps through."""
    prefixes = ops.alias("a").join(ops.select(F.col("doc").alias("d"), F.col("seq").alias("step")).alias("b"), F.expr("doc = d AND seq <= step"))
    named = prefixes.select(F.to_json(F.struct("doc", "step")).alias("doc"), "seq", "op", "j")
    built = replay(named).select(F.from_json("doc", f"doc {dict(ops.dtypes)['doc']}, step int").alias("k"), "text")
    return built.select("k.doc", F.col("k.step").alias("seq"), "text").join(ops.select("doc", "seq", "op"), ["doc", "seq"]).select("doc", "seq", "op", "text")
