"""What makes a graph well formed, as violations of finished documents and of edit logs alike.

Every part of a document has ``born``: the place in the log of the edit that made it, or 0 where a document is read whole. Parts are never taken
away, so a part holds from ``born`` on; what a boundary reference stands for can change as tiers grow, so resolved endpoints hold over ``[since, until)``.
A rule finds for each offence the least place at which it is one: a use of something is an offence at the use unless the thing was born by then; two parts that can't both be
are an offence at the later one. Each rule is a join or a window over all documents; no prefix of a log is replayed, and the first refusal
of a log is the least place over all rules. Every table here grows with the documents, and Spark takes one that was cut for as small as its compressed files, so
joins here are always dealt by their keys (``dealt``), never broadcast through the driver.

A document's parts (``Parts``), names written ``{namespace}local``:

=============  ===============================================================================================
namespaces     doc, born, ord, prefix, namespace
tiers          doc, born, ord, tier
items          doc, born, tier, i, id, named (the place from which ``id`` holds; both null without one)
relations      doc, born, ord, name, kind, tier, item_type, left_type, right_type, left_kind, right_kind, single_parent, acyclic,
               sources, targets (``SIDE``), unique_sources, distinct_targets, subset_of
attributes     doc, born, ord, name, domain, value_type
instances      doc, born, ord, many, relation, left, right (``REF``), sources, targets (arrays of ``REF``), id
values         doc, born, domain, owner (what carries it, as text), name, value_type, lexical
positions      doc, born, ord, ref (``REF``), filled
names          doc, born, subject, name, namespace: every qualified name that declares or types something
=============  ===============================================================================================
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.lexical import canonical
from strata.operators.cycles import closing
from strata.plans.stage import cut, dealt

#: kind: item, boundary or position; an item or position has tier and i, or an id; a boundary an anchor (id or tier) and a side.
REF = "struct<kind:string,tier:string,i:bigint,id:string,side:string>"
SIDE = "struct<allow_empty:boolean,kinds:array<string>,maximum:bigint,minimum:bigint,tiers:array<string>>"
ALWAYS = (1 << 63) - 1
KINDS = ("boolean", "integer", "decimal", "double")  # every text is a string


@dataclass(frozen=True)
class Parts:
    namespaces: DataFrame
    tiers: DataFrame
    items: DataFrame
    relations: DataFrame
    attributes: DataFrame
    instances: DataFrame
    values: DataFrame
    positions: DataFrame
    names: DataFrame


def _bad(rows: DataFrame, rule: str, subject: Column, detail: Column | str, born: Column | None = None) -> DataFrame:
    text = F.lit(detail) if isinstance(detail, str) else detail
    return rows.select("doc", (F.col("born") if born is None else born).cast("bigint").alias("born"), F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), text.cast("string").alias("detail"))


def _all_bad(rows: DataFrame, subject: Column, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """One pass for several rules: (rule, whether it is broken, detail)."""
    found = F.array_compact(F.array(*(F.when(broken, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))) for rule, broken, detail in rules)))
    return rows.select("doc", F.col("born").cast("bigint").alias("born"), subject.cast("string").alias("subject"), F.explode(found).alias("x")).select("doc", "born", "x.rule", "subject", "x.detail")


def _again(rows: DataFrame, keys: list[str], order: list[str], rule: str, subject: Column, detail: str) -> DataFrame:
    """All but the first of the rows that share ``keys``."""
    later = rows.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).withColumn("__turn", F.row_number().over(Window.partitionBy("doc", *keys).orderBy(*order)))
    return _bad(later.where("__turn > 1"), rule, subject, detail)


def _without(uses: DataFrame, known: DataFrame, on: list[str], rule: str, subject: Column, detail: Column | str) -> DataFrame:
    """Uses of what isn't there by then. ``known`` has doc, ``on`` and since, the least place from which it is."""
    first = known.groupBy("doc", *on).agg(F.min("since").alias("since"))
    return _bad(uses.join(dealt(first), ["doc", *on], "left").where("since IS NULL OR since > born"), rule, subject, detail)


def _at(ord_: str = "ord", what: str = "relation instance") -> Column:
    return F.concat(F.lit(f"{what} "), F.col(ord_).cast("string"))


def duplicates(p: Parts) -> list[DataFrame]:
    """O1, O2: prefixes, URIs, and names of tiers, relations, attributes, and of the values on one owner."""
    order = ["born", "ord"]
    return [
        _again(p.namespaces, ["prefix"], order, "unique prefix", F.col("prefix"), "declared twice"),
        _again(p.namespaces, ["namespace"], order, "unique namespace", F.col("namespace"), "declared twice"),
        _again(p.tiers, ["tier"], order, "unique tier", F.col("tier"), "declared twice"),
        _again(p.relations, ["name"], order, "unique relation", F.col("name"), "declared twice"),
        _again(p.attributes, ["name"], order, "unique attribute", F.col("name"), "declared twice"),
        _again(p.values, ["domain", "owner", "name"], ["born", "lexical"], "unique value", F.concat_ws(" ", "owner", "name"), "given twice"),
    ]


def declared(p: Parts) -> list[DataFrame]:
    """O3 to O6: namespaces, tiers of simple relations, attributes with their domain and type, relations of the right kind."""
    spaces = p.namespaces.select("doc", "namespace", F.col("born").alias("since"))
    tiers = p.tiers.select("doc", "tier", F.col("born").alias("since"))
    simple = p.relations.where("kind = 'simple'")
    known = p.attributes.select("doc", "name", F.col("domain").alias("own_domain"), F.col("value_type").alias("own_type"), F.col("born").alias("since"), F.row_number().over(Window.partitionBy("doc", "name").orderBy("born", "ord")).alias("n")).where("n = 1")
    used = p.values.join(dealt(known), ["doc", "name"], "left").withColumn("there", F.coalesce(F.col("since") <= F.col("born"), F.lit(False)))
    owner = F.concat_ws(" ", "owner", "name")
    kinds = p.relations.select("doc", F.col("name").alias("relation"), (F.col("kind") == "polyadic").alias("many"), F.col("born").alias("since")).where(F.col("kind") != "simple")
    wanted = F.concat(F.when(F.col("many"), "no polyadic relation ").otherwise("no bipartite relation "), "relation")
    return [
        _without(p.names, spaces, ["namespace"], "declared namespace", F.col("subject"), F.col("namespace")),
        _without(simple, tiers, ["tier"], "declared tier", F.col("name"), F.col("tier")),
        _again(simple, ["tier"], ["born", "ord"], "one type for a tier", F.col("tier"), "has another simple relation"),
        _all_bad(used, owner, [
            ("declared attribute", ~F.col("there"), F.lit("undeclared")),
            ("attribute domain", F.expr("there AND own_domain <> domain"), F.concat("own_domain", F.lit(", not "), "domain")),
            ("attribute type", F.expr("there AND own_domain = domain AND own_type <> value_type"), F.concat("own_type", F.lit(", not "), "value_type")),
        ]),
        _without(p.instances, kinds, ["relation", "many"], "declared relation", _at(), wanted),
    ]


def lexical(p: Parts) -> list[DataFrame]:
    """O14: a value's text is one of its type's."""
    out = []
    for kind in KINDS:  # a plan for each type: the forms are large expressions
        own = p.values.where(F.col("value_type") == kind)
        out.append(_bad(own.where(canonical(kind, F.col("lexical")).isNull()), "lexical form", F.concat_ws(" ", "owner", "name"), F.concat(F.lit(f"no {kind}: "), "lexical")))
    return out


def sides(p: Parts) -> list[DataFrame]:
    """What a polyadic relation says of its sides must make sense by itself."""
    rules = []
    for side in ("sources", "targets"):
        s = F.col(side)
        detail = (
            F.when(F.size(s.kinds) == 0, "no endpoint kind")
            .when(F.size(F.array_distinct(s.kinds)) < F.size(s.kinds), "an endpoint kind twice")
            .when(F.size(F.array_distinct(s.tiers)) < F.size(s.tiers), "a tier twice")
            .when((s.minimum < 0) | (s.maximum < -1), "a negative bound")
            .when((s.maximum >= 0) & (s.maximum < s.minimum), "maximum below minimum")
        )
        rules.append(("relation side", detail.isNotNull(), F.concat(F.lit(f"{side}: "), detail)))
    return [_all_bad(p.relations.where("kind = 'polyadic'"), F.col("name"), rules)]


def _endpoints(p: Parts) -> DataFrame:
    """doc, born, ord, many, relation, side, at, n, ref: every endpoint of every instance."""
    one = p.instances.where("NOT many").select("doc", "born", "ord", "many", "relation", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(c).alias("ref")) for s, c in (("sources", "left"), ("targets", "right"))))).alias("x"))
    one = one.select("doc", "born", "ord", "many", "relation", "x.side", F.lit(0).alias("at"), F.lit(1).alias("n"), "x.ref")
    for side in ("sources", "targets"):
        one = one.unionByName(p.instances.where("many").select("doc", "born", "ord", "many", "relation", F.lit(side).alias("side"), F.size(side).alias("n"), F.posexplode(side).alias("at", "ref")))
    return one


def places(refs: DataFrame, p: Parts) -> DataFrame:
    """``refs`` (doc, born, ref and others) with tier, i and since, until: the coordinates that a reference has, and while it has them; tier is null where it has none by ``born``.

    An item's coordinate is its own. Before or after an item is the item's place or the next; before a tier is 0, and after a tier moves with every item added.
    """
    named = p.items.where("id IS NOT NULL").select("doc", F.col("id").alias("__id"), F.col("tier").alias("__t"), F.col("i").alias("__i"), "named")
    first = named.withColumn("n", F.row_number().over(Window.partitionBy("doc", "__id").orderBy("named", "__t", "__i"))).where("n = 1").drop("n")
    tiers = p.tiers.groupBy("doc", F.col("tier").alias("__tier")).agg(F.min("born").alias("__there"))
    keyed = refs.withColumn("__id", F.col("ref.id")).withColumn("__tier", F.col("ref.tier"))
    joined = keyed.join(dealt(first), ["doc", "__id"], "left").join(dealt(tiers), ["doc", "__tier"], "left")
    by_id = F.col("ref.id").isNotNull()
    there = F.when(by_id, F.col("named") <= F.col("born")).otherwise(F.col("__there") <= F.col("born"))
    after = F.when(F.col("ref.side") == "after", 1).otherwise(0)
    tier = F.when(there, F.when(by_id, F.col("__t")).otherwise(F.col("ref.tier")))
    moving = (F.col("ref.kind") == "boundary") & ~by_id & (F.col("ref.side") == "after")
    i = F.when(by_id, F.col("__i") + after).when(F.col("ref.kind") == "boundary", F.lit(0)).otherwise(F.col("ref.i"))
    fixed = joined.where(~F.coalesce(moving, F.lit(False))).select(*refs.columns, tier.alias("tier"), i.cast("bigint").alias("i"), F.col("born").alias("since"), F.lit(ALWAYS).alias("until"))
    # after a tier: one row for each size that the tier has from then on
    grown = p.items.select("doc", F.col("tier").alias("__tier"), (F.col("i") + 1).alias("size"), F.col("born").alias("from"))
    grown = grown.unionByName(tiers.select("doc", "__tier", F.lit(0).cast("bigint").alias("size"), F.col("__there").alias("from")))
    # items that are born together (a document read whole) make one size
    grown = grown.groupBy("doc", "__tier", "from").agg(F.max("size").alias("size"))
    grown = grown.withColumn("to", F.coalesce(F.lead("from").over(Window.partitionBy("doc", "__tier").orderBy("from")), F.lit(ALWAYS)))
    ends = joined.where(moving & F.coalesce(there, F.lit(False))).join(dealt(grown), ["doc", "__tier"]).where(F.col("to") > F.col("born"))
    ends = ends.select(*refs.columns, tier.alias("tier"), F.col("size").cast("bigint").alias("i"), F.greatest("from", "born").alias("since"), F.col("to").alias("until"))
    lost = joined.where(moving & ~F.coalesce(there, F.lit(False))).select(*refs.columns, F.lit(None).cast("string").alias("tier"), F.lit(None).cast("bigint").alias("i"), F.col("born").alias("since"), F.lit(ALWAYS).alias("until"))
    return fixed.unionByName(ends).unionByName(lost)


def _sizes(rows: DataFrame, p: Parts) -> DataFrame:
    """Adds size: the items of the row's tier by ``born``, for rows with a tier; by one window over uses and births together, so nothing is counted pair by pair."""
    keep = rows.columns
    births = p.items.select("doc", "tier", F.col("born").alias("__place"), F.lit(1).alias("__add"))
    uses = rows.withColumn("__row", F.monotonically_increasing_id()).withColumn("__place", F.col("born")).withColumn("__add", F.lit(0))
    both = uses.unionByName(births, allowMissingColumns=True)
    running = Window.partitionBy("doc", "tier").orderBy("__place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("size", F.sum("__add").over(running)).where("__row IS NOT NULL").select(*keep, "size")


def endpoints(p: Parts, held: DataFrame) -> list[DataFrame]:
    """O7, O8: kinds, places, types and tiers of endpoints, and how many a side has. ``held``: the endpoints with their first places."""
    rel = p.relations.withColumn("n", F.row_number().over(Window.partitionBy("doc", "name").orderBy("born", "ord"))).where("n = 1")
    rel = rel.select("doc", F.col("name").alias("relation"), "left_type", "right_type", "left_kind", "right_kind", F.col("sources").alias("__s"), F.col("targets").alias("__t"), (F.col("kind") == "polyadic").alias("many"), F.col("kind").alias("__kind")).where("__kind <> 'simple'").drop("__kind")
    own = held.join(dealt(rel), ["doc", "relation", "many"])
    first = F.col("side") == "sources"
    is_kind = F.when(F.col("ref.kind") == "item", "item").otherwise("boundary")
    subject = F.concat(_at(), F.when(F.col("many"), F.concat(F.lit(" "), F.rtrim(F.regexp_replace("side", "s\\z", "")), F.lit(" endpoint "), F.col("at").cast("string"))).otherwise(F.when(first, " left endpoint").otherwise(" right endpoint")))
    side = F.when(first, F.col("__s")).otherwise(F.col("__t"))
    wrong_kind = F.when(F.col("many"), ~F.array_contains(side.kinds, is_kind)).otherwise(F.when(first, F.col("left_kind")).otherwise(F.col("right_kind")) != is_kind)
    sized = _sizes(own.withColumn("wrong", wrong_kind).withColumn("allowed", side.tiers).withColumn("expected", F.when(first, F.col("left_type")).otherwise(F.col("right_type"))).drop("__s", "__t"), p)
    outside = F.col("tier").isNull() | ((F.col("ref.kind") == "item") & F.col("ref.id").isNull() & ((F.col("i") < 0) | (F.col("i") >= F.col("size"))))
    types = p.relations.where("kind = 'simple'").groupBy("doc", "tier").agg(F.min(F.struct("born", "ord", "item_type")).alias("x")).select("doc", "tier", F.col("x.born").alias("typed"), F.col("x.item_type").alias("item_type"))
    typed = sized.join(dealt(types), ["doc", "tier"], "left")
    where_ = F.concat(F.coalesce("ref.tier", "ref.id"), F.coalesce(F.concat(F.lit(" "), F.col("ref.i").cast("string")), F.lit("")))
    single, late = ~outside & ~F.col("many"), F.coalesce(F.col("typed") > F.col("born"), F.lit(True))
    out = [
        _all_bad(typed, subject, [
            ("endpoint kind", F.col("wrong"), is_kind),
            ("endpoint range", outside, where_),
            ("typed tier", single & late, F.col("tier")),
            ("endpoint type", single & ~late & (F.col("item_type") != F.col("expected")), F.col("item_type")),
            ("endpoint tier", ~outside & F.col("many") & (F.size("allowed") > 0) & ~F.array_contains("allowed", F.col("tier")), F.col("tier")),
        ])
    ]
    many = p.instances.where("many").withColumn("many", F.lit(True)).join(dealt(rel), ["doc", "relation", "many"])
    rules = []
    for name, declared_side in (("sources", "__s"), ("targets", "__t")):
        s, n = F.col(declared_side), F.size(name)
        rules.append(("arity", F.when(n == 0, ~s.allow_empty).otherwise((n < s.minimum) | ((s.maximum >= 0) & (n > s.maximum))), F.concat(F.lit(f"{name}: "), n.cast("string"))))
    return [*out, _all_bad(many, _at(), rules)]


def positions(p: Parts) -> list[DataFrame]:
    """O9: values stand at boundaries that are there, at one place once, and are never none."""
    at = _sizes(places(p.positions, p), p)
    gone = F.col("tier").isNull() | ((F.col("ref.kind") == "position") & F.col("ref.id").isNull() & ((F.col("i") < 0) | (F.col("i") > F.col("size"))))
    there = at.where(~gone)
    pairs = _meeting(there, ["tier", "i"], ["ord"])
    return [
        _bad(p.positions.where("NOT filled"), "position values", _at(what="position"), "none"),
        _bad(at.where(gone), "position range", _at(what="position"), F.concat_ws(" ", F.coalesce("ref.tier", "ref.id"), F.col("ref.i").cast("string"))),
        _bad(pairs, "one position", _at(what="position"), F.concat_ws(" ", "tier", F.col("i").cast("string")), F.col("meet")),
    ]


def _meeting(rows: DataFrame, place: list[str], who: list[str]) -> DataFrame:
    """The rows that come to a place while another ``who`` is there, with meet, the least place in the log at which they do.

    Rows that stay for good (nearly all) are compared with the first of their place, by a window; those that move on meet by an interval join.
    """
    key, own = ["doc", *place], F.struct(*who)
    order = Window.partitionBy(*key).orderBy("since", *who)
    staying = rows.where(F.col("until") == ALWAYS)
    later = staying.withColumn("__first", F.first(own).over(order)).where(F.col("__first") != own).withColumn("meet", F.col("since")).drop("__first")
    moving = rows.where(F.col("until") < ALWAYS)
    other = rows.select(*key, F.col("since").alias("__since"), F.col("until").alias("__until"), own.alias("__who"))
    crossed = moving.join(dealt(other), key).where((F.col("__who") != own) & (F.col("since") < F.col("__until")) & (F.col("__since") < F.col("until"))).withColumn("meet", F.greatest("since", "__since"))
    return later.unionByName(crossed.select(*later.columns))


def identities(p: Parts) -> list[DataFrame]:
    """O10: a durable id names one item or instance of its document."""
    ids = p.items.where("id IS NOT NULL").select("doc", F.col("named").alias("born"), "id", F.lit(0).alias("part"), F.concat(F.lit("item "), "tier", F.lit(" "), F.col("i").cast("string")).alias("who"))
    ids = ids.unionByName(p.instances.where("id IS NOT NULL").select("doc", "born", "id", F.lit(1).alias("part"), _at().alias("who")))
    again = _again(ids, ["id"], ["born", "part", "who"], "unique id", F.col("id"), "names another part too")
    return [again, _bad(ids.where("id = ''"), "empty id", F.col("who"), "must not be empty")]


def promises(p: Parts, held: DataFrame) -> list[DataFrame]:
    """O11 to O13: parents, sources, targets, membership and cycles of what is declared so. ``held``: endpoints with their places."""
    rel = p.relations.groupBy("doc", F.col("name").alias("relation")).agg(F.min(F.struct("born", "ord", "single_parent", "acyclic", "unique_sources", "distinct_targets", "subset_of")).alias("d"))
    rel = rel.select("doc", "relation", "d.single_parent", "d.acyclic", "d.unique_sources", "d.distinct_targets", "d.subset_of")
    node = F.concat_ws(" ", F.when(F.col("ref.kind") == "item", "item").otherwise("boundary"), "tier", F.col("i").cast("string"))
    known = cut(held.where("tier IS NOT NULL").join(dealt(rel), ["doc", "relation"]).withColumn("node", node).drop("n", "ref", "tier", "i"))
    start = known.where(F.col("since") == F.col("born"))
    sources, targets = known.where("side = 'sources'"), known.where("side = 'targets'")
    # a whole source sequence is one parent
    parent = start.where("side = 'sources'").groupBy("doc", "ord", "many").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda x: x.node)).alias("parent"))
    child = targets.where("single_parent").join(dealt(parent), ["doc", "ord", "many"]).select("doc", "relation", "node", "ord", "many", "since", "until", "parent", "born")
    second = _meeting(child, ["relation", "node"], ["parent"])
    repeated = sources.where("many AND unique_sources").select("doc", "relation", "node", "ord", "at", "since", "until", "born")
    again = _meeting(repeated, ["relation", "node"], ["ord", "at"])
    doubled = start.where("many AND distinct_targets AND side = 'targets'").groupBy("doc", "ord", "born", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    within = rel.where("subset_of IS NOT NULL").select("doc", "relation", "subset_of")
    bases = p.relations.where("kind = 'polyadic'").select("doc", F.col("name").alias("subset_of"), F.col("born").alias("since"))
    pair = lambda rows, *more: rows.where("side = 'sources'").select("doc", "relation", "ord", "born", F.col("node").alias("source"), *more)
    own_sources = pair(start.where("many")).join(dealt(within), ["doc", "relation"])
    own = own_sources.join(dealt(start.where("many AND side = 'targets'").select("doc", "ord", F.col("node").alias("target"))), ["doc", "ord"])
    base_sources = pair(start.where("many")).select("doc", F.col("relation").alias("subset_of"), "ord", "source", F.col("born").alias("since"))
    base = base_sources.join(dealt(start.where("many AND side = 'targets'").select("doc", "ord", F.col("node").alias("target"))), ["doc", "ord"])
    edges = start.where("acyclic").where("side = 'sources'").select("doc", "relation", "many", "ord", "born", F.col("node").alias("l")).join(dealt(start.where("acyclic AND side = 'targets'").select("doc", "many", "ord", F.col("node").alias("r"))), ["doc", "many", "ord"])
    closed = closing(edges.select("doc", "relation", F.struct("born", "ord").alias("at"), "l", "r"), ["doc", "relation"])
    return [
        _bad(second, "single parent", _at(), F.col("node"), F.col("meet")),
        _bad(again, "unique sources", _at(), F.col("node"), F.col("meet")),
        _bad(doubled, "distinct targets", _at(), F.col("node")),
        _without(p.relations.where("kind = 'polyadic' AND subset_of IS NOT NULL"), bases, ["subset_of"], "declared base", F.col("name"), F.col("subset_of")),
        _without(own_sources, base_sources, ["subset_of", "source"], "membership", _at(), F.col("source")),
        _without(own, base, ["subset_of", "source", "target"], "targets subset", _at(), F.col("target")),
        _bad(closed.withColumn("born", F.col("at.born")), "acyclic", F.concat(F.lit("relation instance "), F.col("at.ord").cast("string")), F.col("relation")),
    ]


def empty_names(p: Parts) -> list[DataFrame]:
    """O16: no prefix, namespace or name is empty."""
    n = p.namespaces.where("prefix = '' OR namespace = ''")
    return [_bad(n, "empty name", F.concat(F.lit("namespace "), F.col("ord").cast("string")), "must not be empty"), _bad(p.names.where("namespace = '' OR name = ''"), "empty name", F.col("subject"), "must not be empty")]


def check(p: Parts) -> DataFrame:
    """doc, born, rule, subject, detail of every violation.

    Some rules at a time are run and their violations kept: Spark plans a job anew after each of its stages, so one job of all rules costs the driver memory in the square of their number.
    """
    held = cut(places(_endpoints(p), p))
    first = held.where(F.col("since") == F.col("born"))
    some = [[*empty_names(p), *duplicates(p), *sides(p)], declared(p), lexical(p), endpoints(p, first), [*positions(p), *identities(p)], promises(p, held)]
    return reduce(DataFrame.unionByName, [cut(reduce(DataFrame.unionByName, rules)) for rules in some]).distinct()


def first_refusal(violations: DataFrame) -> DataFrame:
    """doc, born, rule, subject, detail: the least place of each document that breaks a rule; of several at one place the least by name."""
    return violations.groupBy("doc").agg(F.min(F.struct("born", "rule", "subject", "detail")).alias("x")).select("doc", "x.*")
