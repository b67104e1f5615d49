"""Personal data: pattern spans, and terms that disclose a protected value by corpus co-occurrence.

Only DataFrame and SQL functions are used.

* *Protected values* are the e-mail addresses, IPv4 addresses, payment cards and telephone numbers that the patterns find.
* Around each mention lies a context of ``CONTEXT`` characters. A term (a word of four letters or more in it, lower-cased)
  co-occurs with the value there. With counts of rows over the whole corpus,
  ``PMI(value; term) = log2(n(value, term) * N / (df(value) * (df(term) + PRIOR)))`` says how many bits of the value's information
  content ``IC(value) = log2(N / df(value))`` the term gives away. ``PRIOR`` is the rule of confidence: a term is taken to occur in one more
  document, without the value, so that a term seen once gives away one bit less than all. There is no other floor: values of one mention are judged
  too. All counts are of rows, so copies weigh alike in each of them.
* A term that gives away at least ``GENERALISE`` of the content is generalised to the class of words with its first ``CLASS`` letters, if that class
  stays below the threshold, and otherwise removed; from ``REMOVE`` on it is removed. This is done wherever the term stands in a document with the value.

Terms of fewer than four letters, and terms that never come within ``CONTEXT`` characters of a value, aren't measured. Rows are told apart by doc_id and a hash
of the text.

Defined results: null text is empty; an empty table gives an empty result; rows with a null doc_id, and rows that share one, are treated each by its own text;
equal rows (ties) are counted each and have equal results; very long texts are read whole, positions being summed in blocks of ``BLOCK`` matches; extra
columns are ignored by ``detect`` and kept by ``sanitise``. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm._stage import bit_table, cut, row_key, salted

CONTEXT, PRIOR, GENERALISE, REMOVE, CLASS, PART, BLOCK = 60, 1, 0.7, 0.9, 3, 16, 256
KINDS = ("email", "ip", "card", "phone")
TERM = r"(?<=\P{L})\p{L}{4,}+(?=\P{L})"
#: The contract's patterns, made linear: possessive repeats, and starts inside a run excluded where an earlier start would match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a match of the kind must hold; plain scans, so that most texts never reach the patterns.
HINTS = {"email": "contains({t}, '@')", "ip": "{t} rlike r'[0-9][.][0-9]'", "card": "{t} rlike r'[0-9](?:[ -]?[0-9]){{15}}'", "phone": "contains({t}, '+')"}
DIGITS = "regexp_replace(m, '[^0-9]', '')"
VALID = {
    "email": "true",
    "ip": "forall(split(m, '[.]'), p -> length(ltrim('0', p)) <= 3 and int(concat('0', right(ltrim('0', p), 3))) <= 255)",
    "card": f"""aggregate(sequence(1, length({DIGITS})), 0, (a, i) -> a + CASE WHEN pmod(length({DIGITS}) - i, 2) = 0
        THEN int(substring({DIGITS}, i, 1)) ELSE element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), int(substring({DIGITS}, i, 1)) + 1) END) % 10 = 0""",
    "phone": f"length({DIGITS}) BETWEEN 8 AND 15",
}


def _raw(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\'") + "'"


def _matches(text: str, pattern: str) -> str:
    """SQL: array of (m, s, e) of the leftmost non-overlapping matches of a pattern, by the lengths of what stands between.

    Lengths are summed within blocks of matches and then over the blocks, so that arrays never grow beyond a block one by one.
    """
    found, gaps = f"regexp_extract_all({text}, {_raw(pattern)}, 0)", f"split({text}, {_raw(pattern)}, -1)"
    none = "cast(array() AS array<struct<m: string, s: int, e: int>>)"
    pairs = f"zip_with({found}, slice({gaps}, 1, size({found})), (m, g) -> named_struct('m', m, 'g', length(g), 'n', length(m)))"
    block = f"""aggregate(b, named_struct('at', 0, 'out', {none}),
        (a, x) -> named_struct('at', a.at + x.g + x.n, 'out', concat(a.out, array(named_struct('m', x.m, 's', a.at + x.g, 'e', a.at + x.g + x.n)))))"""
    summed = f"transform(sequence(0, (size(z) - 1) div {BLOCK}), k -> transform(array(slice(z, k * {BLOCK} + 1, {BLOCK})), b -> {block})[0])"
    starts = "aggregate(y, named_struct('at', 0, 'out', cast(array() AS array<int>)), (a, x) -> named_struct('at', a.at + x.at, 'out', concat(a.out, array(a.at))), a -> a.out)"
    placed = f"flatten(zip_with(y, {starts}, (x, o) -> transform(x.out, w -> named_struct('m', w.m, 's', w.s + o, 'e', w.e + o))))"
    return f"transform(array({pairs}), z -> CASE WHEN size(z) = 0 THEN {none} ELSE transform(array({summed}), y -> {placed})[0] END)[0]"


def base_spans(text: str, kind: str) -> Column:
    """array of (m, s, e): the valid spans of one kind in the text column."""
    none = "cast(array() AS array<struct<m: string, s: int, e: int>>)"
    valid = VALID[kind].replace("(m,", "(x.m,").replace("split(m", "split(x.m")
    return F.expr(f"CASE WHEN {HINTS[kind].format(t=text)} THEN filter({_matches(text, PATTERNS[kind])}, x -> {valid}) ELSE {none} END")


def _with_base(docs: DataFrame) -> DataFrame:
    out = docs.withColumn("__t", F.coalesce("text", F.lit("")))
    return out.withColumns({f"__{k}": base_spans("__t", k) for k in KINDS})


def _each(kind: str, f) -> Column:
    return F.transform(f"__{kind}", lambda x: f(kind, x))


def _found(docs: DataFrame) -> DataFrame:
    """One pass over the texts: doc_id and the row's key, the number of spans of each kind, the joined base spans, and a row's mentions in their contexts.

    The result holds no text beyond the contexts, and is computed once; __row numbers its rows.
    """
    based = _with_base(docs.select("doc_id", "text"))
    text = lambda k, c: F.transform(c, lambda x: F.concat_ws(":", F.lit(k), x.s, x.e))
    fragment = lambda k, x: F.struct(
        F.concat(F.lit(f"{k}:"), F.lower(x.m)).alias("value"),
        x.s.alias("vs"),
        x.e.alias("ve"),
        F.greatest(F.lit(0), x.s - CONTEXT).alias("c0"),
        F.substring(F.concat(F.lit(" "), F.col("__t"), F.lit(" ")), F.greatest(F.lit(0), x.s - CONTEXT) + 1, F.least(F.length("__t"), x.e + CONTEXT) - F.greatest(F.lit(0), x.s - CONTEXT) + 2).alias("frag"),
    )
    return cut(
        based.select(
            "doc_id",
            *row_key(),
            F.monotonically_increasing_id().alias("__row"),
            *(F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS),
            F.concat_ws(",", F.concat(*(text(k, f"__{k}") for k in KINDS))).alias("base"),
            F.concat(*(_each(k, fragment) for k in KINDS)).alias("mentions"),
        )
    )


def _mentions(found: DataFrame) -> DataFrame:
    """A row for each term in the context of each protected value: __row, __id, __key, value, term."""
    key = ["__row", "__id", "__key"]
    one = found.where(F.size("mentions") > 0).select(*key, F.inline("mentions"))
    words = one.select(*key, "value", "vs", "ve", "c0", F.explode(F.expr(_matches("frag", TERM))).alias("w"))
    at = words.select(*key, "value", "vs", "ve", F.lower("w.m").alias("term"), (F.col("c0") - 1 + F.col("w.s")).alias("s"), (F.col("c0") - 1 + F.col("w.e")).alias("e"))
    return at.where("e <= vs OR s >= ve").drop("vs", "ve", "s", "e")


def _frequencies(docs: DataFrame, wanted: DataFrame, column: str = "term", length: int | None = None) -> DataFrame:
    """(term, df_term): in how many rows the wanted terms occur, or, with ``length``, words that begin with them; a few others may come along."""
    near = bit_table(wanted.select(column).distinct(), column)
    text = F.lower(F.concat(F.lit(" "), F.coalesce("text", F.lit("")), F.lit(" ")))
    words = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    terms = words if length is None else F.transform(words, lambda w: F.substring(w, 1, length))
    return docs.select(F.explode(F.array_distinct(F.filter(terms, near))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_term"))


def disclosing_terms(docs: DataFrame, found: DataFrame | None = None, prior: float = PRIOR, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(value, term, bits, content, action): the terms that disclose a protected value beyond the thresholds; ``action`` is remove or generalise."""
    found = _found(docs) if found is None else found
    mentions = _mentions(found)
    values = found.where(F.size("mentions") > 0).select("__row", F.explode(F.array_distinct(F.transform("mentions", lambda m: m.value))).alias("value"))
    per_value = values.groupBy("value").agg(F.count(F.lit(1)).alias("df_value"))
    pairs = mentions.groupBy("value", "term").agg(F.count_distinct("__row").alias("n"))
    # rows that hold the term in any context are a lower bound of its frequency: a pair that fails by it fails anyway
    per_term = mentions.groupBy("term").agg(F.count_distinct("__row").alias("seen"))
    total = found.agg(F.count(F.lit(1)).alias("total"))
    pairs = salted(salted(pairs, per_value, ["value"]), per_term, ["term"]).crossJoin(F.broadcast(total))  # total is one row
    ic = F.log2(F.col("total").cast("double") / F.col("df_value"))
    gain = lambda df: F.log2(F.col("n").cast("double") * F.col("total") / (F.col("df_value").cast("double") * (F.col(df) + prior)))
    pairs = cut(pairs.where((ic > 0) & (gain("seen") >= generalise * ic)))
    # a part of the documents bounds the frequencies from below as well, and excludes common terms before all documents are counted
    part = _frequencies(docs.where(F.pmod(F.xxhash64("text"), F.lit(PART)) == 0), pairs).withColumnRenamed("df_term", "df_part")
    pairs = cut(pairs.join(part, "term", "left").where(gain("df_part").isNull() | (gain("df_part") >= generalise * ic)).drop("df_part"))
    scored = pairs.join(_frequencies(docs, pairs), "term").withColumns({"bits": gain("df_term"), "content": ic}).where("bits >= " + repr(generalise) + " * content")
    scored = cut(scored.withColumn("class", F.substring("term", 1, CLASS)))
    coarse = _frequencies(docs, scored, "class", CLASS).select(F.col("term").alias("class"), F.col("df_term").alias("df_class"))
    hidden = (F.col("bits") < remove * F.col("content")) & (gain("df_class") < generalise * F.col("content"))
    return scored.join(coarse, "class", "left").select("value", "term", "bits", "content", F.when(hidden, "generalise").otherwise("remove").alias("action"))


def term_spans(docs: DataFrame, found: DataFrame, **thresholds: float) -> DataFrame:
    """(__id, __key, __terms array<(s, e, action)>): where the disclosing terms of its values stand, for each document that has any."""
    terms = disclosing_terms(docs, found, **thresholds).select("value", "term", "action")
    rows = salted(_mentions(found).select("__id", "__key", "value", "term").distinct(), terms, ["value", "term"])
    # the stricter action where several values ask for one; at most as many terms as its contexts hold
    own = rows.groupBy("__id", "__key", "term").agg(F.max("action").alias("action")).groupBy("__id", "__key").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("__own"))
    own = cut(own)
    passes = bit_table(own, "__key")
    texts = docs.select(*row_key(), F.coalesce("text", F.lit("")).alias("__said")).where(passes(F.col("__key"))).dropDuplicates(["__id", "__key"])
    near = texts.join(own, ["__id", "__key"]).withColumn("__padded", F.concat(F.lit(" "), "__said", F.lit(" ")))
    all_ = F.expr(_matches("__padded", TERM))
    hit = F.filter(F.transform(all_, lambda x: F.struct((x.s - 1).alias("s"), (x.e - 1).alias("e"), F.element_at("__own", F.lower(x.m)).alias("action"))), lambda x: x.action.isNotNull())
    return near.select("__id", "__key", hit.alias("__terms"))


def detect(docs: DataFrame, **thresholds: float) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of ``docs``."""
    found = _found(docs)
    joined = F.concat_ws(",", F.transform("__terms", lambda x: F.concat_ws(":", F.lit("term"), x.s, x.e)))
    terms = term_spans(docs, found, **thresholds).select("__id", "__key", joined.alias("__extra"))
    return found.join(terms, ["__id", "__key"], "left").select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.col("__extra") != "", F.col("__extra"))).alias("spans")
    )


def sanitise(docs: DataFrame, **thresholds: float) -> DataFrame:
    """``docs`` with ``text`` rewritten: protected values become ``[KIND]``, generalised terms their first letters and ``*``, removed terms vanish."""
    based = _with_base(docs.select("*", *row_key()))
    none = F.expr("cast(array() AS array<struct<s:int,e:int,p:string>>)")
    values = F.concat(*(_each(k, lambda k, x: F.struct(x.s.alias("s"), x.e.alias("e"), F.lit(f"[{k.upper()}]").alias("p"))) for k in KINDS))
    plain = based.withColumn("__cuts", values).drop(*(f"__{k}" for k in KINDS))
    clean = plain.where(F.size("__cuts") == 0)
    terms = term_spans(docs, _found(docs), **thresholds)
    hit = plain.where(F.size("__cuts") > 0).join(terms, ["__id", "__key"], "left")
    extra = F.transform("__terms", lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), F.when(x.action == "remove", "").otherwise(F.concat(F.substring(F.col("__t"), x.s + 1, CLASS), F.lit("*"))).alias("p")))
    # in order, a value first where two begin together; of one that overlaps an earlier one the rest is cut out
    sorted_ = F.expr("array_sort(__all, (a, b) -> CASE WHEN a.s <> b.s THEN a.s - b.s WHEN left(a.p, 1) = '[' THEN -1 WHEN left(b.p, 1) = '[' THEN 1 ELSE b.e - a.e END)")
    apart = F.expr(f"""aggregate(__all, named_struct('at', 0, 'out', cast(array() AS array<struct<s:int,e:int,p:string>>)),
        (a, x) -> CASE WHEN x.s >= a.at THEN named_struct('at', x.e, 'out', concat(a.out, array(x))) WHEN x.e > a.at THEN named_struct('at', x.e, 'out', concat(a.out, array(named_struct('s', a.at, 'e', x.e, 'p', '')))) ELSE a END, a -> a.out)""")
    hit = hit.withColumn("__all", F.concat("__cuts", F.coalesce(extra, none))).withColumn("__all", sorted_).withColumn("__c", apart)
    # the text is cut into blocks of spans first, so that no block is searched from the text's start
    ends = f"transform(sequence(0, (size(__c) - 1) div {BLOCK}), k -> named_struct('k', k, 'a', CASE WHEN k = 0 THEN 0 ELSE __c[k * {BLOCK} - 1].e END, 'z', CASE WHEN (k + 1) * {BLOCK} >= size(__c) THEN length(__t) ELSE __c[(k + 1) * {BLOCK} - 1].e END))"
    blocks = F.expr(f"transform({ends}, x -> named_struct('a', x.a, 'said', substring(__t, x.a + 1, x.z - x.a), 'c', slice(__c, x.k * {BLOCK} + 1, {BLOCK})))")
    piece = "concat(substring(b.said, CASE WHEN i = 0 THEN 1 ELSE b.c[i - 1].e - b.a + 1 END, x.s - CASE WHEN i = 0 THEN b.a ELSE b.c[i - 1].e END), x.p)"
    rest = "substring(b.said, b.c[size(b.c) - 1].e - b.a + 1)"
    done = hit.withColumn("__b", blocks).withColumn("text", F.expr(f"array_join(transform(__b, b -> concat(array_join(transform(b.c, (x, i) -> {piece}), ''), {rest})), '')"))
    return clean.select(docs.columns).unionByName(done.select(docs.columns))
