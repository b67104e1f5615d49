"""Benchmark decontamination by winnowing, with DataFrame and SQL functions only.

Texts are lower-cased (A-Z) and cut into words. The fingerprint of a window of ``WINDOW`` words is the least hash of the
``GRAM``-word grams in it, so that equal windows have equal fingerprints: every shared span of ``WINDOW`` words or more is found.

1. Benchmark: each item's windows (an item with fewer words is one window), with fingerprints. A bit table of their hash buckets goes
   into the plan as a literal; it only thins out.
2. Documents: one pass makes each text's fingerprints. Neighbouring windows with the same least gram are one *stretch* and give one fingerprint;
   stretches in the bit table stay, with their words, and are joined with the benchmark's distinct fingerprints, which bring no item
   along (a fingerprint of many items multiplies nothing).
3. Extension: a hit grows to all windows around its gram, which are compared with the benchmark's windows by a 256-bit digest; equal
   windows give hit words, and the items by window, once per document and window.

Rows are told apart by doc_id and a hash of the text, and frequent fingerprints and passages are spread by a salt.

Defined results: null text has no words; rows with a null doc_id, and rows that share one, are judged each by its own text; equal rows (ties)
have equal results; very long texts are read whole, in time linear in their length; empty tables give no hits; an item with a
null item_id hits words like any other, but has no name to be listed or counted by; extra columns are
ignored by ``report`` and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm._stage import bit_table, cut, row_key, salted

WINDOW, GRAM, MIN_SHARE = 13, 5, 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
STRETCH = 16  # windows in a stretch at most


def words(column: str) -> Column:
    """The words of a text column; empty for null."""
    return F.filter(F.split(F.translate(F.coalesce(F.col(column), F.lit("")), UPPER, LOWER), GAP), lambda w: w != "")


def _hash(grams: str, size: int) -> str:
    """SQL: hashes of ``size`` consecutive elements, at each position of an array of word hashes."""
    return f"transform(slice({grams}, 1, greatest(0, size({grams}) - {size - 1})), (x, i) -> xxhash64(x{''.join(f', get({grams}, i + {k})' for k in range(1, size))}))"


def _fingerprints(h: str, window: int) -> Column:
    """At each window's start the least gram hash in it, from the array of word hashes."""
    if window <= GRAM:
        return F.expr(_hash(h, window))
    span = window - GRAM + 1
    rest = "".join(f", get(__g, i + {k})" for k in range(1, span))
    return F.expr(f"transform(slice(__g, 1, greatest(0, size(__g) - {span - 1})), (x, i) -> least(x{rest}))")


def _fingerprinted(df: DataFrame, window: int) -> DataFrame:
    """Adds __f, from __w: in steps, so that an element is computed once."""
    out = df.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    if window > GRAM:
        out = out.withColumn("__g", F.expr(_hash("__h", GRAM)))
    return out.withColumn("__f", _fingerprints("__h", window)).drop("__h", "__g")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, size, f, digest): each distinct window of each item, with its fingerprint."""
    base = benchmark.select("item_id", words("text").alias("__w")).withColumn("__n", F.least(F.size("__w"), F.lit(WINDOW))).where("__n > 0")
    parts = []
    for size in [r["__n"] for r in base.select("__n").distinct().collect()]:  # at most WINDOW sizes
        part = _fingerprinted(base.where(F.col("__n") == size), size)
        row = F.expr(f"transform(__f, (f, i) -> named_struct('f', f, 'digest', sha2(array_join(slice(__w, i + 1, {size}), ' '), 256)))")
        parts.append(part.select("item_id", F.lit(size).alias("size"), F.inline(row)))
    if not parts:
        return base.select("item_id", F.lit(0).alias("size"), F.lit(0).cast("long").alias("f"), F.lit("").alias("digest")).where("false")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def hits(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, __id, __key, n_words) of every row, and (__id, __key, start, size, digest) of every window of the benchmark in a document."""
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most WINDOW sizes
    prints = cut(windows.select("size", "f").distinct())
    out = docs.select("doc_id", *row_key(), words("text").alias("__w"))
    found = []
    for size in sizes:
        passes = bit_table(prints.where(F.col("size") == size), "f")
        out = _fingerprinted(out, size)
        begins = F.filter(F.transform("__f", lambda f, i: F.when((i % STRETCH != 0) & f.eqNullSafe(F.get("__f", i - 1)), -1).otherwise(i)), lambda i: i >= 0)
        out = out.withColumn("__b", begins)
        stretch = F.transform("__b", lambda i, k: F.struct(F.get("__f", i).alias("f"), i.alias("a"), F.coalesce(F.get("__b", k + 1), F.size("__f")).alias("z")))
        out = out.withColumn(f"__c{size}", F.filter(stretch, lambda x: passes(x.f))).drop("__f", "__b")
        found.append(F.expr(f"transform(__c{size}, x -> named_struct('size', {size}, 'f', x.f, 'start', x.a, 'n', x.z - x.a, 'said', slice(__w, x.a + 1, x.z - x.a + {size - 1})))"))
    none = F.expr("cast(array() AS array<struct<size:int,f:bigint,start:int,n:int,said:array<string>>>)")
    all_found = F.concat(none, *found) if found else none
    once = cut(out.select("doc_id", "__id", "__key", F.size("__w").cast("long").alias("n_words"), all_found.alias("__found")))
    near = once.where(F.size("__found") > 0).select("__id", "__key", F.inline("__found"))
    hit = salted(near, prints, ["size", "f"], "left_semi")
    around = hit.select("__id", "__key", "start", "size", "said", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    digest = F.sha2(F.array_join(F.slice("said", F.col("k") + 1, F.col("size")), " "), 256)
    each = around.select("__id", "__key", (F.col("start") + F.col("k")).alias("start"), "size", digest.alias("digest"))
    exact = windows.select("size", "digest").distinct()
    return once.select("doc_id", "__id", "__key", "n_words"), cut(salted(each, exact, ["size", "digest"], "left_semi").distinct())


def _judged(docs: DataFrame, benchmark: DataFrame, min_share: int) -> DataFrame:
    """The rows of ``report`` with their keys."""
    windows = cut(item_windows(benchmark))
    counted, found = hits(docs, windows)
    key = ["__id", "__key"]
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct((a.n + F.greatest(F.lit(0), x.end - F.greatest(a.to, x.start))).alias("n"), F.greatest(a.to, x.end).alias("to")),
        lambda a: a.n,
    )
    hit = found.groupBy(*key).agg(spans.alias("spans")).select(*key, covered.cast("long").alias("n_hit"))
    pairs = salted(found.select(*key, "size", "digest").distinct(), windows.select("size", "digest", "item_id").distinct(), ["size", "digest"]).select(*key, "item_id").distinct()
    items = pairs.groupBy(*key).agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    out = counted.join(hit.join(items, key), key, "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        *key,
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * min_share >= F.col("n_words"))).alias("contaminated"),
    )


def report(docs: DataFrame, benchmark: DataFrame, min_share: int = MIN_SHARE) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (a hit word in ``min_share`` words or fewer)."""
    return _judged(docs, benchmark, min_share).drop("__id", "__key")


def clean(docs: DataFrame, benchmark: DataFrame, min_share: int = MIN_SHARE) -> DataFrame:
    """The documents that are not contaminated, unchanged."""
    bad = _judged(docs, benchmark, min_share).where("contaminated").select("__id", "__key").distinct()
    return docs.select("*", *row_key()).join(bad, ["__id", "__key"], "left_anti").select(docs.columns)
