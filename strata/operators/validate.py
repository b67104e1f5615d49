"""Constraints as violation queries: each gives (doc, rule, subject, detail), no rows where the promise holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.traverse import cyclic


def _rows(df: DataFrame, rule: str, subject: Column, detail: Column) -> DataFrame:
    return df.select("doc", F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def unique(df: DataFrame, columns: list[str], rule: str) -> DataFrame:
    """Names, prefixes, durable ids, owners: no two rows of a document share the columns."""
    many = df.where(" AND ".join(f"{c} IS NOT NULL" for c in columns)).groupBy("doc", *columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _rows(many, rule, F.concat_ws(":", *(F.col(c).cast("string") for c in columns)), F.col("n"))


def declared(used: DataFrame, declarations: DataFrame, column: str, rule: str) -> DataFrame:
    """Every used name is declared in its document."""
    return _rows(used.select("doc", column).distinct().join(declarations, ["doc", column], "left_anti"), rule, F.col(column), F.lit("undeclared"))


def in_range(edges: DataFrame, sizes: DataFrame, side: str, kind: str = "item") -> DataFrame:
    """Endpoints lie in their tier: items 0 to n - 1, boundaries 0 to n. ``sizes`` has doc, t, n."""
    at = edges.select("doc", F.col("ord"), F.col(f"{side}.t").alias("t"), F.col(f"{side}.i").alias("i")).join(sizes, ["doc", "t"], "left")
    top = F.coalesce("n", F.lit(0)) - (0 if kind == "boundary" else 1)
    return _rows(at.where((F.col("i") < 0) | (F.col("i") > top)), "endpoint range", F.col("ord"), F.col("i"))


def single_parent(edges: DataFrame) -> DataFrame:
    """A target has one parent; a repeated equal edge is one."""
    many = edges.groupBy("doc", "r").agg(F.count_distinct("l").alias("n")).where("n > 1")
    return _rows(many, "single parent", F.concat_ws(":", F.col("r.t").cast("string"), F.col("r.i").cast("string")), F.col("n"))


def single_parent_polyadic(rows: DataFrame) -> DataFrame:
    """A whole source sequence counts as one parent."""
    many = rows.select("doc", "sources", F.explode("targets").alias("r")).groupBy("doc", "r").agg(F.count_distinct("sources").alias("n")).where("n > 1")
    return _rows(many, "single parent", F.concat_ws(":", F.col("r.t").cast("string"), F.col("r.i").cast("string")), F.col("n"))


def unique_sources(rows: DataFrame) -> DataFrame:
    return _rows(rows.groupBy("doc", "sources").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord")).where("n > 1"), "unique sources", F.col("ord"), F.col("n"))


def distinct_targets(rows: DataFrame) -> DataFrame:
    bad = rows.where(F.size(F.array_distinct("targets")) < F.size("targets"))
    return _rows(bad, "distinct targets", F.col("ord"), F.size("targets") - F.size(F.array_distinct("targets")))


def arity(rows: DataFrame, side: str, low: int, high: int | None, allow_empty: bool) -> DataFrame:
    """Bounds hold for sides that aren't empty; whether a side may be empty is its own promise."""
    n = F.size(side)
    bad = ((n == 0) & F.lit(not allow_empty)) | ((n > 0) & ((n < low) | (F.lit(False) if high is None else n > high)))
    return _rows(rows.where(bad), "arity", F.col("ord"), n)


def subset(rows: DataFrame, base: DataFrame) -> DataFrame:
    """Targets are among those of all base instances with the same sources."""
    own = rows.select("doc", "ord", "sources", F.explode("targets").alias("r"))
    allowed = base.select("doc", "sources", F.explode("targets").alias("r"))
    return _rows(own.join(allowed, ["doc", "sources", "r"], "left_anti"), "targets subset", F.col("ord"), F.concat_ws(":", F.col("r.t").cast("string"), F.col("r.i").cast("string")))


def acyclic(edges: DataFrame) -> DataFrame:
    """The edges that lie on or below a cycle."""
    return _rows(cyclic(edges), "acyclic", F.concat_ws(":", F.col("l.t").cast("string"), F.col("l.i").cast("string")), F.concat_ws(":", F.col("r.t").cast("string"), F.col("r.i").cast("string")))


def lexical(values: DataFrame, canonical: Column) -> DataFrame:
    """Stored text is valid and canonical. ``values`` has doc, subject, lexical."""
    return _rows(values.where(canonical.isNull() | (canonical != F.col("lexical"))), "lexical", F.col("subject"), F.coalesce(canonical, F.lit("invalid")))


def strict(violations: DataFrame) -> None:
    """Raises on the first violation by rule, document and subject."""
    first = violations.orderBy("rule", "doc", "subject", "detail").limit(1).collect()
    if first:
        raise ValueError(f"{first[0].rule}: document {first[0].doc}, {first[0].subject} ({first[0].detail})")
