"""Bulk resolution of structural paths: a table of texts against a corpus, with a refusal code for each that doesn't resolve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.lexical import index, pointer_escape, pointer_segments
from strata.model import Corpus


def parsed(paths: DataFrame) -> DataFrame:
    """Adds form, tier, i, id, side and code. Forms: items or positions, structural (tier and index) or durable (id, or an anchor and side)."""
    p = F.col("__p")
    at = lambda k: F.get(p, F.lit(k))
    n = F.size(p)
    staged = paths.withColumn("__p", pointer_segments(F.col("path")))
    form = (
        F.when((at(0) == "items") & (at(1) == "structural") & (n == 4), "item")
        .when((at(0) == "items") & (at(1) == "durable") & (n == 3), "durable item")
        .when((at(0) == "positions") & (at(1) == "structural") & (n == 4), "position")
        .when((at(0) == "positions") & (at(1) == "durable") & (at(2) == "item") & (n == 5), "anchored item")
        .when((at(0) == "positions") & (at(1) == "durable") & (at(2) == "tier") & (n == 5), "anchored tier")
    )
    out = staged.withColumn("form", form)
    structural = F.col("form").isin("item", "position")
    out = out.withColumn("tier", F.when(structural, at(2)).when(F.col("form") == "anchored tier", at(3)))
    out = out.withColumn("i", F.when(structural, index(at(3)))).withColumn("id", F.when(F.col("form") == "durable item", at(2)).when(F.col("form") == "anchored item", at(3)))
    out = out.withColumn("side", F.when(F.col("form").startswith("anchored"), at(4)))
    code = (
        F.when(F.col("path").isNull() | p.isNull(), "malformed")
        .when(F.col("form").isNull(), "unknown form")
        .when(structural & F.col("i").isNull(), "bad index")
        .when(F.col("side").isNotNull() & ~F.col("side").isin("before", "after"), "bad side")
    )
    return out.withColumn("code", code).drop("__p")


def resolved(paths: DataFrame, corpus: Corpus) -> DataFrame:
    """path, doc, kind (item or position), t, i, code: ``paths`` has doc and path; NULL code where the path resolves."""
    at = parsed(paths)
    tiers = corpus.tier_rows().select("doc", "tier", "t", "n")
    ids = corpus.items().where("durable_id IS NOT NULL").select("doc", F.col("durable_id").alias("id"), F.col("node.t").alias("t2"), F.col("node.i").alias("i2"))
    joined = at.join(tiers, ["doc", "tier"], "left").join(ids, ["doc", "id"], "left")
    position = F.col("form").isin("position", "anchored item", "anchored tier")
    after = F.when(F.col("side") == "after", 1).otherwise(0)
    i = F.when(F.col("form").isin("item", "position"), F.col("i")).when(F.col("form") == "durable item", F.col("i2")).when(F.col("form") == "anchored item", F.col("i2") + after).otherwise(F.when(F.col("side") == "after", F.col("n")).otherwise(0))
    t = F.coalesce("t", "t2")
    top = F.col("n") - F.when(position, 0).otherwise(1)
    code = (
        F.col("code").isNotNull(),
        F.coalesce("code", F.when(F.col("tier").isNotNull() & F.col("t").isNull(), "unknown tier").when(F.col("id").isNotNull() & F.col("t2").isNull(), "unknown id").when(F.col("tier").isNotNull() & (i > top), "out of range")),
    )[1]
    out = joined.select("doc", "path", F.when(position, "position").otherwise("item").alias("kind"), t.alias("t"), i.cast("bigint").alias("i"), code.alias("code"))
    keep = lambda c: F.when(F.col("code").isNull(), F.col(c)).alias(c)
    return out.select("doc", "path", keep("kind"), keep("t"), keep("i"), "code")


def spelled(tier: Column, i: Column, kind: str = "items") -> Column:
    """The structural path of a coordinate."""
    return F.concat(F.lit(f"/{kind}/structural/"), pointer_escape(tier), F.lit("/"), i.cast("string"))
