"""JSON values of any depth as nodes and occurrences, and back.

Each nesting level is one plan step over all documents. A node's path is the array of its positions from the root (an object's members stand in
key order), so pre-order is the order of the paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.plans.stage import cut

MAX_DEPTH = 256


def nodes(df: DataFrame, column: str) -> DataFrame:
    """doc, id, parent, key, kind, text of every node: ids count pre-order, ``text`` is a scalar's JSON. Raises on text that isn't JSON."""
    level = cut(df.select("doc", F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("key"), F.to_json(F.parse_json(column)).alias("json")))
    found = level
    for depth in range(MAX_DEPTH + 1):
        level.createOrReplaceTempView("__strata_level")
        inner = df.sparkSession.sql("SELECT doc, concat(path, array(v.pos)) AS path, v.key AS key, to_json(v.value) AS json FROM (SELECT * FROM __strata_level WHERE json LIKE '{%' OR json LIKE '[%') l, LATERAL variant_explode(parse_json(l.json)) v")
        level = cut(inner)
        df.sparkSession.catalog.dropTempView("__strata_level")
        if level.isEmpty():
            break
        if depth == MAX_DEPTH:
            raise ValueError("nesting too deep")
        found = found.unionByName(level)
    ids = found.withColumn("id", F.row_number().over(Window.partitionBy("doc").orderBy("path")) - 1)
    first = F.substring("json", 1, 1)
    kind = (
        F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(F.col("json").isin("true", "false"), "boolean").when(F.col("json") == "null", "null")
        .when(F.col("json").rlike(r"\A-?[0-9]+\z"), "integer").otherwise("double")
    )
    parents = ids.select("doc", F.col("path").alias("above"), F.col("id").alias("parent"))
    joined = ids.withColumn("above", F.when(F.size("path") > 0, F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))))).join(parents, ["doc", "above"], "left")
    return joined.select("doc", "id", "parent", "key", kind.alias("kind"), F.when(~kind.isin("object", "array"), F.col("json")).alias("text"))


def text(tree: DataFrame) -> DataFrame:
    """doc, json: each document's root again, compact, object keys sorted; containers are closed from the deepest level up."""
    rows = cut(tree.select("doc", "id", "parent", "key", "kind", "text"))
    while True:
        open_ = rows.where("text IS NULL")
        if open_.isEmpty():
            return rows.where("parent IS NULL").select("doc", F.col("text").alias("json"))
        blocked = open_.where("parent IS NOT NULL").select("doc", F.col("parent").alias("id")).distinct()
        ready = open_.join(blocked, ["doc", "id"], "left_anti")
        quoted = F.to_json(F.array("key"))
        part = F.concat(F.when(F.col("key").isNotNull(), F.concat(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit(":"))).otherwise(""), "text")
        below = rows.where("parent IS NOT NULL").select("doc", F.col("parent").alias("id"), F.struct("id", part.alias("part")).alias("p"))
        gathered = below.join(ready.select("doc", "id"), ["doc", "id"], "left_semi").groupBy("doc", "id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
        inside = F.coalesce(F.array_join(F.transform("ps", lambda x: x.part), ","), F.lit(""))
        closed = F.when(F.col("kind") == "object", F.concat(F.lit("{"), inside, F.lit("}"))).otherwise(F.concat(F.lit("["), inside, F.lit("]")))
        done = ready.join(gathered, ["doc", "id"], "left").select("doc", "id", "parent", "key", "kind", closed.alias("text"))
        rows = cut(rows.join(done.select("doc", "id"), ["doc", "id"], "left_anti").unionByName(done))
