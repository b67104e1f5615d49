"""Renderings of tiers and span views: DOT lines, rulers and tables as text, and an HTML report; lines are rows with an ordinal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.lexical import dot_quote, html_escape
from strata.model import Corpus


def dot_lines(corpus: Corpus) -> DataFrame:
    """doc, place, line: a digraph with a row of boxes for each tier, the items chained, the binary relations' arrows, and an arc from each source
    to each target of the polyadic ones."""
    parts = []
    docs = corpus.tier_rows().select("doc").distinct()
    place = lambda *c: F.struct(*((F.lit(x) if isinstance(x, int) else x).cast("bigint") for x in c))
    name = lambda t, i: F.concat(F.lit("n"), t.cast("string"), F.lit("_"), i.cast("string"))
    parts.append(docs.select("doc", place(0, 0, 0).alias("o"), F.lit("digraph strata {").alias("line")))
    for x in corpus.tiers:
        label = F.coalesce(F.col(x.durable).cast("string") if x.durable else F.lit(None).cast("string"), F.col("idx").cast("string"))
        rows = x.rows
        parts.append(rows.select("doc", place(1, x.t, F.col("idx")).alias("o"), F.concat(F.lit("  "), name(F.lit(x.t), F.col("idx")), F.lit(" [shape=box, label="), dot_quote(label), F.lit("];")).alias("line")))
        parts.append(rows.where("idx > 0").select("doc", place(2, x.t, F.col("idx")).alias("o"), F.concat(F.lit("  "), name(F.lit(x.t), F.col("idx") - 1), F.lit(" -> "), name(F.lit(x.t), F.col("idx")), F.lit(" [color=gray];")).alias("line")))
    for k, r in enumerate(corpus.relations):
        parts.append(r.edges.select("doc", place(3 + k, 0, F.col("ord")).alias("o"), F.concat(F.lit("  "), name(F.col("l.t"), F.col("l.i")), F.lit(" -> "), name(F.col("r.t"), F.col("r.i")), F.lit(f" [label={r.name}];")).alias("line")))
    for k, r in enumerate(corpus.polyadic):
        arcs = r.rows.select("doc", "ord", F.posexplode("sources").alias("a", "l"), "targets").select("doc", "ord", "a", "l", F.posexplode("targets").alias("b", "r"))
        at = F.struct(F.lit(1000 + k).cast("bigint"), F.col("ord").cast("bigint"), (F.col("a") * 1000000 + F.col("b")).cast("bigint"))
        parts.append(arcs.select("doc", at.alias("o"), F.concat(F.lit("  "), name(F.col("l.t"), F.col("l.i")), F.lit(" -> "), name(F.col("r.t"), F.col("r.i")), F.lit(f" [style=dashed, label={r.name}];")).alias("line")))
    parts.append(docs.select("doc", place(1000000, 0, 0).alias("o"), F.lit("}").alias("line")))
    parts = [p.select("doc", F.struct(*(F.col(f"o.{c}").alias(f"k{i}") for i, c in enumerate(p.schema["o"].dataType.names))).alias("o"), "line") for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    number = F.row_number().over(Window.partitionBy("doc").orderBy("o")).cast("bigint") - 1
    return out.select("doc", number.alias("place"), "line")


def whole(lines: DataFrame) -> DataFrame:
    """doc, text: each document's lines joined."""
    gathered = F.array_sort(F.collect_list(F.struct("place", "line")))
    return lines.groupBy("doc").agg(gathered.alias("x")).select("doc", F.concat(F.array_join(F.transform("x", lambda r: r.line), "\n"), F.lit("\n")).alias("text"))


def ruler(view: DataFrame) -> DataFrame:
    """doc, span, line: a mark under the span's characters: ^ for one, brackets for more."""
    width = F.col("char_end") - F.col("char_start")
    mark = F.when(width <= 1, F.repeat(F.lit("^"), width.cast("int"))).otherwise(F.concat(F.lit("["), F.repeat(F.lit("-"), (width - 2).cast("int")), F.lit("]")))
    return view.select("doc", "span", F.concat(F.repeat(F.lit(" "), F.col("char_start").cast("int")), mark).alias("line"))


def span_table(view: DataFrame) -> DataFrame:
    """doc, span, line: columns start, end and label, padded to the document's widest."""
    w = Window.partitionBy("doc")
    width = F.max(F.length(F.col("end").cast("string"))).over(w)
    cell = lambda c: F.lpad(F.col(c).cast("string"), width, F.lit(" "))
    return view.select("doc", "span", F.concat_ws("  ", cell("start"), cell("end"), F.col("span").cast("string")).alias("line"))


def html_report(view: DataFrame, texts: DataFrame) -> DataFrame:
    """doc, html: the text and its spans in a self-contained page."""
    row = F.concat(F.lit("<tr><td>"), F.col("start").cast("string"), F.lit("</td><td>"), F.col("end").cast("string"), F.lit("</td><td>"), html_escape(F.col("span").cast("string")), F.lit("</td></tr>"))
    rows = view.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end", row.alias("r")))).alias("x"))
    body = F.array_join(F.transform(F.coalesce("x", F.array().cast("array<struct<start:bigint,end:bigint,r:string>>")), lambda r: r.r), "")
    page = F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>spans</title></head><body><pre>'), html_escape(F.col("text")), F.lit("</pre><table>"), body, F.lit("</table></body></html>"))
    return texts.join(rows, "doc", "left").select("doc", page.alias("html"))
