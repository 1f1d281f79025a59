"""Markdown files: counts, links and where they lead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.paths import normalized, parts

_FENCE = r"^\s{0,3}(?:```|~~~)"
_LINK = r"(?<!!)\[[^\]]*\]\(([^()\s]+)[^()]*\)"


def _lines(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, line, fence, inside): lines of a text, whether they open or close a fence, and stand within one.

    A text's lines are taken in place; no text is split over tasks.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")
    fences = F.transform(lines, lambda x: x.rlike(_FENCE).cast("int"))
    marked = F.aggregate(
        F.arrays_zip(lines.alias("line"), fences.alias("fence")),
        F.struct(F.lit(0).alias("open"), F.expr("cast(array() as array<struct<line:string,fence:boolean,inside:boolean>>)").alias("rows")),
        lambda a, x: F.struct(
            F.when(x["fence"] == 1, 1 - a["open"]).otherwise(a["open"]).alias("open"),
            F.array_append(a["rows"], F.struct(x["line"].alias("line"), (x["fence"] == 1).alias("fence"), ((a["open"] == 1) & (x["fence"] == 0)).alias("inside"))).alias("rows"),
        ),
        lambda a: a["rows"],
    )
    return docs.select(F.col(id), F.inline(marked))


def measure(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, headings, max_depth, code_lines, links) of each text; a null one counts as empty."""
    rows = _lines(docs, id, text)
    out = ~F.col("fence") & ~F.col("inside")
    depth = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))
    return rows.groupBy(id).agg(
        F.count(F.when(out & (depth > 0), 1)).alias("headings"), F.coalesce(F.max(F.when(out, depth)), F.lit(0)).alias("max_depth"),
        F.count(F.when(F.col("inside"), 1)).alias("code_lines"), F.coalesce(F.sum(F.when(out, F.regexp_count("line", F.lit(_LINK)))), F.lit(0)).alias("links"),
    )


def classify_links(docs: DataFrame, by: list[str], path: str, text: str) -> DataFrame:
    """(by, path, link, kind): doc for another Markdown file, local for any other known file, external for an address, broken for neither."""
    rows = docs.select(*by, F.col(path).alias("path"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(_LINK), F.lit(1)))).alias("link"))
    target = F.regexp_replace("link", "[#?].*$", "")
    folder = parts(F.col("path"))["dir"]
    rows = rows.withColumn("far", normalized(F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(folder, F.lit("/"), target))))
    known = docs.select(*by, F.col(path).alias("far"), F.lit(True).alias("known")).distinct()
    outer = F.col("link").rlike(r"^[a-zA-Z][\w+.-]*:")
    rows = rows.join(known, [*by, "far"], "left")
    kind = F.when(outer, "external").when(F.startswith("link", F.lit("#")), "local").when(F.col("known").isNull(), "broken").when(F.col("far").rlike(r"(?i)\.(md|markdown)$"), "doc").otherwise("local")
    return rows.select(*by, "path", "link", kind.alias("kind"))
