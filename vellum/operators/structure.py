"""Operators over blocks in document order: scans, neighbours, nesting, numbering, chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import slug

#: The start tag of a heading or paragraph and what follows up to the next tag that isn't bold or a line break.
HEADING_OR_PARAGRAPH = r"(?i)<(h[1-6]|p)(?: [^>]*)?>([^<]*(?:<(?:/?b|br ?/?)>[^<]*)*)"


def line_blocks(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each line of a text: (id, ord, text)."""
    return docs.select(id_col, F.posexplode(F.split("text", "\n", -1)).alias("ord", "text")).withColumn("ord", F.col("ord").cast("long"))


def page_blocks(pages: DataFrame) -> DataFrame:
    """Headings and paragraphs of pages, tolerant of unclosed ones: (page_id, ord, tag, inner)."""
    tags = F.regexp_extract_all("html", F.lit(HEADING_OR_PARAGRAPH), F.lit(1))
    inner = F.regexp_extract_all("html", F.lit(HEADING_OR_PARAGRAPH), F.lit(2))
    rows = pages.select("page_id", F.posexplode(F.arrays_zip(tags.alias("tag"), inner.alias("inner"))).alias("ord", "b"))
    return rows.select("page_id", F.col("ord").cast("long").alias("ord"), F.lower("b.tag").alias("tag"), F.col("b.inner").alias("inner"))


def hrefs(pages: DataFrame) -> DataFrame:
    """Link targets in order: (page_id, ord, href)."""
    found = F.regexp_extract_all("html", F.lit(r'<a\s+href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("ord", "href")).withColumn("ord", F.col("ord").cast("long"))


def neighbours(rows: DataFrame, doc: str, order: str, kind: Column) -> DataFrame:
    """Adds `nearby`: the kind of the row before, else of the row after (nulls are no kind)."""
    w = Window.partitionBy(doc).orderBy(order)
    return rows.withColumn("nearby", F.coalesce(F.lag(kind).over(w), F.lead(kind).over(w)))


def chapters(rows: DataFrame, doc: str, order: str, starts: Column) -> DataFrame:
    """Adds `chapter` (`chapter-001`, ..): a starting row opens one unless it is the document's first row."""
    w = Window.partitionBy(doc).orderBy(order)
    ranked = rows.withColumn("_first", F.row_number().over(w) > 1).withColumn("_n", F.sum(F.when(starts & F.col("_first"), 1).otherwise(0)).over(w) + 1)
    return ranked.withColumn("chapter", F.concat(F.lit("chapter-"), F.lpad(F.col("_n").cast("string"), 3, "0"))).drop("_first", "_n")


def islands(rows: DataFrame, doc: str, order: str, member: Column, ordered: Column) -> DataFrame:
    """List building: consecutive members with one `ordered` form a list. Adds `list_no` (from 1; null outside of lists)
    and `item_no`."""
    w = Window.partitionBy(doc).orderBy(order)
    marked = rows.withColumn("_m", member).withColumn("_o", ordered)
    marked = marked.withColumn("_new", F.col("_m") & (~F.coalesce(F.lag("_m").over(w), F.lit(False)) | (F.lag("_o").over(w) != F.col("_o"))))
    marked = marked.withColumn("_no", F.sum(F.when(F.col("_new"), 1).otherwise(0)).over(w))
    marked = marked.withColumn("list_no", F.when(F.col("_m"), F.col("_no")))
    inside = Window.partitionBy(doc, "list_no").orderBy(order)
    return marked.withColumn("item_no", F.when(F.col("_m"), F.row_number().over(inside).cast("long"))).drop("_m", "_o", "_new", "_no")


def nesting(rows: DataFrame, part: str, order: str, begins: Column, ends: Column) -> DataFrame:
    """Adds `depth` of nested fields after each row: begins so far less ends so far."""
    w = Window.partitionBy(part).orderBy(order)
    return rows.withColumn("depth", F.sum(F.when(begins, 1).when(ends, -1).otherwise(0)).over(w))


def note_numbers(references: DataFrame, doc: str, order: str, note: str) -> DataFrame:
    """Adds `number`: notes count in the order of their first reference in each document."""
    first = references.groupBy(doc, note).agg(F.min(order).alias("_first"))
    first = first.withColumn("number", F.row_number().over(Window.partitionBy(doc).orderBy("_first", note)).cast("long"))
    return references.join(first.drop("_first"), [doc, note])


def unique_slugs(rows: DataFrame, doc: str, order: str, text: Column) -> DataFrame:
    """Adds `anchor`: the slug of a heading's text, with `-2`, `-3` for those that a document has before."""
    rows = rows.withColumn("_slug", slug(text))
    n = F.row_number().over(Window.partitionBy(doc, "_slug").orderBy(order))
    return rows.withColumn("_n", n).withColumn("anchor", F.when(F.col("_n") == 1, F.col("_slug")).otherwise(F.concat("_slug", F.lit("-"), F.col("_n").cast("string")))).drop("_slug", "_n")


def asset_paths(assets: DataFrame, doc: str, asset: str, extension: Column, is_font: Column) -> DataFrame:
    """Adds `path`: images and fonts are numbered apart, by id; null where there is no extension."""
    rows = assets.withColumn("_ext", extension).withColumn("_font", is_font)
    n = F.row_number().over(Window.partitionBy(doc, "_font", F.col("_ext").isNull()).orderBy(asset))
    number = F.lpad(n.cast("string"), 3, "0")
    path = F.when(F.col("_font"), F.concat(F.lit("fonts/font-"), number, F.lit("."), "_ext")).otherwise(F.concat(F.lit("images/image-"), number, F.lit("."), "_ext"))
    return rows.withColumn("path", path).drop("_ext", "_font")


def without_subtrees(blocks: DataFrame, dropped: DataFrame, doc: str, path: str) -> DataFrame:
    """Blocks that are neither in `dropped` (doc, path) nor below one of them; paths are `0001.0002` strings.

    Ancestors become rows, so that the condition on a prefix is an equi-join.
    """
    parts = F.split(path, r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    gone = blocks.select(doc, path, F.explode(prefixes).alias("_up")).join(dropped.select(doc, F.col(path).alias("_up")), [doc, "_up"], "left_semi").select(doc, path).distinct()
    return blocks.join(gone, [doc, path], "left_anti")


def first_violation(parts: DataFrame, doc: str, order: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(doc, code): the first rule that a document breaks, by row and then by rule; null if it breaks none."""
    broken = F.coalesce(*[F.when(c, F.lit(code)) for code, c in rules])
    return parts.withColumn("_code", broken).groupBy(doc).agg(F.min_by("_code", F.when(F.col("_code").isNotNull(), F.col(order))).alias("code"))
