"""Metadata: candidates with priorities, their resolution, and edits on top."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import base_name, plain_text, slug

CANDIDATE = ("page_id", "field", "value", "source", "priority", "confidence", "method")


def page_candidates(pages: DataFrame) -> DataFrame:
    """Title, language and identifier candidates of pages, blank ones left out. One scan: all of a page's candidates are an
    array in its row first."""
    first = lambda tag: plain_text(F.regexp_extract("html", rf"(?is)<{tag}\b[^>]*>(.*?)(?:</{tag}>|<p\b|<h|</article>)", 1))
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    found = [
        ("title", plain_text(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)), "title-element", 1, "certain", "extracted"),
        ("title", first("h1"), "first-heading", 4, "high", "inferred"),
        ("title", first("p"), "first-paragraph", 5, "medium", "inferred"),
        ("title", base_name(F.regexp_replace(path, "/$", "")), "file-name", 7, "low", "inferred"),
        ("language", F.regexp_extract("html", r'(?i)<html[^>]*\blang="([^"]*)"', 1), "html-element", 1, "certain", "extracted"),
        ("identifier", F.concat(F.lit("urn:vellum:"), slug(F.coalesce("url", F.lit("")))), "file-name", 7, "low", "default"),
    ]
    row = lambda field, value, *rest: F.struct(F.lit(field).alias("field"), F.trim(value).alias("value"), *[F.lit(x).alias(n) for n, x in zip(CANDIDATE[3:], rest, strict=True)], F.lit(0).cast("long").alias("ord"))
    return pages.select("page_id", F.inline(F.array(*[row(*c) for c in found]))).filter("value <> ''")


def resolve(candidates: DataFrame) -> DataFrame:
    """The winning candidate of each field: lowest priority, then order. One two-phase aggregate, no sort."""
    best = F.min_by(F.struct("value", "source", "confidence", "method"), F.struct("priority", "ord"))
    return candidates.groupBy("page_id", "field").agg(best.alias("b")).select("page_id", "field", "b.*")


def all_values(candidates: DataFrame, field: str) -> DataFrame:
    """All values of a field in priority order, repeats included: (page_id, values)."""
    held = candidates.filter(F.col("field") == field).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("priority", "ord", "value"))).alias("v"))
    return held.select("page_id", F.transform("v", lambda x: x["value"]).alias("values"))


def publication_date(candidates: DataFrame, conversion_date: str) -> DataFrame:
    """(page_id, value, method): the first candidate of high or certain confidence, else the conversion date by default."""
    sure = F.when(F.col("confidence").isin("high", "certain"), F.struct("priority", "ord"))
    best = candidates.groupBy("page_id").agg(F.min_by("value", sure).alias("value"))
    return best.select("page_id", F.coalesce("value", F.lit(conversion_date)).alias("value"), F.when(F.col("value").isNull(), "default").otherwise("extracted").alias("method"))


def overlay(resolved: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (page_id, field, value) over resolved fields: a blank value deletes, others are certain and the user's."""
    e = edits.select("page_id", "field", F.trim("value").alias("edit"))
    both = resolved.join(e, ["page_id", "field"], "full")
    kept = both.filter(F.col("edit").isNull() | (F.col("edit") != ""))
    edited = F.col("edit").isNotNull()
    return kept.select("page_id", "field", F.coalesce("edit", "value").alias("value"), F.when(edited, "editor").otherwise(F.col("source")).alias("source"), F.when(edited, "certain").otherwise(F.col("confidence")).alias("confidence"), F.when(edited, "user").otherwise(F.col("method")).alias("method"))


def edit_people(people: DataFrame, edits: DataFrame) -> DataFrame:
    """Authors (page_id, ord, name) after edits (page_id, ord, name): a name replaces the author of that place or is added,
    a blank one removes it; places close up."""
    both = people.select("page_id", "ord", "name").join(edits.select("page_id", "ord", F.trim("name").alias("edit")), ["page_id", "ord"], "full")
    kept = both.filter(F.coalesce("edit", "name") != "")
    order = Window.partitionBy("page_id").orderBy("ord")
    return kept.select("page_id", (F.row_number().over(order) - 1).alias("ord"), F.coalesce("edit", "name").alias("name"))
