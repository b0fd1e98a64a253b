"""Packages from reading to output: one call for what a converter does with a document, over a corpus.

Everything here is an expression over one row of read packages, so that a conversion is one pass: parsed once, analysed in its
row, rendered, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators import render as R
from vellum.operators import styles as Y

#: What parse_packages() must read for analyse(), resolved_metadata(), and ready() and convert().
ANALYSED, RESOLVED, CONVERTED = ("styles", "usages"), ("candidates",), ("model", "styles", "usages", "candidates", "warnings", "assets")
SCALARS = ("title", "subtitle", "language", "publisher", "description", "version", "sourceCreatedAt", "sourceModifiedAt", "identifier", "rights")


def analyse(packages: DataFrame, mappings: Mapping[str, str] | None = None, preset: Mapping[str, str] | None = None) -> DataFrame:
    """Styles of each document with their use and meaning: (doc_id, style_id, .., mapping, confidence, evidence).

    `mappings` and `preset` map style ids to meanings, the user's own and those of a preset. Only styles that are used are
    judged.
    """
    found = packages.filter("error IS NULL").select("doc_id", Y.analysed(F.col("styles"), F.col("usages"), dict(mappings or {}), dict(preset or {})).alias("styles"))
    return found.select("doc_id", F.inline("styles"))


def resolved(candidates: Column, conversion_date: str, edits: Mapping[str, str] | None = None, authors: Sequence[str] | None = None, subjects: Sequence[str] | None = None) -> Column:
    """The winning value of each field of an array of candidates, with all authors and subjects and the dates.

    Lower priorities win, then the order. The publication date is the first of high or certain confidence, else the conversion
    date. `edits` stand over what was found, a blank one deletes; so do lists of authors and subjects, without blanks.
    """
    ordered = lambda field: F.array_sort(F.transform(F.filter(candidates, lambda c: c["field"] == field), lambda c: F.struct(c["priority"], c["ord"], c["value"], c["confidence"])))
    first = lambda rows: F.get(rows, 0)["value"]
    sure = F.filter(ordered("publicationDate"), lambda c: c["confidence"].isin("high", "certain"))
    fields = {f: first(ordered(f)) for f in SCALARS} | {"publicationDate": F.coalesce(first(sure), F.lit(conversion_date)), "conversionDate": F.lit(conversion_date)}
    for field, value in (edits or {}).items():
        if value.strip() or field != "conversionDate":
            fields[field] = F.lit(value if value.strip() else None).cast("string")
    given = lambda names: F.array(*[F.lit(x.strip()) for x in names if x.strip()]).cast("array<string>")
    lists = {f: given(own) if own is not None else F.transform(ordered(f), lambda c: c["value"]) for f, own in (("authors", authors), ("subjects", subjects))}
    return F.struct(*[c.alias(f) for f, c in (fields | lists).items()])


def resolved_metadata(packages: DataFrame, conversion_date: str, **edits) -> DataFrame:
    """(doc_id, metadata): the resolved fields as JSON; see resolved()."""
    return packages.filter("error IS NULL").select("doc_id", F.to_json(resolved(F.col("candidates"), conversion_date, **edits)).alias("metadata"))


def convert(
    packages: DataFrame, format: str, mode: str, conversion_date: str, formula: str = "mathml", mappings: Mapping[str, str] | None = None,
    preset: Mapping[str, str] | None = None, cover: dict | None = None, **edits,
) -> DataFrame:
    """Outputs of all packages, with the reader's warnings before the writer's; one that could not be read has its error.

    `cover` holds the settings of a generated cover, `edits` what resolved() takes.
    """
    return R.convert(ready(packages, conversion_date, mappings, preset, **edits), format, mode, formula, cover, tuple(mappings or ()))


def ready(packages: DataFrame, conversion_date: str, mappings: Mapping[str, str] | None = None, preset: Mapping[str, str] | None = None, **edits) -> DataFrame:
    """Packages with what their styles mean and their metadata, as a writer needs them; see convert()."""
    styles = Y.analysed(F.col("styles"), F.col("usages"), dict(mappings or {}), dict(preset or {}))
    return packages.select(
        "doc_id", "error", "model", "assets", "warnings", Y.let(styles, Y.meanings).alias("mapping"),
        F.to_json(resolved(F.col("candidates"), conversion_date, **edits)).alias("metadata"), F.lit(conversion_date).alias("modified"),
    )
