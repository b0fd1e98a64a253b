"""Warnings and validation as relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ("info", "warning", "error")


def route(code: Column) -> Column:
    """The part of a document that a warning concerns; null if none in particular."""
    has = lambda *words: reduce(Column.__or__, [F.contains(code, F.lit(w)) for w in words])
    return F.when(has("formula", "math"), "formula").when(has("metadata"), "metadata").when(has("style", "heading"), "styles")


def deduplicate(warnings: DataFrame, doc: str, order: str) -> DataFrame:
    """The first of equal warnings: style warnings are equal by style, other routed ones never, the rest by code and message."""
    key = F.when((route(F.col("code")) == "styles") & F.col("style_id").isNotNull(), F.concat(F.lit("style:"), "style_id")).when(route(F.col("code")).isNull(), F.concat_ws(":", "code", "message"))
    rows = warnings.withColumn("_key", key)
    first = F.row_number().over(Window.partitionBy(doc, "_key").orderBy(order))
    return rows.withColumn("_n", first).filter("_key IS NULL OR _n = 1").drop("_key", "_n")


def rules(rows: DataFrame, doc: str, tests: list[tuple[str, str, str, Column]]) -> DataFrame:
    """Issues of each row in the order of the rules: (doc, rule, path, code, message); each test is true where it is broken."""
    found = F.array_compact(F.array(*[
        F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(i).alias("rule"), F.lit(path).alias("path"), F.lit(code).alias("code"), F.lit(message).alias("message")))
        for i, (path, code, message, test) in enumerate(tests, 1)
    ]))
    return rows.select(doc, F.explode(found).alias("issue")).select(doc, "issue.*")


def with_style_names(warnings: DataFrame, styles: DataFrame, doc: str) -> DataFrame:
    """Adds `style_name`: the name of the warning's style, or its id where there is no such style."""
    named = styles.select(doc, "style_id", F.col("name").alias("_name"))
    return warnings.join(named, [doc, "style_id"], "left").withColumn("style_name", F.coalesce("_name", "style_id")).drop("_name")


def merged(model: DataFrame, writer: DataFrame, doc: str) -> DataFrame:
    """Warnings of the reader before those of the writer: (doc, ord, code, message) with a new order."""
    both = model.withColumn("_side", F.lit(0)).unionByName(writer.withColumn("_side", F.lit(1)))
    order = Window.partitionBy(doc).orderBy("_side", "ord")
    return both.withColumn("ord", F.row_number().over(order) - 1).drop("_side")
