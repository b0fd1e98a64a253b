"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, new_path, write_table


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node joins its larger neighbours to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("least")).select("u", F.least("u", "least").alias("least"))
    larger = both.filter("b > a")
    return larger.join(least, larger["a"] == least["u"]).select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node joins itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("least"))
    moved = down.join(least, down["a"] == least["u"]).filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("least").alias("b"))).distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): the least node of the component of each node that an edge (a, b) of longs names; a != b.

    A round takes each path about half as long, and rounds end when the edges are stars. Minima are put together before
    they shuffle, so a node with very many edges is a skewed join key at most, which Spark's skew joins part. A round's
    table is dropped when the next one is written.
    """
    spark = edges.sparkSession
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    path, before = new_path(spark, f"{name}-edges"), None
    edges = write_table(edges.distinct(), path)
    while (now := state(edges)) != before and now[0]:
        old, path, before = path, new_path(spark, f"{name}-stars"), now
        edges = write_table(_small_star(_large_star(edges)), path)
        drop_table(spark, old)
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
