"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, word_count

LEVELS, BITS = 3, 12  # 36 bits of the hash, 4096 buckets at each level


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """Budgets of each source: (source, source_size) -> + (target, copies, rest).

    Sources in code-point order, null last, weigh `weights`, repeated. All sizes together are shared out by weight; no
    target exceeds `max_repeat` times its source, and what stops there is reshared. Filling by rising cap-to-weight ratio
    gives that fixed point at once: a source is capped if the level that the rest would get lies above its own cap.
    There is one row for each source, so the window over all of them holds source summaries, never documents.
    """
    lcm, n = math.lcm(*weights), len(weights)
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_ratio = Window.orderBy("ratio", "place")
    big = lambda c: F.col(c).cast("decimal(38,0)")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % n + 1).cast("int"))
    everything = Window.partitionBy()
    level = (
        sizes.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * max_repeat)
        .withColumn("ratio", F.col("cap") * (F.lit(lcm) / F.col("weight")).cast("long"))
        .withColumn("cap_before", F.sum("cap").over(by_ratio) - F.col("cap"))
        .withColumn("weight_before", F.sum("weight").over(by_ratio) - F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("capped", big("cap") * (big("weights") - big("weight_before")) < big("weight") * (big("total") - big("cap_before")))
        .withColumn("cap_sum", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything))
        .withColumn("weight_sum", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everything))
    )
    shared = (F.col("weight") * (F.col("total") - F.col("cap_sum"))).cast("double") / F.col("weight_sum").cast("double")
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.least(shared, F.col("cap").cast("double")))
    copies = F.when(F.col("source_size") > 0, F.least(F.lit(max_repeat).cast("long"), F.floor(F.col("target") / F.col("source_size")))).otherwise(F.lit(0).cast("long"))
    return (
        level.withColumn("target", target)
        .withColumn("copies", copies)
        .withColumn("rest", F.greatest(F.lit(0).cast("long"), F.floor(F.col("target") - F.col("copies") * F.col("source_size"))))
        .select("source", "source_size", "target", "copies", "rest")
    )


def _digit(level: int) -> Column:
    return F.shiftright("h", BITS * (LEVELS - 1 - level)).bitwiseAND(F.lit(2**BITS - 1))


def _refine(rows: DataFrame, budgets: DataFrame, level: int) -> DataFrame:
    """Sum words by source and bucket, and go down into the one bucket where the budget ends.

    `budgets` holds (source, rest, path): only rows below `path` are summed. At most 4096 buckets a source come out of
    each task, so the sums shuffle, not the documents, and a source with a third of the rows is no larger than others.
    """
    if level:
        above = F.shiftright("h", BITS * (LEVELS - level))
        b = budgets.select(F.col("source").alias("s"), F.col("path").alias("p"))
        rows = rows.join(b, rows["source"].eqNullSafe(b["s"]) & (above == b["p"])).select("source", "size", "h")
    sums = rows.groupBy("source", _digit(level).alias("bucket")).agg(F.sum("size").alias("n"))
    order = Window.partitionBy("source").orderBy("bucket")
    b = budgets.select(F.col("source").alias("s"), "rest", "path")
    ends = (
        sums.withColumn("upto", F.sum("n").over(order))
        .join(b, sums["source"].eqNullSafe(b["s"]))
        .filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest")))
        .select(
            "source",
            (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"),
            (F.col("path") * 2**BITS + F.col("bucket")).alias("path"),
            F.col("n").alias("last"),
        )
    )
    return materialise(ends, f"mix-level{level}")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """Choose how many words of each document a mix takes: doc_id, source, size, source_size, target, taken.

    A document's words are counted over its whole text (null or empty: 0, and it takes 0). Every document is taken
    `copies` times; the rest of its source's budget goes to the documents whose 36-bit hash of doc_id lies under a
    threshold. The threshold is found in nested histograms: words summed by source and hash bucket, then again inside the
    bucket where the budget ends, three levels deep; a last bucket is taken if more than half of it fits. Nothing is sorted
    and nothing is drawn at random, so reruns agree. Null sources form a source of their own; a null doc_id hashes as empty
    text; rows with equal doc_id share a decision; other columns of `docs` are ignored. An empty table gives no rows.
    """
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, LEVELS * BITS // 4), 16, 10)
    rows = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), h.cast("long").alias("h")), "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    budgets = materialise(source_targets(sizes, weights, max_repeat), "mix-targets")
    ends = reduce(lambda b, k: _refine(rows, b, k), range(LEVELS), budgets.select("source", "rest", F.lit(0).cast("long").alias("path")))
    e = ends.select(F.col("source").alias("s"), "path", (2 * F.col("rest") >= F.col("last")).alias("with_last"))
    plan = budgets.join(e, budgets["source"].eqNullSafe(e["s"]), "left").select(F.col("source").alias("s"), "source_size", "target", "copies", "path", "with_last")
    plan = materialise(plan, "mix-plan")
    extra = F.coalesce((F.col("h") < F.col("path")) | ((F.col("h") == F.col("path")) & F.col("with_last")), F.lit(False))
    taken = F.col("size") * (F.col("copies") + F.when(extra, 1).otherwise(0))
    return rows.join(plan, rows["source"].eqNullSafe(plan["s"])).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def op10_mix(spark, sf_dir: str) -> DataFrame:
    return mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


OP10_SQL = """
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS h
  FROM {documents}),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
ranked AS (
  SELECT *, 1 + ((row_number() OVER (ORDER BY source IS NULL, source)) - 1) % 3 AS weight,
         source_size * 3 AS cap FROM sizes),
filled AS (
  SELECT *, sum(cap) OVER o - cap AS cap_before, sum(weight) OVER o - weight AS weight_before,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM ranked WINDOW o AS (ORDER BY cap * (6 // weight), source IS NULL, source)),
capped AS (SELECT *, cap::HUGEINT * (weights - weight_before) < weight::HUGEINT * (total - cap_before) AS capped FROM filled),
shares AS (
  SELECT *, (sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::BIGINT AS cap_sum,
         (sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ())::BIGINT AS weight_sum FROM capped),
targets AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap::DOUBLE ELSE least((weight * (total::BIGINT - cap_sum))::DOUBLE / weight_sum::DOUBLE, cap::DOUBLE) END AS target
  FROM shares),
plan AS (
  SELECT *, greatest(0, floor(target - copies * source_size)::BIGINT) AS rest FROM (
    SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)::BIGINT) ELSE 0 END AS copies FROM targets)),
buckets AS (
  SELECT source, h, sum(size)::BIGINT AS n, (sum(sum(size)) OVER (PARTITION BY source ORDER BY h))::BIGINT AS upto
  FROM rows GROUP BY source, h)
SELECT r.doc_id, r.size, p.source_size, p.target,
       (r.size * (p.copies + CASE WHEN b.upto <= p.rest OR (b.upto - b.n <= p.rest AND 2 * (b.upto - b.n) + b.n <= 2 * p.rest) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source
JOIN buckets b ON r.source IS NOT DISTINCT FROM b.source AND r.h = b.h
""".replace("{documents}", "documents")
