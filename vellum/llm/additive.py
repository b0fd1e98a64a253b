"""Nearest neighbours by additive quantisation.

A unit vector is coded as a sum of one word from each of several full-dimensional codebooks, found by beam search over the
residuals. A query makes a table of its products with all words; the score of a row is a sum of table entries over the
stored norm of its code's sum. The best of each block are scored again on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: A row is scored exactly if its score by code is among the best of its group, as large a share of it as RECALL needs and
#: RERANK rows at least, or less than MARGIN under them, so that near copies, whose codes hardly differ, are told apart by their
#: vectors however many they are.
RERANK, MARGIN, RECALL = 256, 0.02, 0.97
#: The codebooks are fitted on so many vectors at most, those with the smallest hashes of their ids; the share to score exactly is
#: measured with so many queries among so many others, which the codebooks have not seen. All of them hold so many numbers at most.
SAMPLE, TRIED, TRIED_QUERIES, SAMPLED_NUMBERS = 12_000, 8192, 200, 20_000_000
BOOKS, WORDS, BEAM = 16, 256, 4
#: Vectors and queries that one group scores against each other, at most, and the numbers that they hold together; queries whose
#: tables are made at once.
BLOCK, QUERIES, NUMBERS, TABLES = 16_384, 16_384, 2_000_000, 256
FOUND = "query_row long, query_id long, vec_id long, score double"


@dataclass
class Codebooks:
    words: np.ndarray  # [book, word, d]

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes [n, book] of unit vectors: level by level, the `beam` best sums so far are each extended by every word."""
        n, d = x.shape
        books, size, _ = self.words.shape
        residual = x[:, None, :]
        codes = np.zeros((n, 1, 0), np.uint8)
        for m in range(books):
            c = self.words[m]
            left = (residual**2).sum(axis=2)[:, :, None] - 2 * (residual.reshape(-1, d) @ c.T).reshape(n, -1, size) + (c**2).sum(axis=1)
            flat = left.reshape(n, -1)
            keep = min(beam, flat.shape[1]) if m + 1 < books else 1
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.argsort(flat, axis=1)
            parent, word = best // size, best % size
            rows = np.arange(n)[:, None]
            residual = residual[rows, parent] - c[word]
            codes = np.concatenate((codes[rows, parent], word[:, :, None].astype(np.uint8)), axis=2)
        return codes[:, 0]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(len(self.words)))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = ((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.integers(len(x), size=k)]).astype(np.float32)
    return c


def fit(x: np.ndarray, seed: int = 1) -> Codebooks:
    """Codebooks for unit vectors: k-means on the residuals one by one, then twice beam codes and least squares for all."""
    rng = np.random.default_rng(seed)
    size = int(min(WORDS, max(2, len(x) // 8)))
    residual, words = x.copy(), []
    for _ in range(BOOKS):
        c = _kmeans(residual, size, rng)
        residual -= c[((c**2).sum(axis=1) - 2 * residual @ c.T).argmin(axis=1)]
        words.append(c)
    books = Codebooks(np.stack(words))
    for _ in range(2):
        at = books.encode(x).astype(np.int64) + np.arange(BOOKS) * size
        gram = np.zeros((BOOKS * size, BOOKS * size))
        for a in range(BOOKS):
            for b in range(BOOKS):
                np.add.at(gram, (at[:, a], at[:, b]), 1)
        right = np.zeros((BOOKS * size, x.shape[1]))
        for a in range(BOOKS):
            np.add.at(right, at[:, a], x)
        old = books.words.reshape(-1, x.shape[1])
        gram[np.diag_indices(len(gram))] += 0.1
        books = Codebooks(np.linalg.solve(gram, right + 0.1 * old).astype(np.float32).reshape(books.words.shape))
    return books


def levelled(x: np.ndarray) -> np.ndarray:
    """Vectors in double precision, each times a power of two that brings its largest component near one: no square over- or
    underflows, and no cosine changes by a bit."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = levelled(x)
    return (x / np.sqrt((x**2).sum(axis=1, keepdims=True))).astype(np.float32)


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of one levelled vector with many, in double precision."""
    return (x * q).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(axis=1)))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part, row by row; floats stay floats, other numbers are doubles."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind if kind == "array<float>" else "array<double>"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite & F.exists("embedding", lambda x: x != 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def by_book(codes: np.ndarray) -> np.ndarray:
    """Codes [n, book] as places to look up, book by book."""
    return np.ascontiguousarray(codes.T).astype(np.intp)


def code_scores(places: np.ndarray, norm: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Score of each row by its code, for a query with that table [book, word] of products."""
    score = table[0].take(places[0])
    for words, at in zip(table[1:], places[1:], strict=True):
        score += words.take(at)
    return score / np.maximum(norm, 1e-12)


def tables(books: Codebooks, q: np.ndarray) -> np.ndarray:
    return np.einsum("qd,mkd->qmk", unit(q), books.words, optimize=True).astype(np.float32)


def needed_share(books: Codebooks, x: np.ndarray, k: int, recall: float) -> float:
    """The share of a block that must be scored exactly for this recall of the k nearest.

    Measured in a block of vectors that the codebooks were not fitted on: for each query among them, how deep in the order by
    code its true k nearest lie.
    """
    if len(x) < 2:
        return 1.0
    codes = books.encode(unit(x))
    norm, whole, places = np.sqrt((books.decode(codes) ** 2).sum(axis=1)), levelled(x), by_book(codes)
    depth = []
    for i, table in enumerate(tables(books, x[:TRIED_QUERIES])):
        score, exact = code_scores(places, norm, table), cosine(whole[i], whole)
        score[i] = exact[i] = -np.inf
        best = np.argsort(-exact, kind="stable")[: min(k, len(x) - 1)]
        depth += [int((score > score[b]).sum()) + 1 for b in best]
    return float(np.quantile(depth, recall, method="higher")) / len(x)


def build_index(rows: DataFrame, d: int, k: int) -> tuple[DataFrame, Codebooks, float]:
    """Every row with its code and the norm of what its code stands for; the codebooks; the share to score exactly."""
    salted = F.xxhash64("vec_id", "embedding")
    most = max(2, min(SAMPLE + TRIED, SAMPLED_NUMBERS // d))
    cut = rows.select(salted.alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0]
    sample = rows.filter(salted <= F.lit(cut)).select(salted.alias("h"), "embedding").orderBy("h").limit(most).toArrow()
    x = _matrix(sample.column("embedding"))
    fitted = max(1, len(x) * SAMPLE // (SAMPLE + TRIED))
    books = fit(unit(x[:fitted]))
    share = needed_share(books, x[fitted:], k, RECALL)
    kind = rows.schema["embedding"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                codes = books.encode(unit(_matrix(part.column(2))))
                norms = np.sqrt((books.decode(codes) ** 2).sum(axis=1)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms)], names=["row", "vec_id", "embedding", "codes", "norm"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding")
    return numbered.mapInArrow(encode, f"row long, vec_id long, embedding {kind}, codes binary, norm float"), books, share


def _scan(books: Codebooks, k: int, share: float):
    """Best k of a block of rows for each of a block of queries."""
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def scan(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])
            ids, own, x = rows.column("vec_id").to_numpy(), rows.column("row").to_numpy(), levelled(_matrix(rows.column("embedding")))
            norm = rows.column("norm").to_numpy()
            places = by_book(np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1))
            q = _matrix(queries.column("query"))
            exactly = max(RERANK, int(np.ceil(share * len(ids))))
            made = (t for lo in range(0, len(q), TABLES) for t in tables(books, q[lo : lo + TABLES]))
            for table, row, name, query in zip(made, queries.column("query_row").to_pylist(), queries.column("query_id").to_pylist(), levelled(q), strict=True):
                score = code_scores(places, norm, table)
                score[own == row] = -np.inf
                least = np.partition(score, len(ids) - exactly)[len(ids) - exactly] - MARGIN if len(ids) > exactly else -np.inf
                near = np.flatnonzero(score >= least)
                near = near[own[near] != row]
                exact = cosine(query, x[near])
                best = np.lexsort((ids[near], -exact))[:k]
                out += [(row, name, int(ids[near[j]]), float(exact[j])) for j in best]
        columns = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return scan


def search(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """The k nearest rows by cosine of every row that `is_query` (a condition on vec_id) picks: query_id, rank, vec_id, score.

    Scores are cosines of the original vectors in double precision; nearest first, ties to the smaller vec_id; fewer than k
    rows where there are fewer candidates. Vectors that are null, zero, or hold null or non-finite components take no part, nor
    do rows without an id. Each row is a candidate and each picked row a query of its own, rows with the same id or vector
    included; vectors have a cosine with those of their own length only, so each length is searched apart. Other columns are
    ignored. Too few vectors to form a pair give no rows.

    Every row is indexed. Rows are dealt to blocks by a hash and queries likewise, and each block of queries meets each block
    of rows in one group of bounded size, whatever the vectors are: copies of a vector spread like others. How many rows of a
    block are scored exactly follows from the recall measured on vectors that the codebooks have not seen.
    """
    rows = usable(vectors)
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for d in sorted(r["d"] for r in rows.select(F.size("embedding").alias("d")).distinct().collect()):
        out = out.unionByName(_of_length(rows.filter(F.size("embedding") == d), d, is_query, k))
    return out


def _of_length(rows: DataFrame, d: int, is_query, k: int) -> DataFrame:
    """search() among vectors of one length."""
    index, books, share = build_index(rows, d, k)
    index = materialise(index, "additive-index")
    n = index.count()
    queries = index.filter(is_query).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    most = lambda rows: max(1, min(rows, NUMBERS // d))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks, parts = max(math.ceil(n / most(BLOCK)), min(2 * cores, math.ceil(n / most(2048)))), max(1, math.ceil(queries.count() / most(QUERIES)))
    deal = lambda c, m: F.pmod(F.xxhash64(F.lit("block"), c), F.lit(m)).cast("int")
    left = index.select("*", deal("row", blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = queries.select("*", deal("query_row", parts).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    near = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_scan(books, k, share), FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
