"""Toxicity by a convolutional text classifier, trained and run in numpy.

Hashed word embeddings, filters of several widths, the maximum of each filter over the text, and a logistic unit. What a
text's threshold is depends on its language, which is told from its own function words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_chunks, id_bucket, plain_words, sample_rows, small_batches, tidy

#: The model is fitted on so many labelled documents at most, none longer than that.
TRAIN_ROWS, TRAIN_CHARS = 9000, 20_000
BUCKETS, DIM, FILTERS, WIDTHS = 2**15, 16, 16, (1, 2, 3)
PREFIXES = (4, 6)
EPOCHS, BATCH = 12, 32
#: A score of at least this says toxic.
DECIDE = 0.7
SCORES = "doc_id long, held_out boolean, score double, predicted int"

# Function words that tell languages apart.
FUNCTION_WORDS = {
    "de": "der die das und nicht ist ein eine den mit sich auf für von dem",
    "en": "the of and to in is that for it with as was by on are",
    "es": "el los las una del por con para su como más pero y lo al",
    "fr": "le les des et est une du dans pour pas sur qui au avec ce",
}
LANGUAGES = [*sorted(FUNCTION_WORDS), "other"]
_SPEAKS = {w.encode(): k for k, lang in enumerate(sorted(FUNCTION_WORDS)) for w in FUNCTION_WORDS[lang].split()}


def _buckets(words: list[bytes]) -> np.ndarray:
    """Embedding rows of each word: of the word itself and of its beginnings."""
    rows = [[zlib.crc32(w) % BUCKETS for w in words], *[[zlib.crc32(w[:n], n) % BUCKETS for w in words] for n in PREFIXES]]
    return np.array(rows, np.int32).T.reshape(-1, 1 + len(PREFIXES))


class Batch:
    """Texts as numbers of their distinct words; number 0 is the padding, as long as the widest filter, after each text. Filters
    start at a text's words and the first place after them, so that none reaches into the next text."""

    def __init__(self, texts: list[str | None]):
        number: dict[bytes, int] = {}
        ids: list[int] = []
        self.begin = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            self.begin[i] = len(ids)
            ids += [number.setdefault(w, len(number) + 1) for w in plain_words(text)]
            ids += [0] * max(WIDTHS)
        self.ids = np.array(ids, np.int32)
        ends = np.append(self.begin[1:], len(ids)) if texts else self.begin
        self.no_start = (ends[:, None] - 1 - np.arange(max(WIDTHS) - 1)).ravel()
        words = list(number)
        self.rows = np.concatenate((np.zeros((1, 1 + len(PREFIXES)), np.int32), _buckets(words)))
        speaks = np.zeros((len(words) + 1, len(_SPEAKS)), np.float32)[:, : len(FUNCTION_WORDS)]
        for w, k in _SPEAKS.items():
            if w in number:
                speaks[number[w], k] = 1
        told = np.add.reduceat(speaks[self.ids], self.begin, axis=0) if len(texts) else np.zeros((0, len(FUNCTION_WORDS)))
        self.language = np.where(told.max(axis=1, initial=0) > 0, told.argmax(axis=1) if len(texts) else 0, len(FUNCTION_WORDS))


@dataclass
class Model:
    embedding: np.ndarray  # [bucket, d]
    filters: dict[tuple[int, int], np.ndarray]  # (width, offset) -> [d, filter]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    thresholds: np.ndarray | None = None  # by language

    def pooled(self, b: Batch, where: bool = False) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Greatest value of each filter in each text, on request also where it is, and the distinct words' vectors."""
        x = self.embedding[b.rows].sum(axis=1)
        x[0] = 0
        found, at = [], []
        ends = np.append(b.begin[1:], len(b.ids))
        for w in WIDTHS:
            p = x @ self.filters[w, 0]
            conv = p[b.ids]
            for o in range(1, w):
                conv[:-o] += (x @ self.filters[w, o])[b.ids[o:]]
            conv[b.no_start] = -np.inf
            found.append(np.maximum.reduceat(conv, b.begin, axis=0))
            if where:
                at.append(np.stack([s + conv[s:e].argmax(axis=0) for s, e in zip(b.begin, ends, strict=True)]))
        return np.concatenate(found, axis=1), at, x

    def logits(self, b: Batch) -> np.ndarray:
        return np.maximum(self.pooled(b)[0] + self.bias, 0) @ self.out + self.out_bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """DECIDE at the threshold of a text's language, and rising with the logit."""
        b = Batch(texts)
        z = (self.logits(b) - self.thresholds[b.language]) * self.scale + np.log(DECIDE / (1 - DECIDE))
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -500, 500)))


def _step(m: Model, moments: dict, b: Batch, y: np.ndarray, weight: np.ndarray, rate: float) -> float:
    """One step down the gradient of the weighted logistic loss; returns the loss."""
    top, at, x = m.pooled(b, where=True)
    h = np.maximum(top + m.bias, 0)
    p = 1 / (1 + np.exp(-np.clip(h @ m.out + m.out_bias, -30, 30)))
    dz = ((p - y) * weight / len(y)).astype(np.float32)
    dh = dz[:, None] * m.out * (h > 0)
    dx = np.zeros_like(x)
    grads = {"out": h.T @ dz, "out_bias": dz.sum(), "bias": dh.sum(axis=0)}
    for k, w in enumerate(WIDTHS):
        d, rows = dh[:, k * FILTERS : (k + 1) * FILTERS], at[k]
        which = np.broadcast_to(np.arange(FILTERS), rows.shape)
        on = d != 0
        d, rows, which = d[on], rows[on], which[on]
        for o in range(w):
            word = b.ids[np.minimum(rows + o, len(b.ids) - 1)]
            g = np.zeros((FILTERS, DIM), np.float32)
            np.add.at(g, which, d[:, None] * x[word])
            grads[w, o] = g.T
            np.add.at(dx, word, d[:, None] * m.filters[w, o].T[which])
    dx[0] = 0
    for key, g in grads.items():
        first, second, t = moments.get(key, (0, 0, 0))
        first, second, t = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g, t + 1
        moments[key] = first, second, t
        change = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
        if key in m.filters:
            m.filters[key] -= change.astype(np.float32)
        else:
            setattr(m, key, getattr(m, key) - change)
    used = np.flatnonzero(np.abs(dx).sum(axis=1))
    for k in range(1 + len(PREFIXES)):
        rows = b.rows[used, k]
        total = moments.setdefault("embedding", np.full(BUCKETS, 1e-6, np.float32))
        np.add.at(total, rows, (dx[used] ** 2).mean(axis=1))
        np.add.at(m.embedding, rows, -5 * rate * dx[used] / np.sqrt(total[rows])[:, None])
    eps = 1e-7
    return float(-(weight * (y * np.log(p + eps) + (1 - y) * np.log(1 - p + eps))).mean())


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The logit that parts the classes with the best F1, halfway between its neighbours."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    right = np.cumsum(y)
    f1 = 2 * right / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    return float((z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 1)


def fit(texts: list[str], toxic: list[int], seed: int = 5) -> Model:
    """Train on four fifths of the rows and set each language's threshold on the fifth held back, by best F1.

    A language with fewer than 20 toxic or other rows in that fifth takes the threshold of all of it; if that holds fewer than
    20 of a class in all (small samples), thresholds are set on all rows. Without rows of both classes no text is more
    toxic than another, and every score is the share of toxic rows, with one row of either class added.
    """
    rng = np.random.default_rng(seed)
    y = np.array(toxic, np.float32)
    m = Model(
        rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32),
        {(w, o): rng.normal(0, 0.3, (DIM, FILTERS)).astype(np.float32) for w in WIDTHS for o in range(w)},
        np.zeros(FILTERS * len(WIDTHS), np.float32),
        rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32),
        np.float32(0),
    )
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        m.scale, m.thresholds = 0.0, np.zeros(len(LANGUAGES))
        m.constant = float(share)
        return m
    balance = np.where(y > 0, min(8.0, (1 - y.mean()) / y.mean()), 1).astype(np.float32)
    part = rng.permutation(len(y))
    train = part[: max(1, len(part) * 4 // 5)].copy() if len(part) >= 50 else part.copy()
    moments: dict = {}
    for epoch in range(EPOCHS):
        rng.shuffle(train)
        loss = 0.0
        for lo in range(0, len(train), BATCH):
            rows = train[lo : lo + BATCH]
            loss += len(rows) * _step(m, moments, Batch([texts[i] for i in rows]), y[rows], balance[rows], 0.01 / (1 + 0.3 * epoch))
        if loss / len(train) < 0.003:
            break
    apart = part[len(train) :]
    if min(y[apart].sum(), (1 - y[apart]).sum()) < 20:
        apart = part
    z, language, y = np.zeros(len(apart)), np.zeros(len(apart), int), y[apart]
    for lo in range(0, len(apart), 200):
        b = Batch([texts[i] for i in apart[lo : lo + 200]])
        z[lo : lo + 200], language[lo : lo + 200] = m.logits(b), b.language
    overall = _threshold(z, y)
    m.thresholds = np.full(len(LANGUAGES), overall)
    for k in range(len(LANGUAGES)):
        own = language == k
        if y[own].sum() >= 20 and (1 - y[own]).sum() >= 20:
            m.thresholds[k] = _threshold(z[own], y[own])
    m.scale = float(4 / max(1e-3, np.std(z)))
    return m


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """Texts and labels of at most TRAIN_ROWS labelled documents that are not held out, by hash of their id."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (id_bucket("doc_id", 3) != 1))
    known = sample_rows(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", TRAIN_ROWS, "toxicity")
    wanted = docs.sparkSession.createDataFrame(known.collect(), "doc_id long, toxic int")
    short = docs.select("doc_id", "text").filter(F.length("text") <= TRAIN_CHARS)
    rows = short.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def _scored(texts: list[str | None], model: Model) -> np.ndarray:
    if hasattr(model, "constant"):
        return np.full(len(texts), model.constant)
    out = np.zeros(len(texts))
    for lo, hi in bounded_chunks(texts, 1_000_000):
        out[lo:hi] = model.scores(texts[lo:hi])
    return out


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Score every document: doc_id, held_out, score, predicted (1 from a score of DECIDE on).

    Whole texts are read, each from its own row; nothing shuffles. Null and empty texts score as a text of padding does;
    repeated rows score alike; a null doc_id is not held out; only doc_id and text are read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _scored(batch.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= DECIDE).astype(np.int32))], schema=schema)

    return small_batches(docs).select("doc_id", (id_bucket("doc_id", 3) == 1).alias("held_out"), "text").mapInArrow(tidy(score), SCORES)


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that score under DECIDE, with all their columns, by a model fitted on `labels`.

    Each row is judged by its text alone: repeated rows share their fate, null and empty texts score as padding does, null ids
    only take no part in the fit. Without labels of both classes every text scores the share of toxic ones, a half without
    any label: all rows stay unless that share reaches DECIDE. An empty table stays empty.
    """
    model, at = fit(*training_rows(docs, labels)), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scored(batch.column(at).to_pylist(), model) < DECIDE))

    return small_batches(docs).mapInArrow(tidy(keep), docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_toxicity(docs, fit(*training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))))
