"""A hidden Markov language model over words.

Latent states are trained by Baum-Welch steps over all documents: in each, every block of documents counts what its words
and transitions expect, and the counts are put together over all blocks. The scaled forward recursion then gives each text's
exact likelihood.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chain import forward_backward
from .common import collect_segments, drop_table, dropped_shuffles, id_bucket, new_path, small_batches, tidy, tidy_groups, words_of, write_table
from .exchange import aligned, answer, bucket_count, pack_ids, requests, unpack_ids

STATES = 4
#: Where Baum-Welch over the corpus starts is found on so many segments of training documents at most, of so many characters.
START_ROWS, START_CHARS, START_STEPS = 2000, 20_000, 15
#: Steps over all training documents end when one gains less than this in the log likelihood of a word (in nats).
TOLERANCE = 0.01
#: Documents of a block have about so many words together.
BLOCK_TOKENS = 3_000_000
#: Each state's emissions are smoothed with the unigram model, as if it had dealt so many words for each distinct word.
SMOOTHING = 2.0
#: A pass of forward-backward takes documents of about so many words together.
PASS_TOKENS = 200_000
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, known_mass double, score_mass double"
END = b""


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


@dataclass
class Counts:
    """Expected counts: of words in states, of transitions, of first states."""

    words: np.ndarray
    pairs: np.ndarray
    starts: np.ndarray


def recursion(ids: np.ndarray, lengths: np.ndarray, emission: np.ndarray, start: np.ndarray, transition: np.ndarray, count: bool = False) -> tuple[np.ndarray, Counts | None]:
    """Log likelihood of each sequence by the scaled forward recursion, and the expected counts by forward-backward.

    `emission` [word, state] may be scaled by any factor of a word.
    """
    found = forward_backward(np.ascontiguousarray(emission.T), ids, lengths, start, transition, count)
    if not count:
        return found.likelihood, None
    told = ids[found.source]
    words = np.stack([np.bincount(told, x, minlength=len(emission)) for x in found.states], axis=1)
    first = np.zeros(len(ids), bool)
    first[np.cumsum(lengths) - lengths] = True
    return found.likelihood, Counts(words, found.pairs, found.states[:, first[found.source]].sum(axis=1))


@dataclass
class Start:
    """Where Baum-Welch over the corpus starts: states, and the emissions of some words, relative to all states'."""

    start: np.ndarray
    transition: np.ndarray
    relative: dict[bytes, np.ndarray]


def fit_start(texts: list[str], states: int = STATES, seed: int = 2) -> Start:
    """States fitted on a sample: documents are first told apart by a mixture of unigrams, then Baum-Welch steps follow."""
    rng = np.random.default_rng(seed)
    docs = [[*words_of(t), END] for t in texts]
    if 0 < len(docs) < states:  # too few to tell states apart by
        size = max(1, sum(map(len, docs)) // (4 * states))
        docs = [d[i : i + size] for d in docs for i in range(0, len(d), size)]
    seen = Counter(w for d in docs for w in d)
    known = [w for w, c in sorted(seen.items()) if c >= 3] or sorted(seen)
    uniform = np.full(states, 1 / states)
    if not docs:
        return Start(uniform, np.full((states, states), 1 / states), {})
    number = {w: i + 1 for i, w in enumerate(known)}  # 0: any other word
    coded = [np.array([number.get(w, 0) for w in d]) for d in docs]
    ids, lengths = np.concatenate(coded), np.array([len(c) for c in coded])
    of = np.repeat(np.arange(len(docs)), lengths)
    total = np.bincount(ids, minlength=len(known) + 1) + 1.0
    total /= total.sum()
    part = rng.dirichlet(np.full(states, 0.3), len(docs))
    for _ in range(20):
        words = np.stack([np.bincount(ids, part[of, k], minlength=len(total)) for k in range(states)], axis=1) + 20 * total[:, None]
        log = np.log(words / words.sum(axis=0)) - np.log(total)[:, None]
        fit = np.stack([np.bincount(of, log[ids, k], minlength=len(docs)) for k in range(states)], axis=1)
        fit += np.log(part.mean(axis=0) + 1e-9)
        part = np.exp(np.maximum(fit - fit.max(axis=1, keepdims=True), -50))
        part = _scaled(part)
    emission = words / words.sum(axis=0) / total[:, None]
    transition = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
    begin = _scaled(part.mean(axis=0) + 1e-3)
    for _ in range(START_STEPS):
        _, c = recursion(ids, lengths, emission, begin, _scaled(transition), count=True)
        words = c.words + 20 * total[:, None]
        emission = words / words.sum(axis=0) / total[:, None]
        transition, begin = _scaled(c.pairs + 0.1), _scaled(c.starts + 0.1)
    return Start(begin, transition, {w: emission[i] for w, i in number.items()})


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _block(rows: list[tuple[int | None, bool, str | None]], start: Start, block: int) -> dict:
    """A row of the table of blocks: documents as numbers of their words, the words' keys, and the counts of its training part."""
    number: dict[bytes, int] = {END: 0}
    coded = []
    for _, _, text in rows:
        coded.append(np.array([number.setdefault(w, len(number)) for w in words_of(text)] + [0], np.int32))
    lengths = np.array([len(c) for c in coded])
    emission = np.ones((len(number), len(start.start)))
    for i, w in enumerate(number):
        if (r := start.relative.get(w)) is not None:
            emission[i] = r
    held, ids = [h for _, h, _ in rows], np.concatenate(coded)
    del coded
    return {
        "block": block,
        "doc_ids": [i for i, _, _ in rows],
        "held": held,
        "lengths": lengths.astype(np.int32).tobytes(),
        "ids": pack_ids(ids),
        "keys": np.array([_hash(w) for w in number], np.uint64).tobytes(),
    } | _expected(ids, lengths, held, emission, start.start, start.transition)


def _parts(ids: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, end, words) of documents that have about PASS_TOKENS words together."""
    ends, lo = np.cumsum(lengths), 0
    while lo < len(lengths):
        begin = ends[lo] - lengths[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, begin + PASS_TOKENS, "right")))
        yield lo, hi, ids[begin : ends[hi - 1]]
        lo = hi


def _expected(ids: np.ndarray, lengths: np.ndarray, held: list[bool], emission: np.ndarray, start: np.ndarray, transition: np.ndarray) -> dict:
    """The counts that the training part of a block expects, and its log likelihood."""
    k, trained = len(start), ~np.array(held, bool)
    totals, pairs, starts, likelihood = np.zeros((len(emission), k)), np.zeros((k, k)), np.zeros(k), 0.0
    counts = np.zeros(len(emission), np.uint32)
    for lo, hi, part in _parts(ids, lengths):
        size, use = lengths[lo:hi], trained[lo:hi]
        if use.any():
            part = part[np.repeat(use, size)]
            logs, c = recursion(part, size[use], emission, start, transition, count=True)
            likelihood += logs.sum()
            totals += c.words
            pairs += c.pairs
            starts += c.starts
            counts += np.bincount(part, minlength=len(emission)).astype(np.uint32)
    shares = (totals[:, :-1] / np.maximum(counts, 1)[:, None]).astype(np.float32)
    by_state = np.append(totals[:, :-1].sum(axis=0), counts.sum() - totals[:, :-1].sum())
    return {
        "n_keys": len(emission),
        "counts": counts.tobytes(),
        "shares": shares.tobytes(),
        "tokens": int(counts.sum()),
        "likelihood": float(likelihood),
        "by_state": by_state.tolist(),
        "pairs": pairs.ravel().tolist(),
        "starts": starts.tolist(),
    }


#: What stays of a block: documents as numbers of words, and the words' keys.
TEXTS = {"block": "long", "doc_ids": "array<long>", "held": "array<boolean>", "lengths": "binary", "ids": "binary", "keys": "binary"}
#: What a step finds of a block, with the keys that it is about.
FOUND = {
    "block": "long", "n_keys": "long", "keys": "binary", "counts": "binary", "shares": "binary", "tokens": "long", "likelihood": "double",
    "by_state": "array<double>", "pairs": "array<double>", "starts": "array<double>",
}
_ARROW = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<double>": pa.list_(pa.float64())}


def _schemas(columns: dict[str, str]) -> tuple[pa.Schema, str]:
    return pa.schema([(c, _ARROW[t]) for c, t in columns.items()]), ", ".join(f"{c} {t}" for c, t in columns.items())


BLOCKS, BLOCKS_SQL = _schemas(TEXTS | FOUND)
STEP, STEP_SQL = _schemas(FOUND)


def expect(docs: DataFrame, start: Start) -> DataFrame:
    """The table of blocks of `docs` (doc_id, held_out, text), with the expected counts of each block."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, rows, size = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                size += len(row[2] or "") // 6 + 1
                if size >= BLOCK_TOKENS:
                    yield pa.RecordBatch.from_pylist([_block(rows, start, base + made)], schema=BLOCKS)
                    made, rows, size = made + 1, [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([_block(rows, start, base + made)], schema=BLOCKS)

    return small_batches(docs).mapInArrow(tidy(blocks), BLOCKS_SQL)


@dataclass
class Model:
    start: np.ndarray
    transition: np.ndarray
    by_state: np.ndarray  # words counted in each state
    tokens: int
    types: int

    def emission(self, counts: np.ndarray, in_state: np.ndarray) -> np.ndarray:
        """Emissions of words over their unigram probabilities: [word, state]."""
        unigram = (counts + 1) / (self.tokens + self.types + 1)
        dealt = 1 + SMOOTHING * self.types * self.by_state / max(1, self.tokens)
        return (in_state / unigram[:, None] + dealt) / (self.by_state + dealt)


def maximise(blocks: DataFrame, types: int, states: int = STATES) -> Model:
    """The model that the counts of all blocks make."""
    total = lambda c, n: [F.coalesce(F.sum(F.col(c)[i]), F.lit(0.0)) for i in range(n)]
    row = list(blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), *total("by_state", states), *total("pairs", states**2), *total("starts", states)).first())
    by_state, pairs, starts = np.array(row[1 : 1 + states]), np.array(row[1 + states : 1 + states + states**2]), np.array(row[1 + states + states**2 :])
    return Model(_scaled(starts + 0.1), _scaled(pairs.reshape(states, states) + 0.1), np.maximum(by_state, 0), int(row[0]), types)


def count_types(blocks: DataFrame, buckets: int) -> int:
    """Distinct words of all training documents."""

    def trained(row: dict) -> tuple[int, np.ndarray, list[np.ndarray]]:
        return row["block"], np.frombuffer(row["keys"], np.uint64)[np.frombuffer(row["counts"], np.uint32) > 0], []

    def distinct(table: pa.Table) -> pa.Table:
        n = len(np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()])))
        return pa.table({"n": pa.array([n], pa.int64())})

    asked = requests(blocks, buckets, trained, ["block", "keys", "counts"], 0)
    return asked.groupBy("bucket").applyInArrow(distinct, "n long").agg(F.sum("n")).first()[0] or 0


def _emission(row: dict, answers: pa.Table, model: Model, buckets: int, states: int) -> tuple[np.ndarray, np.ndarray]:
    """The corpus's counts of a block's words, and their emissions."""
    keys = np.frombuffer(row["keys"], np.uint64)
    counts = aligned(answers, keys, buckets, "answer_0", np.uint64).astype(np.float64)
    in_state = aligned(answers, keys, buckets, "answer_1", np.float32, states - 1).astype(np.float64).reshape(len(keys), -1)
    in_state = np.concatenate((in_state, np.maximum(0, counts - in_state.sum(axis=1))[:, None]), axis=1)
    return counts, model.emission(counts, in_state)


def _coded(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return unpack_ids(row["ids"]), np.frombuffer(row["lengths"], np.int32).astype(np.int64)


def _stepper(model: Model, buckets: int, states: int):
    """A step of Baum-Welch in a block: what its documents expect of the model."""

    def step(block: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for row in block.to_pylist():
            _, emission = _emission(row, answers, model, buckets, states)
            rows.append({"block": row["block"], "keys": row["keys"]} | _expected(*_coded(row), row["held"], emission, model.start, model.transition))
        return pa.Table.from_pylist(rows, schema=STEP)

    return step


def _scorer(model: Model, buckets: int, states: int):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("known_mass", pa.float64()), ("score_mass", pa.float64())])

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in block.to_pylist():
            counts, emission = _emission(row, answers, model, buckets, states)
            unigram = np.log10((counts + 1) / (model.tokens + model.types + 1))
            ids, lengths = _coded(row)
            for lo, hi, part in _parts(ids, lengths):
                size = lengths[lo:hi]
                of = np.repeat(np.arange(len(size)), size)
                log, _ = recursion(part, size, emission, model.start, model.transition)
                base = np.bincount(of, unigram[part], minlength=len(size))
                known = np.bincount(of, counts[part] > 0, minlength=len(size))
                out.append(pa.table([pa.array(row["doc_ids"][lo:hi], pa.int64()), pa.array(row["held"][lo:hi]), pa.array(size), pa.array(known.astype(np.int64)), pa.array(base), pa.array(base + log / np.log(10))], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return score


def _answers(blocks: DataFrame, buckets: int) -> DataFrame:
    """What all blocks together count of each block's words: times, and times in each state but the last."""

    def counted(row: dict) -> tuple[int, np.ndarray, list[np.ndarray]]:
        n = row["n_keys"]
        return row["block"], np.frombuffer(row["keys"], np.uint64), [np.frombuffer(row["counts"], np.uint32), np.frombuffer(row["shares"], np.float32).reshape(n, -1)]

    def total(distinct: np.ndarray, number: np.ndarray, sent: list[list[bytes]]) -> list[np.ndarray]:
        c = np.frombuffer(b"".join(sent[0]), np.uint32).astype(np.float64)
        share = np.frombuffer(b"".join(sent[1]), np.float32).reshape(len(c), -1).astype(np.float64)
        in_state = np.stack([np.bincount(number, c * s, minlength=len(distinct)) for s in share.T], axis=1) if share.shape[1] else share
        return [np.bincount(number, c, minlength=len(distinct)).astype(np.uint64), in_state.astype(np.float32)]

    return answer(requests(blocks, buckets, counted, ["block", "n_keys", "keys", "counts", "shares"], 2), total, 2, 2)


def _meet(texts: DataFrame, answers: DataFrame, task, schema: str) -> DataFrame:
    """`task` of each block's texts and what all blocks together found of its words."""
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tidy_groups(task), schema)


def train(rows: DataFrame, start: Start, states: int = STATES) -> tuple[DataFrame, DataFrame, Model, int]:
    """Baum-Welch over all training documents: the blocks' texts, what all of them together found of each block's words in
    the last step, its model, and the number of buckets.

    Steps follow each other until one gains less than TOLERANCE. Texts are coded and written once. A step writes what it found
    of the blocks' words, and then the answers for each block; each table, and the shuffle files of each query, are dropped
    when the next one is written.
    """
    spark, options = rows.sparkSession, {"parquet.block.size": "8388608"}

    def written(df: DataFrame, old: str | None) -> tuple[DataFrame, str]:
        path = new_path(spark, "hmm-step")
        table = write_table(df, path, **options)
        if old:
            drop_table(spark, old)
        return table, path

    with dropped_shuffles(spark):
        found = write_table(expect(rows, start), new_path(spark, "hmm-texts"), **options)
        texts = found.select(*TEXTS)
        buckets = bucket_count(found)
        types = count_types(found, buckets)
        model, before = maximise(found, types, states), -np.inf
        answers, path = written(_answers(found, buckets), None)
        while model.tokens:
            found, path = written(_meet(texts, answers, _stepper(model, buckets, states), STEP_SQL), path)
            now = found.agg(F.sum("likelihood")).first()[0] / model.tokens  # of the model that the step started with
            model = maximise(found, types, states)
            answers, path = written(_answers(found, buckets), path)
            if now - before < TOLERANCE:
                break
            before = now
    return texts, answers, model, buckets


def score_documents(docs: DataFrame, states: int = STATES) -> DataFrame:
    """Score every text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Words are lower-cased in A-Z and parted by ASCII white space; each text ends with an end token. Training documents are
    those whose crc32(doc_id as text) modulo 7 is not 2. All of them are counted in every step of Baum-Welch: words, and the
    expected counts of words in states, transitions and first states; steps end when they gain less than TOLERANCE.
    base_score is the unigram model with one added to each count; score is log10 of the text's probability in the hidden
    Markov model, whose states' emissions are smoothed with the unigram's.
    Null and empty texts are the end token alone; without training documents both scores are of the empty model; repeated
    rows count as often as they are there; other columns are not read. Words are known by 64-bit hashes.

    Tokens never shuffle: each block of documents sends its distinct words with their counts to buckets and gets the
    corpus's back.
    """
    rows = docs.select("doc_id", (id_bucket("doc_id", 7) == 2).alias("held_out"), "text")
    start = fit_start(collect_segments(rows.filter(~F.col("held_out")), "doc_id", START_ROWS, START_CHARS, "hmm"), states)
    texts, answers, model, buckets = train(rows, start, states)
    scored = _meet(texts, answers, _scorer(model, buckets, states), SCORES)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.col("known_mass").alias("base_score"), F.col("score_mass").alias("score"), F.pow(F.lit(10.0), -F.col("score_mass") / F.col("n_tokens")).alias("perplexity"),
    )


def op2_hmm(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
