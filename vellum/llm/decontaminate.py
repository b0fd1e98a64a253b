"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

The letters of the edit distance are words. A CGK walk reads a word sequence through a pointer that a random bit of each
step and word moves on or not; two sequences at a small edit distance fall into step again after each edit, so their
embeddings differ in few places. Samples of a few places are then locality-sensitive hashes of the edit distance.
"""

from __future__ import annotations

import functools
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_chunks, filesystem, new_path, plain_words, small_batches, tidy

SIMILARITY = 0.8
#: Items with fewer words are no evidence of leakage: they are reported, but by default no document is removed for them.
MIN_WORDS = 5
RECALL = 0.97
#: Items are searched for in blocks of about so many characters, each block in a pass of its own.
ITEMS_CHARS = 8_000_000
#: Characters of text that a task works on at once.
CHARS_AT_ONCE = 4_000_000
TABLES = 8  # samples of a walk; walks are added until the recall is reached
#: So many walks in a row that find no further copy mean that the recall is out of reach.
STALLED = 1000


def allowed(n: int, similarity: float) -> int:
    """The most word edits that leave an item of n words at that similarity."""
    return int((1 - similarity) * n + 1e-9)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cgk_samples(hashes: np.ndarray, start: np.ndarray, n: int, walk: int, places: np.ndarray) -> np.ndarray:
    """Hash of each sample of the embeddings of the windows hashes[start : start + n]: [window, table].

    `places` [table, z] are sampled steps of the walk; each of 3n steps copies the word under the pointer (0 past the end).
    """
    rng = np.random.default_rng((walk, n))
    odd = rng.integers(1, 2**63, size=3 * n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    at = start.astype(np.int64).copy()
    end = at + n
    out = np.zeros((len(start), len(places)), np.uint64)
    tables_at: dict[int, list[int]] = {}
    for t, row in enumerate(places):
        for j in row:
            tables_at.setdefault(int(j), []).append(t)
    for j in range(max(tables_at) + 1):
        if j < n:  # the pointer has made fewer steps than the window has words
            word = hashes[at]
        else:
            word = hashes[np.minimum(at, end - 1)]
            word[at >= end] = 0
        for t in tables_at.get(j, ()):
            out[:, t] = (out[:, t] ^ word) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j)
        at += ((word * odd[j]) >> np.uint64(63)).astype(np.int64)
    return out


def sample_places(n: int, walk: int, tables: int, z: int) -> np.ndarray:
    """Sampled steps: a walk makes about two steps a word, and near step 2n it reads the padding after the window."""
    rng = np.random.default_rng((7919, walk, n))
    return np.sort(rng.integers(0, max(2, 8 * n // 5), size=(tables, z)), axis=1)


def edit_distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Least edit distance of each row of a to any prefix of the row of b, where it is at most `most` (else more).

    Only the diagonals within `most` of the main one are filled, for all rows and diagonals at once: insertions, which go
    along a line of the table, are a running minimum.
    """
    rows, n = a.shape
    width, far = 2 * most + 1, n + 2 * most + 1
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    step = np.arange(width, dtype=np.int32)[:, None]
    band = np.full((width + 1, rows), far, np.int32)  # the last line stays far
    band[most:width] = step[: most + 1]
    for i in range(1, n + 1):
        lo, hi = max(0, most - i + 1), min(width, len(b) - i + most + 1)  # diagonals with a word of b
        new = np.full_like(band, far)
        if lo:
            new[lo - 1] = i
        np.minimum(band[lo:hi] + (b[i + lo - most - 1 : i + hi - most - 1] != a[i - 1]), band[lo + 1 : hi + 1] + 1, out=new[lo:hi])
        first = max(0, lo - 1)
        new[first:hi] = np.minimum.accumulate(new[first:hi] - step[first:hi]) + step[first:hi]
        band = new
    return band.min(axis=0)


def best_run(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """(edits, first place) of the run of `region` with the fewest edits to the item, the first of them.

    The table of edit distances is filled from the ends, with all places where a run may end at no cost, so that its last row
    holds the least edits for each place where a run may start.
    """
    back = region[::-1]
    step = np.arange(len(back) + 1)
    row = np.zeros(len(back) + 1, np.int64)
    for i, word in enumerate(item[::-1], 1):
        new = np.minimum(row + 1, i)
        new[1:] = np.minimum(new[1:], row[:-1] + (back != word))
        row = np.minimum.accumulate(new - step) + step
    starts = row[::-1]
    return int(starts.min()), int(starts.argmin())


@dataclass
class Words:
    """By word number, 0 for words of no item: hash, weight, and the most times that an item holds the word."""

    hashes: np.ndarray
    weights: np.ndarray
    most_held: np.ndarray


@dataclass
class Items:
    """Benchmark items of one length with their samples."""

    n: int
    most: int
    ids: np.ndarray
    words: np.ndarray  # [item, n], word numbers from 1
    least: float  # weight of words that a match holds at least
    walks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # places, sorted samples [table, item], item of each


def _edited(words: np.ndarray, edits: int, rng: np.random.Generator, fresh: int) -> np.ndarray:
    x = list(words)
    for _ in range(edits):
        kind, p = rng.integers(3), int(rng.integers(max(1, len(x))))
        if kind == 0 and x:
            x[p] = fresh
        elif kind == 1 and len(x) > 1:
            del x[p]
        else:
            x.insert(p, fresh)
    return np.array((x + [0] * len(words))[: len(words)])


def repetitions(words: np.ndarray, hashes: np.ndarray, most: int, z: int, recall: float) -> int:
    """Walks (of TABLES samples each) after which items with `most` random edits are found with this recall.

    Measured on edited copies of the items themselves, 200 of them; an error where the recall is out of reach.
    """
    n = words.shape[1]
    rng = np.random.default_rng((104729, n))
    pick = rng.integers(len(words), size=200)
    copies = np.stack([_edited(words[i], most, rng, 0) for i in pick])
    flat = lambda w: (hashes[w].ravel(), np.arange(len(w)) * n)
    hit, walks, last = np.zeros(len(pick), bool), 0, 0  # last: walks after which a copy was found last
    while not walks or hit.mean() < recall:
        if walks - last >= STALLED:
            raise RuntimeError(f"recall {recall} of items of {n} words with {most} edits is out of reach: {hit.mean():.3f} after {walks} walks")
        places = sample_places(n, walks, TABLES, z)
        left = np.flatnonzero(~hit)
        found = (cgk_samples(*flat(words[pick[left]]), n, walks, places) == cgk_samples(*flat(copies[left]), n, walks, places)).any(axis=1)
        hit[left[found]] = True
        walks += 1
        last = walks if found.any() else last
    return walks


def build_index(rows: list[tuple[int, str]], similarity: float, recall: float, fewest: int = 1) -> tuple[dict[bytes, int], Words, list[Items]]:
    """Vocabulary of the items, what is known of each word number, and the items of `fewest` words or more by length.

    A word weighs more the fewer of the items' words it is; a word of no item weighs nothing. A match leaves out or changes
    `most` words of its item, so it holds the item's weight but for its `most` heaviest words.
    """
    vocabulary: dict[bytes, int] = {}
    by_length: dict[int, list[tuple[int, list[int]]]] = {}
    for item, text in rows:
        words = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in plain_words(text)]
        if len(words) >= max(1, fewest):
            by_length.setdefault(len(words), []).append((item, words))
    hashes = _mix(np.arange(len(vocabulary) + 1, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    counts = np.bincount([w for held in by_length.values() for _, words in held for w in words], minlength=len(vocabulary) + 1)
    weights = np.maximum(0, np.log2(np.maximum(counts.sum(), 1) / np.maximum(counts, 1)) - 8).astype(np.float32)
    weights[0] = 0
    most_held = np.zeros(len(counts), np.int64)
    for held in by_length.values():
        for _, words in held:
            u, c = np.unique(words, return_counts=True)
            most_held[u] = np.maximum(most_held[u], c)
    found = []
    for n, held in sorted(by_length.items()):
        words = np.array([w for _, w in held])
        most = allowed(n, similarity)
        z = 2 if most else 3
        walks = []
        for walk in range(repetitions(words, hashes, most, z, recall)):
            places = sample_places(n, walk, TABLES, z)
            samples = cgk_samples(hashes[words].ravel(), np.arange(len(words)) * n, n, walk, places).T
            order = np.argsort(samples, axis=1, kind="stable")
            walks.append((places, np.take_along_axis(samples, order, 1), order))
        least = float(np.sort(weights[words], axis=1)[:, : n - most].sum(axis=1).min())
        found.append(Items(n, most, np.array([i for i, _ in held], object), words, least, walks))
    return vocabulary, Words(hashes, weights, most_held), found


class _Text:
    """Numbered words with what finds windows that can match.

    In a run of one word, no match uses more of it than an item holds at most; from there on the run's words count as
    others. Running sums hold others and weights; for a window that starts inside a run, the rest of that run counts anew.
    """

    def __init__(self, held: np.ndarray, weights: np.ndarray, most_held: np.ndarray, reach: int):
        self.held = held
        heads = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
        lengths = np.diff(np.append(heads, len(held)))
        useful = (held != 0) & (np.arange(len(held)) - np.repeat(heads, lengths) < most_held[held])
        self.others = np.concatenate(([0], np.cumsum(~useful, dtype=np.int32)))
        self.weight = np.concatenate(([0], np.cumsum(np.where(useful, weights[held], 0), dtype=np.float64)))
        self.at = np.flatnonzero(held[: len(held) - reach] != 0).astype(np.int32)  # a best match starts with a word of the items
        self.run_end = np.repeat(heads + lengths, lengths)[self.at].astype(np.int32)
        self.most_held = most_held[held[self.at]].astype(np.int32)
        self.own = weights[held[self.at]]

    def windows(self, items: Items) -> np.ndarray:
        """Starts where at most `most` of n words are others, for each costs an edit, and n + most words weigh enough."""
        end = self.at + np.int32(items.n)
        run = np.minimum(self.run_end, end)
        excess = np.maximum(run - self.at - self.most_held, 0)
        k = np.flatnonzero(excess + self.others[end] - self.others[run] <= items.most)
        at = self.at[k]
        end = at + np.int32(items.n + items.most)
        run = np.minimum(self.run_end[k], end)
        weight = np.minimum(run - at, self.most_held[k]) * self.own[k] + self.weight[end] - self.weight[run]
        return at[weight >= items.least - 1e-3]


def _candidates(values: np.ndarray, start: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Windows and items that share a sample in some table."""
    pairs = []
    for lo in range(0, len(start), 200_000):
        part = start[lo : lo + 200_000]
        for walk, (places, samples, order) in enumerate(items.walks):
            keys = cgk_samples(values, part, items.n, walk, places)
            for t in range(len(places)):
                left = np.searchsorted(samples[t], keys[:, t], "left")
                right = np.searchsorted(samples[t], keys[:, t], "right")
                hits = np.flatnonzero(right > left)
                if len(hits):
                    count = right[hits] - left[hits]
                    of = np.repeat(hits, count)
                    step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                    pairs.append((part[of] * len(items.ids)) + order[t][np.repeat(left[hits], count) + step])
        if len(pairs) > 64:
            pairs = [np.unique(np.concatenate(pairs))]
    if not pairs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    both = np.unique(np.concatenate(pairs))
    return both // len(items.ids), both % len(items.ids)


def _search(texts: list[str | None], vocabulary: dict[bytes, int], known: Words, found: list[Items]) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, distance, words of the item, first word) of the best match of each item in each text."""
    longest = max(x.n + x.most for x in found)
    gap, get = [0] * longest, vocabulary.get
    numbers: list[int] = []
    begin = []
    for text in texts:
        begin.append(len(numbers))
        numbers += [get(w, 0) for w in plain_words(text)]
        numbers += gap  # a window may reach past the end of its text, where nothing matches
    held, begin = np.array(numbers, np.int32), np.array(begin)
    values = known.hashes[held]
    text = _Text(held, known.weights, known.most_held, longest)
    for items in found:
        start = text.windows(items)
        if not len(start):
            continue
        at, of = _candidates(values, start, items)
        hits: dict[tuple[int, int], list[int]] = {}
        for lo in range(0, len(at), 50_000):
            s, i = at[lo : lo + 50_000], of[lo : lo + 50_000]
            b = held[s[:, None] + np.arange(items.n + items.most)]
            for k in np.flatnonzero(edit_distances(items.words[i], b, items.most) <= items.most).tolist():
                hits.setdefault((int(np.searchsorted(begin, s[k], "right")) - 1, int(i[k])), []).append(int(s[k]))
        for (row, i), starts in sorted(hits.items()):
            d, s = min(_best_near(held, begin, row, items, i, part) for part in np.split(starts, np.flatnonzero(np.diff(starts) > items.n) + 1))
            yield row, items.ids[i], d, items.n, s


def _best_near(held: np.ndarray, begin: np.ndarray, row: int, items: Items, i: int, starts: np.ndarray) -> tuple[int, int]:
    """(distance, first word) of the best run around windows of a text that match an item, exactly."""
    lo, end = max(int(begin[row]), int(starts[0]) - items.n), begin[row + 1] if row + 1 < len(begin) else len(held)
    d, at = best_run(items.words[i], held[lo : min(int(starts[-1]) + 2 * items.n, end)])
    return d, lo + at - int(begin[row])


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Benchmark items found in documents: doc_id, item_id, distance, item_words, start_word, similarity.

    A document holds an item if some run of its words is within `(1 - similarity) * item words` word edits of the whole
    item; its best such run (fewest edits, then first) is reported, one row for each document row and item. Words are
    lower-cased, with ASCII punctuation as space. Windows of each item length over whole texts are embedded by CGK walks,
    and samples of the embeddings looked up in the items' tables; walks are added until edited copies of the items are
    found with `recall`; every candidate is verified exactly. Windows are skipped only where they cannot match: where more
    words than the allowed edits occur in no item. The benchmark is indexed in blocks of ITEMS_CHARS characters, each of which
    makes a pass over the documents; documents never move between tasks. Null and empty texts hold nothing; null items
    and those without a word are never reported, and the shortest are reported where they occur word for word, as they allow
    no edit; equal items and repeated rows are each reported; ids of any type are carried, null ones too; other columns are
    ignored.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    items = dict(benchmark.dtypes)["item_id"]
    found = f"doc_id {kind}, item_id {items}, distance int, item_words int, start_word int"
    out = None
    for path in write_indexes(benchmark, similarity, recall):
        part = small_batches(docs).select("doc_id", "text").mapInArrow(tidy(_searcher(path)), found)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], found)
    return out.withColumn("similarity", 1 - F.col("distance") / F.col("item_words"))


def write_indexes(benchmark: DataFrame, similarity: float, recall: float, fewest: int = 1) -> list[str]:
    """Indexes of blocks of the benchmark as files in the shared folder, made by the tasks that read the blocks.

    The driver gets the files' names alone, one for each ITEMS_CHARS characters or task; a task that searches holds one index.
    """
    folder = new_path(benchmark.sparkSession, "benchmark")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple[int, str]] = []
        size = 0

        def written() -> pa.RecordBatch:
            index = build_index(block, similarity, recall, fewest)
            path = f"{folder}/{uuid.uuid4().hex}" if index[-1] else None
            if path:
                store, at = filesystem(path)
                store.create_dir(at.rpartition("/")[0], recursive=True)
                with store.open_output_stream(at, compression=None) as out:
                    pickle.dump(index, out)
            return pa.RecordBatch.from_arrays([pa.array([path], pa.string())], names=["path"])

        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block.append((item, text))
                size += len(text)
                if size > ITEMS_CHARS:
                    yield written()
                    block, size = [], 0
        if block:
            yield written()

    items = benchmark.select("item_id", "text").where("text IS NOT NULL").coalesce(8)
    return sorted(r["path"] for r in small_batches(items).mapInArrow(tidy(make), "path string").collect() if r["path"])


@functools.lru_cache(maxsize=1)
def _index(path: str) -> tuple:
    """The index of a file, kept as long as the worker searches for the same one."""
    store, at = filesystem(path)
    with store.open_input_file(at) as file:
        return pickle.loads(file.read())


def _searcher(path: str):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in bounded_chunks(texts, CHARS_AT_ONCE):
                rows = list(_search(texts[lo:hi], *_index(path)))
                if rows:
                    at, items, *rest = zip(*rows, strict=True)
                    columns = [ids.take(pa.array([lo + i for i in at])), pa.array(items), *[pa.array(x, pa.int32()) for x in rest]]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "distance", "item_words", "start_word"])

    return search


def remove_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, fewest: int = MIN_WORDS) -> DataFrame:
    """The rows of `docs` in which find_leaks() finds no item of `fewest` words or more, with all their columns: each is judged
    alone, nothing shuffles. Null and empty texts and repeated rows of clean texts stay; an empty benchmark removes nothing, an
    empty table stays empty; ids are not read."""
    text_at = docs.columns.index("text")

    def keep(path: str):
        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, clean = batch.column(text_at).to_pylist(), np.ones(batch.num_rows, bool)
                for lo, hi in bounded_chunks(texts, CHARS_AT_ONCE):
                    clean[[lo + r[0] for r in _search(texts[lo:hi], *_index(path))]] = False
                yield batch.filter(pa.array(clean))

        return kept

    for path in write_indexes(benchmark, similarity, recall, fewest):
        docs = small_batches(docs).mapInArrow(tidy(keep(path)), docs.schema)
    return docs


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
