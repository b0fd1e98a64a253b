"""Language ID by a linear-chain conditional random field over the words of a text.

Affixes, letter n-grams and lexicons score each word for each language, learned transitions tie neighbours, and
forward-backward gives each word's distribution; a text's language is the one that holds most of its words.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chain import forward_backward
from .common import bounded_chunks, collect_labelled, id_bucket, plain_words, small_batches, tidy

#: The field is fitted on so many segments of labelled documents at most, of so many characters, and on so many of each
#: language at least, where it has them.
TRAIN_ROWS, TRAIN_CHARS, LEAST_ROWS = 2000, 20_000, 25
HASHED = 2**17
AFFIXES = (2, 3, 4)
#: Words whose scores a task keeps; then it starts anew.
CACHED = 200_000
#: Bytes of words whose n-grams are hashed at once.
BYTES_AT_ONCE = 1_000_000
#: A word is known if it is in a lexicon or so large a part of its n-grams and affixes has been learned.
KNOWN = 0.6
UNKNOWN = "und"
FIELDS = "doc_id long, held_out boolean, lang_pred string, score double"


def has_letter(word: bytes) -> bool:
    return any(c.isalpha() for c in word.decode("utf-8", "replace"))


def _hash(tag: int, letters: Iterable[np.ndarray]) -> np.ndarray:
    h = np.uint64(tag)
    for x in letters:
        h = (h ^ x) * np.uint64(0x100000001B3)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % HASHED


def features(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the word, weight row) of each word's bigrams and trigrams, with its ends marked, and its affixes.

    Words stand one after the other in one run of bytes, which is hashed in pieces: what it takes grows with the bytes alone.
    """
    size = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8)
    ends = np.cumsum(size + 2)
    for lo in range(0, len(letters), BYTES_AT_ONCE):
        at = np.arange(lo, min(lo + BYTES_AT_ONCE, len(letters)))
        of = np.searchsorted(ends, at, "right")
        part = letters[lo : at[-1] + 4].astype(np.uint64)
        for k in (2, 3):
            inside = np.flatnonzero(at + k <= ends[of])
            yield of[inside], _hash(k, (part[inside + j] for j in range(k)))
    begin = ends - size - 1
    for k in AFFIXES:
        long = np.flatnonzero(size >= k)
        for tag, first in ((10, begin[long]), (20, begin[long] + size[long] - k)):
            yield long, _hash(tag + k, (letters[first + j].astype(np.uint64) for j in range(k)))


def marginals(scores: np.ndarray, ids: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place's distribution over labels [place, label], and the expected transitions, of sequences of words with those
    scores [word, label] that follow each other in `ids`. Sequences are never cut: a line's words all bear on each other."""
    if not len(ids):
        return np.zeros((0, scores.shape[1])), np.zeros_like(transition)
    e = np.exp((scores - scores.max(axis=1, keepdims=True)).astype(np.float64))
    found = forward_backward(np.ascontiguousarray(e.T), ids, lengths, np.ones(len(transition)), np.exp(transition), True)
    out = np.empty((len(ids), len(transition)))
    out[found.source] = found.states.T
    return out, found.pairs


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray  # [HASHED, language]
    lexicon: dict[bytes, int]  # word -> language
    lexical: np.ndarray  # [language of the lexicon, language]
    transition: np.ndarray

    def scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Scores [word, language], and whether each word is known."""
        out, n, seen = np.zeros((len(words), len(self.languages))), np.zeros(len(words)), np.zeros(len(words))
        learned = self.weights.any(axis=1)
        for of, rows in features(words):
            for k in range(out.shape[1]):
                out[:, k] += np.bincount(of, self.weights[rows, k], minlength=len(words))
            n += np.bincount(of, minlength=len(words))
            seen += np.bincount(of, learned[rows], minlength=len(words))
        told = np.array([self.lexicon.get(w, -1) for w in words], np.int64)
        out[told >= 0] += self.lexical[told[told >= 0]]
        return out, (told >= 0) | (seen >= KNOWN * n)


def fit(texts: list[str], languages: list[str], epochs: int = 10, seed: int = 6) -> Field:
    """Maximise the likelihood of the labels by stochastic gradients.

    Every word of a text is labelled with the text's language; to learn transitions, half of the sequences are
    put together from short pieces of two or three texts. The lexicon of a language holds the words that two of its texts have and no other language's.
    """
    names = sorted(set(languages))
    n = len(names)
    rng = np.random.default_rng(seed)
    docs = [([w for w in plain_words(t) if has_letter(w)], names.index(g)) for t, g in zip(texts, languages, strict=True)]
    docs = [d for d in docs if d[0]]
    seen: dict[bytes, Counter] = defaultdict(Counter)
    for words, k in docs:
        for w in set(words):
            seen[w][k] += 1
    lexicon = {w: next(iter(c)) for w, c in seen.items() if len(c) == 1 and c.total() >= 2}
    field = Field(names, np.zeros((HASHED, n)), lexicon, np.zeros((n, n)), np.zeros((n, n)))
    if n < 2 or not docs:
        return field
    number = {w: i for i, w in enumerate(seen)}
    of, hashed = (np.concatenate(x) for x in zip(*features(list(number)), strict=True))
    by_word = np.argsort(of, kind="stable")
    rows = np.split(hashed[by_word], np.cumsum(np.bincount(of, minlength=len(number)))[:-1])
    in_lexicon = np.array([lexicon.get(w, -1) for w in number])
    total = {"w": np.full((HASHED, n), 1e-3), "l": np.full((n, n), 1e-3), "t": np.full((n, n), 1e-3)}
    for epoch in range(epochs):
        rate = 0.3 / (1 + 0.5 * epoch)
        for lo in range(0, len(docs), 16):
            sequences, labels = [], []
            for pieces in rng.choice((1, 2, 3), p=(0.5, 0.25, 0.25), size=16):
                part, own = [], []
                for words, k in (docs[i] for i in rng.integers(len(docs), size=pieces)):
                    size = 40 if pieces == 1 else rng.integers(2, 16)
                    s = rng.integers(max(1, len(words) - size))
                    part += words[s : s + size]
                    own += [k] * len(words[s : s + size])
                sequences.append([number[w] for w in part])
                labels.append(own)
            ids = np.array([w for x in sequences for w in x])
            y = np.array([k for x in labels for k in x])
            length = np.array([len(x) for x in sequences])
            begin = np.cumsum(length) - length
            distinct, inverse = np.unique(ids, return_inverse=True)
            lex = in_lexicon[distinct]
            score = np.stack([field.weights[rows[w]].sum(axis=0) for w in distinct])
            score[lex >= 0] += field.lexical[lex[lex >= 0]]
            g, pairs = marginals(score, inverse, length, field.transition)
            g[np.arange(len(y)), y] -= 1
            by_word = np.zeros_like(score)
            np.add.at(by_word, inverse, g)
            inner = np.ones(len(y), bool)
            inner[begin] = False
            np.add.at(pairs, (y[:-1][inner[1:]], y[1:][inner[1:]]), -1)
            touched = np.concatenate([rows[w] for w in distinct])
            change = np.zeros((HASHED, n))
            np.add.at(change, touched, np.repeat(by_word, [len(rows[w]) for w in distinct], axis=0))
            lexical = np.zeros((n, n))
            np.add.at(lexical, lex[lex >= 0], by_word[lex >= 0])
            used = np.unique(touched)
            total["w"][used] += change[used] ** 2
            field.weights[used] -= rate * change[used] / np.sqrt(total["w"][used])
            for key, gradient, values in (("l", lexical, field.lexical), ("t", pairs, field.transition)):
                total[key] += gradient**2
                values -= rate * gradient / np.sqrt(total[key])
    return field


class Labeller:
    """Labels the words of texts, and keeps the scores of words it has met."""

    def __init__(self, field: Field):
        self.field = field
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.scores = np.zeros((0, len(self.field.languages)), np.float32)
        self.known = np.zeros(0, bool)
        self.letters = np.zeros(0, bool)

    def _learn(self) -> None:
        words = list(islice(self.number, len(self.scores), None))
        if words:
            scores, known = self.field.scores(words)
            self.scores = np.concatenate((self.scores, scores.astype(np.float32)))
            self.known = np.concatenate((self.known, known))
            self.letters = np.concatenate((self.letters, [w.isalpha() or has_letter(w) for w in words]))

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, distribution over languages, whether known) of each word that has a letter. A sequence is a whole line."""
        if len(self.number) > CACHED:
            self.clear()
        number, ids, ends, owner = self.number, [], [], []
        for i, text in enumerate(texts):
            for line in (text or "").split("\n"):
                ids += [number.setdefault(w, len(number)) for w in plain_words(line)]
                ends.append(len(ids))
                owner.append(i)
        self._learn()
        held = np.array(ids, np.int64)
        line = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        lettered = self.letters[held]
        held, line = held[lettered], line[lettered]
        lengths = np.bincount(line, minlength=1)
        used, inverse = np.unique(held, return_inverse=True)
        g, _ = marginals(self.scores[used], inverse, lengths[lengths > 0], self.field.transition)
        return np.array(owner, np.int64)[line], g, self.known[held]

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (its share of the words) and share of known words of each text; UNKNOWN, 0 and 0 where no word has
        a letter."""
        if not self.field.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        owner, g, known = self.words(texts)
        mass = np.stack([np.bincount(owner, column, minlength=len(texts)) for column in g.T], axis=1)
        total, count = mass.sum(axis=1), np.bincount(owner, minlength=len(texts))
        best = mass.argmax(axis=1)
        share = mass[np.arange(len(texts)), best] / np.maximum(total, 1e-300)
        names = [self.field.languages[k] if n else UNKNOWN for k, n in zip(best, count, strict=True)]
        return names, np.minimum(np.where(count > 0, share, 0.0), 1.0), np.bincount(owner, known, minlength=len(texts)) / np.maximum(count, 1)

    def all_texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        found = [self.texts(texts[lo:hi]) for lo, hi in bounded_chunks(texts, 1_000_000)]
        parts = lambda i: np.concatenate([x[i] for x in found] or [np.zeros(0)])
        return [x for names, *_ in found for x in names], parts(1), parts(2)


def fit_on(docs: DataFrame) -> Field:
    """A field fitted on segments of documents with a known language that are not held out: TRAIN_ROWS over all languages, and
    LEAST_ROWS of each, so that rare languages are learned too."""
    known = docs.filter(F.col("lang").isNotNull() & (id_bucket("doc_id", 3) != 1)).select("doc_id", "text", "lang")
    rows = collect_labelled(known, "doc_id", "lang", TRAIN_ROWS, LEAST_ROWS, TRAIN_CHARS, "language")
    return fit([text for text, _ in rows], [lang for _, lang in rows])


def identify(docs: DataFrame, field: Field) -> DataFrame:
    """The language of every document: doc_id, held_out, lang_pred, score.

    Whole texts are labelled word by word, each from its own row; nothing shuffles. Null texts and texts without a letter
    are `und` with score 0, and so are all texts if the field knows no language; ties go to the first language by name;
    repeated rows are judged alike; a null doc_id is not held out; other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(field)
        for batch in batches:
            names, scores, _ = labeller.all_texts(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)], schema=schema)

    return small_batches(docs).select("doc_id", (id_bucket("doc_id", 3) == 1).alias("held_out"), "text").mapInArrow(tidy(label), FIELDS)


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of `docs` whose text is in a language that the field knows, with all their columns.

    A text is rejected if it is null or without a letter, or if fewer than `least` of its words are known: in a lexicon, or
    made of n-grams and affixes that were learned. That doesn't depend on how many languages there are. Repeated rows are
    judged alike; a null doc_id only keeps a row out of no sample; an empty table stays empty; without any labelled text
    nothing is known of languages, and all rows stay.
    """
    field, at = fit_on(docs), docs.columns.index("text")
    if not field.languages:
        return docs

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(field)
        for batch in batches:
            names, _, known = labeller.all_texts(batch.column(at).to_pylist())
            yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(names, known, strict=True)], pa.bool_()))

    return small_batches(docs).mapInArrow(tidy(keep), docs.schema)


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit_on(docs))
