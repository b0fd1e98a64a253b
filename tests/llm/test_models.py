"""Operators that learn: the language model, toxicity, language ID."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.compute  # noqa: F401
import pytest

from vellum.llm import chain, hmm, langid, toxicity
from vellum.llm.common import words_of

DOCS = "doc_id long, text string, lang string, source string, score string"
TONGUES = {
    "en": "the of and to house river stone walking under their small".split(),
    "de": "der die und nicht haus fluss stein gehen unter ihre klein".split(),
    "fr": "le les et dans maison rivière pierre marcher sous leur petit".split(),
}


def texts(n, seed=0, insult=0.0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(TONGUES))
        w = [rng.choice(TONGUES[lang]) for _ in range(rng.randint(20, 60))]
        bad = rng.random() < insult
        if bad:
            w[rng.randrange(len(w))] = {"en": "scumbag", "de": "mistkerl", "fr": "connard"}[lang]
        rows.append((i, " ".join(w), lang, "s", "x", bad))
    return rows


# hidden Markov model


def test_recursion_is_the_plain_one_over_cuts(monkeypatch):
    monkeypatch.setattr(chain, "SEGMENT", 7)
    rng = np.random.default_rng(0)
    k, v = 3, 12
    emission, start, move = rng.random((v, k)), rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k)
    lengths = np.array([1, 7, 8, 14, 40, 3])
    ids = rng.integers(v, size=lengths.sum())
    likelihood, counts = hmm.recursion(ids, lengths, emission, start, move, count=True)
    words, pairs, at = np.zeros((v, k)), np.zeros((k, k)), 0
    for i, n in enumerate(lengths):
        x = ids[at : at + n]
        at += n
        a, b = np.zeros((n, k)), np.ones((n, k))
        a[0] = start * emission[x[0]]
        for t in range(1, n):
            a[t] = (a[t - 1] @ move) * emission[x[t]]
        for t in range(n - 2, -1, -1):
            b[t] = move @ (emission[x[t + 1]] * b[t + 1])
        p = a[-1].sum()
        assert likelihood[i] == pytest.approx(math.log(p))
        for t in range(n):
            words[x[t]] += a[t] * b[t] / p
        for t in range(n - 1):
            pairs += a[t][:, None] * move * (emission[x[t + 1]] * b[t + 1]) / p
    assert np.allclose(words, counts.words) and np.allclose(pairs, counts.pairs)


def scored(spark, rows):
    return hmm.score_documents(spark.createDataFrame(rows, DOCS)).collect()


def test_base_scores_are_exact_and_the_model_is_better(spark):
    rows = [r[:5] for r in texts(300)] + [(1000, None, None, None, None), (1001, "", "", "", ""), (1002, "Never SEEN\x0bwords\u00a0here", "", "", ""), (None, "the of", "", "", "")]
    rows.append(rows[0])
    found = scored(spark, rows)
    assert len(found) == len(rows)
    c = Counter(w for i, t, *_ in rows if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2 for w in [*words_of(t), b""])
    n, v = c.total(), len(c)
    told = {i: (len(words_of(t)) + 1, sum(c[w] > 0 for w in [*words_of(t), b""]), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words_of(t), b""])) for i, t, *_ in rows}
    for r in found:
        assert (r["n_tokens"], r["n_known"]) == told[r["doc_id"]][:2] and r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(told[r["doc_id"]][2])
    held = [r for r in found if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_are_those_of_the_plain_recursion_on_the_assembled_model(spark):
    """Every count, emission and score again, from the step's found tables alone, word by word in plain loops."""
    rows = [r[:5] for r in texts(60, 9)] + [(500, None, "", "", "")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("held_out", hmm.id_bucket("doc_id", 7) == 2).select("doc_id", "held_out", "text")
    start = hmm.fit_start([r[1] for r in rows if r[1]])
    found, answers, model, buckets = hmm.train(docs, start)
    answers = answers.toArrow()
    counts, in_state = Counter(), {}
    for row in found.collect():
        keys = np.frombuffer(row["keys"], np.uint64)
        own = answers.filter(hmm.pa.compute.equal(answers.column("block"), row["block"]))
        c = hmm.aligned(own, keys, buckets, "answer_0", np.uint64).tolist()
        s = hmm.aligned(own, keys, buckets, "answer_1", np.float32, 3).astype(float)
        counts |= dict(zip(keys.tolist(), c, strict=True))
        in_state |= {k: np.append(x, n - x.sum()) for k, n, x in zip(keys.tolist(), c, s, strict=True)}
    mass = sum(in_state.values())
    total, types = counts.total(), sum(c > 0 for c in counts.values())
    told = {}
    for i, t, *_ in rows:
        log, a = 0.0, model.start
        for w in [*words_of(t), b""]:
            key = hmm._hash(w)
            unigram = (counts[key] + 1) / (total + types + 1)
            dealt = hmm.SMOOTHING * types * mass / total + 1
            b = a * (in_state.get(key, np.zeros(4)) + dealt * unigram) / (mass + dealt)
            log, a = log + math.log10(b.sum()), b / b.sum() @ model.transition
        told[i] = log
    again = {r["doc_id"]: r["score"] for r in hmm.score_documents(spark.createDataFrame(rows, DOCS)).collect()}
    assert again == pytest.approx(told, rel=1e-4)


def test_counts_do_not_wrap_round():
    n = 3
    answers = hmm.pa.table({"bucket": hmm.pa.array([0], hmm.pa.int32()), "answer_0": [np.full(n, 2**40, np.uint64).tobytes()], "answer_1": [np.zeros((n, 3), np.float32).tobytes()]})
    counts, _ = hmm._emission({"keys": np.arange(n, dtype=np.uint64).tobytes()}, answers, hmm.Model(np.ones(4) / 4, np.ones((4, 4)) / 4, np.full(4, 2.0**40), 2**42, n), 1, 4)
    assert counts.tolist() == [2.0**40] * n


def test_probabilities_of_all_one_word_texts_sum_to_less_than_one(spark):
    rows = [r[:5] for r in texts(200, 3)] + [(5000 + i, w, "", "", "") for i, w in enumerate(sorted({w for t in TONGUES.values() for w in t}))]
    total = sum(10 ** r["score"] for r in scored(spark, rows) if r["doc_id"] >= 5000)
    assert 0 < total < 1


def test_language_model_of_nothing(spark):
    assert scored(spark, []) == []
    only_held = [(i, "a b", "", "", "") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    assert all(r["train_tokens"] == 0 and r["score"] == pytest.approx(r["base_score"]) for r in scored(spark, only_held))


def test_very_long_texts_are_scored_whole_and_repeated_rows_alike(spark):
    rng = random.Random(13)
    long = " ".join(rng.choice(TONGUES["de"]) for _ in range(150_000))
    rows = [r[:5] for r in texts(80, 14)] + [(700, long, "", "", ""), (700, long, "", "", ""), (701, "the of", "", "", ""), (708, "the of", "", "", "")]
    found = [r for r in scored(spark, rows) if r["doc_id"] >= 700]
    assert sorted(r["n_tokens"] for r in found) == [3, 3, 150_001, 150_001]
    assert len({r["score"] for r in found}) == 2 and all(math.isfinite(r["score"]) for r in found)


def test_blocks_do_not_change_the_counts(spark, monkeypatch):
    rows = [r[:5] for r in texts(120, 4)]
    one = {r["doc_id"]: r["base_score"] for r in scored(spark, rows)}
    monkeypatch.setattr(hmm, "BLOCK_TOKENS", 50)
    assert {r["doc_id"]: r["base_score"] for r in scored(spark, rows)} == pytest.approx(one)


def held_gain(found):
    held = [r for r in found if r["held_out"]]
    return sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)


def test_states_are_learned_from_all_documents_and_not_the_start(spark, monkeypatch):
    rows = [r[:5] for r in texts(300)]
    steps, maximise = [], hmm.maximise
    monkeypatch.setattr(hmm, "maximise", lambda *a: steps.append(1) or maximise(*a))
    whole = held_gain(scored(spark, rows))
    assert len(steps) >= 3
    monkeypatch.setattr(hmm, "START_ROWS", 12)
    assert held_gain(scored(spark, rows)) == pytest.approx(whole, abs=0.02)


def test_long_or_few_documents_start_the_states_too(spark, monkeypatch):
    monkeypatch.setattr(hmm, "START_CHARS", 60)
    assert held_gain(scored(spark, [r[:5] for r in texts(200, 6)])) > 0.1
    one = " ".join(t for _, t, *_ in sorted(texts(100, 7), key=lambda r: r[2]))
    assert [r["score"] > r["base_score"] for r in scored(spark, [(0, one, "", "", "")])] == [True]


# toxicity


def test_toxicity_is_learned_and_held_out_texts_are_judged(spark):
    rows = texts(900, 1, 0.3)
    docs = spark.createDataFrame([r[:5] for r in rows] + [(2000, None, None, None, None), (2001, "", "", "", ""), (None, "the of", "", "", "")], DOCS)
    labels = spark.createDataFrame([(r[0], int(r[5]), 1) for r in rows] + [(1, None, 1), (None, 1, 1)], "doc_id long, toxic int, text int")
    model = toxicity.fit(*toxicity.training_rows(docs, labels))
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(found) == 903 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found.values())
    held = [r for r in rows if found[r[0]]["held_out"]]
    assert {r[0] for r in held} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1}
    assert np.mean([found[r[0]]["predicted"] == r[5] for r in held]) >= 0.97
    assert not found[2000]["predicted"] and not found[2001]["predicted"]
    kept = toxicity.remove_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 for r in found.values() if not r["predicted"])


def plain_logit(m, text):
    """The classifier in plain loops: sums of embeddings, filters at each place, their maximum, and the last unit."""
    words = [*toxicity.plain_words(text), None]
    zero = np.zeros(toxicity.DIM)
    x = [zero if w is None else sum(m.embedding[r] for r in toxicity._buckets([w])[0]) for w in words]
    z, unit = float(m.out_bias), 0
    for width in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            best = max(sum(float(x[i + o] @ m.filters[width, o][:, f]) for o in range(width) if i + o < len(x)) for i in range(len(x)))
            z += max(0.0, best + m.bias[unit]) * m.out[unit]
            unit += 1
    return z


def test_logits_are_those_of_plain_loops():
    rows = texts(120, 12, 0.4)
    m = toxicity.fit([r[1] for r in rows], [int(r[5]) for r in rows])
    odd = [rows[0][1], "one", "", None, "the scumbag", "der " * 30]
    assert toxicity.Model.logits(m, toxicity.Batch(odd)) == pytest.approx([plain_logit(m, t) for t in odd], rel=1e-4, abs=1e-4)


def test_gradients_are_finite_differences(monkeypatch):
    rng = np.random.default_rng(4)
    m = toxicity.Model(
        rng.normal(0, 0.3, (toxicity.BUCKETS, toxicity.DIM)), {(w, o): rng.normal(0, 0.3, (toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS for o in range(w)},
        rng.normal(0, 0.1, toxicity.FILTERS * 3), rng.normal(0, 0.3, toxicity.FILTERS * 3), 0.1,
    )
    held = ["the of scumbag river", "der die haus", "les petit connard maison"]
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([2.0, 1.0, 2.0])

    def loss():
        p = 1 / (1 + np.exp(-m.logits(toxicity.Batch(held))))
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()

    told = {}
    for key, at in [("out", 3), ("out", 40), ("bias", 5), ((1, 0), (2, 3)), ((2, 1), (5, 7)), ((3, 2), (1, 9))]:
        values = m.filters[key] if key in m.filters else getattr(m, key)
        values[at] += 1e-5
        up = loss()
        values[at] -= 2e-5
        told[key, at] = (up - loss()) / 2e-5
        values[at] += 1e-5
    moments = {}
    toxicity._step(m, moments, toxicity.Batch(held), y, weight, 0.0)
    for (key, at), slope in told.items():
        assert 10 * moments[key][0][at] == pytest.approx(slope, rel=1e-3, abs=1e-6)


def test_without_both_classes_scores_are_one_share(spark):
    docs = spark.createDataFrame([(i, "a b c", "", "", "") for i in range(5)], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scores = {r["score"] for r in toxicity.score_toxicity(docs, toxicity.fit(*toxicity.training_rows(docs, none))).collect()}
    assert scores == {0.5}


def test_very_long_texts_are_read_to_the_end():
    rows = texts(400, 2, 0.4)
    model = toxicity.fit([r[1] for r in rows], [int(r[5]) for r in rows])
    clean = " ".join(random.Random(1).choice(TONGUES["en"]) for _ in range(200_000))
    low, high = toxicity._scored([clean, clean + " scumbag"], model)
    assert low < 0.7 <= high


# language ID


def test_languages_are_told_and_odd_texts_are_unknown(spark):
    rows = [r[:5] for r in texts(400, 5)] + [(900, None, "en", "", ""), (901, "", "en", "", ""), (902, "12 ?! 34", "en", "", ""), (903, "the of and", None, "", ""), (None, "der die und", "de", "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    found = {r["doc_id"]: r for r in langid.identify(docs, langid.fit_on(docs)).collect()}
    assert len(found) == 405 and all(0 <= r["score"] <= 1 for r in found.values())
    assert [found[i]["lang_pred"] for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "en", "de"]
    held = [r for r in rows[:400] if found[r[0]]["held_out"]]
    assert np.mean([found[r[0]]["lang_pred"] == r[2] for r in held]) >= 0.98
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(i if i is not None else -1 for i, r in found.items() if r["lang_pred"] != "und" )


def test_words_of_mixed_texts_get_their_own_language():
    rows = texts(500, 6)
    labeller = langid.Labeller(langid.fit([r[1] for r in rows], [r[2] for r in rows]))
    text = "the of and house river stone der die nicht haus fluss le les dans maison rivière"
    _, g, _ = labeller.words([text])
    names = [labeller.field.languages[k] for k in g.argmax(axis=1)]
    told = ["en"] * 6 + ["de"] * 5 + ["fr"] * 5
    assert np.mean([a == b for a, b in zip(names, told, strict=True)]) >= 0.85
    assert np.allclose(g.sum(axis=1), 1)


def test_forward_backward_is_the_sum_over_all_labellings():
    from itertools import product

    rng = np.random.default_rng(1)
    scores, move = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    told = np.zeros((4, 3))
    for labels in product(range(3), repeat=4):
        p = np.exp(sum(scores[t, y] for t, y in enumerate(labels)) + sum(move[a, b] for a, b in zip(labels, labels[1:], strict=False)))
        for t, y in enumerate(labels):
            told[t, y] += p
    g, pairs = langid.marginals(scores, np.arange(4), np.array([4]), move)
    assert np.allclose(g, told / told.sum(axis=1, keepdims=True)) and pairs.sum() == pytest.approx(3)


def test_lines_are_never_cut(monkeypatch):
    rng = np.random.default_rng(2)
    scores, move, ids, lengths = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), rng.integers(9, size=1200), np.array([700, 1, 499])
    whole, pairs = langid.marginals(scores, ids, lengths, move)
    monkeypatch.setattr(chain, "SEGMENT", 10**6)
    same, again = langid.marginals(scores, ids, lengths, move)
    assert np.allclose(whole, same) and np.allclose(pairs, again) and np.allclose(whole.sum(axis=1), 1)


def plain_features(word):
    """Feature strings of a word, letter by letter."""
    marked = b"^" + word + b"$"
    out = [(k, marked[i : i + k]) for k in (2, 3) for i in range(len(marked) - k + 1)]
    for k in langid.AFFIXES:
        if len(word) >= k:
            out += [(10 + k, word[:k]), (20 + k, word[-k:])]
    return out


def test_features_and_text_scores_are_those_of_plain_loops(monkeypatch):
    rows = texts(80, 10)
    field = langid.fit([r[1] for r in rows], [r[2] for r in rows])
    held = [b"a", b"", "maison".encode(), "fluss".encode(), "rivi\u00e8re".encode(), b"zq" * 40]
    row = lambda tag, part: int(langid._hash(tag, (np.array([c], np.uint64) for c in part))[0])
    told = np.array([sum((field.weights[row(*f)] for f in plain_features(w)), np.zeros(3)) + (field.lexical[field.lexicon[w]] if w in field.lexicon else 0) for w in held])
    assert np.allclose(field.scores(held)[0], told)
    monkeypatch.setattr(langid, "BYTES_AT_ONCE", 5)
    assert np.allclose(field.scores(held)[0], told)
    text = "house der river\n12 les petit"
    mass = np.zeros(3)
    from itertools import product

    for line in (["house", "der", "river"], ["les", "petit"]):
        s = field.scores([w.encode() for w in line])[0]
        weigh = {y: np.exp(sum(s[t, k] for t, k in enumerate(y)) + sum(field.transition[a, b] for a, b in zip(y, y[1:], strict=False))) for y in product(range(3), repeat=len(line))}
        for y, p in weigh.items():
            for k in y:
                mass[k] += p / sum(weigh.values())
    (name,), (score,), _ = langid.Labeller(field).all_texts([text])
    assert name == field.languages[mass.argmax()] and score == pytest.approx(mass.max() / mass.sum(), rel=1e-4)


def test_junk_in_no_known_language_is_rejected(spark):
    rng = random.Random(3)
    rows = [r[:5] for r in texts(300, 11)] + [(1000 + i, " ".join("".join(rng.choice("qxzvkjw") for _ in range(9)) for _ in range(30)), None, "", "") for i in range(5)]
    kept = {r["doc_id"] for r in langid.keep_identified(spark.createDataFrame(rows, DOCS)).select("doc_id").collect()}
    assert kept == set(range(300))
    unlabelled = spark.createDataFrame([(1, "x", None, "", "")], DOCS)
    assert langid.keep_identified(unlabelled).count() == 1


def test_long_words_take_what_their_bytes_take():
    import time

    rows = texts(60, 7)
    field = langid.fit([r[1] for r in rows], [r[2] for r in rows])
    began = time.perf_counter()
    scores, _ = field.scores([b"ab" * 2_000_000, b"the"])
    assert time.perf_counter() - began < 20 and np.isfinite(scores).all()


def test_one_language_and_none(spark):
    docs = spark.createDataFrame([(i, "the of", "en", "", "") for i in range(9)], DOCS)
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit_on(docs)).collect()} == {"en"}
    empty = spark.createDataFrame([], DOCS)
    field = langid.fit_on(empty)
    assert langid.identify(empty, field).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, field).collect()} == {"und"}


def test_words_longer_than_any_width():
    rows = texts(60, 7)
    labeller = langid.Labeller(langid.fit([r[1] for r in rows], [r[2] for r in rows]))
    names, scores, _ = labeller.all_texts(["the" * 50_000, "x", "é" * 100])
    assert all(n in ("de", "en", "fr") for n in names) and all(0 < s <= 1 for s in scores)


def test_rare_and_long_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_ROWS", 30)
    monkeypatch.setattr(langid, "TRAIN_CHARS", 300)
    rng = random.Random(8)
    rows = [r[:5] for r in texts(400, 8) if r[2] != "de"]
    rows += [(1000 + i, " ".join(rng.choice(TONGUES["de"]) for _ in range(200)), "de", "", "") for i in range(4)]
    docs = spark.createDataFrame(rows, DOCS)
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, langid.fit_on(docs)).collect()}
    assert [found[1000 + i] for i in range(4)] == ["de"] * 4
    assert np.mean([found[i] == lang for i, _, lang, *_ in rows]) >= 0.95
