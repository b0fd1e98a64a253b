"""Operators that search: neighbours, the Jaccard join, decontamination. Each against brute force, and on odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import additive, decontaminate, jaccard
from vellum.llm.common import words_of

WORDS = [a + b for a in ("ba", "co", "di", "fu", "ge", "ho", "ki", "lo", "mu", "ne") for b in ("ra", "st", "nt", "li", "mo", "p", "sk", "x")]


def words(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


# nearest neighbours

VECTORS = "vec_id long, embedding array<float>, extra string"


def brute_neighbours(rows, k=5):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    found = {}
    for q, x in ok:
        if q % 50 == 0:
            scored = sorted((-float((x * y).sum() / np.sqrt((x * x).sum()) / np.sqrt((y * y).sum())), i) for i, y in ok if i != q)
            found[q] = [i for _, i in scored[:k]]
    return found


def nearest(spark, rows):
    out: dict = {}
    for r in additive.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_neighbours_reach_the_recall_and_odd_vectors_take_no_part(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist(), "x") for i in range(600)]
    rows += [(1000, None, ""), (1050, [0.0] * 16, ""), (1100, [float("nan")] * 16, ""), (1150, [1.0, None] * 8, ""), (1200, [1.0, 2.0], ""), (None, [1.0] * 16, "")]
    found, told = nearest(spark, rows), brute_neighbours([r for r in rows if r[0] != 1200])  # alone in its length
    assert set(found) == set(told)
    hits = sum(len(set(found[q]) & set(told[q])) for q in told)
    assert hits >= 0.9 * sum(map(len, told.values()))


@pytest.mark.parametrize("d", [16, 64, 256])
def test_recall_holds_for_vectors_the_codebooks_have_not_seen(monkeypatch, d):
    """Gaussian vectors have no structure to learn: the order by code is as bad as it gets, and the measured share makes up."""
    rng = np.random.default_rng(d)
    x = rng.normal(size=(6000, d)).astype(np.float32)
    monkeypatch.setattr(additive, "BOOKS", 6)
    books = additive.fit(additive.unit(x[:1500]))
    share = additive.needed_share(books, x[1500:3500], 5, additive.RECALL)
    block, own = x[3500:], np.arange(2500)
    codes = books.encode(additive.unit(block))
    rows = additive.pa.table({"row": own, "vec_id": own, "embedding": list(block), "codes": [c.tobytes() for c in codes], "norm": np.sqrt((books.decode(codes) ** 2).sum(axis=1)).astype(np.float32)})
    queries = additive.pa.table({"query_row": own[:100], "query_id": own[:100], "query": list(block[:100])})
    monkeypatch.setattr(additive, "RERANK", 5)
    monkeypatch.setattr(additive, "MARGIN", 0.0)
    found: dict = {}
    for r in additive._scan(books, 5, share)(rows, queries).to_pylist():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    unit = additive.unit(block).astype(float)
    exact = unit[:100] @ unit.T
    np.fill_diagonal(exact, -np.inf)
    hits = sum(len(found[i] & set(np.argsort(-exact[i])[:5].tolist())) for i in range(100))
    assert share < 0.9 and hits >= 0.9 * 500


def test_doubles_lengths_and_repeated_ids(spark):
    tiny = [[1e-250 * v for v in x] for x in ([1.0, 2.0], [2.0, 1.0], [1.0, 2.0000001], [-1.0, -2.0])]
    rows = [(50, tiny[0], ""), (1, tiny[1], ""), (2, tiny[2], ""), (3, tiny[3], ""), (50, [3e200, 0.0], ""), (100, [1.0, 2.0, 3.0], ""), (7, [3.0, 2.0, 1.0], ""), (7, [1.0, 2.0, 3.5], "")]
    found = additive.search(spark.createDataFrame(rows, VECTORS.replace("float", "double")), F.col("vec_id") % 50 == 0).collect()
    by = lambda q: sorted(tuple(r)[1:] for r in found if r["query_id"] == q)
    assert [x[1] for x in by(100)] == [7, 7] and by(100)[0][2] > by(100)[1][2]
    lists = by(50)
    assert [x[0] for x in lists] == [1, 1, 2, 2, 3, 3, 4, 4]  # two rows named 50, each with its four others
    assert {x[1] for x in lists if x[0] == 1} == {2, 1} and max(x[2] for x in lists) == pytest.approx(1)
    assert min(x[2] for x in lists) == pytest.approx(-1)


def test_ties_go_to_the_smaller_id_and_copies_do_not_hide_each_other(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0], "") for i in range(700, 100, -1)] + [(i, [float(i), 1.0, 0.0, 0.0], "") for i in range(50)]
    assert nearest(spark, rows)[500] == [101, 102, 103, 104, 105]


def test_too_few_vectors(spark):
    assert nearest(spark, []) == {}
    assert nearest(spark, [(50, [1.0], "")]) == {}
    assert nearest(spark, [(50, [1.0], ""), (3, [2.0], ""), (3, [2.0], "")]) == {50: [3, 3]}


# Jaccard join

DOCS = "doc_id long, text string, component_id string, n int"


def brute_link(rows, n, percent):
    sets = []
    for _, text, *_ in rows:
        w = words_of(text)
        k = min(n, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else frozenset())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    least: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    own = lambda i: rows[i][0] if rows[i][0] is not None else -1
    return sorted((own(i), len(sets[i]), least.get(find(i), -1) if sets[i] else own(i), links[i]) for i in range(len(rows)))


def linked(spark, rows, n=3, percent=90):
    none = lambda x: -1 if x is None else x
    return sorted((none(r["doc_id"]), r["n_shingles"], none(r["component_id"]), r["n_links"]) for r in jaccard.link(spark.createDataFrame(rows, DOCS), n, percent).collect())


def corpus(seed, docs=150):
    """Texts with copies, edited copies, shared passages, short and odd ones."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    texts = [words(rng, rng.choice((5, 30, 80, 200))) for _ in range(docs)]
    for k in range(docs):
        w = list(texts[rng.randrange(docs)])
        for _ in range(rng.choice((0, 1, 1, 2, 4))):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(w + (passage if k % 3 == 0 else []))
    out = [" ".join(w) for w in texts] + [None, "", " \n\t", "one", "ONE", "one two", "a b c", "A\tb\nc", "one"]
    return [(i, t, "x", 1) for i, t in enumerate(out)] + [(3, out[3], "y", 2), (None, out[5], "", 0), (None, "alone in the world of words", "", 0)]


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 3, 90), (2, 3, 80), (3, 5, 80)])
def test_join_is_what_brute_force_finds(spark, seed, n, percent):
    rows = corpus(seed)
    assert linked(spark, rows, n, percent) == brute_link(rows, n, percent)


def test_groups_in_parts_give_the_same(spark, monkeypatch):
    rows = corpus(4)
    monkeypatch.setattr(jaccard, "CELL", 500)
    monkeypatch.setattr(jaccard, "CELL_SETS", 5)
    monkeypatch.setattr(jaccard, "PARTS", 2)
    assert linked(spark, rows) == brute_link(rows, 3, 90)
    assert linked(spark, rows, 3, 75) == brute_link(rows, 3, 75)


def test_join_of_nothing(spark):
    assert linked(spark, []) == []
    assert linked(spark, [(1, None, "", 0)]) == [(1, 0, 1, 0)]


def test_the_heap_finds_what_counting_does():
    rng = np.random.default_rng(3)
    for least in (1, 2, 5, 9):
        lists = [jaccard.array("i", np.flatnonzero(rng.random(300) < p).tolist()) for p in rng.random(12)]
        count = np.zeros(300, int)
        for x in lists:
            count[list(x)] += 1
        records, counts = jaccard.merge_skip(lists, least, 40)
        assert records == [r for r in range(40, 300) if count[r] >= least] and counts == [count[r] for r in records]


def test_every_link_is_found_once(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(1, 2**40, 60)
    sets = [np.unique(np.where(rng.random(60) < 0.12, rng.integers(1, 2**40, 60), base)) for _ in range(80)]
    sizes, sides = [len(s) for s in sets], [i % 2 for i in range(80)]
    told = {(j, i) for i in range(80) for j in range(i) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (sizes[i] + sizes[j] - c)}
    for probed in (3, 64):
        monkeypatch.setattr(jaccard, "PROBED", probed)
        found = [tuple(sorted((i, s))) for i, others in jaccard.search(sizes, sets, 75) for s in others.tolist()]
        assert len(found) == len(set(found)) and set(found) == told
        across = [tuple(sorted((i, s))) for i, others in jaccard.search(sizes, sets, 75, sides) for s in others.tolist()]
        assert sorted(across) == sorted(x for x in told if sides[x[0]] != sides[x[1]])


def test_one_document_of_each_group_stays(spark):
    w = words(random.Random(5), 80)
    rows = [(9, " ".join(w), "a", 1), (4, " ".join(w), "b", 1), (4, " ".join(w), "b", 1), (7, " ".join([*w[:-1], "end"]), "c", 1), (1, "other words", "d", 1), (2, None, "e", 1), (None, "x", "f", 1)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "component_id", "n"]
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 2, 4]


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    a, b = words(random.Random(6), 60), words(random.Random(7), 60)
    rows = [(4, " ".join(a), "p", 1), (4, " ".join(b), "q", 1), (2, " ".join([*b[:-1], "end"]), "r", 1), (9, " ".join(a), "s", 1), (None, " ".join(a), "t", 1), (5, "", "u", 1), (5, "", "v", 1), (6, " ".join(a[:30]), "y", 2), (6, " ".join(a[:30]), "x", 2)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r["component_id"] for r in kept) == ["p", "r", "u", "v", "x"]
    assert jaccard.keep_one(spark.createDataFrame([], DOCS)).count() == 0
    clash = spark.createDataFrame([(1, "x y z u v w", 1, "a", 2, 3), (2, "x y z u v w", 1, "b", 2, 3), (2, "x y z u v w", 1, "b", 2, 3)], "doc_id long, text string, c int, row string, root int, node int")
    assert [tuple(r) for r in jaccard.keep_one(clash).collect()] == [(1, "x y z u v w", 1, "a", 2, 3)]


# decontamination

ITEMS = "item_id long, text string, doc_id string"


def edit_distance_to_part(item, text):
    """Least word edits between the whole item and any run of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_the_best_run_is_what_brute_force_finds():
    rng = random.Random(12)
    for _ in range(40):
        item, text = [rng.randrange(4) for _ in range(rng.randint(1, 9))], [rng.randrange(4) for _ in range(rng.randint(0, 25))]
        d, at = decontaminate.best_run(np.array(item), np.array(text))
        told = [min(edit_distance(item, text[lo:hi]) for hi in range(lo, len(text) + 1)) for lo in range(len(text) + 1)]
        assert (d, at) == (min(told), told.index(min(told)))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def test_leaks_are_what_brute_force_finds(spark):
    rng = random.Random(11)
    items = [(i, " ".join(words(rng, rng.randint(10, 40))), "") for i in range(25)] + [(90, None, ""), (91, "", ""), (92, "too short", ""), (None, "Null, item! with: words enough here", "")]
    docs = []
    for i in range(120):
        w = words(rng, rng.choice((0, 20, 100)))
        if i % 2:
            x = items[rng.randrange(25)][1].split()
            for _ in range(rng.choice((0, 0, 1, 2, len(x) // 5, len(x) // 3))):
                kind, p = rng.randrange(3), rng.randrange(len(x))
                x[p : p + 1] = [["zz"], [], ["zz", x[p]]][kind]
            at = rng.randrange(len(w) + 1)
            w[at:at] = x
        docs.append((i, " ".join(w).upper() if i % 5 == 0 else ", ".join(w), "", 0))
    docs += [(500, None, "", 0), (501, "", "", 0), (502, "NULL ITEM with words, enough HERE", "", 0), (None, items[0][1], "", 0), (1, docs[1][1], "", 0)]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["item_id"] if r["item_id"] is not None else -1, r["distance"]) for r in found)
    told = []
    for d, text, *_ in docs:
        for i, item, _ in items:
            x = decontaminate.plain_words(item)
            if len(x) >= decontaminate.MIN_WORDS:
                distance = edit_distance_to_part(x, decontaminate.plain_words(text))
                if distance <= decontaminate.allowed(len(x), 0.8):
                    told.append((d if d is not None else -1, i if i is not None else -1, distance))
    assert set(got) <= set(told)
    assert len(set(got)) >= 0.95 * len(set(told))
    assert all(t in got for t in told if t[2] == 0)


def test_removal_keeps_clean_rows_as_they_are(spark):
    item = " ".join(words(random.Random(1), 30))
    rows = [(1, f"before {item} after", "x", 1), (2, "clean", "y", 2), (3, None, "z", 3), (2, "clean", "y", 2)]
    bench = spark.createDataFrame([(1, item, "")], ITEMS)
    kept = decontaminate.remove_leaks(spark.createDataFrame(rows, DOCS), bench)
    assert sorted(tuple(r) for r in kept.collect()) == sorted(rows[1:])
    assert decontaminate.remove_leaks(spark.createDataFrame(rows, DOCS), bench.limit(0)).count() == 4
    assert decontaminate.find_leaks(spark.createDataFrame([], DOCS), bench).count() == 0


def test_ids_of_other_types_and_very_long_texts(spark):
    rng = random.Random(21)
    item = words(rng, 30)
    long = words(rng, 300_000) + item[:20] + ["zz"] + item[20:]
    docs = spark.createDataFrame([("a", " ".join(long)), ("b", " ".join(words(rng, 50)))], "doc_id string, text string")
    bench = spark.createDataFrame([("x", " ".join(item))], "item_id string, text string")
    assert [tuple(r)[:4] for r in decontaminate.find_leaks(docs, bench).collect()] == [("a", "x", 1, 30)]
    assert [r["doc_id"] for r in decontaminate.remove_leaks(docs, bench).collect()] == ["b"]


def test_short_items_are_found_word_for_word(spark):
    items = [(i, x, "") for i, x in enumerate(["Yes!", "forty two", "a b c d", "...", "no", "two two two"])]
    docs = spark.createDataFrame([(1, "he said: yes, forty-two", "", 0), (2, "forty a b c d", "", 0), (3, "a b x d two two", "", 0), (4, "no", "", 0)], DOCS)
    bench = spark.createDataFrame(items, ITEMS)
    found = decontaminate.find_leaks(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"], r["start_word"]) for r in found) == [(1, 0, 0, 2), (1, 1, 0, 3), (2, 2, 0, 1), (4, 4, 0, 0)]
    assert decontaminate.remove_leaks(docs, bench).count() == 4
    assert decontaminate.remove_leaks(docs, bench, fewest=2).count() == 2


def test_long_items_are_found_with_the_recall_too(monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 3000) % 5000)) for i in range(5)]
    _, known, (items,) = decontaminate.build_index(rows, 0.8, 0.97)
    pick = rng.integers(5, size=200)
    copies = np.stack([decontaminate._edited(items.words[i], items.most, rng, 0) for i in pick])
    hit = np.zeros(len(pick), bool)
    for walk, (places, *_) in enumerate(items.walks):
        a, b = (decontaminate.cgk_samples(known.hashes[w].ravel(), np.arange(len(w)) * items.n, items.n, walk, places) for w in (items.words[pick], copies))
        hit |= (a == b).any(axis=1)
    assert hit.mean() >= 0.94
    monkeypatch.setattr(decontaminate, "STALLED", 3)
    monkeypatch.setattr(decontaminate, "cgk_samples", lambda hashes, start, n, walk, places: rng.random((len(start), len(places))))
    with pytest.raises(RuntimeError, match="out of reach"):
        decontaminate.build_index(rows, 0.8, 0.97)


def test_benchmark_in_blocks_gives_the_same(spark, monkeypatch):
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, 12)), "") for i in range(8)]
    docs = spark.createDataFrame([(i, " ".join([*words(rng, 5), items[i][1]]), "", 0) for i in range(8)], DOCS)
    monkeypatch.setattr(decontaminate, "ITEMS_CHARS", 100)
    found = decontaminate.find_leaks(docs, spark.createDataFrame(items, ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} >= {(i, i) for i in range(8)}
