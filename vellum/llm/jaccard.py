"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Documents are sets of word n-grams. Equal sets are one class. A set that can reach the similarity with any other shares
all but a few of its n-grams with other documents; those that do are searched with inverted lists: the short lists of a
set are merged with a heap that skips what can't occur often enough, the long ones are only probed for what is left.
"""

from __future__ import annotations

import heapq
import math
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise, new_path, small_batches, tidy, tidy_groups, tidy_table, words_of, write_table
from .exchange import bucket_count, buckets_of, pack_ids, unpack_ids
from .graph import components

#: Documents of a block have about so many words together.
BLOCK_TOKENS = 1_500_000
#: N-grams and sets that one part of a group holds; groups of candidates with more are searched part by part. Beyond PARTS parts,
#: parts hold up to ten times as many sets, as there are tasks enough.
CELL, CELL_SETS, PARTS = 200_000, 200, 64
#: DivideSkip leaves about T / (MU log2(longest list) + 1) lists to be probed.
MU = 0.0085
#: Long lists are probed so many at once, with binary search in one array.
PROBED = 64


def required(n: int, percent: int) -> int:
    """N-grams that a set of n shares at least with a set as similar as that."""
    return -(-percent * n // 100)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, lengths: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each of the texts that make up a sequence of word hashes: the sorted distinct 64-bit hashes of its n-grams; of a
    text of fewer words, of the whole."""
    h = np.full(max(0, len(words) - n + 1), n, np.uint64)
    for i in range(n):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i])
    end = 0
    for size in lengths.tolist():
        begin, end = end, end + size
        if size >= n:
            yield np.unique(h[begin : end - n + 1])
        else:
            short = np.full(min(size, 1), size, np.uint64)
            for i in range(size):
                short = _mix(short * np.uint64(0x9E3779B97F4A7C15) + words[begin + i])
            yield short


def _signed(x: np.uint64) -> int:
    return int(np.array(x, np.uint64).view(np.int64))


BLOCKS = pa.schema([
    ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("h1", pa.list_(pa.int64())), ("h2", pa.list_(pa.int64())),
    ("lengths", pa.binary()), ("ids", pa.binary()), ("keys", pa.binary()), ("n_keys", pa.int64()),
])
BLOCKS_SQL = "block long, doc_ids array<long>, hashes array<long>, sizes array<int>, h1 array<long>, h2 array<long>, lengths binary, ids binary, keys binary, n_keys long"


def _block(rows: list[tuple[int | None, str | None, int]], n: int, block: int) -> dict:
    """A row of the table of blocks: documents as numbers of words, with the hashes of the words and of the sets."""
    number: dict[bytes, int] = {}
    coded = [np.array([number.setdefault(w, len(number)) for w in words_of(text)], np.int64) for _, text, _ in rows]
    keys = np.array([xxhash.xxh3_64_intdigest(w) for w in number], np.uint64)
    lengths = np.array([len(c) for c in coded], np.int32)
    ids = np.concatenate(coded)
    sets = list(shingles(keys[ids], lengths, n))
    return {
        "block": block,
        "doc_ids": [i for i, _, _ in rows],
        "hashes": [h for _, _, h in rows],
        "sizes": [len(s) for s in sets],
        "h1": [_signed(s.sum(dtype=np.uint64)) for s in sets],
        "h2": [_signed(_mix(s).sum(dtype=np.uint64)) for s in sets],
        "lengths": lengths.tobytes(),
        "ids": pack_ids(ids),
        "keys": keys.tobytes(),
        "n_keys": sum(len(s) for s in sets),
    }


def block_table(docs: DataFrame, n: int) -> DataFrame:
    """The table of blocks of `docs` (doc_id, text, text_hash)."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, rows, size = TaskContext.get().partitionId() << 12, 0, [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                size += len(row[1] or "") // 6 + 1
                if size >= BLOCK_TOKENS:
                    yield pa.RecordBatch.from_pylist([_block(rows, n, base + made)], schema=BLOCKS)
                    made, rows, size = made + 1, [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([_block(rows, n, base + made)], schema=BLOCKS)

    return small_batches(docs).select("doc_id", "text", "text_hash").mapInArrow(tidy(blocks), BLOCKS_SQL)


def _sets(row: dict, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(position, set) of the first document of each distinct set of a block."""
    keys, lengths = np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["lengths"], np.int32)
    seen = set()
    names = zip(row["h1"], row["h2"], row["sizes"], strict=True)
    for i, (name, s) in enumerate(zip(names, shingles(keys[unpack_ids(row["ids"])], lengths, n), strict=True)):
        if len(s) and name not in seen:
            seen.add(name)
            yield i, s


def _pack(sorted32: np.ndarray) -> bytes:
    return pack_ids(np.diff(sorted32, prepend=np.uint32(0)))


def _unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_ids(blob), dtype=np.uint32)


def _dealt(distinct: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, places of its n-grams by their lower 32 bits) of sorted hashes."""
    of, low = buckets_of(distinct, buckets), distinct.astype(np.uint32)
    order = np.lexsort((low, of))
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    return [(int(of[part[0]]), part) for part in np.split(order, cuts)] if len(order) else []


def _ask(n: int, buckets: int):
    """What each block holds of the n-grams of each bucket: their lower 32 bits and in how many of its sets they are."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("low", pa.binary()), ("sets", pa.binary())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                held = [s for _, s in _sets(row, n)]
                if held:
                    distinct, count = np.unique(np.concatenate(held), return_counts=True)
                    count = np.minimum(count, 255).astype(np.uint8)
                    rows = [(b, row["block"], _pack(distinct[at].astype(np.uint32)), zlib.compress(count[at].tobytes(), 1)) for b, at in _dealt(distinct, buckets)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return ask


def _rarity(table: pa.Table) -> pa.Table:
    """For each block's n-grams of a bucket: 0 if no other set has them, else the logarithm of how many sets do, up to 15.

    An n-gram that shares its lower bits with another of the bucket may count as more frequent than it is, for all blocks
    alike. That moves it in the order of the search, and can't hide an n-gram that sets share.
    """
    sent = [_unpack(x) for x in table.column("low").to_pylist()]
    count = np.concatenate([np.frombuffer(zlib.decompress(x), np.uint8) for x in table.column("sets").to_pylist()])
    distinct, number = np.unique(np.concatenate(sent), return_inverse=True)
    rarity = np.minimum(15, np.log2(np.bincount(number, count, minlength=len(distinct)))).astype(np.uint8)[number]
    cuts = np.cumsum([0, *map(len, sent)])
    blobs = [zlib.compress(rarity[lo:hi].tobytes(), 1) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "rarity": pa.array(blobs, pa.binary())})


def _survivors(n: int, percent: int, buckets: int):
    """Sets that share as many n-grams as they need: node, size, and the shared n-grams, rare ones first."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("shared", pa.binary())])

    def choose(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        blobs = dict(zip(answers.column("bucket").to_pylist(), answers.column("rarity").to_pylist(), strict=True))
        for row in block.to_pylist():
            held = list(_sets(row, n))
            if not held:
                continue
            distinct, number = np.unique(np.concatenate([s for _, s in held]), return_inverse=True)
            rarity = np.zeros(len(distinct), np.uint8)
            for b, at in _dealt(distinct, buckets):
                rarity[at] = np.frombuffer(zlib.decompress(blobs[b]), np.uint8)
            rarity = rarity[number]
            begin = np.cumsum([0, *(len(s) for _, s in held)])
            common = np.add.reduceat(rarity > 0, begin[:-1], dtype=np.int64)
            for k in np.flatnonzero(common >= [required(len(s), percent) for _, s in held]).tolist():
                (i, s), r = held[k], rarity[begin[k] : begin[k + 1]]
                s = s[np.argsort(r, kind="stable")][len(s) - common[k] :]
                out.append(((row["block"] << 24) + i, row["sizes"][i], s.tobytes()))
        columns = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return choose


def _prefixes(percent: int):
    """(n-gram, node) for the rarest n-grams of each set, of which two similar sets have one in common."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, nodes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for node, n, shared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = np.frombuffer(shared, np.int64)
                grams.append(s[: len(s) - required(n, percent) + 1])
                nodes.append(np.full(len(grams[-1]), node, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), pa.array(np.concatenate(nodes))], names=["gram", "node"])

    return post


def merge_skip(lists: list[array], least: int, first: int) -> tuple[list[int], list[int]]:
    """Records from `first` on that at least `least` of the sorted lists hold, and how many do.

    A heap holds the head of each list, record and list in one number. Where too few lists have the least head, as many lists
    leave the heap as no record before the next head can occur often enough without, and come back at that head or after it.
    """
    bits = len(lists).bit_length()
    own = (1 << bits) - 1
    at = [bisect_left(x, first) for x in lists]
    heap = [x[i] << bits | k for k, (x, i) in enumerate(zip(lists, at, strict=True)) if i < len(x)]
    heapq.heapify(heap)
    records, counts = [], []
    while len(heap) >= least:
        top, taken = heap[0] >> bits, 0
        while heap and heap[0] >> bits == top:
            k = heap[0] & own
            i = at[k] = at[k] + 1
            taken += 1
            if i < len(lists[k]):
                heapq.heapreplace(heap, lists[k][i] << bits | k)
            else:
                heapq.heappop(heap)
        if taken >= least:
            records.append(top)
            counts.append(taken)
        elif len(heap) >= least:
            behind = [heapq.heappop(heap) & own for _ in range(least - 1)]
            after = heap[0] >> bits
            for k in behind:
                i = at[k] = bisect_left(lists[k], after, at[k])
                if i < len(lists[k]):
                    heapq.heappush(heap, lists[k][i] << bits | k)
        else:
            break
    return records, counts


def _reached(candidates: np.ndarray, count: np.ndarray, need: np.ndarray, long: list[array], records: int) -> np.ndarray:
    """Which candidates occur as often as they need, with binary search in the long lists, longest first.

    PROBED lists are one sorted array to search in. A candidate that has enough, or can't get enough from the lists that are
    left, is searched for no longer.
    """
    reached = count >= need
    open_ = np.flatnonzero(~reached & (count + len(long) >= need))
    for hi in range(len(long), 0, -PROBED):
        if not len(open_):
            break
        part = long[max(0, hi - PROBED) : hi]
        base = np.arange(len(part), dtype=np.int64) * records
        held = np.concatenate([np.frombuffer(x, np.int32) for x in part]) + np.repeat(base, [len(x) for x in part])
        asked = (base[:, None] + candidates[open_]).ravel()
        found = held[np.minimum(np.searchsorted(held, asked), len(held) - 1)] == asked
        count[open_] += found.reshape(len(part), -1).sum(axis=0)
        enough = count[open_] >= need[open_]
        reached[open_[enough]] = True
        open_ = open_[~enough & (count[open_] + max(0, hi - PROBED) >= need[open_])]
    return reached


def search(sizes: list[int], sets: list[np.ndarray], percent: int, sides: list[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(record, those among the records before it that it links to), for every record that links to any.

    Records go by size, and each is searched for among those before it. With `sides`, only records of different sides are
    compared. Every link is found once.
    """
    order = sorted(range(len(sizes)), key=lambda i: sizes[i])
    size = np.array([sizes[i] for i in order], np.int64)
    sized, place = size.tolist(), np.array(order)
    side = np.array([sides[i] for i in order]) if sides else None
    index: dict[int, array] = {}
    for r, i in enumerate(order):
        grams, t = sets[i].tolist(), required(sized[r], percent)
        first = bisect_left(sized, t, 0, r)
        lists = [x for g in grams if (x := index.get(g)) and x[-1] >= first]
        if len(lists) >= t:
            lists.sort(key=len)
            probed = min(t - 1, int(t / (MU * math.log2(len(lists[-1]) + 1) + 1)))
            s, count = (np.array(x, np.int64) for x in merge_skip(lists[: len(lists) - probed], t - probed, first))
            if side is not None:
                s, count = s[(apart := side[s] != side[r])], count[apart]
            if len(s):
                linked = s[_reached(s, count, -(-percent * (sized[r] + size[s]) // (100 + percent)), lists[len(lists) - probed :], r)]
                if len(linked):
                    yield i, place[linked]
        for g in grams:
            index.setdefault(g, array("i")).append(r)


CELL_KEY = ("root", "low_band", "low_part", "high_band", "high_part")


def _cell(percent: int):
    """Links of a cell: (a, b, null) for as many as connect what links connect, and (a, null, links) for how many documents
    each set links to."""

    def join(table: pa.Table) -> pa.Table:
        nodes, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        sets = [np.frombuffer(x, np.int64) for x in table.column("shared").to_pylist()]
        sides = table.column("side").to_pylist()
        root, links, edges = list(range(len(nodes))), np.zeros(len(nodes), np.int64), []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for r, others in search(table.column("n").to_pylist(), sets, percent, sides if sides[0] else None):
            links[r] += copies[others].sum()
            links[others] += copies[r]
            for s in others.tolist():
                if (x := find(r)) != (y := find(s)):
                    root[x] = y
                    edges.append((int(nodes[r]), int(nodes[s]), None))
        counted = np.flatnonzero(links)
        edges += [(a, None, n) for a, n in zip(nodes[counted].tolist(), links[counted].tolist(), strict=True)]
        columns = zip(*edges, strict=True) if edges else ((), (), ())
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("a", "b", "links"), columns, strict=True)})

    return join


def _cells(grouped: DataFrame, percent: int) -> DataFrame:
    """The rows of `grouped` (root, node, n, ..) in the cells that compare them, with CELL_KEY and `side` (0: with each other, else
    those of side 1 with those of side 2).

    A group is one cell, if it is small. A large one is parted by size, into bands so wide that sets of neighbouring bands
    alone can link, and bands into parts by hash; every pair of parts that can link is a cell, and a link is in one of them.
    """
    wide = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9
    band = F.floor(F.log("n") / wide).cast("long")
    sets = F.count("*") / CELL_SETS
    parts = F.ceil(F.greatest(F.sum("n") / CELL, F.least(sets, PARTS + sets / 10))).cast("int")
    bands = grouped.groupBy("root", band.alias("band")).agg(parts.alias("parts"), F.sum("n").alias("n"), F.count("*").alias("sets"))
    whole = bands.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("band", "parts"))).alias("bands"), F.sum("n").alias("grams"), F.sum("sets").alias("sets"))
    large = materialise(whole.filter((F.col("grams") > CELL) | (F.col("sets") > CELL_SETS)).select("root", "bands"), "jaccard-large")
    rows = grouped.join(large, "root", "left").withColumn("band", band)
    parts_of = lambda b: F.coalesce(F.try_element_at("bands", b), F.lit(0))
    own = F.pmod(F.xxhash64("node"), parts_of(F.col("band"))).cast("int")
    rows = rows.withColumn("part", F.when(F.col("bands").isNotNull(), own))
    cell = lambda lb, lp, hb, hp, side: F.struct(lb.cast("long").alias("low_band"), lp.cast("int").alias("low_part"), hb.cast("long").alias("high_band"), hp.cast("int").alias("high_part"), side.cast("int").alias("side"))
    b, p, zero = F.col("band"), F.col("part"), F.lit(0)
    numbers = lambda c: F.filter(F.sequence(F.lit(0), F.greatest(c - 1, F.lit(0))), lambda k: k < c)
    same = F.transform(numbers(parts_of(b)), lambda k: cell(b, F.least(p, k), b, F.greatest(p, k), F.when(p == k, 0).when(p < k, 1).otherwise(2)))
    above = F.transform(numbers(parts_of(b + 1)), lambda k: cell(b, p, b + 1, k, F.lit(1)))
    below = F.transform(numbers(parts_of(b - 1)), lambda k: cell(b - 1, k, b, p, F.lit(2)))
    one = F.array(cell(zero, zero, zero, zero, zero))
    rows = rows.withColumn("cell", F.explode(F.when(F.col("bands").isNull(), one).otherwise(F.concat(same, above, below))))
    return rows.select("node", "n", "shared", "copies", "root", "cell.*")


def _joined(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """What link() returns, with `text_hash`."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    path = new_path(docs.sparkSession, "jaccard-blocks")
    table = write_table(block_table(docs, n), path, **{"parquet.block.size": "8388608"})
    buckets = bucket_count(table)
    rows = table.select("block", F.posexplode(F.arrays_zip("doc_ids", "hashes", "sizes", "h1", "h2")).alias("pos", "d"))
    rows = rows.select(((F.col("block") * (1 << 24)) + F.col("pos")).alias("node"), F.col("d.doc_ids").alias("doc_id"), F.col("d.hashes").alias("text_hash"), F.col("d.sizes").alias("n"), F.col("d.h1").alias("h1"), F.col("d.h2").alias("h2"))
    rows = materialise(rows, "jaccard-rows")
    classes = rows.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("least"), F.min("node").alias("node"), F.count("*").alias("copies"))
    classes = materialise(classes, "jaccard-classes")

    asked = table.select(*BLOCKS.names).mapInArrow(tidy(_ask(n, buckets)), "bucket int, block long, low binary, sets binary")
    answers = asked.groupBy("bucket").applyInArrow(tidy_table(_rarity), "block long, bucket int, rarity binary")
    left = table.select("block", "sizes", "h1", "h2", "lengths", "ids", "keys")
    kept = left.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tidy_groups(_survivors(n, percent, buckets)), "node long, n int, shared binary")
    kept = materialise(kept.join(classes.select("node", "copies"), "node"), "jaccard-kept")
    drop_table(docs.sparkSession, path)

    postings = kept.select("node", "n", "shared").mapInArrow(tidy(_prefixes(percent)), "gram long, node long")
    stars = postings.groupBy("gram").agg(F.min("node").alias("star"), F.count("*").alias("c")).filter("c > 1").select("gram", "star")
    edges = postings.join(stars, "gram").filter("node != star").select(F.col("node").alias("a"), F.col("star").alias("b"))
    cells = _cells(kept.join(components(edges, "jaccard-groups"), "node"), percent)
    links = materialise(cells.groupBy(*CELL_KEY).applyInArrow(tidy_table(_cell(percent)), "a long, b long, links long"), "jaccard-links")
    joined = components(links.filter("b IS NOT NULL").select("a", "b"), "jaccard-joined")

    counted = links.filter("links IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = classes.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node")).join(counted, "node", "left")
    several = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("c")).filter("c > 1").select("root", "component_id")
    named = named.join(several, "root", "left").select("n", "h1", "h2", "root", F.coalesce("component_id", "least").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    found = rows.join(named, ["n", "h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "root")


def link(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """Join documents by the Jaccard similarity of their sets of word n-grams: doc_id, n_shingles, component_id, n_links.

    Words are lower-cased in A-Z and parted by ASCII white space; a text with fewer than n words is one n-gram, and a null
    text or one without words has no n-gram and no link. Two documents link when 100 * common >= percent * all n-grams.
    component_id is the least doc_id that links reach, the row's own included (null ids count last: null only if all are);
    n_links is the number of other rows that a row links to. Repeated rows are each returned; other columns are not read; an
    empty table gives no rows. N-grams and words are known by 64-bit hashes, sets by 128-bit ones.

    1. Blocks of documents ask buckets of n-grams which of their n-grams other sets have too (32 bits for each n-gram, and
       a few bits back). A set with fewer such n-grams than it needs has no partner, and drops out.
    2. The rest post their rarest n-grams, as many as two similar sets have one in common of. Star edges between sets that
       share one, linear in the postings, give groups outside of which no links are.
    3. Each group is searched by DivideSkip; a group too large for one task in parts by size and hash, every pair of parts
       that can link in its own task. All links between different sets are found and counted; only those that connect
       something leave the task.

    Keys of joins that very many rows may have (copies of one text, a star's n-gram) are left to Spark's skew joins.
    """
    return _joined(docs, n, percent).select("doc_id", "n_shingles", "component_id", "n_links")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each group of near duplicates, with all its columns: that with the smallest doc_id (null last).

    Of rows with that id the one with the smallest hash of its text stays; rows equal in both are one, the smallest by all
    columns. Rows without words (null and empty texts) are no duplicates and all stay; an empty table stays empty.

    What goes is found on ids and hashes. Texts meet the list of rows that stay in a join that Catalyst broadcasts by the
    list's size, and only texts of repeated rows are grouped.
    """
    found = _joined(docs, n, percent)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    rows = found.filter("n_shingles > 0").groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("c")).groupBy("root").agg(F.min(F.struct(*[key[c].alias(c) for c in ("none", "doc_id", "text_hash")], "c")).alias("k"))
    wordless = found.filter("n_shingles = 0").select("doc_id", "text_hash", F.lit(1).alias("c"))
    stay = rows.select("k.doc_id", "k.text_hash", "k.c").unionByName(wordless).distinct()
    names = {"doc_id": "_stay_id", "text_hash": "_stay_hash", "c": "_stay_count"}  # none of a table's own columns
    stay = materialise(stay.select(*[F.col(c).alias(n) for c, n in names.items()]), "jaccard-stay")
    kept = docs.join(stay, docs["doc_id"].eqNullSafe(F.col("_stay_id")) & (F.xxhash64(docs["text"]) == F.col("_stay_hash")))
    once = kept.filter(F.col("_stay_count") == 1).select(docs["*"])
    again = kept.filter(F.col("_stay_count") > 1).groupBy("_stay_id", "_stay_hash").agg(F.min(F.struct(docs["*"])).alias("_row")).select("_row.*")
    return once.unionByName(again)


def op3_jaccard(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(list_zip(w[1:-3], w[2:-2], w[3:]), lambda t: t[1] || ' ' || t[2] || ' ' || t[3])) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT y, root FROM reach JOIN links ON x = doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.component_id, coalesce(k.n, 0) AS n_links
FROM sets s JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) r ON r.doc_id = s.doc_id
LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) k ON k.x = s.doc_id
"""
