"""Licence scans, archives, URL rules, mixing, and the pipeline."""

import math

import pytest

import corpus_pipeline
from vellum.llm import licences, mixing, urlfilter, warc
from vellum.llm.common import materialise

DOCS = "doc_id long, text string, lang string, source string, n_chars long, target string, path string"
PERMISSION = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def docs(spark, texts, source=None):
    return spark.createDataFrame([(i, t, "en", source[i] if source else "s", 1, "x", "y") for i, t in enumerate(texts)], DOCS)


# licences


def found(spark, *texts):
    rows = licences.scan_licences(docs(spark, texts)).orderBy("doc_id").collect()
    return [r["licences"] for r in rows]


def test_sentences_and_sequences_name_the_licence(spark):
    assert found(spark, PERMISSION, CLAUSES, CLAUSES + THIRD) == ["MIT", "BSD-2-Clause", "BSD-3-Clause"]
    assert found(spark, "Released under the MIT License.\nText.", "x. LICENSED under the apache license,  version 2.0! y") == ["MIT", "Apache-2.0"]
    assert found(spark, "SPDX-License-Identifier: MIT\nLicensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0,MIT"]


def test_texts_without_a_statement_have_no_licence(spark):
    assert found(spark, None, "", "The MIT License is short", "a license", "Released under the MIT", " \n|.") == [""] * 6


def test_texts_in_one_line_are_met(spark):
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
    one = lambda t: " ".join(t.split())
    numbered = CLAUSES.replace("1. ", "(1) ").replace("2. ", "(2) ")
    bullets = CLAUSES.replace(":\n\n1. ", ":\n* ").replace("2. ", "* ")
    assert found(spark, one(PERMISSION.replace("Somebody", "Somebody.")), one(CLAUSES + THIRD), apache, numbered, bullets) == ["MIT", "BSD-3-Clause", "Apache-2.0", "BSD-2-Clause", "BSD-2-Clause"]


def test_order_of_sentences_counts(spark):
    first, second = CLAUSES.split("1. ")[0], "1. " + CLAUSES.split("1. ")[1]
    assert found(spark, second + "\n" + first) == [""]


def test_long_texts_are_read_to_the_end(spark):
    assert found(spark, "word " * 300_000 + ".\nReleased under the MIT License.") == ["MIT"]


def test_scan_of_nothing(spark):
    assert licences.scan_licences(docs(spark, ["x"]).limit(0)).count() == 0


# archives

PAGES = "page_id long, url string, html string, record_type string"


def archived(spark, tmp_path, rows, **options):
    path = f"file://{tmp_path}/w"
    warc.write_pages(spark.createDataFrame(rows, PAGES), path)
    return spark.read.format("warc").options(**options).load(path)


def test_round_trip_with_revisits_and_odd_rows(spark, tmp_path):
    big, other = "é" * 600, "b" * 1000
    rows = [(1, "u", big, ""), (5, "u", big, ""), (3, "u", big, ""), (7, "u", other, ""), (8, "u", "small", ""), (9, "u", "small", ""), (10, None, None, ""), (11, "a\r\nX: y", "", ""), (None, "u", big, ""), (5, "u", big, ""), (12, "u", "WARC/1.1\r\n\r\n", "")]
    read = archived(spark, tmp_path, rows).collect()
    got = {(r["page_id"], r["record_type"], r["payload_bytes"], r["refers_to_page"]) for r in read}
    assert len(read) == len(rows)
    assert got == {(1, "revisit", 1200, 5), (5, "response", 1200, None), (3, "revisit", 1200, 5), (7, "response", 1000, None), (8, "response", 5, None), (9, "response", 5, None), (10, "response", 0, None), (11, "response", 0, None), (None, "revisit", 1200, 5), (12, "response", 12, None)}
    import hashlib

    assert all(r["payload_digest"] == hashlib.sha1(big.encode()).hexdigest() for r in read if r["payload_bytes"] == 1200)
    assert all(bytes(r["payload"]).decode() == big for r in read if r["page_id"] == 5)


def test_predicates_reach_the_reader_and_payloads_can_be_left(spark, tmp_path):
    read = archived(spark, tmp_path, [(i, f"http://h{i}/", f"p{i}" * 700, "") for i in range(20)])
    some = read.filter("record_type = 'response' AND page_id >= 18 AND target_uri LIKE 'http://h1%'")
    assert "Filter (" not in some._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["page_id"] for r in some.collect()) == [18, 19]
    bare = archived(spark, tmp_path / "x", [(1, "u", "p" * 2000, "")], payload="false").first()
    assert bare["payload"] is None and bare["payload_bytes"] == 2000


@pytest.mark.parametrize("split", [300, 1000, 10_000])
def test_split_files_give_each_record_once(spark, tmp_path, split):
    read = archived(spark, tmp_path, [(i, "u", f"{i} " * 500, "") for i in range(40)], splitBytes=str(split))
    assert sorted(r["page_id"] for r in read.select("page_id").collect()) == list(range(40))


def test_members_of_other_writers_are_read(spark, tmp_path):
    import gzip

    record = warc.record({"record_type": "response", "record_id": "<urn:x>", "page_id": 4, "payload": b"abc", "payload_bytes": 3, "payload_digest": None})
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) * 3)
    read = spark.read.format("warc").load(str(tmp_path))
    assert [bytes(r["payload"]) for r in read.collect()] == [b"abc"] * 3
    assert read.filter("page_id = 5").count() == 0


def test_files_that_are_not_packed_are_read(spark, tmp_path):
    made = [warc.record({"record_type": "response", "record_id": f"<urn:{i}>", "page_id": i, "payload": b"x" * i, "payload_bytes": i, "payload_digest": None}) for i in (0, 5, 70_000)]
    about = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 9\r\n\r\nfoo: bar\n\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(about + b"".join(made))
    read = spark.read.format("warc").load(str(tmp_path))
    assert [(r["page_id"], r["record_type"], len(r["payload"])) for r in read.collect()] == [(None, "warcinfo", 9), (0, "response", 0), (5, "response", 5), (70_000, "response", 70_000)]
    assert [r["payload_bytes"] for r in spark.read.format("warc").option("payload", "false").load(str(tmp_path)).filter("page_id >= 5").collect()] == [5, 70_000]


def test_headers_are_read_and_no_payload_behind_them():
    import io
    import os

    payload = os.urandom(3_000_000)  # of a record that is no HTTP message, and without a blank line to stop at
    block = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Type: image/png\r\nContent-Length: 3000000\r\n\r\n" + payload.replace(b"\r", b".") + b"\r\n\r\n"
    head = warc.Unpacked(warc.Buffered(io.BytesIO(warc.gzip_member(block)), 0, 0))
    row, _, http = warc.WarcReader("", True, 1)._head(head)
    assert row["record_type"] == "resource" and http == {} and head.used < 10_000


def test_archive_of_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_pages(spark.createDataFrame([], PAGES), path)
    assert spark.read.format("warc").load(path).count() == 0


# URL rules

RULES = [urlfilter.Rule("allow", "org", "/"), urlfilter.Rule("block", "example.org", "/es/"), urlfilter.Rule("block", "example.org", "/en/1"), urlfilter.Rule("block", "*.bad.com", "*/x*y/")]


def judged(spark, urls, rules=RULES):
    rows = urlfilter.filter_urls(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string"), rules)
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows.orderBy("page_id").collect()]


def test_longest_rule_of_a_host_and_its_subdomains_decides(spark):
    assert judged(spark, ["http://EXAMPLE.org/es/a", "http://a.example.org/es/?q", "http://example.org/en/12#f", "http://example.org/ES/", "http://notexample.org/es/", "http://example.org", "http://example.org.com/es/"]) == [
        ("example.org", "/es/a", "example.org/es/", "block"),
        ("a.example.org", "/es/", "example.org/es/", "block"),
        ("example.org", "/en/12", "example.org/en/1", "block"),
        ("example.org", "/ES/", "org/", "allow"),
        ("notexample.org", "/es/", "org/", "allow"),
        ("example.org", "", None, "allow"),
        ("example.org.com", "/es/", None, "allow"),
    ]


def test_odd_urls_and_wildcards(spark):
    assert judged(spark, [None, "", "no scheme", "http://", "http://u.bad.com/q/x1y/", "http://bad.com/q/x1y/", "http://spam-farm.net/", "a://b://c/d\n?e"]) == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("u.bad.com", "/q/x1y/", "*.bad.com*/x*y/", "block"), ("bad.com", "/q/x1y/", None, "allow"), ("spam-farm.net", "/", None, "block"), ("b:", "//c/d\n", None, "allow"),
    ]


def test_rules_are_filed_under_whole_pieces_of_any_segment():
    assert urlfilter.Rule("block", "*", "*/wp-login.php").tokens() == {"/wp", "/login"}
    assert urlfilter.Rule("block", "example.org", "/en/1").tokens() == {".example", ".org", "/en"}
    assert urlfilter.Rule("block", "a.*", "/x*y/z/").tokens() == {".a", "/z"}


def test_very_long_urls_are_read_whole(spark):
    url = "http://u.bad.com/" + "a/" * 200_000 + "es/x1y/"
    assert [r[3] for r in judged(spark, [url, url + "?q"], [urlfilter.Rule("block", "bad.com", "*/es/x*y/")])] == ["block", "block"]


def test_many_rules_in_several_indexes(spark, monkeypatch):
    urls = ["http://example.org/es/a", "http://u.bad.com/q/x1y/", "http://x.org/"]
    one = judged(spark, urls)
    monkeypatch.setattr(urlfilter, "RULES_PER_INDEX", 1)
    assert judged(spark, urls) == one
    assert judged(spark, [], RULES) == []
    assert judged(spark, ["http://x.org/"], []) == [("x.org", "/", None, "allow")]


# mixing


def mixed(spark, texts, source):
    return mixing.mix_documents(docs(spark, texts, source)).collect()


def test_budgets_fill_by_weight_up_to_their_cap(spark):
    texts = ["w " * 10] * 100 + ["w " * 10] * 4 + ["w " * 5] * 200
    rows = mixed(spark, texts, ["a"] * 100 + ["b"] * 4 + [None] * 200)
    by = {r["source"]: r for r in rows}
    assert (by["a"]["source_size"], by["b"]["source_size"], by[None]["source_size"]) == (1000, 40, 1000)
    assert by["b"]["target"] == 120.0
    assert by["a"]["target"] == pytest.approx((2040 - 120) / 4) and by[None]["target"] == pytest.approx((2040 - 120) * 3 / 4)
    for s in by:
        taken = sum(r["taken"] for r in rows if r["source"] == s)
        assert abs(taken - by[s]["target"]) <= 10
    assert all(r["taken"] <= 3 * r["size"] for r in rows)


def test_reruns_agree_and_odd_rows_take_nothing(spark):
    texts, source = [None, "", " \n", "a b", "a b", "c"], ["a", "a", "b", "b", None, ""]
    first = sorted(map(tuple, mixed(spark, texts, source)), key=str)
    assert first == sorted(map(tuple, mixed(spark, texts, source)), key=str)
    assert all(r[5] == 0 for r in first if r[2] == 0) and all(math.isfinite(r[4]) for r in first)
    assert mixed(spark, [], []) == []
    assert all(r["taken"] == 0 == r["target"] for r in mixed(spark, [None, ""], ["a", "b"]))


def test_one_source_takes_itself_once(spark):
    assert all(r["taken"] == r["size"] for r in mixed(spark, ["a b c"] * 20, ["s"] * 20))


def test_sum_of_targets_is_everything(spark):
    rows = mixed(spark, ["w " * n for n in range(1, 60)], [f"s{n % 7}" for n in range(59)])
    targets = {r["source"]: (r["target"], r["source_size"]) for r in rows}
    assert sum(t for t, _ in targets.values()) == pytest.approx(sum(r["size"] for r in rows))
    assert all(t <= 3 * s for t, s in targets.values())


# pipeline


def test_stages_keep_the_columns_and_fewer_rows(spark):
    from pathlib import Path

    if not Path("/root/testdata/sf0.001").is_dir():
        pytest.skip("no test data here")
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10_000, None, None, None, None), (10_001, "123", "en", "s", 3), (None, "the words of a document without a number", "en", None, 3)], rows.schema)
    now = rows.unionByName(odd)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "decontaminate", "mix"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now.count(), materialise(stage(spark, now, sf), f"test-{name}")
        assert now.columns == rows.columns and 0 < now.count() <= before
    last = corpus_pipeline.mix(spark, now, sf)
    assert last.count() == now.count()
    assert now.filter("doc_id IN (10000, 10001)").count() == 0


def test_the_whole_pipeline_on_planted_rows(spark, tmp_path):
    """Every stage's decision again by brute force on what the stage before it kept."""
    import random
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).parent))
    from test_models import TONGUES
    from test_search import brute_link, edit_distance_to_part

    rng = random.Random(31)
    insults = {"en": "scumbag", "de": "mistkerl", "fr": "connard"}
    pool = {g: w + [a + w[0] for a in w] for g, w in TONGUES.items()}
    rows, toxic = [], set()
    for i in range(900):
        lang = rng.choice(sorted(TONGUES))
        text = [rng.choice(pool[lang]) for _ in range(rng.randint(40, 60))]
        if rng.random() < 0.25:
            text[rng.randrange(len(text))] = insults[lang]
            toxic.add(i)
        rows.append([i, text, lang, f"s{i % 3}"])
    items = [[rng.choice(pool["en"]) for _ in range(20)] for _ in range(4)]
    clean = [r for r in rows if r[0] not in toxic]
    for k in range(20):
        copy = list(clean[k][1])
        if k % 2:
            copy[rng.randrange(len(copy))] = "changed"
        rows.append([1000 + k, copy, clean[k][2], "s1"])
    for k in range(8):
        leak = list(items[k % 4])
        if k > 3:
            leak[7] = "changed"
        rows.append([2000 + k, [*clean[40 + k][1][:20], *leak], "en", "s2"])
    rows = [(i, " ".join(t), g, s, 0) for i, t, g, s in rows] + [(3000, None, None, None, None), (3001, "12 ?", "en", "s1", 4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(900)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = materialise(stage(spark, now, str(tmp_path)), f"test-{name}")
        kept[name] = [(r["doc_id"], r["text"]) for r in now.collect()]
    ids = {name: {i for i, _ in held} for name, held in kept.items()}
    assert ids["language"] == {r[0] for r in rows} - {3000, 3001}
    gone = ids["language"] - ids["toxicity"]
    assert len(gone & toxic) >= 0.97 * len(toxic) and len(gone - toxic) <= 3
    told = {c for i, _, c, _ in brute_link(kept["toxicity"], 5, 80)}
    assert ids["near_duplicates"] == told
    leaks = {i for i, t in kept["near_duplicates"] if any(edit_distance_to_part(x, t.split()) <= 4 for x in items)}
    assert ids["decontaminate"] == ids["near_duplicates"] - leaks and {i for i in range(2000, 2008)} & ids["near_duplicates"] <= leaks
    mix = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in mix} == ids["decontaminate"]
    sizes = {i: len(t.split()) for i, t in kept["decontaminate"]}
    assert all(r["size"] == sizes[r["doc_id"]] and r["taken"] <= 3 * r["size"] for r in mix)


def test_the_pipeline_on_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mixing_of_very_long_texts_and_clashing_names(spark):
    rows = mixed(spark, ["w " * 2_000_000, "w"], ["a", "b"])
    assert {r["size"] for r in rows} == {2_000_000, 1}


def test_a_cluster_must_name_its_shared_folder(tmp_path):
    from types import SimpleNamespace

    from vellum.llm.common import shared_dir

    def session(master, **conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d), set=lambda k, v: conf.update({k.replace(".", "_"): v})), sparkContext=SimpleNamespace(master=master))

    assert shared_dir(session("spark://x", spark_checkpoint_dir="hdfs:///a/")) == "hdfs:///a"
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(session("spark://x"))
    assert shared_dir(session("local[2]")).startswith("file:///")


def test_tables_live_in_the_applications_part_of_the_folder(spark):
    from vellum.llm.common import drop_table, new_path, write_table

    path = new_path(spark, "t")
    assert spark.sparkContext.applicationId in path
    assert write_table(spark.range(3), path).count() == 3
    drop_table(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
