"""Operators on small relations."""

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import metadata as M
from vellum.operators import model as O
from vellum.operators import preview as P
from vellum.operators import structure as S
from vellum.operators import styles as Y
from vellum.operators import warnings as W

STYLE = "doc_id string, style_id string, name string, kind string, based_on string, font_size double, bold boolean, outline_level int, space_before double, numbering string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_base64_of_a_data_url_has_no_line_ends(spark):
    url = one(spark, T.data_url(F.lit("image/PNG"), F.lit(bytes(300))))
    assert url.startswith("data:image/png;base64,AAAA") and "\n" not in url and "\r" not in url


def test_fence_is_longer_than_any_run_of_backticks(spark):
    assert one(spark, T.fence(F.lit("a ``` b"))) == "````"
    assert one(spark, T.fence(F.lit("plain"))) == "```"


def test_links_of_other_schemes_are_not_safe(spark):
    for policy in ("html", "markdown", "epub"):
        assert one(spark, T.safe_href(F.lit(" JavaScript:alert(1)"), policy)) is None
    assert one(spark, T.safe_href(F.lit("https://x.org"), "epub")) is None
    assert one(spark, T.safe_href(F.lit("a/b.html"), "markdown")) == "a/b.html"


def test_language_codes(spark):
    assert one(spark, T.language_tag(F.lit("1031"))) == "de-DE"
    assert one(spark, T.language_tag(F.lit("en-GB"))) == "en-GB"
    assert one(spark, T.html_language(F.lit("not a tag"))) == "en"


def wide(styles):
    return styles.select("*", *[F.lit(None).cast(t).alias(c) for c, t in Y.FORMATS.items() if c not in styles.columns])


def test_style_inheritance_survives_cycles_and_missing_parents(spark):
    rows = [
        ("d", "A", "A", "paragraph", None, 10.0, True, None, None, None),
        ("d", "B", "B", "paragraph", "A", None, None, 1, None, None),
        ("d", "C", "C", "paragraph", "D", None, None, None, 3.0, None),
        ("d", "D", "D", "paragraph", "C", 9.0, None, None, None, None),
        ("d", "E", "E", "paragraph", "gone", None, None, None, None, "1:0"),
    ]
    found = {r["style_id"]: r for r in Y.effective_formats(wide(spark.createDataFrame(rows, STYLE))).collect()}
    assert (found["B"]["font_size"], found["B"]["bold"], found["B"]["outline_level"]) == (10.0, True, 1)
    assert (found["C"]["font_size"], found["C"]["space_before"]) == (9.0, 3.0)
    assert found["E"]["numbering"] == "1:0" and found["E"]["font_size"] is None


def judged(spark, **given):
    usual = {
        "style_id": "S", "name": "Plain", "kind": "paragraph", "based_on": None, "usages": 3, "first_position": 5, "short": False, "bold_text": False,
        "numbered_text": False, "near_figure": False, "caption_text": False, "most_size": 11.0, "document_size": 20.0, "bold": None, "spaced_text": False,
        "space_before": None, "outline_level": None, "toc_level": None, "user_mapping": None, "preset_mapping": None,
    }
    schema = (
        "style_id string, name string, kind string, based_on string, usages long, first_position long, short boolean, bold_text boolean, numbered_text boolean, near_figure boolean, "
        "caption_text boolean, most_size double, document_size double, bold boolean, spaced_text boolean, space_before double, outline_level int, toc_level int, user_mapping string, preset_mapping string"
    )
    row = Y.classify(spark.createDataFrame([tuple((usual | given).values())], schema)).first()
    return row["mapping"], row["confidence"]


def test_first_rule_that_fits_decides_a_style(spark):
    assert judged(spark) == ("body", "medium")
    assert judged(spark, user_mapping="author", outline_level=0) == ("author", "certain")
    assert judged(spark, outline_level=7, style_id="Heading3") == ("heading3", "high")
    assert judged(spark, outline_level=5) == ("heading6", "certain")
    assert judged(spark, name="Überschrift 2") == ("heading2", "medium")
    assert judged(spark, usages=1, first_position=0, short=True, most_size=40.0, document_size=40.0) == ("title", "high")
    assert judged(spark, name="Bijschrift") == ("caption", "high")
    assert judged(spark, near_figure=True, kind="character") == ("body", "medium")
    assert judged(spark, based_on="Heading2") == ("heading2", "medium")
    assert judged(spark, short=True, bold_text=True, space_before=6.0) == ("heading1", "low")


def test_metadata_takes_the_best_candidate_and_edits_win(spark):
    rows = [(1, "title", "low", "file", 7, "low", "inferred", 0), (1, "title", "best", "core", 1, "certain", "extracted", 5), (1, "authors", "A", "core", 1, "certain", "extracted", 0), (1, "authors", "A", "styles", 4, "high", "inferred", 1)]
    candidates = spark.createDataFrame(rows, "page_id long, field string, value string, source string, priority int, confidence string, method string, ord long")
    found = {r["field"]: r["value"] for r in M.resolve(candidates).collect()}
    assert found["title"] == "best"
    assert M.all_values(candidates, "authors").first()["values"] == ["A", "A"]
    edits = spark.createDataFrame([(1, "title", "  "), (1, "subject", "x")], "page_id long, field string, value string")
    after = {r["field"]: (r["value"], r["confidence"]) for r in M.overlay(M.resolve(candidates), edits).collect()}
    assert "title" not in after and after["subject"] == ("x", "certain")


def test_subtrees_go_with_their_root(spark):
    rows = spark.createDataFrame([("d", p) for p in ("00000", "00001", "00001.00000", "00001.00000.00002", "00010")], "doc_id string, path string")
    kept = S.without_subtrees(rows, spark.createDataFrame([("d", "00001")], "doc_id string, path string"), "doc_id", "path")
    assert sorted(r["path"] for r in kept.collect()) == ["00000", "00010"]


def test_chapters_start_where_they_are_told_to(spark):
    rows = spark.createDataFrame([("d", i, i in (0, 2, 3)) for i in range(5)], "doc_id string, ord long, start boolean")
    found = S.chapters(rows, "doc_id", "ord", F.col("start")).orderBy("ord").collect()
    assert [r["chapter"][-1] for r in found] == ["1", "1", "2", "3", "3"]


def test_warnings_are_deduplicated_by_kind(spark):
    rows = [("d", 0, "style-x", "m", "S"), ("d", 1, "style-x", "n", "S"), ("d", 2, "math-x", "m", None), ("d", 3, "math-x", "m", None), ("d", 4, "other", "m", None), ("d", 5, "other", "m", None)]
    found = W.deduplicate(spark.createDataFrame(rows, "doc_id string, ord long, code string, message string, style_id string"), "doc_id", "ord")
    assert sorted(r["ord"] for r in found.collect()) == [0, 2, 3, 4]


def test_model_envelope_round_trip_and_issues():
    model = {"schema": O.SCHEMA, "version": 1, "metadata": {}, "assets": {"a": {"data": b"\x00\xff"}}, "equations": {}, "notes": {}, "blocks": [], "styles": [], "warnings": []}
    assert O.from_json(O.to_json(model)) == model
    assert O.issues(model) == []
    assert O.issues([]) == [("$", "not-object")]
    assert O.issues(model | {"version": 2, "blocks": {}}) == [("$.version", "version"), ("$.blocks", "not-list")]


def test_presets_with_unknown_meanings_are_refused(spark):
    good = one(spark, O.preset_mappings(O.preset_json(F.create_map(F.lit("S"), F.lit("title")))))
    assert good == {"S": "title"}
    assert one(spark, O.preset_mappings(O.preset_json(F.create_map(F.lit("S"), F.lit("nonsense"))))) is None
    assert one(spark, O.preset_mappings(O.preset_json(F.create_map(F.lit("__proto__"), F.lit("title"))))) is None


def test_preview_keeps_references_as_they_stand():
    """One that no semicolon ends gets none, wherever it is; one that has it keeps it."""
    assert P.clean("<!-- \n --><h1>a &amp</h1>\n&amp; &#38 &#x26;<script>\n&lt</script>\n&am</p>&copy=1 &lt") == "<h1>a &amp</h1>\n&amp; &#38 &#x26;\n&am</p>&copy=1 &lt"


def test_preview_has_nothing_active(spark):
    html = '<p onclick="x()" style="a">Hi<script>alert(1)</script><a href="javascript:x">l</a><iframe src="y"></iframe></p>'
    assert one(spark, P.sanitise(F.lit(html))) == "<p>Hi<a>l</a></p>"


def test_no_spelling_of_an_active_target_or_handler_stays(spark):
    cases = {
        "<a href='javascript:x'>l</a>": "<a>l</a>", "<a href=javascript:x>l</a>": "<a>l</a>", "<img/onerror=x src=/a.png>": '<img src="/a.png">', '<a href="&#106;ava&Tab;script:x">l</a>': "<a>l</a>",
        '<a href=" java\nscript:x">l</a>': "<a>l</a>", '<img src="data:text/html;base64,eA">': "<img>", '<img src="data:image/png;base64,eA">': '<img src="data:image/png;base64,eA">', '<a href="ftp://x">l</a>': "<a>l</a>",
        '<a href="https://x">l</a>': "<a>l</a>", '<a href="#a">l</a>': '<a href="#a">l</a>', "<scr<script>ipt>x</script>y": "ipt&gt;xy", "<svg><p>x</p></svg>z": "z", "<form><input name=a>b</form>": "b", "<p>a < b &amp; c</p>": "<p>a &lt; b &amp; c</p>",
        "<title>t</title><P CLASS=a>q<br/>": '<p class="a">q<br>', "<!-- x --><?y?><!doctype html>z": "z", "<object><b>in</b></object>out": "out", "<link rel=x><meta a=b>t": "t", "<b style='x' srcset=y>k</b>": "<b>k</b>",
        "<p title='a\"b'>": '<p title="a&quot;b">', "<script>if (a < b) x()": "", "": "",
    }
    rows = spark.createDataFrame(list(enumerate([*cases, None])), "k int, html string")
    found = [r["safe"] for r in rows.select("k", P.sanitise(F.col("html")).alias("safe")).orderBy("k").collect()]
    assert dict(zip(cases, found, strict=False)) == cases and found[-1] is None


def test_models_are_judged_alike_in_both_forms(spark):
    good = '{"schema":"vellum/document","version":1,"metadata":{},"assets":{"a":{"data":{"$binary":"uint8-array","bytes":[0,255]}}},"equations":{},"notes":{},"blocks":[],"styles":[],"warnings":[]}'
    texts = [good, None, "", "[]", "{}", "no json", good.replace("[0,255]", "[256]"), good.replace('"$binary"', '"x"'), good.replace('"assets":{', '"assets":[').replace("}}},", "}}],", 1), good.replace('"blocks":[]', '"blocks":{}'), good.replace('"version":1', '"version":2')]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found = [[tuple(i) for i in r["i"]] for r in rows.select("k", O.model_issues(F.col("t")).alias("i")).orderBy("k").collect()]

    def told(text):
        try:
            return O.issues(O.from_json(text) if text is not None else None)
        except ValueError as e:
            return [("$.assets.a.data", "not-binary")] if "bytes" in str(e) else [("$", "not-object")]

    assert found[:8] == [told(t) for t in texts[:8]] and found[9:] == [told(t) for t in texts[9:]]


def test_slugs_and_names_are_those_of_decomposition(spark):
    import re
    import unicodedata

    from vellum.operators import render as R

    held = ["Résumé ½ ﬁn", "Ｆｕｌｌ", "x² + ÿ", "Ünï-Çödé", "", "---", "Ⅳ. Teil", "plain text", "\u0065\u0301a", "日本"]
    rows = spark.createDataFrame(list(enumerate(held)), "k int, t string").orderBy("k")
    assert [r["s"] for r in rows.select(T.slug(F.col("t")).alias("s")).collect()] == [R.slug(t) for t in held]
    name = lambda t: re.sub("[^a-z0-9]+", " ", "".join(c for c in unicodedata.normalize("NFD", t) if not "\u0300" <= c <= "\u036f").lower()).strip()
    assert [r["s"] for r in rows.select(Y.normal_name(F.col("t")).alias("s")).collect()] == [name(t) for t in held]


def test_formula_tokens_are_of_one_kind_in_both_forms(spark):
    from vellum.functions.formula import token_kind

    held = ["12", "1,5", "1.2.3", "٣", "½", "+", "≤≥", "*", "(", "ab", "é", "Ⅳ", "a1", "", "x y", "−", "1,", ",5"]
    rows = spark.createDataFrame(list(enumerate(held)), "k int, t string").orderBy("k")
    assert [r["s"] for r in rows.select(T.math_kind(F.col("t")).alias("s")).collect()] == [token_kind(t) for t in held]


def test_operations_report_results_and_errors_and_can_be_cancelled(spark):
    import time

    import pytest

    from vellum.plans.jobs import Operation

    assert Operation(spark, "count", lambda: spark.range(10).count()).start().result() == 10
    with pytest.raises(ZeroDivisionError):
        Operation(spark, "fail", lambda: 1 / 0).start().result()
    slow = Operation(spark, "slow", lambda: spark.range(10**12).selectExpr("sum(sqrt(id))").collect()).start()
    for _ in range(100):
        if slow.progress()[1]:
            break
        time.sleep(0.1)
    slow.cancel()
    with pytest.raises(Exception, match="(?i)cancel"):
        slow.result()


def test_people_are_replaced_removed_and_added(spark):
    people = spark.createDataFrame([(1, 0, "A"), (1, 1, "B"), (2, 0, "C")], "page_id long, ord int, name string")
    edits = spark.createDataFrame([(1, 0, " "), (1, 5, "Z"), (2, 0, " D ")], "page_id long, ord int, name string")
    assert sorted(tuple(r) for r in M.edit_people(people, edits).collect()) == [(1, 0, "B"), (1, 1, "Z"), (2, 0, "D")]


def test_reader_warnings_come_before_writer_warnings(spark):
    a = spark.createDataFrame([("d", 3, "r")], "doc_id string, ord int, code string")
    b = spark.createDataFrame([("d", 0, "w"), ("e", 1, "w")], "doc_id string, ord int, code string")
    assert sorted(tuple(r) for r in W.merged(a, b, "doc_id").select("doc_id", "ord", "code").collect()) == [("d", 0, "r"), ("d", 1, "w"), ("e", 0, "w")]


def test_first_violation_is_by_row_then_by_rule(spark):
    rows = spark.createDataFrame([("d", 0, 1), ("d", 1, 9), ("d", 2, 99), ("e", 0, 1)], "doc_id string, ord int, size int")
    found = {r["doc_id"]: r["code"] for r in S.first_violation(rows, "doc_id", "ord", [("huge", F.col("size") > 50), ("large", F.col("size") > 5)]).collect()}
    assert found == {"d": "large", "e": None}


def test_admission_and_publication_issues(spark):
    assert one(spark, T.admission_issue(F.lit("A.DOCX"), F.lit(""))) is None
    assert one(spark, T.admission_issue(F.lit("a.doc"), F.lit(None))) == "not-a-docx-name"
    assert one(spark, T.publication_issues(F.lit(" "), F.lit("urn:x"), F.lit("english!"))) == ["title", "language"]
