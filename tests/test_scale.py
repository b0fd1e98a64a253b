"""What keeps the queries over packages in proportion to their input."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from vellum.functions import batches
from vellum.operators import render as R
from vellum.plans import content
from vellum.sources import docx, make_docx
from vellum.sources.package import Limits, open_package
from vellum.sources.xml import parse

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_one_row_group_are_dealt_to_all_cores(spark, tmp_path):
    """A file of one row group has as many splits as it has bytes, all but one of them empty."""
    pq.write_table(pa.table({"doc_id": range(4000), "text": [str(i) * 20 for i in range(4000)]}), f"{tmp_path}/t.parquet", compression="none")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = spark.read.parquet(f"{tmp_path}/t.parquet")
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = make_docx.spread(rows).rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(sizes) == 4000 and max(sizes) < 4000 / spark.sparkContext.defaultParallelism


def test_batches_hold_few_rows_and_bytes():
    schema = pa.schema([("a", pa.string())])
    small = list(batches.batches_of((({"a": str(i)}, 1) for i in range(200)), schema))
    assert [b.num_rows for b in small] == [64, 64, 64, 8]
    assert [b.num_rows for b in batches.batches_of((({"a": "x"}, 1 << 19) for _ in range(5)), schema)] == [2, 2, 1]
    large = pa.RecordBatch.from_pylist([{"a": "x" * 300_000} for _ in range(10)], schema=schema)
    assert [len(r["a"]) for r in batches.rows_of([*small, large])][-11:] == [3] + [300_000] * 10


def test_packages_are_read_in_batches_of_several_rows_and_few_bytes(spark):
    found = docx.parse_packages(make_docx.as_packages(spark.range(300).selectExpr("id AS doc_id", "'a' AS text")))
    assert found.filter("error IS NULL").count() == 300
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m"


def test_only_the_wanted_package_is_made(monkeypatch):
    made = []
    monkeypatch.setattr(make_docx, "package", lambda *a, **k: made.append(a) or b"")
    for k in range(20):
        made.clear()
        make_docx.broken_package(k, "text")
        assert len(made) == (k > 2)


def test_more_files_do_not_make_more_batches():
    assert content.files_at_once(125) == 40
    assert all(-(-n // content.files_at_once(n)) <= 8 for n in (1025, 60_025, 360_025))


@pytest.mark.parametrize(("name", "steps"), [("rich_zip_entries", 4), ("model_round_trip", 2), ("missing_targets", 1), ("block_kinds", 1)])
def test_packages_are_made_and_read_once(spark, name, steps):
    told = plan(entry.queries()[name](spark, SMALL))
    assert told.count("MapInArrow") == steps and "Join" not in told and "Union" not in told


def test_blocks_are_ordered_within_their_row(spark):
    assert "Aggregate" not in plan(entry.queries()["rich_blocks"](spark, SMALL))


def test_parts_are_parsed_and_inflated_once(monkeypatch):
    from vellum.sources import package as P

    told = []
    monkeypatch.setattr(P, "parse", lambda data: told.append(data) or parse(data))
    monkeypatch.setattr(P, "_shared", lambda data: told.append(data) or parse(data))
    found = docx.read_package(make_docx.rich_package(1, ["a"]), "a.docx", Limits(ratio=2000))
    assert found["error"] is None and len(told) == len(set(told))


def test_entries_that_are_damaged_are_refused():
    whole = make_docx.package(make_docx.paragraph("text"))
    at = whole.index(b"word/document.xml") + len("word/document.xml")
    assert open_package(whole, Limits()).parts.get("word/document.xml").endswith(b"</w:document>")
    for broken in (whole[: at + 9] + bytes([whole[at + 9] ^ 64]) + whole[at + 10 :], whole.replace(b"word/document.xml", b"word/documenu.xml", 1)):
        assert docx.read_package(broken, "a.docx")["error"] == "invalid-input"


def test_outputs_of_one_pass_are_those_of_several(spark):
    rows = content._models(spark, SMALL, content.KINDS).limit(20)
    both = {r["doc_id"]: r["outputs"] for r in R.convert_each(rows, [("markdown", "zip"), ("html", "standalone")]).collect()}
    for k, (format, mode) in enumerate([("markdown", "zip"), ("html", "standalone")]):
        for r in R.convert(rows, format, mode).collect():
            assert r.asDict() == {"doc_id": r["doc_id"], **both[r["doc_id"]][k].asDict()}


def test_archives_are_those_of_zipfile():
    import io
    import random
    import zipfile

    from vellum.sources.archive import zip_of

    noise = random.Random(3)
    files = [("mimetype", b"x"), ("a/b.xml", "<a>" + "text é " * 900 + "</a>"), ("empty", b""), ("big.bin", bytes(noise.choices(range(9), k=200_000)))]
    for more, level in (([], -1), ([], 9), ([("\u00e9.txt", b"y")], 9)):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in files + more:
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED, level)
        assert zip_of(files + more, level, ("mimetype",)) == out.getvalue()


def test_regular_packages_need_no_zip_reader(monkeypatch):
    data = make_docx.rich_package(4, ["one", "two"])
    found = docx.read_package(data, "a.docx")
    damaged = bytearray(data)
    damaged[data.index(b"word/document.xml") + 30] ^= 255
    assert found["error"] is None and docx.read_package(bytes(damaged), "a.docx")["error"] == "invalid-input"
    monkeypatch.setattr("zipfile.ZipFile", None)
    assert docx.read_package(data, "a.docx") == found


def test_texts_unlike_captions_are_not_normalised(spark):
    from pyspark.sql import functions as F

    from vellum.operators import styles as Y

    texts = ["Figure 1", " - FIG. 2", "figures", "The figure", "", None, "F\u00edgure 3", "f\u0301igure", "\u212aop", "\u00e9 figure", "**tabel*", "t\u00e1bel 1", "1 figure", "ph\u00f6to", "Photo", "afbeelding", "\u201cimage\u201d", "fo to", "\U0001d405 foto", "\nfoto"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    whole = Y.normal_name(F.col("text")).rlike(rf"^({'|'.join(Y.CAPTION_STARTS)})\b")
    assert rows.filter(~F.equal_null(Y.is_caption(F.col("text")), whole)).count() == 0
    assert rows.filter(Y.is_caption(F.col("text"))).count() == 12
    assert rows.filter(F.col("text").rlike(Y._LIKE_CAPTION) & F.col("text").isin("The figure", "1 figure", "")).count() == 0


def test_only_the_wanted_relations_are_kept(spark):
    data = make_docx.rich_package(7, ["one", "two"])
    whole = docx.read_package(data, "a.docx")
    for only in (("styles", "usages"), ("candidates",), ("model", "assets"), ("blocks",), ()):
        assert docx.read_package(data, "a.docx", only=only) == {k: whole[k] for k in ("error", "message", *only)}
    unsafe = make_docx.broken_package(12, "")
    assert docx.read_package(unsafe, "a.docx", only=("styles",)) == {"error": "unsupported-format", "message": docx.read_package(unsafe, "a.docx")["message"], "styles": []}
    queries = entry.queries()
    for name, absent in (("rich_styles", ("model#", "blocks#", "candidates#")), ("rich_edits", ("model#", "blocks#", "usages#")), ("rich_page", ("blocks#",)), ("rich_html", ("blocks#",)), ("docx_styles", ("blocks#",))):
        shown = plan(queries[name](spark, SMALL))
        assert "MapInArrow" in shown and not any(a in shown for a in absent), name


def test_rows_with_long_texts_make_small_batches(monkeypatch, spark):
    """Without the model too, what is held of packages has a bound."""
    weights = []
    monkeypatch.setattr(docx, "batches_of", lambda rows, schema: iter([weights.append(w) for _, w in rows]))
    held = {}
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, run, schema: held.update(run=run))
    docx.parse_packages(spark.createDataFrame([], "doc_id string, path string, content binary"), Limits(ratio=2000), only=("usages",))
    styled = make_docx.package(make_docx.paragraph("x" * 50_000, "Kop1"))
    list(held["run"]([pa.RecordBatch.from_pylist([{"doc_id": "1", "path": "a", "content": styled}])]))
    assert weights == [50_000]
