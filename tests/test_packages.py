"""Packages: reading, refusing, and writing them out again."""

import io
import json
import zipfile

import pytest

from vellum.functions.cover import cover_svg, text_width, wrap
from vellum.functions.formula import convert
from vellum.operators import render as R
from vellum.plans import corpus
from vellum.sources.docx import errors, parse_packages, read_docx, read_package, relation
from vellum.sources.make_docx import TYPES, package, paragraph
from vellum.sources.package import Limits, passive_svg
from vellum.sources.xml import XmlError, parse

RELS = '<Relationships xmlns="x"><Relationship Id="r1" Type="t/hyperlink" Target="https://example.org/a" TargetMode="External"/><Relationship Id="r2" Type="t/image" Target="media/a.png"/></Relationships>'
NUMBERS = '<w:numbering xmlns:w="w"><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>'
SHEET = '<w:styles xmlns:w="w"><w:style w:type="paragraph" w:styleId="Heading1"><w:name w:val="heading 1"/><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style><w:style w:type="paragraph" w:styleId="Normal" w:default="1"><w:name w:val="Normal"/></w:style></w:styles>'
CORE = "<c:p xmlns:c='c' xmlns:d='d'><d:title>Rivers of Clay</d:title><d:creator>Ilse Moor; Bo</d:creator><d:language>2057</d:language></c:p>"
NOTES = '<w:footnotes xmlns:w="w"><w:footnote w:id="-1"><w:p/></w:footnote><w:footnote w:id="1">' + paragraph("A note.") + "</w:footnote></w:footnotes>"


def item(text, level):
    return f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'


BODY = (
    paragraph("Chapter & more", "Heading1")
    + '<w:p><w:r><w:rPr><w:b/><w:i w:val="0"/></w:rPr><w:t>bold</w:t></w:r><w:hyperlink r:id="r1"><w:r><w:t>link</w:t></w:r></w:hyperlink><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:r><w:footnoteReference w:id="1"/></w:r></w:p>'
    + item("one", 0) + item("deep", 1) + item("two", 0)
    + "<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val='2'/></w:tcPr>" + paragraph("a|b") + "</w:tc></w:tr><w:tr><w:tc>" + paragraph("c") + "</w:tc></w:tr></w:tbl>"
    + "<w:p><m:oMathPara><m:oMath><m:f><m:num><m:r><m:t>1</m:t></m:r></m:num><m:den><m:r><m:t>x</m:t></m:r></m:den></m:f></m:oMath></m:oMathPara></w:p>"
    + '<w:p><w:r><w:drawing><docPr descr="A dot"/><a:blip r:embed="r2"/></w:drawing></w:r></w:p>'
    + '<w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>PAGEREF x</w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>17</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r><w:r><w:t>after</w:t></w:r></w:p>'
)
FULL = package(BODY, {"word/_rels/document.xml.rels": RELS, "word/numbering.xml": NUMBERS, "word/styles.xml": SHEET, "docProps/core.xml": CORE, "word/footnotes.xml": NOTES, "word/media/a.png": b"png", "word/header1.xml": "<h/>", "word/vbaProject.bin": b"x"})


@pytest.fixture(scope="module")
def read():
    found = read_package(FULL, "dir/My File.docx")
    assert found["error"] is None, found["message"]
    return found | json.loads(found["model"])


def test_blocks_are_what_the_document_says(read):
    kinds = [b["type"] for b in read["blocks"] if isinstance(b, dict) and "root" not in b]
    assert kinds[:5] == ["paragraph", "paragraph", "list", "table", "equationBlock"]
    lst = next(b for b in json.loads(read["model"])["blocks"] if b["type"] == "list")
    assert lst["ordered"] and len(lst["items"]) == 2
    assert [b["type"] for b in lst["items"][0]["blocks"]] == ["paragraph", "list"]
    assert not lst["items"][0]["blocks"][1]["ordered"]
    second = json.loads(read["model"])["blocks"][1]["children"]
    assert second[0]["marks"] == [{"type": "bold"}]
    assert second[1] == {"type": "link", "href": "https://example.org/a", "children": [{"type": "text", "text": "link"}]}
    assert second[2] == {"type": "noteReference", "noteId": "footnote-1"}
    assert json.loads(read["model"])["blocks"][-1]["children"] == [{"type": "text", "text": "after"}]


def test_the_reader_says_what_it_left_out(read):
    assert {w["code"] for w in read["warnings"]} == {"active-content-disabled", "decorative-furniture-omitted", "tracked-deletion-omitted"}


def test_metadata_candidates(read):
    found = [(c["field"], c["value"]) for c in read["candidates"]]
    assert found[:4] == [("title", "Rivers of Clay"), ("authors", "Ilse Moor"), ("authors", "Bo"), ("language", "en-GB")]
    assert ("identifier", "urn:vellum:my-file") in found and ("title", "My File") in found


def test_deleted_text_is_not_used(read):
    assert "gone" not in json.dumps(read["usages"]) and read["usages"][0]["style_id"] == "Heading1"


@pytest.mark.parametrize(
    ("data", "code"),
    [
        (b"", "unsupported-format"),
        (b"plain text", "unsupported-format"),
        (b"PK\x03\x04 cut off", "invalid-input"),
        (package("", {"word/document.xml": None}), "invalid-input"),
        (package("", {"[Content_Types].xml": None}), "invalid-input"),
        (package("", types=TYPES.replace("main+xml", "other+xml")), "unsupported-format"),
        (package("", {"word/document.xml": "<!DOCTYPE x [<!ENTITY a 'b'>]><w:document/>"}), "invalid-input"),
        (package("<w:p>"), "invalid-input"),
        (package("", {"EncryptedPackage": b"x"}), "encrypted-document"),
        (package("", {"../x": b"x"}), "invalid-input"),
        (package("", {"word/big.bin": bytes(10_000_000)}), "resource-limit"),
        (package("", {"word/_rels/document.xml.rels": RELS.replace('media/a.png"', 'http://x/a.png" TargetMode="External"')}), "unsupported-format"),
        (package('<w:p><w:hyperlink r:id="r1"/></w:p>', {"word/_rels/document.xml.rels": RELS.replace("https:", "javascript:")}), "unsupported-format"),
    ],
)
def test_hostile_packages_have_an_error_code(data, code):
    found = read_package(data, "x.docx")
    assert found["error"] == code and found["model"] is None


def test_literal_reading_is_what_simple_readers_do():
    body = '<w:p><w:r><w:rPr><w:b w:val="0"/></w:rPr><w:t>t</w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p><w:sdt><w:sdtContent>' + paragraph("inside") + "</w:sdtContent></w:sdt>"
    data = package(body, {"word/styles.xml": SHEET})
    for literal, marks, texts, used in ((False, None, ["t", "inside"], "t"), (True, [{"type": "bold"}], ["t"], "tgone")):
        found = read_package(data, "x.docx", literal=literal)
        assert json.loads(found["model"])["blocks"][0]["children"][0].get("marks") == marks
        assert [b["text"] for b in found["blocks"]] == texts and found["usages"][0]["text"] == used


def test_limits_can_be_set():
    assert read_package(FULL, "x.docx", Limits(entries=3))["error"] == "resource-limit"
    assert read_package(FULL, "x.docx", Limits(image=2))["error"] == "resource-limit"
    assert read_package(FULL, "x.docx", Limits(compressed=100))["error"] == "resource-limit"


@pytest.mark.parametrize("body", ["<script/>", "<rect onload='x'/>", "<use href='#a'/>", "<a href='http://x'/>", "<rect fill='url(http://x)'/>", "<style>@import 'x'</style>"])
def test_active_svg_is_refused(body):
    assert not passive_svg(f"<svg xmlns='s'>{body}</svg>".encode())


def test_passive_svg_passes():
    assert passive_svg(b"<svg xmlns='s'><rect fill='url(#a)'/><a href='#b'/></svg>")


def test_xml_keeps_mixed_content_and_refuses_types():
    root = parse("<a x:b='1'>t<c>u</c>v&amp;&#x41;</a>")
    assert root.text() == "tuv&A" and root.get("b") == "1"
    for bad in ("<a>", "<a/><b/>", "<!DOCTYPE a><a/>", "<a>&x;</a>", "<a b=1/>"):
        with pytest.raises(XmlError):
            parse(bad)


def doc(read, **metadata):
    model = json.loads(read["model"])
    meta = {"title": "Rivers of Clay", "language": "en-GB", "identifier": "urn:x", "authors": ["Ilse"]} | metadata
    return R.Doc(R.map_styles(model["blocks"], {"Heading1": "heading1"}), model["notes"], model["equations"], meta, {a["asset_id"]: a for a in read["assets"]})


def test_html_is_complete_and_the_same_each_time(read):
    html = R.write_html(doc(read)).decode()
    assert html == R.write_html(doc(read)).decode()
    for part in ('<html lang="en-GB">', '<h1 class="document-title">Rivers of Clay</h1>', '<h2 id="chapter-more">Chapter &amp; more</h2>', "<strong>bold</strong>", '<a href="https://example.org/a">link</a>', "<ol><li><p>one</p><ul><li><p>deep</p></li></ul></li><li><p>two</p></li></ol>", '<td colspan="2"><p>a|b</p></td>', "<mfrac><mn>1</mn><mi>x</mi></mfrac>", 'alt="A dot"', "data:image/png;base64,cG5n", '<li id="note-footnote-1"><p>A note.</p>'):
        assert part in html, part


def test_html_zip_holds_page_style_and_images(read):
    z = zipfile.ZipFile(io.BytesIO(R.write_html(doc(read), "zip")))
    assert z.namelist() == ["document.html", "images/image-001.png", "styles.css"]
    assert b'src="images/image-001.png"' in z.read("document.html")


def test_markdown(read):
    data, warnings = R.write_markdown(doc(read), formula="source")
    text = data.decode()
    for part in ("# Rivers of Clay\n\n## Chapter & more", "**bold**[link](https://example.org/a)[^footnote-1]", "1. one\n   - deep\n2. two", "| a\\|b |\n| --- |\n| c |", "$$\n\\frac{1}{x}\n$$", "[^footnote-1]: A note."):
        assert part in text, part
    assert [w["code"] for w in warnings] == ["markdown-table-span"]


def test_epub_has_its_files_in_order(read):
    z = zipfile.ZipFile(io.BytesIO(R.write_epub(doc(read), "2026-01-02", cover_svg=cover_svg("T"))))
    assert z.namelist()[:7] == ["mimetype", "META-INF/container.xml", "EPUB/package.opf", "EPUB/nav.xhtml", "EPUB/styles.css", "EPUB/cover.svg", "EPUB/cover.xhtml"]
    assert z.getinfo("mimetype").compress_type == zipfile.ZIP_STORED
    for name in z.namelist():
        if name.endswith((".xhtml", ".opf", ".svg")):
            parse(z.read(name).replace(b"<!DOCTYPE html>", b""))
    assert b"https://example.org" not in b"".join(z.read(n) for n in z.namelist())
    with pytest.raises(R.EpubError):
        R.write_epub(doc(read, identifier=" "), "2026-01-02")
    with pytest.raises(R.EpubError):
        R.write_epub(doc(read), "yesterday")


def test_chapters_split_at_second_level_headings():
    h = lambda level: {"type": "heading", "level": level, "children": []}
    p = {"type": "paragraph", "children": []}
    assert [len(c) for c in R.split_chapters([h(2), p, h(3), h(2), h(2)])] == [3, 1, 1]
    assert R.split_chapters([]) == [[]]


def test_formulas():
    run = lambda t: f"<m:r><m:t>{t}</m:t></m:r>"
    wrap_ = lambda x: f'<m:oMath xmlns:m="m">{x}</m:oMath>'
    root = convert(wrap_(f"<m:rad><m:deg>{run(3)}</m:deg><m:e>{run('y')}</m:e></m:rad>"))
    assert root["tex"] == r"\sqrt[3]{y}" and root["complete"]
    assert convert(wrap_(f"<m:m><m:mr><m:e>{run(1)}</m:e><m:e>{run(2)}</m:e></m:mr></m:m>"))["tex"] == r"\begin{matrix}1 & 2\end{matrix}"
    odd = convert(wrap_(f"<m:nary>{run('&lt;')}</m:nary>"))
    assert odd["unsupported"] == ["nary"] and not odd["complete"] and "<" not in odd["fallback"]
    assert convert("<broken")["unsupported"] == ["malformed-omml"]
    assert convert(wrap_(run("x_1 50%\\")))["tex"] == r"\text{x\_1 50\%\textbackslash{}}"


def test_cover_text_fits_its_lines():
    lines = wrap("An incomprehensibilityextraordinarily long title", 100, 700)
    assert all(text_width(x, 100) <= 700 for x in lines) and len(lines) > 2
    assert "&lt;b&gt;" in cover_svg("<b>")
    with pytest.raises(ValueError, match="out of range"):
        cover_svg("x", margin=26)


def test_corpus_from_files_to_outputs(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(FULL)
    (tmp_path / "b.DOCX").write_bytes(b"no zip")
    (tmp_path / "c.txt").write_bytes(b"other")
    packages = read_docx(spark, str(tmp_path))
    assert packages.count() == 2
    assert [r["error"] for r in errors(packages).collect()] == ["unsupported-format"]
    styles = {r["style_id"]: r["mapping"] for r in corpus.analyse(packages).collect()}
    assert styles["Heading1"] == "heading1"
    made = corpus.convert(packages, "markdown", "zip", "2026-01-31").collect()
    made.sort(key=lambda r: r["error"] or "")
    assert [r["error"] for r in made] == [None, "unsupported-format"] and made[0]["files"] == ["document.md", "images/image-001.png"]
    assert [w["ord"] for w in made[0]["warnings"]] == list(range(len(made[0]["warnings"]))) and made[0]["warnings"][0]["code"] == "active-content-disabled"
    assert b"# Rivers of Clay" in zipfile.ZipFile(io.BytesIO(bytes(made[0]["data"]))).read("document.md")


def test_a_conversion_is_one_pass_without_a_shuffle(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(FULL)
    plan = corpus.convert(read_docx(spark, str(tmp_path)), "epub", "single", "2026-01-31")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Exchange" not in plan and "Join" not in plan


def test_styles_that_share_an_id_and_very_many_styles(spark):
    from pyspark.sql import functions as F

    from vellum.operators import styles as Y

    sheet = '<w:styles xmlns:w="w">' + "".join(f'<w:style w:type="{t}" w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for t, i, n in (("paragraph", "Twin", "Kop 2"), ("character", "Twin", "Twin"), ("paragraph", "Twin", "Kop 3"))) + "</w:styles>"
    body = paragraph("x", "Twin") + '<w:p><w:r><w:rPr><w:rStyle w:val="Twin"/></w:rPr><w:t>y</w:t></w:r></w:p>'
    rows = spark.createDataFrame([("a", "a.docx", package(body, {"word/styles.xml": sheet}))], "doc_id string, path string, content binary")
    made = corpus.convert(parse_packages(rows), "html", "fragment", "2026-01-31").collect()
    assert made[0]["error"] is None and b"<h4" in bytes(made[0]["data"])
    many = spark.range(100).select(F.lit("d").alias("doc_id"), F.format_string("s%03d", "id").alias("style_id"), F.when(F.col("id") > 0, F.format_string("s%03d", F.col("id") - 1)).alias("based_on"), *[F.when(F.col("id") == 0, 7.0 if c == "font_size" else None).cast(t).alias(c) for c, t in Y.FORMATS.items()])
    assert {r["font_size"] for r in Y.effective_formats(many).collect()} == {7.0}


def test_edits_covers_and_publication_dates(spark):
    rows = spark.createDataFrame([("a", "a.docx", FULL)], "doc_id string, path string, content binary")
    packages = parse_packages(rows)
    meta = json.loads(corpus.resolved_metadata(packages, "2026-01-31", edits={"title": "", "language": "nl"}, subjects=[" x "]).first()["metadata"])
    assert "title" not in meta and meta["language"] == "nl" and meta["subjects"] == ["x"] and meta["publicationDate"] == "2026-01-31"
    made = corpus.convert(packages, "epub", "single", "2026-01-31", cover={"layout": "typographic"}).first()
    assert "EPUB/cover.svg" in made["files"] and "EPUB/cover.xhtml" in made["files"]
    assert corpus.convert(packages, "epub", "single", "2026-01-31", edits={"title": " "}).first()["error"] == "invalid-model"


def test_requests_report_phases_results_errors_and_cancellation(spark, tmp_path):
    from vellum.plans.jobs import Runtime

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(FULL)
    (tmp_path / "in" / "b.docx").write_bytes(b"x")
    said: list[dict] = []
    runtime = Runtime(spark, said.append)
    for request in (
        {"type": "analyse", "operation": "one", "path": str(tmp_path / "in"), "table": str(tmp_path / "t")},
        {"type": "convert", "operation": "two", "table": str(tmp_path / "t"), "output": str(tmp_path / "o"), "format": "epub", "date": "2026-01-31"},
        {"type": "convert", "operation": "three", "table": str(tmp_path / "none"), "output": str(tmp_path / "p"), "format": "html", "date": "2026-01-31"},
    ):
        runtime.handle(request)
        runtime.wait(request["operation"])
    assert [(m["operation"], m["type"], m.get("phase")) for m in said] == [("one", "progress", "inspect"), ("one", "progress", "read"), ("one", "analysed", None), ("two", "progress", "write"), ("two", "output", None), ("three", "progress", "write"), ("three", "error", None)]
    assert (said[2]["packages"], said[2]["refused"]) == (2, 1) and said[4]["media_type"] == "application/epub+zip" and said[6]["code"] == "conversion-failed"
    assert spark.read.parquet(str(tmp_path / "o")).filter("error IS NULL").count() == 1
    said.clear()
    runtime.handle({"type": "cancel", "operation": "nobody"})
    runtime.send = lambda m: said.append(m) or (m.get("phase") == "inspect" and runtime.handle({"type": "cancel", "operation": "four"}))
    runtime.handle({"type": "analyse", "operation": "four", "path": str(tmp_path / "in"), "table": str(tmp_path / "u")})
    runtime.wait("four")
    assert [m.get("phase") or m["code"] for m in said] == ["inspect", "cancelled"] and runtime.active() == 0


def test_stream_reads_what_arrives(spark, tmp_path):
    from vellum.streaming.ingest import sink, stream_packages

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(FULL)
    seen = []
    for _ in range(2):
        sink(stream_packages(spark, str(tmp_path / "in")), lambda df, n: seen.append(df.count()), str(tmp_path / "state")).awaitTermination()
    assert seen == [1]


def test_empty_tables_give_empty_relations(spark):
    none = spark.createDataFrame([], "doc_id string, path string, content binary")
    assert relation(parse_packages(none), "blocks").count() == 0
