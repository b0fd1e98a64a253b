"""Packages made from texts, for corpora without any and for tests."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.batches import batches_of, rows_of, small_batches

from .archive import zip_of

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
MAIN = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
TYPES = f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/><Override PartName="/word/document.xml" ContentType="{MAIN}"/></Types>'


def package(body: str, parts: dict[str, bytes | str] | None = None, types: str = TYPES) -> bytes:
    """A package whose document has that body; `parts` adds to and replaces its parts (None leaves one out)."""
    all_parts = {"[Content_Types].xml": types, "word/document.xml": f'<?xml version="1.0"?><w:document {W}><w:body>{body}</w:body></w:document>'} | (parts or {})
    return zip_of([(name, data) for name, data in all_parts.items() if data is not None])


def paragraph(text: str, style: str | None = None) -> str:
    properties = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f'<w:p>{properties}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'


_UNFIT = re.compile("[\x00-\x08\x0b-\x1f\ud800-\udfff\ufffe\uffff]")


def clean_text(text: str | None) -> str:
    """A text without the characters that XML can't hold."""
    return _UNFIT.sub("", text or "")


def spread(rows: DataFrame) -> DataFrame:
    """The table dealt out evenly. What is made of a row costs far more than moving it, and a table in few files or in few large row
    groups, whose splits are mostly empty, would keep few cores busy with all that follows."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(2 * cores, rows.rdd.getNumPartitions()))


def as_packages(docs: DataFrame) -> DataFrame:
    """(doc_id, path, content): a package of each text, with a paragraph for each line."""
    schema = pa.schema([("doc_id", pa.string()), ("path", pa.string()), ("content", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple[dict, int]]:
            for row in rows_of(batches):
                content = package("".join([paragraph(line) for line in clean_text(row["text"]).split("\n")]))
                yield {"doc_id": row["doc_id"], "path": f"{row['doc_id']}.docx", "content": content}, len(content)

        yield from batches_of(made(), schema)

    return small_batches(spread(docs.select(F.col("doc_id").cast("string"), "text"))).mapInArrow(make, "doc_id string, path string, content binary")


RELATIONS = (
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="t/hyperlink" Target="https://example.org/{id}" TargetMode="External"/>'
    '<Relationship Id="r2" Type="t/image" Target="media/dot.png"/></Relationships>'
)
NUMBERING = (
    '<w:numbering xmlns:w="w"><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum>'
    '<w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>'
)
STYLES = (
    '<w:styles xmlns:w="w"><w:style w:type="paragraph" w:styleId="Normal" w:default="1"><w:name w:val="Standaard"/><w:rPr><w:sz w:val="22"/></w:rPr></w:style>'
    '<w:style w:type="paragraph" w:styleId="Kop1"><w:name w:val="Kop 1"/><w:basedOn w:val="Normal"/><w:rPr><w:b/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="Title"><w:name w:val="Title"/></w:style>'
    '<w:style w:type="paragraph" w:styleId="Level"><w:name w:val="Any"/><w:basedOn w:val="Deep"/></w:style><w:style w:type="paragraph" w:styleId="Deep"><w:name w:val="Unused"/><w:pPr><w:outlineLvl w:val="2"/></w:pPr></w:style>'
    '<w:style w:type="character" w:styleId="Strong"><w:name w:val="Strong"/><w:rPr><w:b/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="Same"><w:name w:val="Same"/></w:style>'
    '<w:style w:type="character" w:styleId="Same"><w:name w:val="Same"/></w:style></w:styles>'
)


def _run(text: str, properties: str = "") -> str:
    return f"<w:r>{f'<w:rPr>{properties}</w:rPr>' if properties else ''}<w:t xml:space='preserve'>{escape(text)}</w:t></w:r>"


def _item(text: str, level: int) -> str:
    return f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="1"/></w:numPr></w:pPr>{_run(text)}</w:p>'


def rich_package(number: int, lines: list[str]) -> bytes:
    """A package with one of everything: styles, marks, a link, a deletion, a note, lists, a table with a span, a formula, an image,
    a field, properties, a header and a macro part, and the lines as paragraphs. Odd numbers have their title in a paragraph."""
    field = lambda kind: f'<w:r><w:fldChar w:fldCharType="{kind}"/></w:r>'
    body = (
        (paragraph(f"Styled {number}", "Title") if number % 2 else "")
        + paragraph(f"Report {number}", "Kop1")
        + "<w:p>" + _run(f"b{number}", "<w:b/>") + _run("iu", "<w:i/><w:u w:val='single'/>") + '<w:hyperlink r:id="r1">' + _run("link") + "</w:hyperlink>"
        + "<w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:r><w:footnoteReference w:id='1'/></w:r><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t><w:br/><w:t>z</w:t></w:r>"
        + _run("2", "<w:vertAlign w:val='superscript'/>") + _run("s", "<w:strike/>") + _run("st", "<w:rStyle w:val='Strong'/>") + "</w:p>"
        + _item("one", 0) + _item("deep", 1) + _item("two", 0)
        + "<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val='2'/></w:tcPr>" + paragraph(f"a|{number}") + "</w:tc></w:tr><w:tr><w:tc>" + paragraph("c") + "</w:tc><w:tc>" + paragraph("d") + "</w:tc></w:tr></w:tbl>"
        + f"<w:p><w:pPr><w:pStyle w:val='Same'/></w:pPr>{_run(f'Beside {number} ')}{_run('run', '<w:rStyle w:val=\"Same\"/>')}</w:p>"
        + paragraph("Below", "Level")
        + f"<w:p><m:oMathPara><m:oMath><m:f><m:num><m:r><m:t>{number}</m:t></m:r></m:num><m:den><m:r><m:t>x</m:t></m:r></m:den></m:f></m:oMath></m:oMathPara></w:p>"
        + f"<w:p><m:oMath><m:nary><m:r><m:t>{number}</m:t></m:r></m:nary></m:oMath></w:p>"
        + '<w:p><w:r><w:drawing><a:blip r:embed="r2"/></w:drawing></w:r></w:p>'
        + f"<w:p>{field('begin')}<w:r><w:instrText>PAGEREF x</w:instrText></w:r>{field('separate')}{_run('17')}{field('end')}{_run('after')}</w:p>"
        + "".join(map(paragraph, lines))
    )
    title = f"<d:title>Core &amp; Title {number}</d:title>" if number % 2 == 0 else ""
    dated = '<property name="Publication Date">2020-01-02</property>' if number % 4 == 0 else ""
    return package(body, {
        "word/_rels/document.xml.rels": RELATIONS.replace("{id}", str(number)), "word/numbering.xml": NUMBERING, "word/styles.xml": STYLES,
        "word/footnotes.xml": f'<w:footnotes xmlns:w="w"><w:footnote w:id="-1">{paragraph("line")}</w:footnote><w:footnote w:id="1">{paragraph(f"Note {number}.")}</w:footnote></w:footnotes>',
        "docProps/core.xml": f'<c:p xmlns:c="c" xmlns:d="d">{title}<d:creator>Ada {number}; Bo</d:creator><d:language>{"1031" if number % 3 == 0 else "en"}</d:language><d:subject>Topics {number}</d:subject><d:keywords>k1, k2</d:keywords></c:p>',
        "docProps/app.xml": "<p><Company>Firm</Company></p>", "docProps/custom.xml": f'<p>{dated}<property name="Ver-sion">v{number}</property></p>',
        "word/media/dot.png": f"png{number}".encode(), "word/header1.xml": "<h/>", "word/comments.xml": "<c/>", "word/vbaProject.bin": b"x",
    })


#: Packages that are refused, each with what is wrong with it; number k of them is for rows k, k + 20, ..
def broken_package(number: int, text: str) -> bytes:
    """A package with a fault, by number; the other ones hold the text."""
    k = number % 20
    relation = lambda more: {"word/_rels/document.xml.rels": RELATIONS.replace("{id}", "x").replace(*more)}
    link = '<w:p><w:hyperlink r:id="r1"/></w:p>'
    image = '<w:p><w:r><w:drawing><a:blip r:embed="r2"/></w:drawing></w:r></w:p>'
    make = [  # only the one that is wanted is made
        lambda: b"", lambda: text.encode(), lambda: b"PK\x03\x04 cut off", lambda: package("", {"word/document.xml": None}), lambda: package("", {"[Content_Types].xml": None}), lambda: package("", types=TYPES.replace("main+xml", "other+xml")),
        lambda: package("", {"word/document.xml": "<!DOCTYPE x><w:document/>"}), lambda: package("<w:p>"), lambda: package("", {"EncryptedPackage": b"x"}), lambda: package("", {"../x": b"x"}), lambda: package("", {"word/big.bin": bytes(1_000_000)}),
        lambda: package("", relation(('media/dot.png"', 'http://x/a.png" TargetMode="External"'))), lambda: package(link, relation(("https:", "javascript:"))), lambda: package(image, relation(("dot.png", "dot.bmp")) | {"word/media/dot.bmp": b"x"}),
        lambda: package("", {"word/styles.xml": "<w:styles>"}), lambda: package("<w:p/>", {"word/document.xml": "<w:document xmlns:w='w'/>"}), lambda: package("", {f"word/p{i}.xml": "<a/>" for i in range(30)}),
    ]
    return make[k]() if k < len(make) else package(paragraph(text))


def made_packages(rows: DataFrame, make) -> DataFrame:
    """(doc_id, path, content): what `make(number, text)` makes of each row (number, text), without the characters that XML can't
    hold."""
    schema = pa.schema([("doc_id", pa.string()), ("path", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple[dict, int]]:
            for number, text in (row.values() for row in rows_of(batches)):
                content = make(number, clean_text(text))
                yield {"doc_id": str(number), "path": f"in/File {number}.docx", "content": content}, len(content)

        yield from batches_of(made(), schema)

    return small_batches(spread(rows)).mapInArrow(run, "doc_id string, path string, content binary")


def rich_packages(docs: DataFrame) -> DataFrame:
    """A rich package of each text (doc_id, text)."""
    return made_packages(docs.select("doc_id", "text"), lambda number, text: rich_package(number, text.split("\n")))
