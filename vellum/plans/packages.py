"""Queries over rich packages: one of everything that a reader knows, with what must come out of it stated in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import cover as C
from vellum.operators import model as O
from vellum.operators import render as R
from vellum.sources.docx import errors, parse_packages, relation
from vellum.sources.make_docx import broken_package, made_packages, rich_packages
from vellum.sources.package import Limits

from . import corpus
from .scalar import _read
from .structure import _LINES

DATE = "2026-01-31"
LIMITS = Limits(ratio=2000)  # some texts repeat a word thousands of times


def _number(rows):
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def _rich(spark, sf_dir, only=None):
    return parse_packages(rich_packages(_read(spark, sf_dir, "documents")), LIMITS, only=only)


def rich_blocks(spark, sf_dir):
    """Blocks of bodies and notes in document order."""
    roots = F.array_distinct(F.transform("blocks", lambda b: b["root"]))
    rows = _rich(spark, sf_dir, ["blocks"]).select("doc_id", "blocks", F.explode(roots).alias("root"))
    own = F.transform(F.filter("blocks", lambda b: b["root"] == F.col("root")), lambda b: F.struct(*[b[c].alias(c) for c in ("path", "depth", "type", "style_id", "text")]))
    rows = rows.select("doc_id", "root", F.posexplode(F.array_sort(own)).alias("ord", "x"))
    return _number(rows.select("doc_id", "root", F.col("ord").cast("long").alias("ord"), "x.depth", "x.type", "x.style_id", "x.text"))


def rich_html(spark, sf_dir):
    made = corpus.convert(_rich(spark, sf_dir, corpus.CONVERTED), "html", "fragment", DATE)
    return _number(made.select("doc_id", F.decode("data", "UTF-8").alias("html")))


def rich_page(spark, sf_dir):
    """Heads of standalone pages, and what follows the style sheet."""
    made = corpus.convert(_rich(spark, sf_dir, corpus.CONVERTED), "html", "standalone", DATE).select("doc_id", F.decode("data", "UTF-8").alias("html"))
    return _number(made.select("doc_id", F.substring_index("html", "<style>", 1).alias("head"), F.startswith(F.element_at(F.split("html", "</style>"), -1), F.lit("</head><body><main>")).alias("has_body")))


def rich_markdown(spark, sf_dir):
    made = corpus.convert(_rich(spark, sf_dir, corpus.CONVERTED), "markdown", "single", DATE, formula="source")
    return _number(made.select("doc_id", F.decode("data", "UTF-8").alias("markdown")))


def rich_warnings(spark, sf_dir):
    """Warnings of the reader, then those of the Markdown writer; a style that the user has mapped is no reason for one."""
    made = corpus.convert(_rich(spark, sf_dir, corpus.CONVERTED), "markdown", "single", DATE, mappings={"Same": "body"})
    rows = made.select("doc_id", F.inline("warnings"))
    return _number(rows.select("doc_id", "ord", "code", "severity"))


def rich_zip_entries(spark, sf_dir):
    """Entries of Markdown and HTML archives, with the sizes of the images."""
    made = R.convert_each(corpus.ready(_rich(spark, sf_dir, corpus.CONVERTED), DATE), [("markdown", "zip"), ("html", "zip")])
    rows = R.entries(made.select("doc_id", F.inline("outputs")), "format")
    return _number(rows.select("doc_id", "format", "position", "name", F.when(F.col("name").startswith("images/"), F.octet_length("data")).alias("image_bytes")))


def rich_epub(spark, sf_dir):
    """Container, package, contents, title page and first chapter of publications with a generated cover."""
    made = corpus.convert(_rich(spark, sf_dir, corpus.CONVERTED), "epub", "single", DATE, cover=C.cover_settings("generated"))
    rows = R.entries(made).filter("name RLIKE 'mimetype|container|package|nav|title|cover.xhtml|chapter-001'")
    return _number(rows.select("doc_id", "position", "name", F.decode("data", "UTF-8").alias("text")))


def rich_styles(spark, sf_dir):
    """Styles that are used, with their use, what they mean and why; one id is that of two styles."""
    rows = corpus.analyse(_rich(spark, sf_dir, corpus.ANALYSED), mappings={"Kop1": "heading4"}, preset={"Strong": "code"})
    return _number(rows.select("doc_id", "style_id", "kind", "usages", F.array_join("examples", "|").alias("examples"), "font_size", "bold", "outline_level", "mapping", "confidence", "evidence"))


def rich_candidates(spark, sf_dir):
    rows = relation(_rich(spark, sf_dir, ["candidates"]), "candidates")
    return _number(rows.select("doc_id", "ord", "field", "value", "source", "priority", "confidence", "method"))


def rich_metadata(spark, sf_dir):
    found = corpus.resolved_metadata(_rich(spark, sf_dir, corpus.RESOLVED), DATE)
    fields = ("title", "language", "publisher", "version", "identifier", "publicationDate", "conversionDate", "subtitle")
    value = F.from_json("metadata", ", ".join(f"{f} string" for f in fields) + ", authors array<string>, subjects array<string>")
    rows = found.select("doc_id", value.alias("m"))
    return _number(rows.select("doc_id", *[F.col(f"m.{f}").alias(f) for f in fields], F.array_join("m.authors", "|").alias("authors"), F.array_join("m.subjects", "|").alias("subjects")))


def rich_edits(spark, sf_dir):
    """The same after edits: a title set, the publisher deleted, other authors and subjects."""
    found = corpus.resolved_metadata(_rich(spark, sf_dir, corpus.RESOLVED), DATE, edits={"title": "Mine", "publisher": " ", "publicationDate": "1999"}, authors=["Cy", " "], subjects=[" a ", "b"])
    value = F.from_json("metadata", "title string, publisher string, publicationDate string, authors array<string>, subjects array<string>")
    rows = found.select("doc_id", value.alias("m"))
    return _number(rows.select("doc_id", "m.title", "m.publisher", "m.publicationDate", F.array_join("m.authors", "|").alias("authors"), F.array_join("m.subjects", "|").alias("subjects")))


def rich_assets(spark, sf_dir):
    rows = relation(_rich(spark, sf_dir, ["assets"]), "assets")
    return _number(rows.select("doc_id", "asset_id", "media_type", "filename", F.decode("data", "UTF-8").alias("data")))


def _broken(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("number"), F.col("p_name").alias("text"))
    return parse_packages(made_packages(rows, broken_package), Limits(entries=25))


def package_errors(spark, sf_dir):
    """Error codes of packages, each of which has another fault: whether the code is one of the seven, and whether the message
    holds nothing of the document."""
    named = _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), "p_name")
    rows = errors(_broken(spark, sf_dir)).join(named, "doc_id")
    parts = ("big.bin", "dot.bmp", "document.xml", "styles.xml", "javascript", "../x")
    held = F.exists(F.array("p_name", *map(F.lit, parts)), lambda w: F.contains("message", w))
    return _number(rows.select("doc_id", "error", F.col("error").isin(*O.ERRORS).alias("known"), (~held).alias("private")))


def package_outputs(spark, sf_dir):
    """Every package has a row of output: its own error, or a text."""
    made = corpus.convert(_broken(spark, sf_dir), "markdown", "single", DATE)
    return _number(made.select("doc_id", "error", F.decode("data", "UTF-8").alias("markdown")))


#: Formulas, as OMML with a number in it, and what they are: TeX, MathML, what is not supported, and the words.
FORMULAS = (
    ("<m:rad><m:deg/><m:e>{n}</m:e></m:rad>", r"\sqrt{{n}}", "<msqrt>{mn}</msqrt>", "", "root {n}"),
    ("<m:rad><m:deg>{n}</m:deg><m:e>{x}</m:e></m:rad>", r"\sqrt[{n}]{x}", "<mroot><mi>x</mi>{mn}</mroot>", "", "root x"),
    ("<m:sSubSup><m:e>{x}</m:e><m:sub>{n}</m:sub><m:sup>{x}</m:sup></m:sSubSup>", "x_{{n}}^{x}", "<msubsup><mi>x</mi>{mn}<mi>x</mi></msubsup>", "", "x {n} x"),
    ("<m:sSub><m:e>{x}</m:e><m:sub>{n}</m:sub></m:sSub>", "x_{{n}}", "<msub><mi>x</mi>{mn}</msub>", "", "x {n}"),
    ("<m:m><m:mr><m:e>{n}</m:e><m:e>{x}</m:e></m:mr><m:mr><m:e>{x}</m:e><m:e>{n}</m:e></m:mr></m:m>", r"\begin{matrix}{n} & x \\ x & {n}\end{matrix}", "<mtable><mtr><mtd>{mn}</mtd><mtd><mi>x</mi></mtd></mtr><mtr><mtd><mi>x</mi></mtd><mtd>{mn}</mtd></mtr></mtable>", "", "{n} x; x {n}"),
    ("<m:nary><m:naryPr/>{n}</m:nary>{x}", r"\text{{n}}x", "<mrow><merror><mtext>Unsupported nary: {n}</mtext></merror><mi>x</mi></mrow>", "nary", "Unsupported formula (nary): {n}x"),
    ("<m:f><m:num>{n}</m:num></m:f>", r"\frac{{n}}{\text{missing-den}}", "<mfrac>{mn}<merror><mtext>Unsupported missing-den: </mtext></merror></mfrac>", "missing-den", "Unsupported formula (missing-den): {n}/"),
    ("<m:r><m:t>5 % of {raw}</m:t></m:r>", r"\text{5 \% of {n}}", "<mtext>5 % of {n}</mtext>", "", "5 % of {n}"),
    ("<m:r><m:t>≤≥</m:t></m:r>{n}", "≤≥{n}", "<mrow><mo>≤≥</mo>{mn}</mrow>", "", "≤≥{n}"),
    ("<m:r><m:t>f(x)</m:t></m:r>", r"\text{f(x)}", "<mtext>f(x)</mtext>", "", "f(x)"),
    ("<m:broken>{n}", r"\text{{n}}", "<merror><mtext>Unsupported malformed-omml: {n}</mtext></merror>", "malformed-omml", "Unsupported formula (malformed-omml): {n}"),
)


def formula_forms(spark, sf_dir):
    """Roots, scripts, matrices, unsupported and malformed formulas of every order."""
    from vellum.functions import formula as E

    number = F.col("o_orderkey").cast("string")
    run = lambda t: F.concat(F.lit("<m:r><m:t>"), t, F.lit("</m:t></m:r>"))
    forms = F.element_at(F.array(*[F.lit(f[0]) for f in FORMULAS]), (F.col("o_orderkey") % len(FORMULAS) + 1).cast("int"))
    inner = F.replace(F.replace(F.replace(forms, F.lit("{n}"), run(number)), F.lit("{x}"), run(F.lit("x"))), F.lit("{raw}"), number)
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", E.omml_to_struct(F.concat(F.lit('<m:oMath xmlns:m="m">'), inner, F.lit("</m:oMath>"))).alias("f"))
    return rows.select("o_orderkey", "f.tex", "f.mathml", "f.complete", F.array_join("f.unsupported", ",").alias("unsupported"), "f.fallback")


def cover_drawing(spark, sf_dir):
    """Covers with a title of one line, for each supplier: with a panel or without, in two colours."""
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey")
    return rows.select("s_suppkey", C.drawn_cover(F.concat(F.lit("T & "), F.col("s_suppkey").cast("string")), F.array(F.lit("A"), F.lit("B")), F.col("s_suppkey") % 2 == 0).alias("svg"))


def cover_files(spark, sf_dir):
    kinds = ("image/jpeg", "image/gif", "image/svg+xml", "image/webp")
    media = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = _read(spark, sf_dir, "part").select("p_partkey", media.alias("media"), (F.col("p_size").cast("long") * 300_000).alias("size"))
    return rows.select("p_partkey", C.file_issue(F.col("media"), F.col("size")).alias("issue"))


def model_round_trip(spark, sf_dir):
    """Models as JSON rows and back: the envelope has no issue, and blocks and assets are what they were."""
    rows = O.read_models(O.model_rows(_rich(spark, sf_dir).withColumn("told", F.col("model")), "told"), "told")
    same = F.get_json_object("model", "$.blocks") == F.get_json_object("told", "$.blocks")
    return _number(rows.select("doc_id", same.alias("same_blocks"), F.size("issues").alias("issues"), F.decode(F.col("assets")[0]["data"], "UTF-8").alias("image")))


QUERIES = {
    f.__name__: f
    for f in (
        rich_blocks, rich_html, rich_page, rich_markdown, rich_warnings, rich_zip_entries, rich_epub, rich_styles, rich_candidates, rich_metadata, rich_edits,
        rich_assets, package_errors, package_outputs, formula_forms, cover_drawing, cover_files, model_round_trip,
    )
}

_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_MD = r"regexp_replace({}, '([\\`*_\[\]<>#])', '\\\1', 'g')"
_IMAGE = "'data:image/png;base64,' || base64(encode('png' || doc_id))"
_TITLE = "CASE WHEN doc_id % 2 = 1 THEN 'Styled ' || doc_id ELSE 'Core & Title ' || doc_id END"
_FORMULA = """'<span class="formula-mathml" role="math" aria-label="' || doc_id || '{label}"><math xmlns="http://www.w3.org/1998/Math/MathML">{math}</math></span>'"""
_SPAN = lambda label, math: _FORMULA.replace("{label}", label).replace("{math}", math)
_HTML_BODY = f"""CASE WHEN doc_id % 2 = 1 THEN '<h1 id="styled-' || doc_id || '">Styled ' || doc_id || '</h1>' ELSE '' END
  || '<h2 id="report-' || doc_id || '">Report ' || doc_id || '</h2><p><strong>b' || doc_id || '</strong><u><em>iu</em></u><a href="https://example.org/' || doc_id || '">link</a><sup id="note-ref-footnote-1"><a href="#note-footnote-1" role="doc-noteref">[1]</a></sup>x' || chr(9)
  || 'y<br>z<sup>2</sup><s>s</s><span class="style-strong">st</span></p><ol><li><p>one</p><ul><li><p>deep</p></li></ul></li><li><p>two</p></li></ol>'
  || '<table><tbody><tr><td colspan="2"><p>a|' || doc_id || '</p></td></tr><tr><td><p>c</p></td><td><p>d</p></td></tr></tbody></table><p>Beside ' || doc_id || ' <span class="style-same">run</span></p><h4 id="below">Below</h4>'
  || '<div class="equation" role="math">' || {_SPAN("/x", "<mfrac><mn>' || doc_id || '</mn><mi>x</mi></mfrac>")} || '</div>'
  || '<p><span class="equation" role="math">' || {_SPAN("", "<merror><mtext>Unsupported nary: ' || doc_id || '</mtext></merror>")} || '</span></p>'
  || '<p><img src="' || {_IMAGE} || '" alt=""></p><p>after</p>' || string_agg('<p>' || {_ESC.format("text")} || '</p>', '' ORDER BY ord)
  || '<section class="notes" aria-label="Notes"><h2>Notes</h2><ol><li id="note-footnote-1"><p>Note ' || doc_id || '.</p><a href="#note-ref-footnote-1" role="doc-backlink" aria-label="Back to reference 1">↩</a></li></ol></section></main>'"""
_CHAPTER = (
    _HTML_BODY.replace("<br>", "<br/>").replace('alt=""></p>', 'alt=""/></p>').replace('<u><em>iu</em></u>', '<span class="underline"><em>iu</em></span>')
    .replace('<a href="https://example.org/\' || doc_id || \'">link</a>', "link")
    .replace('<sup id="note-ref-footnote-1"><a href="#note-footnote-1" role="doc-noteref">[1]</a></sup>', '<a id="note-ref-footnote-1" href="#note-footnote-1" epub:type="noteref">[1]</a>')
    .replace(_IMAGE, "'images/image-001.png'")
    .replace('<section class="notes" aria-label="Notes"><h2>Notes</h2><ol><li id="note-footnote-1">', '<section epub:type="footnotes"><ol><li id="note-footnote-1" epub:type="footnote">')
    .replace(' role="doc-backlink" aria-label="Back to reference 1"', "").replace("</section></main>'", "</section>'")
)
_XHTML = lambda title, body: f"""'<?xml version="1.0" encoding="UTF-8"?><!DOCTYPE html><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" xml:lang="' || lang || '" lang="' || lang || '"><head><meta charset="UTF-8"/><title>' || {title} || '</title><link rel="stylesheet" type="text/css" href="styles.css"/></head><body>' || {body} || '</body></html>'"""
_SAFE = _ESC.format("title")
_TWO = "doc_id % 2 = 1"  # these have a title above the first chapter's heading, and so two chapters


def _chosen(column: str, k: int) -> str:
    """A column of FORMULAS by order, with the number put in."""
    texts = [f[k] for f in FORMULAS]
    listed = ", ".join("'" + t.replace("'", "''") + "'" for t in texts)
    return f"replace(replace([{listed}][o_orderkey % {len(FORMULAS)} + 1], '{{mn}}', '<mn>' || o_orderkey || '</mn>'), '{{n}}', o_orderkey::VARCHAR) AS {column}"


_CODES = ["unsupported-format"] * 2 + ["invalid-input"] * 3 + ["unsupported-format"] + ["invalid-input"] * 2 + ["encrypted-document", "invalid-input", "resource-limit"] + ["unsupported-format"] * 3 + ["invalid-input"] * 2 + ["resource-limit"]
_CODE = "[" + ", ".join(f"'{c}'" for c in _CODES) + "][p_partkey % 20 + 1]"
_BLOCKS = [  # depth, type, style, text
    (0, "paragraph", "Kop1", "'Report ' || doc_id"), (0, "paragraph", None, "'b' || doc_id || 'iulinkx' || chr(9) || 'yz2sst'"), (0, "list", None, None), (1, "paragraph", None, "'one'"), (1, "list", None, None),
    (2, "paragraph", None, "'deep'"), (1, "paragraph", None, "'two'"), (0, "table", None, None), (1, "paragraph", None, "'a|' || doc_id"), (1, "paragraph", None, "'c'"), (1, "paragraph", None, "'d'"),
    (0, "paragraph", "Same", "'Beside ' || doc_id || ' run'"), (0, "paragraph", "Level", "'Below'"), (0, "equationBlock", None, None), (0, "paragraph", None, "''"), (0, "paragraph", None, "''"), (0, "paragraph", None, "'after'"),
]
_quoted = lambda x: "NULL" if x is None else f"'{x}'"
_BLOCK_ROWS = "[" + ", ".join(f"{{'depth': {d}, 'type': '{t}', 'style_id': {_quoted(s)}, 'text': {x or 'NULL'}}}" for d, t, s, x in _BLOCKS) + "]"
_CANDIDATES = [
    ("doc_id % 2 = 0", "title", "'Core & Title ' || doc_id", "docProps/core.xml", 1, "certain"), ("true", "authors", "'Ada ' || doc_id", "docProps/core.xml", 1, "certain"), ("true", "authors", "'Bo'", "docProps/core.xml", 1, "certain"),
    ("true", "language", "CASE WHEN doc_id % 3 = 0 THEN 'de-DE' ELSE 'en' END", "docProps/core.xml", 1, "certain"), ("true", "subjects", "'Topics ' || doc_id", "docProps/core.xml", 1, "certain"), ("true", "subjects", "'k1, k2'", "docProps/core.xml", 1, "certain"),
    ("true", "publisher", "'Firm'", "docProps/app.xml", 2, "certain"), ("doc_id % 4 = 0", "publicationDate", "'2020-01-02'", "docProps/custom.xml:Publication Date", 3, "certain"), ("true", "version", "'v' || doc_id", "docProps/custom.xml:Ver-sion", 3, "certain"),
    ("doc_id % 2 = 1", "title", "'Styled ' || doc_id", "Title style", 4, "certain"), ("true", "title", "CASE WHEN doc_id % 2 = 1 THEN 'Styled ' ELSE 'Report ' END || doc_id", "first-page structure", 5, "low"),
    ("true", "title", "'File ' || doc_id", "filename", 7, "low"), ("true", "identifier", "'urn:vellum:file-' || doc_id", "filename", 7, "low"),
]
_CANDIDATE_ROWS = "list_filter([" + ", ".join(
    f"{{'use': {use}, 'field': '{f}', 'value': {v}, 'source': '{s}', 'priority': {p}, 'confidence': '{c}', 'method': '{'inferred' if c == 'low' else 'extracted'}'}}" for use, f, v, s, p, c in _CANDIDATES
) + "], lambda c: c.use)"
_PLAIN_USES = "'b' || doc_id || 'iulinkxyz2sst|one|deep'"
#: style, kind, uses, examples, size, bold, outline, meaning, confidence, evidence
_STYLE_ROWS = [
    ("Kop1", "paragraph", "1", "'Report ' || doc_id", "11.0", "true", "NULL", "heading4", "certain", "user-mappings"),
    ("Level", "paragraph", "1", "'Below'", "NULL", "NULL", "2", "heading3", "certain", "outline-level"),
    ("Normal", "paragraph", "11 + n", _PLAIN_USES, "11.0", "NULL", "NULL", "caption", "high", "caption-context-analysis"),
    ("Same", "character", "1", "'run'", "NULL", "NULL", "NULL", "body", "medium", "plain-paragraph-fallback"),
    ("Same", "paragraph", "1", "'Beside ' || doc_id || ' run'", "NULL", "NULL", "NULL", "caption", "high", "caption-context-analysis"),
    ("Strong", "character", "1", "'st'", "NULL", "true", "NULL", "code", "certain", "mapping-preset"),
    ("Title", "paragraph", "1", "'Styled ' || doc_id", "NULL", "NULL", "NULL", "title", "medium", "localized-style-aliases"),
]

SQL = {
    "rich_blocks": f"""WITH {_LINES}, b AS (SELECT doc_id, unnest(CASE WHEN doc_id % 2 = 1 THEN list_concat([{{'depth': 0, 'type': 'paragraph', 'style_id': 'Title', 'text': 'Styled ' || doc_id}}], {_BLOCK_ROWS}) ELSE {_BLOCK_ROWS} END) AS x,
        generate_subscripts(CASE WHEN doc_id % 2 = 1 THEN list_concat([{{'depth': 0, 'type': '', 'style_id': '', 'text': ''}}], {_BLOCK_ROWS}) ELSE {_BLOCK_ROWS} END, 1) - 1 AS ord FROM documents)
      SELECT doc_id, 'body' AS root, ord, x.depth, x.type, x.style_id, x.text FROM b
      UNION ALL SELECT doc_id, 'body', ord + {len(_BLOCKS)} + doc_id % 2, 0, 'paragraph', NULL, text FROM lines
      UNION ALL SELECT doc_id, 'note:footnote-1', 0, 0, 'paragraph', NULL, 'Note ' || doc_id || '.' FROM documents""",
    "rich_html": f"""WITH {_LINES} SELECT doc_id, '<main>' || CASE WHEN doc_id % 2 = 1 THEN '' ELSE '<h1 class="document-title">Core &amp; Title ' || doc_id || '</h1>' END
      || '<div class="table-of-contents"><h2>Contents</h2><ol>' || CASE WHEN doc_id % 2 = 1 THEN '<li><a href="#styled-' || doc_id || '">Styled ' || doc_id || '</a></li>' ELSE '' END
      || '<li><a href="#report-' || doc_id || '">Report ' || doc_id || '</a></li><li><a href="#below">Below</a></li></ol></div>' || {_HTML_BODY} AS html FROM lines GROUP BY doc_id""",
    "rich_page": f"""SELECT doc_id, true AS has_body, '<!doctype html><html lang="' || CASE WHEN doc_id % 3 = 0 THEN 'de-DE' ELSE 'en' END || '"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width,initial-scale=1"><meta name="generator" content="vellum"><meta name="author" content="Ada '
      || doc_id || '"><meta name="author" content="Bo"><title>' || {_ESC.format(_TITLE)} || '</title>' AS head FROM documents""",
    "rich_markdown": f"""WITH {_LINES} SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN '# Styled ' ELSE '# Core & Title ' END || doc_id || chr(10) || chr(10) || '## Report ' || doc_id || chr(10) || chr(10)
      || '**b' || doc_id || '**<u>_iu_</u>[link](https://example.org/' || doc_id || ')[^footnote-1]x' || chr(9) || 'y  ' || chr(10) || 'z<sup>2</sup>~~s~~st' || chr(10) || chr(10)
      || '1. one' || chr(10) || '   - deep' || chr(10) || '2. two' || chr(10) || chr(10) || '| a\\|' || doc_id || ' |  |' || chr(10) || '| --- | --- |' || chr(10) || '| c | d |' || chr(10) || chr(10)
      || 'Beside ' || doc_id || ' run' || chr(10) || chr(10) || '#### Below' || chr(10) || chr(10) || '$$' || chr(10) || '\\frac{{' || doc_id || '}}{{x}}' || chr(10) || '$$' || chr(10) || chr(10) || '$\\text{{' || doc_id || '}}$' || chr(10) || chr(10)
      || '![](' || {_IMAGE} || ')' || chr(10) || chr(10) || 'after' || coalesce(chr(10) || chr(10) || string_agg({_MD.format("text")}, chr(10) || chr(10) ORDER BY ord) FILTER (WHERE text <> ''), '')
      || chr(10) || chr(10) || '[^footnote-1]: Note ' || doc_id || '.' || chr(10) AS markdown FROM lines GROUP BY doc_id""",
    "rich_warnings": """SELECT doc_id, i - 1 AS ord, ['active-content-disabled', 'decorative-furniture-omitted', 'comments-omitted', 'tracked-deletion-omitted', 'formula-conversion-incomplete', 'markdown-unsupported-style-mark', 'markdown-table-span'][i] AS code,
      ['warning', 'info', 'info', 'info', 'warning', 'info', 'warning'][i] AS severity FROM documents, range(1, 8) AS r(i)""",
    "rich_zip_entries": """SELECT doc_id, 'markdown' AS format, i::INT AS position, ['document.md', 'images/image-001.png'][i + 1] AS name, (CASE WHEN i = 1 THEN 3 + length(doc_id::VARCHAR) END)::INT AS image_bytes FROM documents, range(2) AS r(i)
      UNION ALL SELECT doc_id, 'html', i::INT, ['document.html', 'images/image-001.png', 'styles.css'][i + 1], (CASE WHEN i = 1 THEN 3 + length(doc_id::VARCHAR) END)::INT FROM documents, range(3) AS r(i)""",
    "rich_epub": f"""WITH {_LINES}, bodies AS (SELECT doc_id, {_CHAPTER} AS whole FROM lines GROUP BY doc_id),
      d AS (SELECT *, {_TITLE} AS title, CASE WHEN doc_id % 3 = 0 THEN 'de-DE' ELSE 'en' END AS lang FROM bodies)
      SELECT doc_id, 0 AS position, 'mimetype' AS name, 'application/epub+zip' AS text FROM d
      UNION ALL SELECT doc_id, 1, 'META-INF/container.xml', '<?xml version="1.0" encoding="UTF-8"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>' FROM d
      UNION ALL SELECT doc_id, 2, 'EPUB/package.opf', '<?xml version="1.0" encoding="UTF-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="pub-id" xml:lang="' || lang || '"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="pub-id">urn:vellum:file-' || doc_id || '</dc:identifier><dc:title>' || {_SAFE}
        || '</dc:title><dc:language>' || lang || '</dc:language><dc:creator>Ada ' || doc_id || '</dc:creator><dc:creator>Bo</dc:creator><meta property="dcterms:modified">{DATE}T00:00:00Z</meta></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="styles" href="styles.css" media-type="text/css"/>'
        || '<item id="cover-image" href="cover.svg" media-type="image/svg+xml" properties="cover-image"/><item id="cover-page" href="cover.xhtml" media-type="application/xhtml+xml"/><item id="title-page" href="title.xhtml" media-type="application/xhtml+xml"/><item id="chapter-001" href="chapter-001.xhtml" media-type="application/xhtml+xml"/>'
        || CASE WHEN {_TWO} THEN '<item id="chapter-002" href="chapter-002.xhtml" media-type="application/xhtml+xml"/>' ELSE '' END || '<item id="image-001" href="images/image-001.png" media-type="image/png"/></manifest><spine><itemref idref="cover-page"/><itemref idref="title-page"/><itemref idref="chapter-001"/>'
        || CASE WHEN {_TWO} THEN '<itemref idref="chapter-002"/>' ELSE '' END || '</spine></package>' FROM d
      UNION ALL SELECT doc_id, 3, 'EPUB/nav.xhtml', {_XHTML("'Contents'", '''\'<nav epub:type="toc" id="toc"><h1>Contents</h1><ol>\' || CASE WHEN doc_id % 2 = 1 THEN \'<li><a href="chapter-001.xhtml#styled-\' || doc_id || \'">Styled \' || doc_id || \'</a></li>\' ELSE \'\' END || \'<li><a href="chapter-00\' || (1 + doc_id % 2) || \'.xhtml#report-\' || doc_id || \'">Report \' || doc_id || \'</a></li><li><a href="chapter-00\' || (1 + doc_id % 2) || \'.xhtml#below">Below</a></li></ol></nav>\'''')} FROM d
      UNION ALL SELECT doc_id, 6, 'EPUB/cover.xhtml', {_XHTML(f"'Cover for ' || {_SAFE}", f"""'<section epub:type="cover"><img src="cover.svg" alt="Cover for ' || {_SAFE} || '"/></section>'""")} FROM d
      UNION ALL SELECT doc_id, 7, 'EPUB/title.xhtml', {_XHTML(_SAFE, f"""'<section epub:type="titlepage"><h1>' || {_SAFE} || '</h1><p class="author">Ada ' || doc_id || '</p><p class="author">Bo</p></section>'""")} FROM d
      UNION ALL SELECT doc_id, 8, 'EPUB/chapter-001.xhtml', CASE WHEN {_TWO} THEN {_XHTML("'Styled ' || doc_id", "split_part(whole, '<h2', 1)")} ELSE {_XHTML("'Report ' || doc_id", "whole")} END FROM d""",
    "rich_styles": f"""WITH {_LINES}, d AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id) """
    + " UNION ALL ".join(
        f"""SELECT doc_id, '{i}' AS style_id, '{kind}' AS kind, ({uses})::BIGINT AS usages, {texts} AS examples, {size}::DOUBLE AS font_size, {bold}::BOOLEAN AS bold, {outline}::INT AS outline_level, '{m}' AS mapping, '{c}' AS confidence, '{e}' AS evidence FROM d {"WHERE doc_id % 2 = 1" if i == "Title" else ""}"""
        for i, kind, uses, texts, size, bold, outline, m, c, e in _STYLE_ROWS
    ),
    "rich_candidates": f"SELECT doc_id, ord, c.field, c.value, c.source, c.priority, c.confidence, c.method FROM (SELECT doc_id, unnest({_CANDIDATE_ROWS}) AS c, generate_subscripts({_CANDIDATE_ROWS}, 1) - 1 AS ord FROM documents)",
    "rich_metadata": f"""SELECT doc_id, {_TITLE} AS title, CASE WHEN doc_id % 3 = 0 THEN 'de-DE' ELSE 'en' END AS language, 'Firm' AS publisher, 'v' || doc_id AS version, 'urn:vellum:file-' || doc_id AS identifier,
      CASE WHEN doc_id % 4 = 0 THEN '2020-01-02' ELSE '{DATE}' END AS "publicationDate", '{DATE}' AS "conversionDate", NULL::VARCHAR AS subtitle, 'Ada ' || doc_id || '|Bo' AS authors, 'Topics ' || doc_id || '|k1, k2' AS subjects FROM documents""",
    "rich_edits": """SELECT doc_id, 'Mine' AS title, NULL::VARCHAR AS publisher, '1999' AS "publicationDate", 'Cy' AS authors, 'a|b' AS subjects FROM documents""",
    "rich_assets": "SELECT doc_id, 'asset-1' AS asset_id, 'image/png' AS media_type, 'dot.png' AS filename, 'png' || doc_id AS data FROM documents",
    "package_errors": f"SELECT p_partkey AS doc_id, {_CODE} AS error, true AS known, true AS private FROM part WHERE p_partkey % 20 < {len(_CODES)}",
    "package_outputs": f"SELECT p_partkey AS doc_id, {_CODE} AS error, CASE WHEN p_partkey % 20 >= {len(_CODES)} THEN '# File ' || p_partkey || chr(10) || chr(10) || {_MD.format('p_name')} || chr(10) END AS markdown FROM part",
    "formula_forms": f"""WITH f AS (SELECT o_orderkey, {_chosen('tex', 1)}, {_chosen('body', 2)}, {_chosen('unsupported', 3)}, {_chosen('fallback', 4)} FROM orders)
      SELECT o_orderkey, tex, '<math xmlns="http://www.w3.org/1998/Math/MathML">' || body || '</math>' AS mathml, unsupported = '' AS complete, unsupported, fallback FROM f""",
    "cover_drawing": """SELECT s_suppkey, '<svg xmlns="http://www.w3.org/2000/svg" width="1600" height="2560" viewBox="0 0 1600 2560"><rect width="100%" height="100%" fill="' || CASE WHEN s_suppkey % 2 = 0 THEN '#172033' ELSE '#f1ede4' END || '"/>'
      || CASE WHEN s_suppkey % 2 = 0 THEN '<rect x="64" y="332" width="1472" height="212.79999999999998" rx="24" fill="#000" opacity="0.56"/>' ELSE '' END
      || '<text x="800" y="460.8" text-anchor="middle" font-family="Georgia,serif" font-size="112" font-weight="700" fill="' || CASE WHEN s_suppkey % 2 = 0 THEN '#fff' ELSE '#111' END || '"><tspan x="800" dy="0">T &amp; ' || s_suppkey || '</tspan></text>'
      || '<text x="800" y="2201.6" text-anchor="middle" font-family="Arial,sans-serif" font-size="54" fill="' || CASE WHEN s_suppkey % 2 = 0 THEN '#fff' ELSE '#111' END || '">A · B</text></svg>' AS svg FROM supplier""",
    "cover_files": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN 'unsupported-format' WHEN p_size * 300000 > 10485760 THEN 'resource-limit' END AS issue FROM part",
    "model_round_trip": "SELECT doc_id, true AS same_blocks, 0 AS issues, 'png' || doc_id AS image FROM documents",
}
