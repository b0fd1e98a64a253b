"""Queries of rendering, packages and covers."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import cover as C
from vellum.functions import formula as E
from vellum.functions import text as T
from vellum.operators import model as O
from vellum.operators import preview as P
from vellum.operators import render as R
from vellum.operators import structure as S
from vellum.sources.docx import parse_packages, relation
from vellum.sources.make_docx import as_packages
from vellum.sources.package import Limits

from . import corpus
from .scalar import PLAIN, _read
from .structure import BLOCKS_SQL, INNER, SLUG, _LINES

DATE = "2026-01-31"


def html_render(spark, sf_dir):
    rows = S.line_blocks(_read(spark, sf_dir, "documents"))
    return R.ordered_html(rows, "doc_id", "ord", F.when(F.col("ord") == 0, "h1").otherwise("p"))


def gfm_table(spark, sf_dir):
    rows = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return R.gfm_rows(rows.withColumn("pair", F.concat("r_name", F.lit("|"), "n_name")), "r_regionkey", "n_nationkey", ["n_name", "pair"])


def toc_html(spark, sf_dir):
    rows = S.page_blocks(_read(spark, sf_dir, "pages")).filter("tag <> 'p'").withColumn("text", T.plain_text(F.col("inner")))
    return R.contents(S.unique_slugs(rows, "page_id", "ord", F.col("text")), "page_id", "ord")


def sanitise_preview(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", P.sanitise(F.col("html")).alias("safe"))


def preset_round_trip(spark, sf_dir):
    meaning = F.when(F.col("p_size") % 3 == 0, "heading1").when(F.col("p_size") % 3 == 1, "caption").otherwise("unknown")
    rows = _read(spark, sf_dir, "part").select("p_partkey", O.preset_json(F.create_map("p_name", meaning)).alias("preset"), "p_name")
    return rows.select("p_partkey", F.element_at(O.preset_mappings(F.col("preset")), F.col("p_name")).alias("mapping"))


def _packages(spark, sf_dir, only):
    """Packages of the texts. Some texts repeat a word thousands of times, so no limit on the ratio of compression holds."""
    return parse_packages(as_packages(_read(spark, sf_dir, "documents")), Limits(ratio=2000), only=only)


def docx_blocks(spark, sf_dir):
    rows = relation(_packages(spark, sf_dir, ["blocks"]), "blocks")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("long").alias("ord"), "type", "text")


def docx_metadata(spark, sf_dir):
    found = relation(_packages(spark, sf_dir, ["candidates"]), "candidates")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "field", "value", "source", "priority", "confidence")


def _converted(spark, sf_dir, format, mode="single"):
    read = _packages(spark, sf_dir, ("model", "assets", "warnings")).select("doc_id", "error", "model", "assets", "warnings", F.lit(DATE).alias("modified"))
    rows = read.withColumn("mapping", F.lit(None).cast("map<string,string>")).withColumn("metadata", F.to_json(F.struct(F.concat(F.lit("Document "), "doc_id").alias("title"), F.lit("en").alias("language"), F.concat(F.lit("urn:vellum:"), "doc_id").alias("identifier"))))
    return R.convert(rows, format, mode)


def docx_html(spark, sf_dir):
    return _converted(spark, sf_dir, "html", "fragment").select(F.col("doc_id").cast("long").alias("doc_id"), F.decode("data", "UTF-8").alias("html"))


def docx_markdown(spark, sf_dir):
    return _converted(spark, sf_dir, "markdown").select(F.col("doc_id").cast("long").alias("doc_id"), F.decode("data", "UTF-8").alias("markdown"))


def docx_epub_files(spark, sf_dir):
    rows = R.ranked_files(_converted(spark, sf_dir, "epub"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("position").cast("long").alias("position"), "name")


def docx_styles(spark, sf_dir):
    """The whole way of a converter: packages of the corpus to Markdown zips, with styles analysed and metadata resolved, and
    what is in them."""
    rows = R.entries(corpus.convert(_packages(spark, sf_dir, corpus.CONVERTED), "markdown", "zip", DATE))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "name", F.decode("data", "UTF-8").alias("markdown"))


def omml_convert(spark, sf_dir):
    """A fraction with a power from each order, through the formula converter."""
    run = lambda c: F.concat(F.lit("<m:r><m:t>"), c.cast("string"), F.lit("</m:t></m:r>"))
    omml = F.concat(F.lit('<m:oMath xmlns:m="m"><m:f><m:num>'), run(F.col("o_orderkey")), F.lit("</m:num><m:den><m:sSup><m:e><m:r><m:t>x</m:t></m:r></m:e><m:sup>"), run(F.col("o_custkey")), F.lit("</m:sup></m:sSup></m:den></m:f></m:oMath>"))
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", E.omml_to_struct(omml).alias("f"))
    return rows.select("o_orderkey", "f.tex", "f.mathml", "f.complete", "f.fallback")


def cover_wrap(spark, sf_dir):
    title = T.plain_text(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1))
    rows = _read(spark, sf_dir, "pages").select("page_id", title.alias("title"))
    return rows.select("page_id", F.array_join(C.cover_lines(F.col("title"), F.lit(120.0), F.lit(1280.0)), " ").alias("lines"), F.length(C.cover(F.col("title"), F.lit("Anon"))).alias("svg_chars"))


def model_validate(spark, sf_dir):
    """Envelopes made of events, some broken, with their issues."""
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.lit('{"schema":"vellum/document","version":1,"metadata":{},"assets":{},"equations":{},"notes":{},"blocks":[],"styles":[],"warnings":[]}')).when(kind == 1, F.col("props")).when(kind == 2, F.lit("[]")).otherwise(F.lit('{"schema":"vellum/document","version":2,"metadata":{},"assets":{"a":{"data":1}},"equations":{},"notes":{},"blocks":[],"styles":[],"warnings":[]}'))
    found = _read(spark, sf_dir, "events").select("event_id", F.explode(O.model_issues(text)).alias("i"))
    return found.select("event_id", "i.path", "i.code")


QUERIES = {
    f.__name__: f
    for f in (
        html_render, gfm_table, toc_html, sanitise_preview, preset_round_trip, docx_blocks, docx_metadata, docx_html, docx_markdown, docx_epub_files,
        docx_styles, omml_convert, cover_wrap, model_validate,
    )
}

_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_MD = r"regexp_replace({}, '([\\`*_\[\]<>#])', '\\\1', 'g')"
#: Pages hold no attributes but these: targets within their own place, classes, languages and character sets.
_SAN = r"""regexp_replace(html, '(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style|title)\b.*?</(script|style|title)\s*>|</?(html|head|body|meta)\b[^>]*>', '', 'g')"""

SQL = {
    "html_render": f"""WITH {_LINES} SELECT doc_id, string_agg(CASE WHEN ord = 0 THEN '<h1>' || {_ESC.format("text")} || '</h1>' ELSE '<p>' || {_ESC.format("text")} || '</p>' END, '' ORDER BY ord) AS html FROM lines GROUP BY doc_id""",
    "gfm_table": r"""SELECT r_regionkey, '| n_name | pair |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || r_name || '\|' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS "table"
      FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey""",
    "toc_html": f"""WITH {BLOCKS_SQL}, t AS (SELECT page_id, ord, {INNER} AS text FROM blocks WHERE tag <> 'p'), s AS (SELECT *, {SLUG.format("text")} AS slug FROM t),
      n AS (SELECT *, row_number() OVER (PARTITION BY page_id, slug ORDER BY ord) AS n FROM s)
      SELECT page_id, '<nav><ol>' || string_agg('<li><a href="#' || CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END || '">' || {_ESC.format("text")} || '</a></li>', '' ORDER BY ord) || '</ol></nav>' AS toc FROM n GROUP BY page_id""",
    "sanitise_preview": f"SELECT page_id, {_SAN} AS safe FROM pages",
    "preset_round_trip": "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'heading1' WHEN 1 THEN 'caption' END AS mapping FROM part",
    "docx_blocks": f"WITH {_LINES} SELECT doc_id, ord::BIGINT AS ord, 'paragraph' AS type, text FROM lines",
    "docx_metadata": f"""WITH {_LINES}, firsts AS (SELECT doc_id, 'title' AS field, '' || doc_id AS value, 'filename' AS source, 7 AS priority, 'low' AS confidence FROM documents
      UNION ALL SELECT doc_id, 'identifier', 'urn:vellum:' || doc_id, 'filename', 7, 'low' FROM documents) SELECT * FROM firsts""",
    "docx_html": f"""WITH {_LINES} SELECT doc_id, '<main><h1 class="document-title">Document ' || doc_id || '</h1>' || string_agg('<p>' || {_ESC.format("text")} || '</p>', '' ORDER BY ord) || '</main>' AS html FROM lines GROUP BY doc_id""",
    "docx_markdown": f"""WITH {_LINES} SELECT doc_id, '# Document ' || doc_id || coalesce(chr(10) || chr(10) || string_agg({_MD.format("text")}, chr(10) || chr(10) ORDER BY ord) FILTER (WHERE text <> ''), '') || chr(10) AS markdown FROM lines GROUP BY doc_id""",
    "docx_epub_files": """SELECT doc_id, i AS position, ['mimetype', 'META-INF/container.xml', 'EPUB/package.opf', 'EPUB/nav.xhtml', 'EPUB/styles.css', 'EPUB/title.xhtml', 'EPUB/chapter-001.xhtml'][i] AS name FROM documents, range(1, 8) AS r(i)""",
    "docx_styles": f"""WITH {_LINES} SELECT doc_id, 'document.md' AS name, '# ' || doc_id || coalesce(chr(10) || chr(10) || string_agg({_MD.format("text")}, chr(10) || chr(10) ORDER BY ord) FILTER (WHERE text <> ''), '') || chr(10) AS markdown FROM lines GROUP BY doc_id""",
    "omml_convert": r"""SELECT o_orderkey, '\frac{' || o_orderkey || '}{x^{' || o_custkey || '}}' AS tex,
      '<math xmlns="http://www.w3.org/1998/Math/MathML"><mfrac><mn>' || o_orderkey || '</mn><msup><mi>x</mi><mn>' || o_custkey || '</mn></msup></mfrac></math>' AS mathml,
      true AS complete, o_orderkey || '/x ' || o_custkey AS fallback FROM orders""",
    "model_validate": """SELECT event_id, i.path, i.code FROM (SELECT event_id, unnest(CASE event_id % 4 WHEN 2 THEN [{'path': '$', 'code': 'not-object'}] WHEN 3 THEN [{'path': '$.version', 'code': 'version'}, {'path': '$.assets.a.data', 'code': 'not-binary'}]
      WHEN 1 THEN list_concat([{'path': '$.schema', 'code': 'schema'}, {'path': '$.version', 'code': 'version'}], list_concat(list_transform(['metadata', 'assets', 'equations', 'notes'], lambda k: {'path': '$.' || k, 'code': 'not-record'}), list_transform(['blocks', 'styles', 'warnings'], lambda k: {'path': '$.' || k, 'code': 'not-list'}))) ELSE [] END) AS i FROM events)""",
}
