"""Queries of style analysis, metadata and warnings."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import metadata as M
from vellum.operators import structure as S
from vellum.operators import styles as Y
from vellum.operators import warnings as W

from .scalar import BASE, PATH, PLAIN, _read
from .structure import BLOCKS_SQL, SLUG, _LINES

#: A style sheet with a chain, a dangling parent and a cycle: style_id, name, kind, based_on, size, bold, outline, before, numbering.
STYLES = [
    ("Normal", "Normal", "paragraph", None, 11.0, None, None, None, None),
    ("Base", "Body Base", "paragraph", "Normal", None, True, None, 6.0, None),
    ("Heading1", "heading 1", "paragraph", "Base", 20.0, None, 0, None, None),
    ("Sub", "Untertitel", "paragraph", "Heading1", None, False, None, None, "1:0"),
    ("Kop2", "Kop 2", "paragraph", "Missing", 16.0, None, None, None, None),
    ("LoopA", "Loop A", "paragraph", "LoopB", None, True, None, None, None),
    ("LoopB", "Loop B", "paragraph", "LoopA", 9.0, None, None, None, None),
    ("Bijschrift", "Bijschrift", "paragraph", "Normal", None, None, None, None, None),
]
_STYLES_SCHEMA = "style_id string, name string, kind string, based_on string, font_size double, bold boolean, outline_level int, space_before double, numbering string"


def _value(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)


_VALUES = ", ".join("(" + ", ".join(map(_value, s)) + ")" for s in STYLES)
SHEET = f"""sheet AS (SELECT style_id, name, kind, based_on, font_size::DOUBLE AS font_size, bold::BOOLEAN AS bold, outline_level::INT AS outline_level, space_before::DOUBLE AS space_before, numbering::VARCHAR AS numbering
  FROM (VALUES {_VALUES}) AS v(style_id, name, kind, based_on, font_size, bold, outline_level, space_before, numbering))"""
EFFECTIVE = """chain AS (
    SELECT style_id AS id, based_on AS up, 0 AS depth, [style_id] AS seen, font_size, bold, outline_level, space_before, numbering FROM sheet
    UNION ALL
    SELECT c.id, s.based_on, c.depth + 1, list_append(c.seen, s.style_id), coalesce(c.font_size, s.font_size), coalesce(c.bold, s.bold), coalesce(c.outline_level, s.outline_level), coalesce(c.space_before, s.space_before), coalesce(c.numbering, s.numbering)
    FROM chain c JOIN sheet s ON s.style_id = c.up WHERE NOT list_contains(c.seen, s.style_id)),
  effective AS (SELECT id AS style_id, arg_max_null(font_size, depth) AS font_size, arg_max_null(bold, depth) AS bold, arg_max_null(outline_level, depth) AS outline_level, arg_max_null(space_before, depth) AS space_before, arg_max_null(numbering, depth) AS numbering FROM chain GROUP BY id)"""


def _sheets(spark, sf_dir):
    """The style sheet for each language of the corpus, as if each were a document."""
    langs = _read(spark, sf_dir, "documents").filter("lang IS NOT NULL").select(F.col("lang").alias("doc_id")).distinct()
    names = [c.split()[0] for c in _STYLES_SCHEMA.split(", ")]
    sheet = F.from_json(F.lit(json.dumps([dict(zip(names, s, strict=True)) for s in STYLES])), f"array<struct<{_STYLES_SCHEMA.replace(' ', ':').replace(',:', ',')}>>")
    rows = langs.select("doc_id", F.inline(sheet))
    return rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in Y.FORMATS.items() if c not in names])


def style_inheritance(spark, sf_dir):
    return Y.effective_formats(_sheets(spark, sf_dir)).select("doc_id", "style_id", "font_size", "bold", "outline_level", "space_before", "numbering")


def _usages(spark, sf_dir):
    return Y.line_usages(S.line_blocks(_read(spark, sf_dir, "documents")))


def style_usage(spark, sf_dir):
    return Y.usage_statistics(_usages(spark, sf_dir), ["doc_id", "style_id"])


def style_examples(spark, sf_dir):
    found = Y.examples(_usages(spark, sf_dir), ["doc_id", "style_id"])
    return found.select("doc_id", "style_id", F.array_join("examples", "|").alias("examples"))


def used_styles(spark, sf_dir):
    """Styles of each language's sheet that its documents use; the usages' styles stand for the sheet's by first letter."""
    used = _usages(spark, sf_dir).join(_read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select(F.col("lang").alias("doc_id"), F.upper(F.substring("style_id", 1, 1)).alias("initial"))
    sheet = _sheets(spark, sf_dir).withColumn("initial", F.substring("style_id", 1, 1))
    return sheet.join(used, ["doc_id", "initial"], "left_semi").select("doc_id", "style_id")


#: Style names of line styles by document: aliases of every list, headings of several languages, names that are none of them.
NAMES = ("Alaotsikko", "Cytat", "Ondertitel", "Überschrift 2", "Nadpis3", "Rubrik", "Felirat 1", "Legenda", "Subtítulo", "Block Quote", "Citace", "Virsraksts 9", "Standaard", "Titlu", "x Kop 4 y", "Baslık")


def _classified(spark, sf_dir):
    """Line styles of each document through the ladder, with mappings, levels and parents for some of them."""
    stats = style_usage(spark, sf_dir)
    size = stats.groupBy("doc_id").agg(F.max("most_size").alias("document_size"))
    styles = stats.join(size, "doc_id")
    at = lambda n: F.col("doc_id") % n
    name = F.when(F.col("style_id").isin("item", "text"), F.element_at(F.array(*[F.lit(x) for x in NAMES]), (at(len(NAMES)) + 1).cast("int"))).otherwise(F.initcap("style_id"))
    return Y.classify(styles.select(
        "doc_id", F.when((F.col("style_id") == "item") & (at(17) == 0), "HeadingChar5").otherwise(F.col("style_id")).alias("style_id"),
        "usages", "first_position", "short", "bold_text", "spaced_text", "numbered_text", "near_figure", "caption_text", "most_size", "document_size",
        name.alias("name"), F.lit("paragraph").alias("kind"), F.when(F.col("style_id") == "short", F.when(at(2) == 0, "Heading3").otherwise("headingchar2")).alias("based_on"),
        F.lit(None).cast("boolean").alias("bold"), F.when(F.col("style_id") == "shout", 6.0).alias("space_before"),
        F.when((F.col("style_id") == "text") & (at(10) == 0), 1).when((F.col("style_id") == "text") & (at(10) == 1), 7).alias("outline_level"),
        F.when((F.col("style_id") == "item") & (at(9) == 0), 8).alias("toc_level"),
        F.when((F.col("style_id") == "text") & (at(11) == 0), F.lit("author")).alias("user_mapping"),
        F.when((F.col("style_id") == "short") & (at(13) == 0), F.lit("caption")).alias("preset_mapping"),
    ))


def style_classify(spark, sf_dir):
    return _classified(spark, sf_dir).select("doc_id", "style_id", "mapping", "confidence", "evidence")


def preset_accept(spark, sf_dir):
    """Confident proposals of the whole corpus by style, over mappings chosen before."""
    votes = _classified(spark, sf_dir).filter("confidence IN ('high', 'certain')").groupBy("style_id").agg(F.min("mapping").alias("mapping"), F.min("confidence").alias("confidence"))
    return Y.accept_confident(votes, spark.createDataFrame([("text", "body")], "style_id string, mapping string"))


def apply_heading_levels(spark, sf_dir):
    rows = S.page_blocks(_read(spark, sf_dir, "pages"))
    level = F.when(F.col("tag") != "p", F.substring("tag", 2, 1).cast("int"))
    mapping = F.when(F.col("tag") == "h1", F.when(F.col("page_id") % 2 == 0, "title").otherwise("heading1")).when(F.col("ord") % 7 == 3, "heading6").otherwise("body")
    return rows.select("page_id", "ord", Y.heading_level(mapping, level).alias("level"))


def metadata_candidates(spark, sf_dir):
    return M.page_candidates(_read(spark, sf_dir, "pages"))


def metadata_resolve(spark, sf_dir):
    return M.resolve(metadata_candidates(spark, sf_dir))


def metadata_titles(spark, sf_dir):
    found = M.all_values(metadata_candidates(spark, sf_dir), "title")
    return found.select("page_id", F.array_join("values", "|").alias("titles"))


def publication_date(spark, sf_dir):
    """Dates of orders as candidates of their customers: some sure, some not, in order."""
    rows = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("value"), F.when(F.col("o_orderstatus") == "F", "certain").otherwise("low").alias("confidence"), F.lit(1).alias("priority"), F.col("o_orderkey").alias("ord"))
    return M.publication_date(rows, "2026-01-31")


def metadata_edit_overlay(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    edits = pages.filter("page_id % 3 = 0").select("page_id", F.lit("title").alias("field"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" Edited "), F.col("page_id").cast("string"))).otherwise(" ").alias("value"))
    edits = edits.unionByName(pages.filter("page_id % 5 = 0").select("page_id", F.lit("subject").alias("field"), F.lit("corpora").alias("value")))
    return M.overlay(M.resolve(metadata_candidates(spark, sf_dir)), edits)


def _warned(spark, sf_dir):
    """Warnings of documents: three kinds by line, in order."""
    rows = Y.line_usages(S.line_blocks(_read(spark, sf_dir, "documents")))
    code = F.when(F.col("style_id") == "shout", "style-unknown").when(F.col("style_id") == "short", "formula-conversion-incomplete").otherwise("long-line")
    return rows.select("doc_id", F.col("position").alias("ord"), code.alias("code"), F.when(F.col("style_id") == "shout", "shout").alias("style_id"), F.concat(F.lit("length "), F.length("text").cast("string")).alias("message"))


def warnings_deduplicate(spark, sf_dir):
    return W.deduplicate(_warned(spark, sf_dir), "doc_id", "ord").select("doc_id", "ord", "code", "message")


def warning_route(spark, sf_dir):
    rows = _warned(spark, sf_dir)
    return rows.groupBy("doc_id", F.coalesce(W.route(F.col("code")), F.lit("none")).alias("part")).agg(F.count("*").alias("warnings"))


def validate_model(spark, sf_dir):
    tests = [
        ("$.text", "missing", "The text is missing.", F.col("text").isNull()),
        ("$.text", "empty", "The text has no letters.", ~F.coalesce("text", F.lit("")).rlike("[A-Za-z]")),
        ("$.lang", "domain", "The language is not of the four.", ~F.coalesce("lang", F.lit("")).isin("de", "en", "es", "fr")),
        ("$.n_chars", "range", "The length is out of range.", ~F.col("n_chars").between(100, 10000)),
        ("$.source", "shape", "The source has two digits.", F.col("source").rlike("^src[0-9]{2}$")),
    ]
    return W.rules(_read(spark, sf_dir, "documents"), "doc_id", tests)


def warning_style_names(spark, sf_dir):
    styles = _read(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select("doc_id", F.lit("shout").alias("style_id"), F.lit("Loud Lines").alias("name"))
    return W.with_style_names(_warned(spark, sf_dir), styles, "doc_id").select("doc_id", "ord", "style_name")


def warnings_merged(spark, sf_dir):
    rows = _warned(spark, sf_dir).select("doc_id", "ord", "code", "message")
    found = W.merged(rows.filter("code = 'long-line'"), rows.filter("code <> 'long-line'"), "doc_id")
    return found.select("doc_id", F.col("ord").cast("long").alias("ord"), "code", "message")


def edited_authors(spark, sf_dir):
    """Customers in groups of forty as authors of a document, one renamed, one removed and one added."""
    from pyspark.sql import Window

    customers = _read(spark, sf_dir, "customer").withColumn("page_id", F.floor(F.col("c_custkey") / 40))
    order = Window.partitionBy("page_id").orderBy("c_custkey")
    people = customers.select("page_id", (F.row_number().over(order) - 1).alias("ord"), F.col("c_name").alias("name"))
    changes = ((0, F.concat(F.lit(" Prof. "), F.col("page_id").cast("string"))), (1, F.lit(" ")), (100000, F.lit("Anon")))
    edits = customers.select("page_id").distinct().select("page_id", F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), n.alias("name")) for i, n in changes])).alias("e"))
    found = M.edit_people(people, edits.select("page_id", "e.*"))
    return found.select("page_id", F.col("ord").cast("long").alias("ord"), "name")


QUERIES = {
    f.__name__: f
    for f in (
        warning_style_names, warnings_merged, edited_authors, style_inheritance, style_usage, style_examples, used_styles, style_classify, preset_accept, apply_heading_levels, metadata_candidates, metadata_resolve,
        metadata_titles, publication_date, metadata_edit_overlay, warnings_deduplicate, warning_route, validate_model,
    )
}

_U = f"""{_LINES}, t AS (SELECT doc_id, ord AS position, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS text FROM lines),
  usages AS (SELECT doc_id, position, text, CASE WHEN upper(text) = text AND lower(text) <> text THEN 'shout' WHEN regexp_matches(text, '^([-*•]|[0-9]+[.)]) ') THEN 'item' WHEN length(text) <= 40 THEN 'short' ELSE 'text' END AS style_id FROM t),
  stats AS (SELECT doc_id, style_id, count(*) AS usages, min(position)::BIGINT AS first_position, bool_and(length(text) <= 100) AS short, bool_and(style_id = 'shout') AS bold_text, bool_or(style_id = 'item') AS numbered_text,
    false AS near_figure, bool_or(regexp_matches(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')), '^(figure|fig|photo|image|table|figuur|afbeelding|foto|tabel)\\b')) AS caption_text, false AS spaced_text,
    max(CASE style_id WHEN 'shout' THEN 32.0 WHEN 'short' THEN 16.0 ELSE 11.0 END)::DOUBLE AS most_size FROM usages GROUP BY ALL)"""
#: What the rules make of each name, stated one by one.
_MEANT = {"Alaotsikko": "subtitle", "Cytat": "blockquote", "Überschrift 2": "heading2", "Nadpis3": "heading3", "Rubrik": "title", "Felirat 1": "caption", "Legenda": "caption", "Subtítulo": "subtitle", "Citace": "blockquote", "Titlu": "title", "x Kop 4 y": "heading4"}
_BY_NAME = "CASE n " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _MEANT.items()) + " END"
_CLASS = f"""{_U}, sized AS (SELECT *, max(most_size) OVER (PARTITION BY doc_id) AS document_size, CASE WHEN style_id IN ('item', 'text') THEN [{", ".join(f"'{n}'" for n in NAMES)}][doc_id % {len(NAMES)} + 1] END AS n FROM stats),
  named AS (SELECT *, {_BY_NAME} AS m FROM sized),
  classified AS (SELECT doc_id, CASE WHEN style_id = 'item' AND doc_id % 17 = 0 THEN 'HeadingChar5' ELSE style_id END AS style_id, CASE
    WHEN style_id = 'text' AND doc_id % 11 = 0 THEN ['author', 'certain', 'user-mappings']
    WHEN style_id = 'short' AND doc_id % 13 = 0 THEN ['caption', 'certain', 'mapping-preset']
    WHEN style_id = 'text' AND doc_id % 10 = 0 THEN ['heading2', 'certain', 'outline-level']
    WHEN style_id = 'item' AND doc_id % 17 = 0 THEN ['heading5', 'high', 'style-id']
    WHEN style_id = 'item' AND doc_id % 9 = 0 THEN ['heading6', 'high', 'table-of-contents']
    WHEN m LIKE 'heading%' THEN [m, 'medium', 'localized-style-aliases']
    WHEN usages = 1 AND first_position <= 2 AND short AND most_size >= 32 AND most_size = document_size THEN ['title', 'high', 'typographic-structural-analysis']
    WHEN m = 'caption' THEN ['caption', 'high', 'caption-context-analysis']
    WHEN caption_text THEN ['caption', 'medium', 'caption-context-analysis']
    WHEN m IS NOT NULL THEN [m, 'medium', 'localized-style-aliases']
    WHEN style_id = 'short' THEN [CASE WHEN doc_id % 2 = 0 THEN 'heading3' ELSE 'heading2' END, 'medium', 'style-inheritance']
    WHEN short AND bold_text AND style_id = 'shout' THEN ['heading1', 'low', 'typographic-structural-analysis']
    ELSE ['body', 'medium', 'plain-paragraph-fallback'] END AS c FROM named)"""
_FIRST = PLAIN.replace("(html,", "(regexp_extract(html, '(?is)<{tag}\\b[^>]*>(.*?)(?:</{tag}>|<p\\b|<h|</article>)', 1),")
_TITLE = PLAIN.replace("(html,", "(regexp_extract(html, '(?is)<title>(.*?)</title>', 1),")
_CAND = f"""cand AS (SELECT page_id, field, trim(value) AS value, source, priority, confidence, method, 0::BIGINT AS ord FROM (
    SELECT page_id, 'title' AS field, {_TITLE} AS value, 'title-element' AS source, 1 AS priority, 'certain' AS confidence, 'extracted' AS method FROM pages
    UNION ALL SELECT page_id, 'title', {_FIRST.replace("{tag}", "h1")}, 'first-heading', 4, 'high', 'inferred' FROM pages
    UNION ALL SELECT page_id, 'title', {_FIRST.replace("{tag}", "p")}, 'first-paragraph', 5, 'medium', 'inferred' FROM pages
    UNION ALL SELECT page_id, 'title', {BASE.format(PATH)}, 'file-name', 7, 'low', 'inferred' FROM pages
    UNION ALL SELECT page_id, 'language', regexp_extract(html, '(?i)<html[^>]*\\blang="([^"]*)"', 1), 'html-element', 1, 'certain', 'extracted' FROM pages
    UNION ALL SELECT page_id, 'identifier', 'urn:vellum:' || {SLUG.format("coalesce(url, '')")}, 'file-name', 7, 'low', 'default' FROM pages) WHERE trim(value) <> ''),
  best AS (SELECT page_id, field, arg_min([value, source, confidence, method], priority) AS b FROM cand GROUP BY ALL)"""
_WARN = f"""{_U}, warned AS (SELECT doc_id, position AS ord, CASE style_id WHEN 'shout' THEN 'style-unknown' WHEN 'short' THEN 'formula-conversion-incomplete' ELSE 'long-line' END AS code,
    CASE WHEN style_id = 'shout' THEN 'shout' END AS style_id, 'length ' || length(text) AS message FROM usages)"""

SQL = {
    "style_inheritance": f"WITH RECURSIVE {SHEET}, {EFFECTIVE} SELECT l.doc_id, e.* FROM effective e, (SELECT DISTINCT lang AS doc_id FROM documents WHERE lang IS NOT NULL) l",
    "style_usage": f"WITH {_U} SELECT * FROM stats",
    "style_examples": f"""WITH {_U}, f AS (SELECT doc_id, style_id, text, min(position) AS seen FROM usages WHERE text <> '' GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, style_id ORDER BY seen, text) AS n FROM f)
      SELECT doc_id, style_id, string_agg(text, '|' ORDER BY n) AS examples FROM r WHERE n <= 3 GROUP BY ALL""",
    "used_styles": f"""WITH {SHEET}, {_U}, used AS (SELECT DISTINCT lang AS doc_id, upper(substr(style_id, 1, 1)) AS initial FROM usages JOIN documents USING (doc_id))
      SELECT doc_id, style_id FROM sheet JOIN used ON initial = substr(style_id, 1, 1) WHERE doc_id IS NOT NULL""",
    "style_classify": f"WITH {_CLASS} SELECT doc_id, style_id, c[1] AS mapping, c[2] AS confidence, c[3] AS evidence FROM classified",
    "preset_accept": f"""WITH {_CLASS} SELECT 'text' AS style_id, 'body' AS mapping UNION ALL SELECT style_id, min(c[1]) FROM classified WHERE c[2] IN ('high', 'certain') AND style_id <> 'text' GROUP BY style_id""",
    "apply_heading_levels": "WITH {blocks} SELECT page_id, ord::BIGINT AS ord, (CASE WHEN tag = 'h1' THEN CASE WHEN page_id % 2 = 0 THEN 1 ELSE 2 END WHEN ord % 7 = 3 THEN 6 WHEN tag <> 'p' THEN substr(tag, 2, 1)::INT END)::INT AS level FROM blocks",
    "metadata_candidates": f"WITH {_CAND} SELECT * FROM cand",
    "metadata_resolve": f"WITH {_CAND} SELECT page_id, field, b[1] AS value, b[2] AS source, b[3] AS confidence, b[4] AS method FROM best",
    "metadata_titles": f"WITH {_CAND} SELECT page_id, string_agg(value, '|' ORDER BY priority) AS titles FROM cand WHERE field = 'title' GROUP BY page_id",
    "publication_date": """SELECT o_custkey AS page_id, coalesce(arg_min(strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) FILTER (WHERE o_orderstatus = 'F'), '2026-01-31') AS value,
      CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') = 0 THEN 'default' ELSE 'extracted' END AS method FROM orders GROUP BY o_custkey""",
    "metadata_edit_overlay": f"""WITH {_CAND}, edits AS (SELECT page_id, 'title' AS field, CASE WHEN page_id % 2 = 0 THEN 'Edited ' || page_id ELSE '' END AS edit FROM pages WHERE page_id % 3 = 0
        UNION ALL SELECT page_id, 'subject', 'corpora' FROM pages WHERE page_id % 5 = 0)
      SELECT coalesce(a.page_id, e.page_id) AS page_id, coalesce(a.field, e.field) AS field, coalesce(edit, b[1]) AS value, CASE WHEN edit IS NULL THEN b[2] ELSE 'editor' END AS source,
        CASE WHEN edit IS NULL THEN b[3] ELSE 'certain' END AS confidence, CASE WHEN edit IS NULL THEN b[4] ELSE 'user' END AS method
      FROM best a FULL JOIN edits e ON a.page_id = e.page_id AND a.field = e.field WHERE edit IS NULL OR edit <> ''""",
    "warnings_deduplicate": f"""WITH {_WARN}, k AS (SELECT *, CASE code WHEN 'style-unknown' THEN 'style:' || style_id WHEN 'long-line' THEN code || ':' || message END AS key FROM warned)
      SELECT doc_id, ord::BIGINT AS ord, code, message FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY ord) AS n FROM k) WHERE key IS NULL OR n = 1""",
    "warning_route": f"""WITH {_WARN} SELECT doc_id, CASE code WHEN 'style-unknown' THEN 'styles' WHEN 'long-line' THEN 'none' ELSE 'formula' END AS part, count(*) AS warnings FROM warned GROUP BY ALL""",
    "warning_style_names": f"WITH {_WARN} SELECT doc_id, ord::BIGINT AS ord, CASE WHEN style_id = 'shout' AND doc_id % 2 = 0 THEN 'Loud Lines' ELSE style_id END AS style_name FROM warned",
    "warnings_merged": f"WITH {_WARN} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY code <> 'long-line', ord) - 1 AS ord, code, message FROM warned",
    "edited_authors": """WITH p AS (SELECT c_custkey // 40 AS page_id, row_number() OVER (PARTITION BY c_custkey // 40 ORDER BY c_custkey) - 1 AS ord, c_name AS name FROM customer),
      d AS (SELECT DISTINCT page_id FROM p), e AS (SELECT page_id, 0 AS ord, 'Prof. ' || page_id AS edit FROM d UNION ALL SELECT page_id, 1, '' FROM d UNION ALL SELECT page_id, 100000, 'Anon' FROM d),
      b AS (SELECT coalesce(p.page_id, e.page_id) AS page_id, coalesce(p.ord, e.ord) AS ord, coalesce(edit, name) AS name FROM p FULL JOIN e ON p.page_id = e.page_id AND p.ord = e.ord)
      SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS ord, name FROM b WHERE name <> ''""",
    "validate_model": """SELECT * FROM (
      SELECT doc_id, 1 AS rule, '$.text' AS path, 'missing' AS code, 'The text is missing.' AS message FROM documents WHERE text IS NULL
      UNION ALL SELECT doc_id, 2, '$.text', 'empty', 'The text has no letters.' FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[A-Za-z]')
      UNION ALL SELECT doc_id, 3, '$.lang', 'domain', 'The language is not of the four.' FROM documents WHERE coalesce(lang, '') NOT IN ('de', 'en', 'es', 'fr')
      UNION ALL SELECT doc_id, 4, '$.n_chars', 'range', 'The length is out of range.' FROM documents WHERE NOT n_chars BETWEEN 100 AND 10000
      UNION ALL SELECT doc_id, 5, '$.source', 'shape', 'The source has two digits.' FROM documents WHERE regexp_matches(source, '^src[0-9]{2}$'))""",
}


SQL["apply_heading_levels"] = SQL["apply_heading_levels"].replace("{blocks}", BLOCKS_SQL)
