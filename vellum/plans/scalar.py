"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.structure import hrefs

LCID_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in T.LCIDS.items())
PLAIN = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '[ \t\n\r\f\x0B]+', ' ', 'g'))"""
HREFS = """(SELECT page_id, unnest(regexp_extract_all(html, '<a\\s+href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a\\s+href="([^"]*)"', 1), 1) - 1 AS ord FROM pages)"""
BASE = r"coalesce(nullif(trim(regexp_replace(trim(list_extract(string_split_regex({}, '[/\\]'), -1)), '\.[^.]+$', '')), ''), 'document')"
PATH = "regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/$', '')"


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def escape_markdown(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.escape_markdown(F.col("text")).alias("escaped"))


def escape_html(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", T.escape_html(F.col("html")).alias("text"), T.escape_attribute(F.col("url")).alias("attribute"), T.escape_xml(F.col("url")).alias("xml"))


def plain_text_html(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", T.plain_text(T.body_of(F.col("html"))).alias("plain"))


def normalise_text(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.normal_text(F.col("text")).alias("normal"))


def data_url(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.data_url(F.lit("IMAGE/png"), F.encode("text", "UTF-8")).alias("url"))


def tokens_and_labels(spark, sf_dir):
    rows = _read(spark, sf_dir, "part")
    return rows.select("p_partkey", T.token(F.col("p_brand")).alias("token"), T.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


def title_in_url(spark, sf_dir):
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    return _read(spark, sf_dir, "pages").select("page_id", T.title_in_name(title, F.col("url")).alias("named"), T.title_in_name(F.col("url"), F.col("html")).alias("url_words_in_page"))


def safe_hrefs(spark, sf_dir):
    rows = hrefs(_read(spark, sf_dir, "pages"))
    return rows.select("page_id", "ord", *[T.safe_href(F.col("href"), p).alias(p) for p in ("html", "markdown", "epub")], T.href_scheme(F.col("href")).alias("scheme"))


def media_admission(spark, sf_dir):
    kinds = list(T.IMAGE_TYPES) + list(T.FONT_TYPES) + ["image/svg+xml", "text/html", "application/pdf"]
    media = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("p_partkey") % len(kinds) + 1).cast("int"))
    rows = _read(spark, sf_dir, "part").select("p_partkey", media.alias("media_type"))
    return rows.select("p_partkey", "media_type", T.media_extension(F.col("media_type"), False).alias("embedded"), T.media_extension(F.col("media_type"), True).alias("packed"))


def language_lcid(spark, sf_dir):
    code = F.element_at(F.array(*[F.lit(x) for x in ("1031", "en", "3082", "9999", "fr-FR", "01033", "x")]), (F.col("doc_id") % 7 + 1).cast("int"))
    rows = _read(spark, sf_dir, "documents").select("doc_id", code.alias("stated"))
    return rows.select("doc_id", "stated", T.language_tag(F.col("stated")).alias("tag"), T.html_language(F.col("stated")).alias("html_tag"))


def output_names(spark, sf_dir):
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), "/$", "")
    outputs = [("html", "single"), ("html", "zip"), ("markdown", "single"), ("markdown", "zip"), ("epub", "single")]
    return _read(spark, sf_dir, "pages").select("page_id", T.base_name(path).alias("base"), *[T.output_name(path, f, m).alias(f"{f}_{m}") for f, m in outputs])


def code_fence(spark, sf_dir):
    text = F.concat_ws("\n", F.repeat(F.lit("`"), (F.col("turn") % 5).cast("int")), "text", F.lit("``"))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", T.fence(text).alias("fence"))


def math_tokens(spark, sf_dir):
    words = _read(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("word"))
    return words.groupBy("doc_id", T.math_kind(F.col("word")).alias("kind")).agg(F.count("*").alias("tokens"))


def json_get(spark, sf_dir):
    value = F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')")
    return _read(spark, sf_dir, "events").select("event_id", value.alias("k"))


def date_stamps(spark, sf_dir):
    date = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", T.utc_seconds(date).alias("stamp"))


def file_admission(spark, sf_dir):
    name = F.concat("p_name", F.element_at(F.array(F.lit(".docx"), F.lit(".DocX"), F.lit(".doc"), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int")))
    media = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "text/plain")
    return _read(spark, sf_dir, "part").select("p_partkey", T.admission_issue(name, media).alias("issue"))


def publication_issues(spark, sf_dir):
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    language = F.when(F.col("page_id") % 3 == 0, "not a tag").otherwise(F.regexp_extract("html", '<html lang="([^"]*)"', 1))
    issues = T.publication_issues(F.when(F.col("page_id") % 4 > 0, title), F.when(F.col("page_id") % 5 > 0, F.col("url")).otherwise(" "), language)
    return _read(spark, sf_dir, "pages").select("page_id", F.array_join(issues, ",").alias("issues"))


QUERIES = {
    f.__name__: f
    for f in (
        file_admission, publication_issues, escape_markdown, escape_html, plain_text_html, normalise_text, data_url, tokens_and_labels, title_in_url, safe_hrefs, media_admission,
        language_lcid, output_names, code_fence, math_tokens, json_get, date_stamps,
    )
}

_IMAGES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.IMAGE_TYPES.items()) + "}"
_ALL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in (T.IMAGE_TYPES | T.FONT_TYPES).items()) + "}"
_KINDS = "[" + ", ".join(f"'{k}'" for k in [*T.IMAGE_TYPES, *T.FONT_TYPES, "image/svg+xml", "text/html", "application/pdf"]) + "]"
_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]{{3,}}')"
_NAMED = "len({w}) >= 2 AND len(list_filter({w}, lambda x: contains(lower({n}), x))) >= len({w}) * 0.6"
_TITLE = "regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"

SQL = {
    "file_admission": "SELECT p_partkey, CASE WHEN p_partkey % 4 > 1 THEN 'not-a-docx-name' WHEN p_size % 3 = 1 THEN 'not-a-docx-type' END AS issue FROM part",
    "publication_issues": f"""SELECT page_id, concat_ws(',', CASE WHEN page_id % 4 = 0 OR trim({_TITLE}) = '' THEN 'title' END, CASE WHEN page_id % 5 = 0 THEN 'identifier' END,
      CASE WHEN page_id % 3 = 0 OR NOT regexp_matches(regexp_extract(html, '<html lang="([^"]*)"', 1), '{T.LANGUAGE_TAG}') THEN 'language' END) AS issues FROM pages""",
    "escape_markdown": r"SELECT doc_id, regexp_replace(text, '([\\`*_\[\]<>#])', '\\\1', 'g') AS escaped FROM documents",
    "escape_html": """SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS text,
      replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS attribute,
      replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml FROM pages""",
    "plain_text_html": f"SELECT page_id, {PLAIN} AS plain FROM (SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<body[^>]*>.*?</body>') THEN regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1) ELSE html END AS html FROM pages)",
    "normalise_text": r"SELECT doc_id, lower(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS normal FROM documents",
    "data_url": "SELECT doc_id, 'data:image/png;base64,' || base64(encode(text)) AS url FROM documents",
    "tokens_and_labels": """SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9_-]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'unknown') AS token,
      coalesce(nullif(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'section') AS slug FROM part""",
    "title_in_url": f"SELECT page_id, {_NAMED.format(w=_WORDS.format(_TITLE), n='url')} AS named, {_NAMED.format(w=_WORDS.format('url'), n='html')} AS url_words_in_page FROM pages",
    "safe_hrefs": f"""SELECT page_id, ord::BIGINT AS ord, CASE WHEN regexp_matches(trim(href), '{T.HTML_HREF}') THEN trim(href) END AS html,
      CASE WHEN regexp_matches(trim(href), '{T.MARKDOWN_HREF}') THEN trim(href) END AS markdown, CASE WHEN regexp_matches(trim(href), '{T.EPUB_HREF}') THEN trim(href) END AS epub,
      coalesce(nullif(lower(regexp_extract(trim(href), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)), ''), 'relative') AS scheme FROM {HREFS}""",
    "media_admission": f"SELECT p_partkey, media_type, {_IMAGES}[media_type] AS embedded, {_ALL}[media_type] AS packed FROM (SELECT p_partkey, {_KINDS}[p_partkey % {len([*T.IMAGE_TYPES, *T.FONT_TYPES]) + 3} + 1] AS media_type FROM part)",
    "language_lcid": f"""SELECT doc_id, stated, CASE WHEN regexp_matches(stated, '{T.LANGUAGE_TAG}') THEN stated WHEN regexp_matches(stated, '^[0-9]{{3,5}}$') THEN coalesce(tag, stated) ELSE stated END AS tag,
      CASE WHEN regexp_matches(stated, '{T.LANGUAGE_TAG}') THEN stated ELSE 'en' END AS html_tag
      FROM (SELECT doc_id, ['1031', 'en', '3082', '9999', 'fr-FR', '01033', 'x'][doc_id % 7 + 1] AS stated FROM documents)
      LEFT JOIN (VALUES {LCID_ROWS}) AS l(code, tag) ON code = ltrim(stated, '0')""",
    "output_names": f"SELECT page_id, base, base || '.html' AS html_single, base || '-html.zip' AS html_zip, base || '.md' AS markdown_single, base || '-markdown.zip' AS markdown_zip, base || '.epub' AS epub_single FROM (SELECT page_id, {BASE.format(PATH)} AS base FROM pages)",
    "code_fence": r"SELECT conv_id, turn, repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(repeat('`', (turn % 5)::INT) || chr(10) || text || chr(10) || '``', '`+'), lambda x: length(x))), 0) + 1)) AS fence FROM conversations",
    "math_tokens": r"""SELECT doc_id, CASE WHEN regexp_matches(word, '^\p{N}+([.,]\p{N}+)?$') THEN 'number' WHEN regexp_matches(word, '^[+\-−=<>≤≥×÷±∓∞∫∑∏√∂∇≈≠∈∉∪∩]+$') THEN 'operator'
      WHEN regexp_matches(word, '^[\p{L}\p{Nl}]+$') THEN 'identifier' ELSE 'text' END AS kind, count(*) AS tokens FROM (SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS word FROM documents) WHERE word <> '' GROUP BY ALL""",
    "json_get": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "date_stamps": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS stamp FROM orders",
}
