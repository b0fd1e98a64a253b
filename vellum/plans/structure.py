"""Queries of the operators over blocks."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import structure as S

from .scalar import PLAIN, _read

BLOCKS_SQL = rf"""blocks AS (SELECT page_id, generate_subscripts(tags, 1) - 1 AS ord, lower(unnest(tags)) AS tag, unnest(inners) AS inner_html FROM (
  SELECT page_id, regexp_extract_all(html, '{S.HEADING_OR_PARAGRAPH}', 1) AS tags, regexp_extract_all(html, '{S.HEADING_OR_PARAGRAPH}', 2) AS inners FROM pages))"""
INNER = PLAIN.replace("(html,", "(inner_html,")
#: Letters with marks fall apart into a letter and a mark, which is no letter of an anchor.
_APART = {c: unicodedata.normalize("NFKD", c) for c in map(chr, range(0xA0, 0x180)) if any("0" <= x.lower() <= "9" or "a" <= x.lower() <= "z" for x in unicodedata.normalize("NFKD", c))}
_MAP = "MAP {" + ", ".join(f"'{c}': '{x}'" for c, x in _APART.items()) + "}"
SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower(array_to_string(list_transform(string_split({}, ''), lambda c: coalesce(" + _MAP.replace("{", "{{").replace("}", "}}") + "[c], c)), '')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'section')"


def blocks_scan(spark, sf_dir):
    return S.line_blocks(_read(spark, sf_dir, "documents"))


def page_blocks(spark, sf_dir):
    rows = S.page_blocks(_read(spark, sf_dir, "pages"))
    return rows.select("page_id", "ord", "tag", T.plain_text(F.col("inner")).alias("text"))


def neighbour_context(spark, sf_dir):
    kind = F.when(F.length("text") > 400, "figure").when(F.length("text") < 80, "table")
    return S.neighbours(_read(spark, sf_dir, "conversations"), "conv_id", "turn", kind).select("conv_id", "turn", "nearby")


def chapter_split(spark, sf_dir):
    return S.chapters(_read(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "chapter")


def list_islands(spark, sf_dir):
    rows = S.islands(_read(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") != "system", F.length("text") % 2 == 0)
    return rows.select("conv_id", "turn", "list_no", "item_no")


def field_depth(spark, sf_dir):
    rows = S.nesting(_read(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "signup", F.col("event_type") == "purchase")
    return rows.select("event_id", "depth")


def note_numbering(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("note"))
    return S.note_numbers(rows, "l_orderkey", "l_linenumber", "note").select("l_orderkey", "l_linenumber", "note", "number")


def heading_slugs(spark, sf_dir):
    rows = S.page_blocks(_read(spark, sf_dir, "pages")).withColumn("text", T.plain_text(F.col("inner")))
    return S.unique_slugs(rows, "page_id", "ord", F.col("text")).select("page_id", "ord", "anchor")


def asset_registry(spark, sf_dir):
    kinds = ["image/png", "font/woff2", "image/svg+xml", "image/jpeg"]
    media = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = _read(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 40).alias("doc_id"), F.concat(F.lit("asset-"), F.col("p_partkey").cast("string")).alias("asset_id"), media.alias("media_type"))
    return S.asset_paths(rows, "doc_id", "asset_id", T.media_extension(F.col("media_type"), True), F.col("media_type").startswith("font/")).select("asset_id", "path")


def ignore_blocks(spark, sf_dir):
    rows = S.line_blocks(_read(spark, sf_dir, "documents"))
    path = F.concat_ws(".", F.lpad(F.floor(F.col("ord") / 4).cast("string"), 5, "0"), F.when(F.col("ord") % 4 > 0, F.lpad((F.col("ord") % 4).cast("string"), 5, "0")))
    rows = rows.withColumn("path", path)
    dropped = rows.filter(F.length("text") < 30).select("doc_id", "path")
    return S.without_subtrees(rows, dropped, "doc_id", "path").select("doc_id", "path")


def limit_check(spark, sf_dir):
    """Each document a package whose lines are its parts: size limits by part and in total, in the order of the parts."""
    from pyspark.sql import Window

    parts = S.line_blocks(_read(spark, sf_dir, "documents")).withColumn("size", F.length("text").cast("long"))
    parts = parts.withColumn("upto", F.sum("size").over(Window.partitionBy("doc_id").orderBy("ord")))
    rules = [("too-many-entries", F.col("ord") >= 40), ("total-size", F.col("upto") > 8000), ("entry-size", F.col("size") > 2000)]
    return S.first_violation(parts, "doc_id", "ord", rules)


def missing_references(spark, sf_dir):
    """Documents that no label refers to, as an asset that is referred to but not there would be found."""
    return _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


QUERIES = {
    f.__name__: f
    for f in (
        blocks_scan, page_blocks, neighbour_context, chapter_split, list_islands, field_depth, note_numbering, heading_slugs, asset_registry,
        ignore_blocks, limit_check, missing_references,
    )
}

_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents)"

SQL = {
    "blocks_scan": f"WITH {_LINES} SELECT doc_id, ord::BIGINT AS ord, text FROM lines",
    "page_blocks": f"WITH {BLOCKS_SQL} SELECT page_id, ord::BIGINT AS ord, tag, {INNER} AS text FROM blocks",
    "neighbour_context": """WITH k AS (SELECT conv_id, turn, CASE WHEN length(text) > 400 THEN 'figure' WHEN length(text) < 80 THEN 'table' END AS kind FROM conversations)
      SELECT conv_id, turn, coalesce(lag(kind) OVER w, lead(kind) OVER w) AS nearby FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "chapter_split": """WITH n AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)
      SELECT conv_id, turn, 'chapter-' || lpad((1 + sum(CASE WHEN role = 'user' AND rn > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT::VARCHAR, 3, '0') AS chapter FROM n""",
    "list_islands": """WITH m AS (SELECT conv_id, turn, role <> 'system' AS m, length(text) % 2 = 0 AS o FROM conversations),
      n AS (SELECT *, m AND (NOT coalesce(lag(m) OVER w, false) OR lag(o) OVER w <> o) AS fresh FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
      l AS (SELECT *, CASE WHEN m THEN sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) END AS list_no FROM n)
      SELECT conv_id, turn, list_no::BIGINT AS list_no, CASE WHEN m THEN row_number() OVER (PARTITION BY conv_id, list_no ORDER BY turn) END AS item_no FROM l""",
    "field_depth": """SELECT event_id, (sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS depth FROM events""",
    "note_numbering": """WITH f AS (SELECT l_orderkey, l_suppkey AS note, min(l_linenumber) AS first FROM lineitem GROUP BY ALL),
      n AS (SELECT l_orderkey, note, row_number() OVER (PARTITION BY l_orderkey ORDER BY first, note) AS number FROM f)
      SELECT l.l_orderkey, l_linenumber, note, number FROM lineitem l JOIN n ON l.l_orderkey = n.l_orderkey AND l_suppkey = note""",
    "heading_slugs": f"""WITH {BLOCKS_SQL}, s AS (SELECT page_id, ord, {SLUG.format(INNER)} AS slug FROM blocks),
      n AS (SELECT *, row_number() OVER (PARTITION BY page_id, slug ORDER BY ord) AS n FROM s)
      SELECT page_id, ord::BIGINT AS ord, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS anchor FROM n""",
    "asset_registry": """WITH a AS (SELECT p_partkey // 40 AS doc_id, 'asset-' || p_partkey AS asset_id, ['image/png', 'font/woff2', 'image/svg+xml', 'image/jpeg'][p_partkey % 4 + 1] AS t FROM part),
      e AS (SELECT *, MAP {'image/png': 'png', 'font/woff2': 'woff2', 'image/jpeg': 'jpg'}[t] AS ext, t = 'font/woff2' AS font FROM a),
      n AS (SELECT *, lpad((row_number() OVER (PARTITION BY doc_id, font, ext IS NULL ORDER BY asset_id))::VARCHAR, 3, '0') AS n FROM e)
      SELECT asset_id, CASE WHEN font THEN 'fonts/font-' ELSE 'images/image-' END || n || '.' || ext AS path FROM n""",
    "ignore_blocks": f"""WITH {_LINES}, p AS (SELECT doc_id, text, lpad((ord // 4)::VARCHAR, 5, '0') || CASE WHEN ord % 4 > 0 THEN '.' || lpad((ord % 4)::VARCHAR, 5, '0') ELSE '' END AS path FROM lines)
      SELECT doc_id, path FROM p WHERE NOT EXISTS (SELECT 1 FROM p d WHERE d.doc_id = p.doc_id AND length(d.text) < 30 AND (d.path = p.path OR starts_with(p.path, d.path || '.')))""",
    "limit_check": f"""WITH {_LINES}, u AS (SELECT doc_id, ord, length(text) AS size, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY ord) AS upto FROM lines),
      c AS (SELECT doc_id, ord, CASE WHEN ord >= 40 THEN 'too-many-entries' WHEN upto > 8000 THEN 'total-size' WHEN size > 2000 THEN 'entry-size' END AS code FROM u)
      SELECT doc_id, arg_min(code, ord) FILTER (WHERE code IS NOT NULL) AS code FROM c GROUP BY doc_id""",
    "missing_references": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
}
