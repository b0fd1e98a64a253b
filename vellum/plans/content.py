"""Queries over packages and models made for one rule each: content that is left out, formats, lists, references, settings, streams
and jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from vellum.functions import cover as C
from vellum.functions import formula as E
from vellum.functions import text as T
from vellum.operators import model as O
from vellum.operators import render as R
from vellum.sources.docx import parse_packages, relation
from vellum.sources.make_docx import NUMBERING, RELATIONS, made_packages, package, paragraph, rich_packages, spread

from . import corpus
from .packages import LIMITS, _number, _rich
from .scalar import _read

DATE = "2026-01-31"

#: Parts by number: what of a package is left out, and whether its image stays.
_SVG = '<svg xmlns="http://www.w3.org/2000/svg">{}</svg>'
PARTS = (
    ({"word/media/dot.svg": _SVG.format('<g><rect fill="url(#a)"/></g>')}, 1, False), ({"word/media/dot.svg": _SVG.format("<script/>")}, 0, True), ({"word/media/dot.svg": _SVG.format('<rect onload="x"/>')}, 0, True),
    ({"word/media/dot.svg": _SVG.format('<a href="http://x"/>')}, 0, True), ({"word/media/dot.svg": _SVG.format('<rect fill="url(http://x)"/>')}, 0, True), ({"word/media/dot.svg": _SVG.format('<a href="#b"/>'), "word/activeX/a.bin": "x"}, 1, True),
    ({"word/media/dot.svg": _SVG.format("<g/>"), "word/page.html": "<p/>"}, 1, True), ({"word/media/dot.svg": _SVG.format("<g/>"), "customUI/u.xml": "<x/>"}, 1, True), ({"word/media/dot.svg": "<p/>"}, 0, True),
    ({"word/media/dot.svg": _SVG.format("<foreignObject/>")}, 0, True),
)


def _with_parts(number: int, text: str) -> bytes:
    image = '<w:p><w:r><w:drawing><a:blip r:embed="r2"/></w:drawing></w:r></w:p>'
    return package(image, {"word/_rels/document.xml.rels": RELATIONS.replace("dot.png", "dot.svg").replace("{id}", "x")} | PARTS[number % len(PARTS)][0])


def _parts(spark, sf_dir):
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("number"), F.col("p_name").alias("text"))


def package_content(spark, sf_dir):
    """What quarantine leaves of packages: images, and whether it warns."""
    rows = parse_packages(made_packages(_parts(spark, sf_dir), _with_parts))
    return _number(rows.select("doc_id", "error", F.size("assets").alias("images"), F.exists("warnings", lambda w: w["code"] == "active-content-disabled").alias("warned")))


def _with_formats(number: int, text: str) -> bytes:
    sheet = (
        f'<w:styles xmlns:w="w"><w:style w:type="paragraph" w:styleId="Base"><w:rPr><w:rFonts w:ascii="Font {number}"/><w:i/><w:sz w:val="{number % 90 + 2}"/></w:rPr>'
        f'<w:pPr><w:spacing w:before="{number}" w:after="40"/><w:ind w:left="{number * 20}"/><w:outlineLvl w:val="{number % 12}"/><w:numPr><w:numId w:val="3"/></w:numPr></w:pPr></w:style>'
        f'<w:style w:type="paragraph" w:styleId="Mine" w:default="1"><w:name w:val="Mine"/><w:basedOn w:val="Base"/><w:rPr><w:rFonts w:hAnsi="Other"/><w:b/><w:i w:val="0"/></w:rPr><w:pPr><w:ind w:right="60" w:firstLine="20"/></w:pPr></w:style></w:styles>'
    )
    return package(paragraph(text), {"word/styles.xml": sheet})


def style_formats(spark, sf_dir):
    """All formats of a style, some its own, others inherited."""
    rows = corpus.analyse(parse_packages(made_packages(_parts(spark, sf_dir), _with_formats)))
    return _number(rows.select("doc_id", "style_id", "font_family", "font_size", "bold", "italic", "outline_level", "space_before", "space_after", "indent_left", "indent_right", "indent_first", "numbering", "mapping"))


def rich_sheet(spark, sf_dir):
    """The styles of packages as they state them themselves."""
    rows = relation(_rich(spark, sf_dir, ["styles"]), "styles")
    return _number(rows.groupBy("doc_id").agg(F.count("*").alias("styles"), F.count_if(F.col("kind") == "character").alias("characters"), F.max(F.when(F.col("style_id") == "Kop1", F.concat_ws("|", "name", "based_on", F.col("bold").cast("string")))).alias("kop"), F.count("font_size").alias("sized")))


def rich_usages(spark, sf_dir):
    """Uses of other styles than the default one, in their order."""
    rows = relation(_rich(spark, sf_dir, ["usages"]), "usages").filter("style_id <> 'Normal'")
    return _number(rows.select("doc_id", "position", "style_id", "kind", "text", "nearby"))


#: Paragraphs by level and kind (o: numbered at level 0, d: at all levels, u: bullets, n: without a number, -: no list), and the
#: lists that they make.
LISTS = (
    ("0o 0o 0u", "<ol><li>{p}</li><li>{p}</li></ol><ul><li>{p}</li></ul>"),
    ("0o 1u 2u 0o", "<ol><li>{p}<ul><li>{p}<ul><li>{p}</li></ul></li></ul></li><li>{p}</li></ol>"),
    ("0u - 0u", "<ul><li>{p}</li></ul>{p}<ul><li>{p}</li></ul>"),
    ("1u 0u", "<ul><li><ul><li>{p}</li></ul></li><li>{p}</li></ul>"),
    ("0o 1u 1d 1d 0o 0d", "<ol><li>{p}<ul><li>{p}</li></ul><ol><li>{p}</li><li>{p}</li></ol></li><li>{p}</li><li>{p}</li></ol>"),
    ("0u 0n 2d", "<ul><li>{p}</li></ul>{p}<ul><li><ul><li><ol><li>{p}</li></ol></li></ul></li></ul>"),
    ("0o 1u 1u - 1u", "<ol><li>{p}<ul><li>{p}</li><li>{p}</li></ul></li></ol>{p}<ul><li><ul><li>{p}</li></ul></li></ul>"),
)


def _with_lists(number: int, text: str) -> bytes:
    more = '<w:abstractNum w:abstractNumId="9"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum>'
    more += '<w:abstractNum w:abstractNumId="8">' + "".join(f'<w:lvl w:ilvl="{k}"><w:numFmt w:val="lowerRoman"/></w:lvl>' for k in range(3)) + "</w:abstractNum>"
    numbering = NUMBERING.replace("<w:num ", f'{more}<w:num w:numId="2"><w:abstractNumId w:val="9"/></w:num><w:num w:numId="3"><w:abstractNumId w:val="8"/></w:num><w:num ', 1)
    body, named = "", {k: f'<w:numId w:val="{n}"/>' for k, n in (("o", 1), ("u", 2), ("d", 3))}
    for x in LISTS[number % len(LISTS)][0].split():
        listed = f'<w:pPr><w:numPr><w:ilvl w:val="{x[0]}"/>{named.get(x[1:], "")}</w:numPr></w:pPr>' if x != "-" else ""
        body += f"<w:p>{listed}<w:r><w:t>i{number}</w:t></w:r></w:p>"
    return package(body, {"word/numbering.xml": numbering})


def list_shapes(spark, sf_dir):
    """Lists of several levels and kinds as HTML."""
    made = corpus.convert(parse_packages(made_packages(_parts(spark, sf_dir), _with_lists)), "html", "fragment", DATE)
    return _number(made.select("doc_id", F.regexp_replace(F.decode("data", "UTF-8"), "^.*</h1>|</main>$", "").alias("html")))


#: Runs of paragraphs with fields (b: begin, s: separate, e: end, p: a page reference, c: another code, digits: text), and what is read.
FIELDS = (("1 b p s 2 e 3", "13"), ("b c s 2 e 3", "23"), ("b p s 1 b c s 2 e 3 e 4", "4"), ("b c s 1 b p s 2 e 3 e 4", "1234"), ("1 e b p 2 s 3", "12"), ("b p e 1", "1"))


def _with_fields(number: int, text: str) -> bytes:
    marks = {k: f'<w:fldChar w:fldCharType="{v}"/>' for k, v in (("b", "begin"), ("s", "separate"), ("e", "end"))} | {"p": "<w:instrText> pageref _x \\h</w:instrText>", "c": "<w:instrText>TOC</w:instrText>"}
    runs = "".join(f"<w:r>{marks.get(x) or f'<w:t>{x}</w:t>'}</w:r>" for x in FIELDS[number % len(FIELDS)][0].split())
    return package(f"<w:p>{runs}</w:p><w:p><w:ins><w:r><w:t>in</w:t></w:r></w:ins><w:del><w:r><w:delText>out</w:delText></w:r></w:del><w:smartTag><w:r><w:t>side</w:t></w:r></w:smartTag></w:p>")


def field_results(spark, sf_dir):
    """Texts of paragraphs with fields, nested and open ones too, and with tracked changes."""
    rows = relation(parse_packages(made_packages(_parts(spark, sf_dir), _with_fields)), "blocks")
    return _number(rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda b: b["text"]), "|").alias("texts")))


def _models(spark, sf_dir, model):
    """Documents of one model each, a JSON with the part's number for `#`."""
    text = F.replace(F.lit(model), F.lit("#"), F.col("p_partkey").cast("string"))
    none = F.lit(None)
    return spread(_read(spark, sf_dir, "part").select("p_partkey")).select(
        F.col("p_partkey").cast("string").alias("doc_id"), none.cast("string").alias("error"), text.alias("model"), none.cast("map<string,string>").alias("mapping"), F.lit('{"title":"T"}').alias("metadata"),
        none.cast("array<struct<asset_id:string,media_type:string,filename:string,data:binary>>").alias("assets"), none.cast("array<struct<code:string,severity:string,message:string,ord:long>>").alias("warnings"), F.lit(DATE).alias("modified"),
    )


#: References to what isn't there, and a link that is not safe.
MISSING = (
    '{"blocks":[{"type":"paragraph","children":[{"type":"image","assetId":"a"},{"type":"equation","equationId":"e"},{"type":"noteReference","noteId":"n_1"},'
    '{"type":"link","href":"javascript:x","children":[{"type":"text","text":"l#"}]},{"type":"link","href":" a(b).html ","title":"q\\"","children":[{"type":"text","text":"m"}]}]}],"notes":{},"equations":{}}'
)
#: A block of every other kind.
KINDS = (
    '{"blocks":[{"type":"codeBlock","language":"C #","text":"a ``` <b>\\n"},{"type":"blockquote","blocks":[{"type":"paragraph","children":[{"type":"text","text":"q#"}]},{"type":"paragraph","children":[{"type":"text","text":"r"}]}]},'
    '{"type":"thematicBreak"},{"type":"pageBreak"},{"type":"list","ordered":true,"start":#,"items":[{"blocks":[{"type":"paragraph","children":[{"type":"text","text":"i"}]}]}]},'
    '{"type":"table","caption":[{"type":"text","text":"cap"}],"rows":[{"cells":[{"header":true,"rowSpan":2,"blocks":[{"type":"paragraph","children":[{"type":"text","text":"h|#"}]},{"type":"paragraph","children":[{"type":"text","text":"k"}]}]}]}]},'
    '{"type":"paragraph","children":[{"type":"text","text":"x`y","marks":[{"type":"code"},{"type":"bold"}]},{"type":"lineBreak"},{"type":"softBreak"},{"type":"text","text":"s","marks":[{"type":"subscript"},{"type":"underline"}]}]},'
    '{"type":"heading","level":3,"id":"Own Id","children":[{"type":"text","text":"H#"}]}],"notes":{},"equations":{}}'
)


def _both(rows):
    """(doc_id, markdown, warnings, html) of models, written in one pass."""
    made = R.convert_each(rows, [("markdown", "single"), ("html", "fragment")])
    text = lambda k: F.decode(F.col("outputs")[k]["data"], "UTF-8")
    return made.select("doc_id", text(0).alias("markdown"), F.col("outputs")[0]["warnings"].alias("warnings"), text(1).alias("html"))


def missing_targets(spark, sf_dir):
    """Markdown and HTML of a model whose references lead nowhere, with the writer's warnings."""
    rows = _both(_models(spark, sf_dir, MISSING))
    return _number(rows.select("doc_id", "markdown", F.array_join(F.transform("warnings", lambda w: w["code"]), ",").alias("codes"), "html"))


def block_kinds(spark, sf_dir):
    """Code, quotes, breaks, captions, headers, starts and marks in HTML and Markdown."""
    return _number(_both(_models(spark, sf_dir, KINDS)).select("doc_id", "markdown", "html"))


def formula_modes(spark, sf_dir):
    """An equation in each mode, and one that is missing."""
    omml = F.concat(F.lit('<m:oMath xmlns:m="m"><m:r><m:t>'), F.col("o_orderkey").cast("string"), F.lit("</m:t></m:r></m:oMath>"))
    modes = [E.shown(omml, m).alias(m) for m in ("disabled", "source", "mathml", "katex")]
    return _read(spark, sf_dir, "orders").select("o_orderkey", *modes, E.shown(F.lit(None).cast("string"), "mathml").alias("missing"))


#: SVG images of covers and what is left of them; null if it is no SVG.
COVERS = (
    ('<svg a="#"><script>x</script><rect/></svg>', '<svg a="#"><rect/></svg>'), ('<svg><use href="#"/><g onclick="x" b="#"/></svg>', '<svg><g b="#"/></svg>'), ('<svg><image href="https://x/#"/><a xlink:href="#y"/></svg>', '<svg><image/><a xlink:href="#y"/></svg>'),
    ("<p>#</p>", None), ("<svg><style>a{}</style><image href='data:text/html,#'/></svg>", "<svg><image/></svg>"),
)


def cover_images(spark, sf_dir):
    texts = F.element_at(F.array(*[F.lit(c[0]) for c in COVERS]), (F.col("p_partkey") % len(COVERS) + 1).cast("int"))
    return _read(spark, sf_dir, "part").select("p_partkey", C.cleaned_svg(F.replace(texts, F.lit("#"), F.concat(F.lit("#"), F.col("p_partkey").cast("string")))).alias("svg"))


def output_settings(spark, sf_dir):
    """Mode and extension that settings choose, for all combinations of format and modes."""
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("k") % len(names) + 1).cast("int"))
    rows = _read(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("k"))
    rows = rows.select("p_partkey", pick("html", "markdown", "epub", None).alias("format"), pick("standalone", "zip", None).alias("html_mode"), pick("single", "zip", None, "single", "zip").alias("markdown_mode"))
    settings = O.output_settings(F.col("format"), F.col("html_mode"), F.col("markdown_mode"))
    return rows.select("p_partkey", settings["format"].alias("format"), settings["mode"].alias("mode"), O.output_extension(settings["format"], settings["mode"]).alias("extension"), O.media_type(settings["format"], settings["mode"]).alias("media_type"))


def entity_text(spark, sf_dir):
    """Named and numeric entities, decoded once and leniently: what is none stays."""
    text = F.concat(F.lit("&lt;"), F.col("p_partkey").cast("string"), F.lit("&gt; &amp;lt; &#65;&#x42;&#X43; &quot;&apos; &nope; &#xD83D; & "), "p_name")
    return _read(spark, sf_dir, "part").select("p_partkey", T.decode_entities(text).alias("text"))


def _place(spark, name: str) -> str:
    """A folder of its own in the shared folder, in a temporary one where no cluster needs it; it goes when the driver ends."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='vellum-')}"
    folder = f"{top.rstrip('/')}/vellum-{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(at)
    store.deleteOnExit(at)
    return folder


def _written(rows, folder: str):
    """Packages as files of their own below a folder."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(at, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{at}/{name}", compression=None) as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows.select("name", "content").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def _supplier_files(spark, sf_dir, name: str) -> str:
    """A folder whose `in` holds a rich package of each supplier and a file that is none of each nation."""
    folder = _place(spark, name)
    made = rich_packages(_read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.col("s_name").alias("text")))
    files = made.select(F.concat("doc_id", F.lit(".docx")).alias("name"), "content")
    broken = _read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".DOCX")).alias("name"), F.encode("n_name", "UTF-8").alias("content"))
    _written(files.unionByName(broken), f"{folder}/in")
    return folder


def files_at_once(files: int) -> int:
    """Files of a batch where so many have come. Each batch lists the folder anew and has its fixed cost, so more files make larger
    batches, which are dealt to more tasks, and not more of them."""
    return max(40, -(-files // 8))


def stream_files(spark, sf_dir):
    """Packages that arrive as files, read as a stream in several batches, written by batch; then what all batches hold."""
    from vellum.streaming.ingest import sink, stream_packages

    folder = _supplier_files(spark, sf_dir, "stream")

    def write(batch, number: int) -> None:
        batch.select("path", "error", F.size("blocks").alias("blocks")).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    files = _read(spark, sf_dir, "supplier").count() + _read(spark, sf_dir, "nation").count()
    sink(stream_packages(spark, f"{folder}/in", files_at_once(files)), write, f"{folder}/state").awaitTermination()
    found = spark.read.parquet(f"{folder}/out")
    return found.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "error", "blocks")


def job_messages(spark, sf_dir):
    """Requests to analyse and to convert a folder of packages, one that fails and one that is cancelled: all that is said of them."""
    from .jobs import Runtime

    folder, said = _supplier_files(spark, sf_dir, "jobs"), []
    runtime = Runtime(spark, said.append)
    requests = [
        {"type": "analyse", "operation": "a", "path": f"{folder}/in", "table": f"{folder}/table"}, {"type": "convert", "operation": "b", "table": f"{folder}/table", "output": f"{folder}/out", "format": "markdown", "mode": "zip", "date": DATE},
        {"type": "convert", "operation": "c", "table": f"{folder}/none", "output": f"{folder}/no", "format": "html", "date": DATE}, {"type": "analyse", "operation": "d", "path": f"{folder}/in", "table": f"{folder}/again"},
    ]
    for request in requests:
        if request["operation"] == "d":
            runtime.send = lambda m: said.append(m) or (m["type"] == "progress" and runtime.handle({"type": "cancel", "operation": "d"}))
        runtime.handle(request)
        runtime.wait(request["operation"])
    rows = [(k, m["operation"], m["type"], m.get("phase") or m.get("code") or m.get("media_type"), m.get("packages"), m.get("refused")) for k, m in enumerate(said)]
    return spark.createDataFrame(rows, "ord long, operation string, type string, about string, packages long, refused long")


QUERIES = {
    f.__name__: f
    for f in (
        package_content, style_formats, rich_sheet, rich_usages, list_shapes, field_results, missing_targets, block_kinds, formula_modes, cover_images, output_settings, entity_text,
        stream_files, job_messages,
    )
}

_pick = lambda values, of="p_partkey": "[" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, (bool, int)) else "'" + v.replace("'", "''") + "'" for v in values) + f"][{of} % {len(values)} + 1]"
_KIND_HTML = (
    '<main><h1 class="document-title">T</h1><div class="table-of-contents"><h2>Contents</h2><ol><li><a href="#own-id">H#</a></li></ol></div><pre><code class="language-c-#">a ``` &lt;b&gt;\n</code></pre><blockquote><p>q#</p><p>r</p></blockquote><hr><div class="page-break" aria-hidden="true"></div>'
    '<ol start="#"><li><p>i</p></li></ol><table><caption>cap</caption><tbody><tr><th rowspan="2"><p>h|#</p><p>k</p></th></tr></tbody></table><p><strong><code>x`y</code></strong><br>\n<u><sub>s</sub></u></p><h3 id="own-id">H#</h3></main>'
)
_KIND_MARKDOWN = "# T\n\n````c-#\na ``` <b>\n````\n\n> q#\n>\n> r\n\n---\n\n<!-- page break -->\n\n#. i\n\n*cap*\n\n| h\\|#<br>k |\n| --- |\n\n**`` x`y ``**  \n\n<u><sub>s</sub></u>\n\n### H#\n"
_GONE_HTML = '<main><h1 class="document-title">T</h1><p><span class="equation" role="math"><span class="formula-error" role="math">Equation unavailable</span></span><sup id="note-ref-n-1"><a href="#note-n-1" role="doc-noteref">[1]</a></sup>l#m</p></main>'
_GONE_MARKDOWN = '# T\n\n[Equation unavailable][^n-1]l#[m](a\\(b\\).html "q\\"")\n'


def _filled(text: str) -> str:
    """A text with the part's number where JSON had it; other signs of that kind are kept apart by a control character."""
    kept = text.replace('href="#', 'href="\x01').replace("# T", "\x01 T").replace("### H", "\x01\x01\x01 H").replace("'", "''")
    return "replace(replace('" + kept.replace("\n", "' || chr(10) || '") + "', '#', p_partkey::VARCHAR), chr(1), '#')"


SQL = {
    "package_content": f"SELECT p_partkey AS doc_id, NULL::VARCHAR AS error, {_pick([p[1] for p in PARTS])}::INT AS images, {_pick([p[2] for p in PARTS])} AS warned FROM part",
    "style_formats": """SELECT p_partkey AS doc_id, 'Mine' AS style_id, 'Other' AS font_family, (p_partkey % 90 + 2) / 2::DOUBLE AS font_size, true AS bold, false AS italic, (p_partkey % 12)::INT AS outline_level, p_partkey / 20::DOUBLE AS space_before, 2.0::DOUBLE AS space_after,
      p_partkey::DOUBLE AS indent_left, 3.0::DOUBLE AS indent_right, 1.0::DOUBLE AS indent_first, '3:0' AS numbering, CASE WHEN p_partkey % 12 <= 5 THEN 'heading' || (p_partkey % 12 + 1) WHEN p_partkey % 90 >= 62 THEN 'title' WHEN p_partkey > 0 THEN 'heading1' ELSE 'body' END AS mapping FROM part""",
    "rich_sheet": "SELECT doc_id, 8::BIGINT AS styles, 2::BIGINT AS characters, 'Kop 1|Normal|true' AS kop, 1::BIGINT AS sized FROM documents",
    "rich_usages": """WITH u AS (SELECT doc_id, unnest([{'p': 0, 's': 'Title', 'k': 'paragraph', 't': 'Styled ' || doc_id, 'n': NULL}, {'p': 1, 's': 'Kop1', 'k': 'paragraph', 't': 'Report ' || doc_id, 'n': NULL}, {'p': 3, 's': 'Strong', 'k': 'character', 't': 'st', 'n': NULL},
        {'p': 10, 's': 'Same', 'k': 'paragraph', 't': 'Beside ' || doc_id || ' run', 'n': 'table'}, {'p': 11, 's': 'Same', 'k': 'character', 't': 'run', 'n': NULL}, {'p': 12, 's': 'Level', 'k': 'paragraph', 't': 'Below', 'n': NULL}]) AS u FROM documents)
      SELECT doc_id, u.p - 1 + doc_id % 2 AS position, u.s AS style_id, u.k AS kind, u.t AS text, u.n AS nearby FROM u WHERE doc_id % 2 = 1 OR u.s <> 'Title'""",
    "list_shapes": f"SELECT p_partkey AS doc_id, replace({_pick([x[1] for x in LISTS])}, '{{p}}', '<p>i' || p_partkey || '</p>') AS html FROM part",
    "field_results": f"SELECT p_partkey AS doc_id, {_pick([x[1] for x in FIELDS])} || '|inside' AS texts FROM part",
    "missing_targets": f"SELECT p_partkey AS doc_id, {_filled(_GONE_MARKDOWN)} AS markdown, 'markdown-missing-asset,markdown-missing-equation,markdown-unsafe-link,markdown-missing-note' AS codes, {_filled(_GONE_HTML)} AS html FROM part",
    "block_kinds": f"SELECT p_partkey AS doc_id, {_filled(_KIND_MARKDOWN)} AS markdown, {_filled(_KIND_HTML)} AS html FROM part",
    "formula_modes": """WITH m AS (SELECT o_orderkey, '<span class="formula-mathml" role="math" aria-label="' || o_orderkey || '"><math xmlns="http://www.w3.org/1998/Math/MathML"><mn>' || o_orderkey || '</mn></math></span>' AS mathml FROM orders)
      SELECT o_orderkey, '' AS disabled, '<span class="formula-source" role="math" aria-label="' || o_orderkey || '">' || o_orderkey || '</span>' AS source, mathml, mathml AS katex, '<span class="formula-error" role="math">Equation unavailable</span>' AS missing FROM m""",
    "cover_images": f"SELECT p_partkey, replace({_pick([c[1] for c in COVERS])}, '#', '#' || p_partkey) AS svg FROM part",
    "output_settings": """WITH s AS (SELECT p_partkey, coalesce(['html', 'markdown', 'epub', NULL][p_partkey % 4 + 1], 'html') AS format, coalesce(['standalone', 'zip', NULL][p_partkey % 3 + 1], 'standalone') AS h, coalesce(['single', 'zip', NULL, 'single', 'zip'][p_partkey % 5 + 1], 'single') AS m FROM part),
      t AS (SELECT p_partkey, format, CASE format WHEN 'html' THEN h WHEN 'markdown' THEN m ELSE 'epub' END AS mode FROM s)
      SELECT *, CASE WHEN format = 'epub' THEN '.epub' WHEN mode = 'zip' THEN '.zip' WHEN format = 'html' THEN '.html' ELSE '.md' END AS extension,
        CASE WHEN mode = 'zip' THEN 'application/zip' WHEN format = 'epub' THEN 'application/epub+zip' WHEN format = 'html' THEN 'text/html;charset=utf-8' ELSE 'text/markdown;charset=utf-8' END AS media_type FROM t""",
    "entity_text": """SELECT p_partkey, '<' || p_partkey || '> &lt; ABC "'' &nope; &#xD83D; & ' || p_name AS text FROM part""",
    "stream_files": """SELECT s_suppkey || '.docx' AS name, NULL::VARCHAR AS error, (19 + s_suppkey % 2)::INT AS blocks FROM supplier UNION ALL SELECT 'n' || n_nationkey || '.DOCX', 'unsupported-format', 0 FROM nation""",
    "job_messages": """SELECT i - 1 AS ord, ['a', 'a', 'a', 'b', 'b', 'c', 'c', 'd', 'd'][i] AS operation, ['progress', 'progress', 'analysed', 'progress', 'output', 'progress', 'error', 'progress', 'error'][i] AS type,
      ['inspect', 'read', NULL, 'write', 'application/zip', 'write', 'conversion-failed', 'inspect', 'cancelled'][i] AS about, CASE WHEN i = 3 THEN (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) END AS packages, CASE WHEN i = 3 THEN (SELECT count(*) FROM nation) END AS refused FROM range(1, 10) AS r(i)""",
}
