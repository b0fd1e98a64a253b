"""DOCX packages as DataFrames: one row a package, with its relations as arrays and its block tree as JSON.

A bad package is a row with an error code; it never fails the job. Reading is Python inside one Arrow pass, as nothing in
Spark unpacks zip files or keeps mixed XML content in order; all that follows is relational.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Collection, Iterator
from dataclasses import asdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.batches import batches_of, rows_of, small_batches
from vellum.functions.formula import convert

from .package import MAGIC, SHARED, Limits, PackageError, open_package
from .xml import Element

# Media types of images by extension.
IMAGES = {"gif": "image/gif", "jpeg": "image/jpeg", "jpg": "image/jpeg", "png": "image/png", "svg": "image/svg+xml", "webp": "image/webp"}
CUSTOM_FIELDS = {"version": "version", "publicationdate": "publicationDate", "publisher": "publisher", "rights": "rights", "identifier": "identifier", "subtitle": "subtitle", "description": "description", "language": "language"}
MARKS = (("b", "bold"), ("i", "italic"), ("u", "underline"))
FIGURES = {"drawing", "pict", "object"}
UNSEEN = {"del", "instrText", "pPr", "rPr"}
FALSE = {"0", "false", "off", "none"}

_FORMATS = "font_family:string,font_size:double,bold:boolean,italic:boolean,outline_level:int,space_before:double,space_after:double,indent_left:double,indent_right:double,indent_first:double,numbering:string"
_STYLE = f"struct<style_id:string,name:string,kind:string,based_on:string,{_FORMATS}>"
_USAGE = "struct<style_id:string,kind:string,text:string,position:long,bold:boolean,space_before:double,numbered:boolean,nearby:string,font_size:double>"
_CANDIDATE = "struct<field:string,value:string,source:string,priority:int,confidence:string,method:string,ord:long>"
_WARNING = "struct<code:string,severity:string,message:string,ord:long>"
_ASSET = "struct<asset_id:string,media_type:string,filename:string,data:binary>"
_BLOCK = "struct<root:string,path:string,depth:int,type:string,level:int,style_id:string,text:string>"
_READ = {"model": "string"} | {f"{r}s": f"array<{t}>" for r, t in (("style", _STYLE), ("usage", _USAGE), ("candidate", _CANDIDATE), ("warning", _WARNING), ("asset", _ASSET), ("block", _BLOCK))}
RELATIONS = tuple(r for r in _READ if r != "model")


def schema_of(only: Collection[str] | None = None) -> str:
    """Columns of packages with those of the model and RELATIONS that are wanted."""
    return "doc_id string, path string, error string, message string" + "".join(f", {c} {t}" for c, t in _READ.items() if only is None or c in only)


SCHEMA = schema_of()
#: Where relations hold what may be long.
TEXTS = (("usages", "text"), ("candidates", "value"), ("assets", "data"), ("blocks", "text"))


def _on(properties: Element | None, name: str, literal: bool = False) -> bool:
    """Whether a switch is there and not switched off; if `literal`, whether it is there."""
    found = properties.first(name) if properties is not None else None
    return found is not None and (literal or (found.get("val") or "1").lower() not in FALSE)


def _number(node: Element | None, name: str, per: float) -> float | None:
    value = node.get(name) if node is not None else None
    try:
        return float(value) / per if value is not None else None
    except ValueError:
        return None


def formats(node: Element, literal: bool = False) -> dict:
    """The formats that a style, a paragraph or a run states itself; sizes and distances in points."""
    run, par = node.first("rPr"), node.first("pPr")
    of = lambda parent, tag: parent.first(tag) if parent is not None else None
    fonts, spacing, indent, numbers = of(run, "rFonts"), of(par, "spacing"), of(par, "ind"), of(par, "numPr")
    level = _number(of(par, "outlineLvl"), "val", 1)
    number = lambda tag, default: (of(numbers, tag).get("val") if of(numbers, tag) is not None else None) or default
    return {
        "font_family": (fonts.get("ascii") or fonts.get("hAnsi")) if fonts is not None else None,
        "font_size": _number(of(run, "sz"), "val", 2),
        "bold": _on(run, "b", literal) if of(run, "b") is not None else None,
        "italic": _on(run, "i", literal) if of(run, "i") is not None else None,
        "outline_level": int(level) if level is not None else None,
        "space_before": _number(spacing, "before", 20),
        "space_after": _number(spacing, "after", 20),
        "indent_left": _number(indent, "left", 20),
        "indent_right": _number(indent, "right", 20),
        "indent_first": _number(indent, "firstLine", 20),
        "numbering": f"{number('numId', '')}:{number('ilvl', '0')}" if numbers is not None else None,
    }


def _use_formats(node: Element, literal: bool) -> tuple[bool | None, float | None, float | None]:
    """Of formats(), what a use needs: bold, space before and font size."""
    run, par = node.first("rPr"), node.first("pPr")
    if par is not None and par.first("outlineLvl") is not None:
        own = formats(node, literal)
        return own["bold"], own["space_before"], own["font_size"]
    bold = _on(run, "b", literal) if run is not None and run.first("b") is not None else None
    return bold, _number(par.first("spacing"), "before", 20) if par is not None else None, _number(run.first("sz"), "val", 2) if run is not None else None


@lru_cache(8)
def _sheet(root: Element | None, literal: bool) -> tuple[list[dict], str | None]:
    """The styles of a sheet, and which is the default one. Packages of one template share the tree."""
    out, default = [], None
    for s in root.elements("style") if root is not None else ():
        if s.get("type") not in ("paragraph", "character") or not s.get("styleId"):
            continue
        named = lambda tag: s.first(tag).get("val") if s.first(tag) is not None else None  # noqa: E731, B023
        row = {"style_id": s.get("styleId"), "name": named("name"), "kind": s.get("type"), "based_on": named("basedOn"), **formats(s, literal)}
        if s.get("type") == "paragraph" and s.get("default") == "1" and default is None:
            default = row["style_id"]
        out.append(row)
    return out, default


class _Reader:
    def __init__(self, data: bytes, limits: Limits, filename: str, literal: bool = False):
        self.limits, self.filename, self.literal = limits, filename, literal
        self.package = open_package(data, limits)
        self.warnings: list[dict] = []
        self.assets: list[dict] = []
        self.equations: dict[str, dict] = {}
        self.relations = self._relations()
        if self.package.quarantined:
            self._warn("active-content-disabled", "warning", "Active content was left out.")
        self.ordered = self._numbering()

    def _warn(self, code: str, severity: str, message: str) -> None:
        self.warnings.append({"code": code, "severity": severity, "message": message, "ord": len(self.warnings)})

    def _relations(self) -> dict[str, dict]:
        root, found = self.package.xml("word/_rels/document.xml.rels"), {}
        for r in root.elements("Relationship") if root is not None else ():
            if r.get("Id") and r.get("Target") is not None:
                found[r.get("Id")] = {"target": r.get("Target"), "type": r.get("Type") or "", "external": r.get("TargetMode") == "External"}
        if any(r["external"] and r["type"].endswith("/image") for r in found.values()):
            raise PackageError("unsupported-format", "Linked images are not loaded.")
        return found

    def _numbering(self) -> dict[tuple[str, str], bool]:
        root = self.package.xml("word/numbering.xml")
        if root is None:
            return {}
        levels = {
            (a.get("abstractNumId"), lvl.get("ilvl")): (lvl.first("numFmt").get("val") if lvl.first("numFmt") is not None else "decimal") != "bullet"
            for a in root.elements("abstractNum")
            for lvl in a.elements("lvl")
        }
        found = {}
        for n in root.elements("num"):
            abstract = n.first("abstractNumId").get("val") if n.first("abstractNumId") is not None else None
            found |= {(n.get("numId"), k[1]): v for k, v in levels.items() if k[0] == abstract}
        return found

    # styles and their use

    def styles(self) -> list[dict]:
        part = "word/styles.xml"
        sheet = _sheet if len(self.package.parts.get(part) or b"") <= SHARED else _sheet.__wrapped__
        rows, self.default_style = sheet(self.package.xml(part), self.literal)
        return [dict(r) for r in rows]

    def usages(self, body: Element) -> list[dict]:
        """Each paragraph's style with its text, and each run's; deleted text and field codes are no text."""
        kinds = []
        for c in body.elements():
            kinds.append("table" if c.local == "tbl" else "figure" if c.holds(FIGURES) else None)
        near = {}
        for i, c in enumerate(body.elements()):
            if c.local == "p":
                near[id(c)] = (kinds[i - 1] if i else None) or (kinds[i + 1] if i + 1 < len(kinds) else None)
        out: list[dict] = []

        def add(node: Element, style: str, kind: str, numbered: bool, nearby: str | None) -> None:
            (bold, before, size), text = _use_formats(node, self.literal), node.text() if self.literal else _visible(node)
            out.append({"style_id": style, "kind": kind, "text": text.strip(), "position": len(out), "bold": bold, "space_before": before, "numbered": numbered, "nearby": nearby, "font_size": size})

        for p in body.descendants("p"):
            par = p.first("pPr")
            style = par.first("pStyle").get("val") if par is not None and par.first("pStyle") is not None else self.default_style
            if style:
                add(p, style, "paragraph", par is not None and par.first("numPr") is not None, near.get(id(p)))
            for r in p.descendants("r"):
                own = r.first("rPr")
                named = own.first("rStyle") if own is not None and own.children else None
                if named is not None and named.get("val"):
                    add(r, named.get("val"), "character", False, None)
        return out

    # blocks

    def inlines(self, parent: Element) -> list[dict]:
        """What a paragraph, a link or an insertion holds. Of a field, its result is read; of a page reference not even that.

        Only fields at the top count: what stands in a field within the result of another is part of that result.
        """
        out: list[dict] = []
        depth, page_ref, skipped = 0, False, False
        for c in parent.elements():
            if c.local == "r":
                for e in c.elements():
                    if e.local not in ("fldChar", "instrText"):
                        continue
                    kind = e.get("fldCharType") if e.local == "fldChar" else None
                    if kind == "begin":
                        depth += 1
                    elif kind == "end":
                        depth = max(0, depth - 1)
                    if kind in ("begin", "end") and depth == (kind == "begin"):
                        page_ref = skipped = False
                    elif kind == "separate" and depth == 1:
                        skipped = page_ref
                    elif e.local == "instrText" and depth == 1:
                        page_ref = page_ref or re.search(r"\bPAGEREF\b", e.text(), re.IGNORECASE) is not None
                if not skipped:
                    out += self._run(c)
            elif c.local == "hyperlink":
                out += self._link(c)
            elif c.local in ("ins", "smartTag", "sdt") or c.local == "sdtContent" and not self.literal:
                out += self.inlines(c)
            elif c.local == "del":
                self._warn("tracked-deletion-omitted", "info", "A tracked deletion was left out.")
            elif c.local in ("oMath", "oMathPara"):
                out.append({"type": "equation", "equationId": self._equation(c), "display": c.local == "oMathPara"})
        return out

    def _equation(self, node: Element) -> str:
        name = f"equation-{len(self.equations) + 1}"
        source = node.serialise()
        made = convert(source)
        self.equations[name] = {"id": name, "source": {"format": "omml", "value": source}, "tex": made["tex"], "mathml": made["mathml"], "conversionComplete": made["complete"]}
        if not made["complete"]:
            self._warn("formula-conversion-incomplete", "warning", "Part of a formula could not be converted.")
        return name

    def _marks(self, properties: Element | None) -> list[dict]:
        if properties is None:
            return []
        marks = [{"type": kind} for name, kind in MARKS if _on(properties, name, self.literal)]
        if _on(properties, "strike", self.literal) or _on(properties, "dstrike", self.literal):
            marks.append({"type": "strikethrough"})
        place = properties.first("vertAlign").get("val") if properties is not None and properties.first("vertAlign") is not None else None
        if place in ("subscript", "superscript"):
            marks.append({"type": place})
        style = properties.first("rStyle") if properties is not None else None
        if style is not None and style.get("val"):
            marks.append({"type": "style", "styleId": style.get("val")})
        return marks

    def _run(self, run: Element) -> list[dict]:
        marks, out = self._marks(run.first("rPr")), []
        text = lambda value: {"type": "text", "text": value, **({"marks": marks} if marks else {})}
        for c in run.elements():
            if c.local in ("t", "delText"):
                if value := c.text():
                    out.append(text(value))
            elif c.local == "tab":
                out.append(text("\t"))
            elif c.local == "br":
                out.append({"type": "softBreak" if c.get("type") == "page" else "lineBreak"})
            elif c.local in ("footnoteReference", "endnoteReference"):
                out.append({"type": "noteReference", "noteId": f"{c.local.removesuffix('Reference')}-{c.get('id')}"})
            elif c.local in ("drawing", "pict"):
                described = next(c.descendants("docPr"), None)
                alt = described.get("descr") if described is not None else None
                for blip in c.descendants("blip"):
                    if (asset := self._asset(blip.get("embed") or blip.get("link"))) is not None:
                        out.append({"type": "image", "assetId": asset, **({"alt": alt} if alt else {})})
        return out

    def _link(self, node: Element) -> list[dict]:
        children, relation = self.inlines(node), self.relations.get(node.get("id") or "")
        if relation is None or not relation["external"]:
            return children
        if relation["target"].partition(":")[0].lower() not in ("http", "https", "mailto"):
            raise PackageError("unsupported-format", "A link has an unsafe target.")
        return [{"type": "link", "href": relation["target"], "children": children}]

    def _asset(self, relation_id: str | None) -> str | None:
        relation = self.relations.get(relation_id or "")
        if relation is None:
            return None
        target = relation["target"]
        name = target[1:] if target.startswith("/") else posixpath.normpath(posixpath.join("word", target))
        data = self.package.parts.get(name)
        if data is None:
            return None
        if len(data) > self.limits.image:
            raise PackageError("resource-limit", "An image is too large.")
        media = IMAGES.get(name.rpartition(".")[2].lower())
        if media is None:
            raise PackageError("unsupported-format", "An image is of an unsupported type.")
        asset = f"asset-{len(self.assets) + 1}"
        self.assets.append({"asset_id": asset, "media_type": media, "filename": posixpath.basename(name), "data": data})
        return asset

    def blocks(self, parent: Element) -> list[dict]:
        out: list[dict] = []
        for c in parent.elements():
            if c.local == "sdt":
                content = c.first("sdtContent") if not self.literal else None
                out += self.blocks(content if content is not None else c)
            elif c.local == "tbl":
                rows = [{"cells": [self._cell(t) for t in r.elements("tc")]} for r in c.elements("tr")]
                out.append({"type": "table", "rows": rows})
            elif c.local == "p":
                block, number = self._paragraph(c), c.at("pPr", "numPr")
                named = lambda tag: number.first(tag).get("val") if number is not None and number.first(tag) is not None else None  # noqa: B023, E731
                if named("numId"):
                    level = int(named("ilvl")) if (named("ilvl") or "").isdigit() else 0
                    _listed(out, block, self.ordered.get((named("numId"), str(level)), False), level)
                else:
                    out.append(block)
        return out

    def _cell(self, cell: Element) -> dict:
        span = cell.at("tcPr", "gridSpan")
        value = span.get("val") if span is not None else None
        return {"blocks": self.blocks(cell), **({"colSpan": int(value)} if value and value.isdigit() else {})}

    def _paragraph(self, p: Element) -> dict:
        children = self.inlines(p)
        if len(children) == 1 and children[0]["type"] == "equation" and children[0]["display"]:
            return {"type": "equationBlock", "equationId": children[0]["equationId"]}
        style = p.at("pPr", "pStyle")
        return {"type": "paragraph", "children": children, **({"styleId": style.get("val")} if style is not None and style.get("val") else {})}

    def notes(self) -> dict[str, dict]:
        found = {}
        for kind in ("footnote", "endnote"):
            root = self.package.xml(f"word/{kind}s.xml")
            for n in root.elements(kind) if root is not None else ():
                value = n.get("id")
                if value is not None and value.lstrip("-").isdigit() and int(value) >= 0:
                    found[f"{kind}-{value}"] = {"id": f"{kind}-{value}", "kind": kind, "blocks": self.blocks(n)}
        return found

    # metadata

    def candidates(self, usages: list[dict]) -> list[dict]:
        out: list[dict] = []

        def add(field: str, value: str | None, source: str, priority: int, confidence: str = "certain", method: str = "extracted") -> None:
            if value and value.strip():
                out.append({"field": field, "value": value.strip(), "source": source, "priority": priority, "confidence": confidence, "method": method, "ord": len(out)})

        def said(part: str, local: str) -> str | None:
            root = self.package.xml(part)
            found = next(root.descendants(local), None) if root is not None else None
            return found.text().strip() if found is not None else None

        core = "docProps/core.xml"
        add("title", said(core, "title"), core, 1)
        for name in (said(core, "creator") or "").replace("\n", ";").split(";"):
            add("authors", name, core, 1)
        add("language", _language(said(core, "language")), core, 1)
        add("description", said(core, "description"), core, 1)
        add("subjects", said(core, "subject"), core, 1)
        add("subjects", said(core, "keywords"), core, 1)
        add("sourceCreatedAt", said(core, "created"), core, 1)
        add("sourceModifiedAt", said(core, "modified"), core, 1)
        add("publisher", said("docProps/app.xml", "Company"), "docProps/app.xml", 2)
        custom = self.package.xml("docProps/custom.xml")
        for p in custom.elements("property") if custom is not None else ():
            field = CUSTOM_FIELDS.get("".join(c for c in (p.get("name") or "").lower() if "a" <= c <= "z"))
            if field:
                add(field, p.text(), f"docProps/custom.xml:{p.get('name')}", 3)
        for u in usages:
            named = u["style_id"].lower()
            if named in ("title", "subtitle"):
                add(named, u["text"], f"{named.capitalize()} style", 4)
            elif named == "author":
                add("authors", u["text"], "Author style", 4, "high", "inferred")
        add("title", next((u["text"] for u in usages if u["kind"] == "paragraph" and u["text"]), None), "first-page structure", 5, "low", "inferred")
        base = posixpath.basename(self.filename.replace("\\", "/"))
        base = base[: -len(".docx")] if base.lower().endswith(".docx") else base
        add("title", base, "filename", 7, "low", "inferred")
        if base.strip():
            slug = re.sub("^-|-$", "", re.sub("[^a-z0-9]+", "-", base.strip().lower()))
            add("identifier", f"urn:vellum:{slug or 'document'}", "filename", 7, "low", "inferred")
        return out

    def read(self, only: Collection[str] | None = None) -> dict:
        """The package's model and relations. All of it is read, whatever is wanted, as an error may be anywhere."""
        document = self.package.xml("word/document.xml")
        body = document.first("body") if document is not None else None
        if body is None:
            raise PackageError("invalid-input", "The document has no body.")
        names = self.package.parts
        if any(n.startswith(("word/header", "word/footer")) and n.endswith(".xml") for n in names):
            self._warn("decorative-furniture-omitted", "info", "Headers and footers were left out.")
        if self.package.xml("word/comments.xml") is not None:
            self._warn("comments-omitted", "info", "Comments were left out.")
        styles = self.styles()
        usages = self.usages(body)
        blocks = self.blocks(body)
        notes = self.notes()
        found = {
            "model": lambda: json.dumps({"blocks": blocks, "notes": notes, "equations": self.equations}, ensure_ascii=False),
            "styles": lambda: styles,
            "usages": lambda: usages,
            "candidates": lambda: candidates,
            "warnings": lambda: self.warnings,
            "assets": lambda: self.assets,
            "blocks": lambda: [*flatten("body", blocks), *(r for k, n in notes.items() for r in flatten(f"note:{k}", n["blocks"]))],
        }
        candidates = self.candidates(usages)
        return {name: made() for name, made in found.items() if only is None or name in only}


def _listed(blocks: list[dict], block: dict, ordered: bool, level: int) -> None:
    """Put a list paragraph of some level at the end of blocks. It goes on with a list that ends them, unless that is its own
    level's and of the other kind; deeper ones go into the last item. A list around deeper ones is unordered."""
    last = blocks[-1] if blocks and blocks[-1]["type"] == "list" else None
    if last is None or level == 0 and last["ordered"] != ordered:
        last = {"type": "list", "ordered": ordered and level == 0, "items": []}
        blocks.append(last)
    if level == 0:
        last["items"].append({"blocks": [block]})
        return
    if not last["items"]:
        last["items"].append({"blocks": []})
    _listed(last["items"][-1]["blocks"], block, ordered, level - 1)


def _language(value: str | None) -> str | None:
    from vellum.functions.text import LCIDS

    return LCIDS.get(int(value), value) if value and value.isdigit() and 3 <= len(value) <= 5 else value


def _visible(node: Element) -> str:
    children = node.children
    if len(children) == 1 and children[0].__class__ is str:
        return children[0]
    return "".join([c if c.__class__ is str else _visible(c) for c in children if c.__class__ is str or c.children and c.local not in UNSEEN])


def inline_text(nodes: list[dict]) -> str:
    return "".join([n["text"] if n["type"] == "text" else inline_text(n["children"]) if n["type"] == "link" else "" for n in nodes])


def flatten(root: str, blocks: list[dict], above: str = "", depth: int = 0) -> Iterator[dict]:
    """Blocks in document order with paths that sort as the document does."""
    for i, b in enumerate(blocks):
        path = f"{above}{i:08d}"
        text = inline_text(b.get("children", [])) if "children" in b else b.get("text")
        yield {"root": root, "path": path, "depth": depth, "type": b["type"], "level": b.get("level"), "style_id": b.get("styleId"), "text": text}
        inner = [x["blocks"] for x in b.get("items", [])] + [c["blocks"] for r in b.get("rows", []) for c in r["cells"]] + ([b["blocks"]] if "blocks" in b else [])
        for k, part in enumerate(inner):
            yield from flatten(root, part, f"{path}.{k:08d}.", depth + 1)


def read_package(data: bytes, filename: str, limits: Limits = Limits(), literal: bool = False, only: Collection[str] | None = None) -> dict:
    """All relations of one package, or those in `only`; `error` and `message` where it can't be read.

    `literal` takes packages as simple readers do: a switch is on wherever it stands, even with a value that says off; content
    controls are not entered; the text of a style's use holds deleted text and field codes too.
    """
    nothing = {r: None if r == "model" else [] for r in _READ if only is None or r in only}
    try:
        return {"error": None, "message": None, **_Reader(data, limits, filename, literal).read(only)}
    except PackageError as e:
        return {"error": e.code, "message": str(e), **nothing}
    except Exception as e:  # noqa: BLE001  a document must not fail the job, and its content must not be in the message
        return {"error": "conversion-failed", "message": type(e).__name__, **nothing}


def read_docx(spark: SparkSession, path: str, limits: Limits = Limits(), literal: bool = False, only: Collection[str] | None = None) -> DataFrame:
    """Packages below a path, one row each (SCHEMA). Files of other names are not read. `literal`: see read_package(); `only`: see
    parse_packages()."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][oO][cC][xX]").option("recursiveFileLookup", "true").load(path)
    return parse_packages(files.select(F.col("path").alias("doc_id"), "path", "content"), limits, literal, only)


def parse_packages(files: DataFrame, limits: Limits = Limits(), literal: bool = False, only: Collection[str] | None = None) -> DataFrame:
    """The same for a table (doc_id, path, content). `only` names the columns of the model and RELATIONS that are wanted; the
    others are not there, and neither leave Python nor are kept in memory. Of content without the magic number, which is refused anyway, and of content
    that is too large, only as much goes to Python as shows it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    columns = schema_of(only)
    schema = to_arrow_schema(_parse_datatype_string(columns))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[dict, int]]:
            for row in rows_of(batches):
                made = read_package(row["content"] or b"", row["path"] or "", own, literal, only)
                texts = sum([len(r[field] or "") for name, field in TEXTS for r in made.get(name, ())])
                yield {"doc_id": row["doc_id"], "path": row["path"], **made}, len(made.get("model") or "") + texts

        own = Limits(**asdict(limits))
        yield from batches_of(found(), schema)

    content = F.col("content")
    content = F.when(F.substring(content, 1, 4) != F.lit(MAGIC), F.substring(content, 1, 4)).when(F.octet_length(content) > limits.compressed, F.substring(content, 1, limits.compressed + 1)).otherwise(content)
    return small_batches(files).select("doc_id", "path", content.alias("content")).mapInArrow(read, columns)


def relation(packages: DataFrame, name: str) -> DataFrame:
    """One of RELATIONS as rows (doc_id, ..)."""
    return packages.select("doc_id", F.explode(name).alias("r")).select("doc_id", "r.*")


def errors(packages: DataFrame) -> DataFrame:
    return packages.filter("error IS NOT NULL").select("doc_id", "error", "message")
