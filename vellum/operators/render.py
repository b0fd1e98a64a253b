"""Rendering of block trees to HTML, Markdown and EPUB 3, and the Spark operators that do it for a corpus.

A document's tree is one JSON value, so each document is rendered alone in one Arrow pass, without a shuffle.
"""

from __future__ import annotations

import base64
import io
import json
import re
import unicodedata
import zipfile
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.batches import batches_of, rows_of, small_batches
from vellum.functions.cover import cover_svg as draw_cover
from vellum.functions.formula import render as render_formula
from vellum.functions.text import EPUB_HREF, FONT_TYPES, HTML_HREF, IMAGE_TYPES, LANGUAGE_TAG, MARKDOWN_HREF, escape_html
from vellum.sources.archive import zip_of

GENERATOR = "vellum"
STYLES = (
    "body{font:1rem/1.5 Georgia,serif;color:#1b1b1b;background:#fff}main{max-width:42rem;margin:2rem auto;padding:0 1rem}"
    "table{border-collapse:collapse}th,td{border:1px solid #999;padding:.3rem .6rem}blockquote{border-left:3px solid #bbb;margin-left:0;padding-left:1rem}"
    "pre{overflow:auto;background:#f4f4f4;padding:.8rem}img{max-width:100%}.page-break{break-after:page}.equation{overflow-x:auto}"
)
MARK_TAGS = {"bold": "strong", "italic": "em", "underline": "u", "strikethrough": "s", "subscript": "sub", "superscript": "sup", "code": "code"}
MARKDOWN_MARKS = {"bold": ("**", "**"), "italic": ("_", "_"), "strikethrough": ("~~", "~~"), "underline": ("<u>", "</u>"), "subscript": ("<sub>", "</sub>"), "superscript": ("<sup>", "</sup>")}


def esc(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def attr(text: str, apostrophe: str = "&#39;") -> str:
    return esc(text).replace('"', "&quot;").replace("'", apostrophe)


def slug(text: str) -> str:
    """Anchor of a heading: compatibility-decomposed, lower-case, other characters as `-`."""
    plain = re.sub(r"[^a-z0-9]+", "-", unicodedata.normalize("NFKD", text).lower())
    return re.sub(r"^-|-$", "", plain) or "section"


def token(text: str) -> str:
    return re.sub(r"^-|-$", "", re.sub(r"[^a-z0-9_-]+", "-", text.lower())) or "unknown"


def plain(nodes: list[dict]) -> str:
    return "".join(n["text"] if n["type"] == "text" else plain(n["children"]) if n["type"] == "link" else "" for n in nodes)


def squeezed(text: str) -> str:
    return " ".join(text.split()).lower()


def inner_blocks(block: dict) -> list[list[dict]]:
    return [i["blocks"] for i in block.get("items", [])] + [c["blocks"] for r in block.get("rows", []) for c in r["cells"]] + ([block["blocks"]] if "blocks" in block else [])


def headings(blocks: list[dict]) -> Iterator[dict]:
    for b in blocks:
        if b["type"] == "heading":
            yield b
        for part in inner_blocks(b):
            yield from headings(part)


def map_styles(blocks: list[dict], mapping: dict[str, str]) -> list[dict]:
    """Paragraphs and headings under their style's mapping: `ignore` drops them, title and headingN are headings."""
    out = []
    for b in blocks:
        to = mapping.get(b.get("styleId", ""))
        if to == "ignore":
            continue
        if b["type"] in ("paragraph", "heading"):
            if to == "title":
                b = {**b, "type": "heading", "level": 1}
            elif to and re.fullmatch("heading[1-6]", to):
                b = {**b, "type": "heading", "level": min(int(to[-1]) + 1, 6)}
        if "items" in b:
            b = {**b, "items": [{**i, "blocks": map_styles(i["blocks"], mapping)} for i in b["items"]]}
        if "rows" in b:
            b = {**b, "rows": [{**r, "cells": [{**c, "blocks": map_styles(c["blocks"], mapping)} for c in r["cells"]]} for r in b["rows"]]}
        if "blocks" in b:
            b = {**b, "blocks": map_styles(b["blocks"], mapping)}
        out.append(b)
    return out


@dataclass
class Doc:
    blocks: list[dict]
    notes: dict[str, dict]
    equations: dict[str, dict]
    metadata: dict
    assets: dict[str, dict]

    @property
    def title(self) -> str:
        return (self.metadata.get("title") or "").strip()

    def titled(self) -> bool:
        """Whether a level 1 heading at the top says the title already."""
        return any(b["type"] == "heading" and b["level"] == 1 and squeezed(plain(b["children"])) == squeezed(self.title) for b in self.blocks)


def asset_files(doc: Doc, fonts: bool = True, prefix: str = "") -> dict[str, str]:
    """Path of each asset that may be packed, numbered by id: images and fonts apart."""
    types, counts, paths = IMAGE_TYPES | (FONT_TYPES if fonts else {}), {"font": 0, "image": 0}, {}
    for name in sorted(doc.assets):
        media = doc.assets[name]["media_type"].lower()
        if media in types:
            kind = "font" if media.startswith("font/") else "image"
            counts[kind] += 1
            paths[name] = f"{prefix}{kind}s/{kind}-{counts[kind]:03d}.{types[media]}"
    return paths


def zipped(files: list[tuple[str, bytes]], stored: tuple[str, ...] = ()) -> bytes:
    """A zip whose bytes depend on its files alone."""
    return zip_of(files, 9, stored)


@dataclass
class Html:
    """Renders blocks as HTML, or as XHTML for EPUB."""

    doc: Doc
    url: Callable[[dict], str | None]
    formula: str
    href: str = HTML_HREF
    xhtml: bool = False
    anchors: dict[int, str] = field(default_factory=dict)
    referenced: list[str] = field(default_factory=list)

    def attr(self, text: str) -> str:
        return attr(text, "&apos;" if self.xhtml else "&#39;")

    def collect(self, blocks: list[dict]) -> list[tuple[int, str, str]]:
        """(level, anchor, label) of all headings; anchors that come again get numbers."""
        seen: dict[str, int] = {}
        found = []
        for h in headings(blocks):
            label = plain(h["children"])
            base = slug(h.get("id") or label)
            seen[base] = seen.get(base, 0) + 1
            self.anchors[id(h)] = base if seen[base] == 1 else f"{base}-{seen[base]}"
            found.append((h["level"], self.anchors[id(h)], label))
        return found

    def blocks(self, blocks: list[dict]) -> str:
        return "".join(map(self.block, blocks))

    def block(self, b: dict) -> str:
        kind = b["type"]
        if kind == "paragraph":
            return f"<p>{self.inlines(b['children'])}</p>"
        if kind == "heading":
            return f'<h{b["level"]} id="{self.attr(self.anchors.get(id(b), "section"))}">{self.inlines(b["children"])}</h{b["level"]}>'
        if kind == "list":
            tag = "ol" if b.get("ordered") else "ul"
            start = f' start="{b["start"]}"' if b.get("ordered") and b.get("start") is not None else ""
            return f"<{tag}{start}>" + "".join(f"<li>{self.blocks(i['blocks'])}</li>" for i in b["items"]) + f"</{tag}>"
        if kind == "table":
            caption = f"<caption>{self.inlines(b['caption'])}</caption>" if b.get("caption") else ""
            rows = "".join("<tr>" + "".join(map(self.cell, r["cells"])) + "</tr>" for r in b["rows"])
            return f"<table>{caption}<tbody>{rows}</tbody></table>"
        if kind == "blockquote":
            return f"<blockquote>{self.blocks(b['blocks'])}</blockquote>"
        if kind == "codeBlock":
            language = f' class="language-{token(b["language"])}"' if b.get("language") and not self.xhtml else ""
            return f"<pre><code{language}>{esc(b['text'])}</code></pre>"
        if kind == "equationBlock":
            return f'<div class="equation" role="math">{render_formula(self.doc.equations.get(b["equationId"]), self.formula, True)}</div>'
        if kind == "imageBlock":
            image = self.image(b)
            caption = f"<figcaption>{self.inlines(b['caption'])}</figcaption>" if b.get("caption") else ""
            return image and f"<figure>{image}{caption}</figure>"
        end = "/>" if self.xhtml else ">"
        return f"<hr{end}" if kind == "thematicBreak" else '<div class="page-break" aria-hidden="true"></div>'

    def cell(self, c: dict) -> str:
        tag = "th" if c.get("header") else "td"
        spans = "".join(f' {name}="{c[key]}"' for key, name in (("colSpan", "colspan"), ("rowSpan", "rowspan")) if c.get(key) is not None)
        return f"<{tag}{spans}>{self.blocks(c['blocks'])}</{tag}>"

    def inlines(self, nodes: list[dict]) -> str:
        return "".join(map(self.inline, nodes))

    def inline(self, n: dict) -> str:
        kind, end = n["type"], "/>" if self.xhtml else ">"
        if kind == "text":
            text = esc(n["text"])
            for m in n.get("marks", ()):
                if m["type"] == "style":
                    text = f'<span class="style-{(slug if self.xhtml else token)(m["styleId"])}">{text}</span>'
                elif m["type"] == "underline" and self.xhtml:
                    text = f'<span class="underline">{text}</span>'
                else:
                    text = f"<{MARK_TAGS[m['type']]}>{text}</{MARK_TAGS[m['type']]}>"
            return text
        if kind == "link":
            inner, href = self.inlines(n["children"]), n["href"].strip()
            title = f' title="{self.attr(n["title"])}"' if n.get("title") else ""
            return f'<a href="{self.attr(href)}"{title}>{inner}</a>' if re.match(self.href, href) else inner
        if kind == "image":
            return self.image(n)
        if kind == "equation":
            return f'<span class="equation" role="math">{render_formula(self.doc.equations.get(n["equationId"]), self.formula, False)}</span>'
        if kind == "noteReference":
            if n["noteId"] not in self.referenced:
                self.referenced.append(n["noteId"])
            name = slug(n["noteId"])
            if self.xhtml:
                return f'<a id="note-ref-{name}" href="#note-{name}" epub:type="noteref">[{self.referenced.index(n["noteId"]) + 1}]</a>'
            return f'<sup id="note-ref-{name}"><a href="#note-{name}" role="doc-noteref">[{self.referenced.index(n["noteId"]) + 1}]</a></sup>'
        return f"<br{end}" if kind == "lineBreak" else "\n"

    def image(self, n: dict) -> str:
        asset = self.doc.assets.get(n["assetId"])
        source = asset and self.url(asset)
        title = f' title="{self.attr(n["title"])}"' if n.get("title") else ""
        return f'<img src="{self.attr(source)}" alt="{self.attr(n.get("alt") or "")}"{title}{"/>" if self.xhtml else ">"}' if source else ""

    def notes(self) -> str:
        items = ""
        for k, name in enumerate(list(self.referenced), 1):
            if note := self.doc.notes.get(name):
                safe = slug(name)
                kind, role = (' epub:type="footnote"', "") if self.xhtml else ("", f' role="doc-backlink" aria-label="Back to reference {k}"')
                items += f'<li id="note-{safe}"{kind}>{self.blocks(note["blocks"])}<a href="#note-ref-{safe}"{role}>↩</a></li>'
        if self.xhtml:
            return f'<section epub:type="footnotes"><ol>{items}</ol></section>' if items else ""
        return f'<section class="notes" aria-label="Notes"><h2>Notes</h2><ol>{items}</ol></section>' if items else ""


def html_fragment(doc: Doc, url: Callable[[dict], str | None], formula: str) -> str:
    out = Html(doc, url, formula)
    contents = out.collect(doc.blocks)
    title = f'<h1 class="document-title">{esc(doc.title)}</h1>' if doc.title and not doc.titled() else ""
    toc = "".join(f'<li><a href="#{attr(anchor)}">{esc(label)}</a></li>' for _, anchor, label in contents)
    toc = f'<div class="table-of-contents"><h2>Contents</h2><ol>{toc}</ol></div>' if toc else ""
    body = out.blocks(doc.blocks)
    return f"<main>{title}{toc}{body}{out.notes()}</main>"


def embedded(asset: dict) -> str | None:
    media = asset["media_type"].lower()
    return f"data:{media};base64,{base64.b64encode(asset['data']).decode()}" if media in IMAGE_TYPES else None


def _page(doc: Doc, fragment: str, style: str) -> str:
    language = doc.metadata.get("language") or "en"
    language = language if re.match(LANGUAGE_TAG, language) else "en"
    authors = "".join(f'<meta name="author" content="{attr(a)}">' for a in doc.metadata.get("authors", ()))
    about = f'<meta name="description" content="{attr(doc.metadata["description"])}">' if doc.metadata.get("description") else ""
    return (
        f'<!doctype html><html lang="{language}"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width,initial-scale=1">'
        f'<meta name="generator" content="{GENERATOR}">{authors}{about}<title>{esc(doc.metadata.get("title") or "Untitled document")}</title>{style}</head><body>{fragment}</body></html>'
    )


def write_html(doc: Doc, mode: str = "standalone", formula: str = "mathml") -> bytes:
    """A page with all it needs in it, a fragment, or a zip of page, style sheet and assets."""
    if mode != "zip":
        fragment = html_fragment(doc, embedded, formula)
        if mode == "fragment":
            return fragment.encode()
        held = [doc.assets[a] for a in sorted(doc.assets) if doc.assets[a]["media_type"].lower() in FONT_TYPES]
        fonts = "".join(
            f'@font-face{{font-family:"{GENERATOR} {i}";src:url("data:{a["media_type"].lower()};base64,{base64.b64encode(a["data"]).decode()}")}}'
            for i, a in enumerate(held, 1)
        )
        return _page(doc, fragment, f"<style>{fonts}{STYLES}</style>").encode()
    paths = asset_files(doc)
    page = _page(doc, html_fragment(doc, lambda a: paths.get(a["asset_id"]), formula), '<link rel="stylesheet" href="styles.css">')
    fonts = "".join(f'@font-face{{font-family:"{GENERATOR} {i}";src:url("{p}")}}' for i, p in enumerate((p for p in paths.values() if p.startswith("fonts/")), 1))
    files = {"document.html": page.encode(), "styles.css": (fonts + STYLES).encode(), **{p: doc.assets[a]["data"] for a, p in paths.items()}}
    return zipped(sorted(files.items()))


class Markdown:
    def __init__(self, doc: Doc, url: Callable[[dict], str | None], formula: str, explicit: tuple[str, ...] = ()):
        self.doc, self.url, self.formula, self.explicit, self.referenced, self.warnings = doc, url, formula, explicit, [], []

    def warn(self, code: str, message: str, severity: str = "warning") -> None:
        self.warnings.append({"code": code, "severity": severity, "message": message, "ord": len(self.warnings)})

    def blocks(self, blocks: list[dict]) -> str:
        return "\n\n".join(filter(None, map(self.block, blocks)))

    def block(self, b: dict) -> str:
        kind = b["type"]
        if kind == "heading":
            return f"{'#' * b['level']} {self.inlines(b['children'])}"
        if kind == "paragraph":
            return self.inlines(b["children"])
        if kind == "blockquote":
            return "\n".join(f"> {x}" if x else ">" for x in self.blocks(b["blocks"]).split("\n"))
        if kind == "list":
            first = 1 if b.get("start") is None else b["start"]
            return "\n".join(self.item(i, f"{first + k}. " if b.get("ordered") else "- ") for k, i in enumerate(b["items"]))
        if kind == "table":
            return self.table(b)
        if kind == "codeBlock":
            text = b["text"].removesuffix("\n")
            marks = "`" * max(3, 1 + max(map(len, re.findall("`+", text)), default=0))
            return f"{marks}{token(b['language']) if b.get('language') else ''}\n{text}\n{marks}"
        if kind == "equationBlock":
            return self.equation(b["equationId"], True)
        if kind == "imageBlock":
            image = self.image(b)
            return f"{image}\n\n*{self.inlines(b['caption'])}*" if image and b.get("caption") else image
        return "---" if kind == "thematicBreak" else "<!-- page break -->"

    def item(self, item: dict, marker: str) -> str:
        """Blocks of an item under its marker; a nested list follows after one line end, others after a blank line."""
        text = ""
        for k, b in enumerate(item["blocks"]):
            text += ("" if not k else "\n" if b["type"] == "list" else "\n\n") + self.block(b)
        lines = text.split("\n")
        return "\n".join([marker + lines[0], *(" " * len(marker) + x for x in lines[1:])])

    def table(self, b: dict) -> str:
        for _ in (c for r in b["rows"] for c in r["cells"] if (c.get("colSpan") or 1) != 1 or (c.get("rowSpan") or 1) != 1):
            self.warn("markdown-table-span", "Merged cells can't be kept.")
        caption = f"*{self.inlines(b['caption'])}*" if b.get("caption") else ""
        if not b["rows"]:
            return caption
        width = max(1, *(len(r["cells"]) for r in b["rows"]))
        rows = [[self.table_cell(c["blocks"]) for c in r["cells"]] + [""] * (width - len(r["cells"])) for r in b["rows"]]
        table = "\n".join(f"| {' | '.join(r)} |" for r in [rows[0], ["---"] * width, *rows[1:]])
        return f"{caption}\n\n{table}" if caption else table

    def table_cell(self, blocks: list[dict]) -> str:
        return re.sub(r" {2}\n|\n+", "<br>", self.blocks(blocks).replace("|", "\\|"))

    def inlines(self, nodes: list[dict]) -> str:
        return "".join(map(self.inline, nodes))

    def inline(self, n: dict) -> str:
        kind = n["type"]
        if kind == "text":
            return self.text(n["text"], n.get("marks", []))
        if kind == "link":
            inner, href = self.inlines(n["children"]), n["href"].strip()
            if not re.match(MARKDOWN_HREF, href):
                self.warn("markdown-unsafe-link", "An unsafe link target was left out.")
                return inner
            title = ' "' + re.sub(r'(["\\])', r"\\\1", n["title"]) + '"' if n.get("title") else ""
            return f"[{inner}]({re.sub(r'([()\\])', r'\\\1', href)}{title})"
        if kind == "image":
            return self.image(n)
        if kind == "equation":
            return self.equation(n["equationId"], False)
        if kind == "noteReference":
            if n["noteId"] not in self.referenced:
                self.referenced.append(n["noteId"])
            return f"[^{token(n['noteId'].replace('_', '-'))}]"
        return "  \n" if kind == "lineBreak" else "\n"

    def text(self, text: str, marks: list[dict]) -> str:
        if any(m["type"] == "code" for m in marks):
            ticks = "`" * (1 + max(map(len, re.findall("`+", text)), default=0))
            pad = " " if "`" in text or text.startswith(" ") or text.endswith(" ") else ""
            out = f"{ticks}{pad}{text}{pad}{ticks}"
        else:
            out = re.sub(r"([\\`*_\[\]<>#])", r"\\\1", text)
        for m in marks:
            if m["type"] in MARKDOWN_MARKS:
                before, after = MARKDOWN_MARKS[m["type"]]
                out = before + out + after
            elif m["type"] == "style" and m["styleId"] not in self.explicit:
                self.warn("markdown-unsupported-style-mark", "A character style can't be kept.", "info")
        return out

    def image(self, n: dict) -> str:
        asset = self.doc.assets.get(n["assetId"])
        if asset is None:
            self.warn("markdown-missing-asset", "An image is missing.")
            return ""
        source = self.url(asset)
        if not source:
            self.warn("markdown-unsupported-image", "An image is of a type that can't be shown.")
            return ""
        title = ' "' + re.sub(r'(["\\])', r"\\\1", n["title"]) + '"' if n.get("title") else ""
        alt = re.sub(r"([\\`*_\[\]<>#])", r"\\\1", n.get("alt") or "")
        return f"![{alt}]({source}{title})"

    def equation(self, name: str, display: bool) -> str:
        equation = self.doc.equations.get(name)
        if equation is None:
            self.warn("markdown-missing-equation", "An equation is missing.")
            return "[Equation unavailable]"
        if self.formula == "source":
            value = equation.get("tex") or equation.get("mathml") or equation["source"]["value"]
            return f"$$\n{value}\n$$" if display else f"${value}$"
        return render_formula(equation, self.formula, display)

    def notes(self) -> str:
        out = []
        for name in self.referenced:
            note = self.doc.notes.get(name)
            if note is None:
                self.warn("markdown-missing-note", "A note is missing.")
                continue
            body = self.blocks(note["blocks"]).replace("\n", "\n    ")
            out.append(f"[^{token(name.replace('_', '-'))}]: {body}")
        return "\n\n".join(out)


def write_markdown(doc: Doc, mode: str = "single", formula: str = "mathml", explicit: tuple[str, ...] = ()) -> tuple[bytes, list[dict]]:
    """The text or a zip of it with its images, and the warnings in the order met; styles in `explicit` are the user's choice."""
    paths = asset_files(doc, fonts=False) if mode == "zip" else {}
    out = Markdown(doc, (lambda a: paths.get(a["asset_id"])) if mode == "zip" else embedded, formula, explicit)
    escaped = re.sub(r"([\\`*_\[\]<>#])", r"\\\1", doc.title)
    title = f"# {escaped}" if doc.title and not doc.titled() else ""
    body = out.blocks(doc.blocks)
    notes = out.notes()
    text = title + ("\n\n" if title and body else "") + body + (f"\n\n{notes}" if notes else "") + "\n"
    if mode != "zip":
        return text.encode(), out.warnings
    files = {"document.md": text.encode(), **{p: doc.assets[a]["data"] for a, p in paths.items()}}
    return zipped(sorted(files.items())), out.warnings


class EpubError(ValueError):
    pass


def epub_metadata(metadata: dict, modified: str) -> dict:
    """Title, identifier, language and time of change, which EPUB requires."""
    found = {k: metadata.get(k) or "" for k in ("title", "identifier", "language")}
    stamp = f"{modified}T00:00:00Z" if re.fullmatch(r"\d{4}-\d{2}-\d{2}", modified) else re.sub(r"\.\d+Z$", "Z", modified)
    missing = [k for k in ("title", "identifier") if not found[k].strip()]
    if not re.match(LANGUAGE_TAG, found["language"]):
        missing.append("language")
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z", stamp):
        missing.append("modified")
    if missing:
        raise EpubError(f"missing or invalid: {', '.join(missing)}")
    return {k: v.strip() for k, v in found.items()} | {"modified": stamp}


def split_chapters(blocks: list[dict]) -> list[list[dict]]:
    """Chapters start at level 2 headings at the top; there is one at least."""
    out: list[list[dict]] = [[]]
    for b in blocks:
        if b["type"] == "heading" and b["level"] == 2 and out[-1]:
            out.append([])
        out[-1].append(b)
    return out


def write_epub(doc: Doc, modified: str, formula: str = "mathml", cover_svg: str | None = None) -> bytes:
    """An EPUB 3 publication: the mimetype stored first, then container, package, contents, style, cover, title page, chapters
    and assets."""
    meta = epub_metadata(doc.metadata, modified)
    language, title = meta["language"], meta["title"]
    x = lambda s: attr(s, "&apos;")

    def page(name: str, body: str, more: str = "") -> bytes:
        return (
            f'<?xml version="1.0" encoding="UTF-8"?><!DOCTYPE html><html xmlns="http://www.w3.org/1999/xhtml"{more} xml:lang="{x(language)}" lang="{x(language)}">'
            f'<head><meta charset="UTF-8"/><title>{esc(name)}</title><link rel="stylesheet" type="text/css" href="styles.css"/></head><body>{body}</body></html>'
        ).encode()

    ops = ' xmlns:epub="http://www.idpf.org/2007/ops"'
    paths = asset_files(doc)
    out = Html(doc, lambda a: paths.get(a["asset_id"]), formula, EPUB_HREF, xhtml=True)
    anchors = out.collect(doc.blocks)
    chapters, contents, k = [], [], 0
    for i, blocks in enumerate(split_chapters(doc.blocks), 1):
        out.referenced = []
        path = f"chapter-{i:03d}.xhtml"
        n = sum(1 for _ in headings(blocks))
        own = [(path, anchor, label or "Untitled section") for _, anchor, label in anchors[k : k + n]]
        contents += own
        k += n
        body = out.blocks(blocks)
        chapters.append((path, page(own[0][2] if own else title, f"{body}{out.notes()}", ops)))
    items = "".join(f'<li><a href="{p}#{x(a)}">{esc(label)}</a></li>' for p, a, label in contents) or '<li><a href="chapter-001.xhtml">Document</a></li>'
    manifest = '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="styles" href="styles.css" media-type="text/css"/>'
    if cover_svg:
        manifest += '<item id="cover-image" href="cover.svg" media-type="image/svg+xml" properties="cover-image"/><item id="cover-page" href="cover.xhtml" media-type="application/xhtml+xml"/>'
    manifest += '<item id="title-page" href="title.xhtml" media-type="application/xhtml+xml"/>'
    manifest += "".join(f'<item id="{p[:-6]}" href="{p}" media-type="application/xhtml+xml"/>' for p, _ in chapters)
    manifest += "".join(f'<item id="{p.rpartition("/")[2].partition(".")[0]}" href="{x(p)}" media-type="{doc.assets[a]["media_type"].lower()}"/>' for a, p in paths.items())
    spine = ('<itemref idref="cover-page"/>' if cover_svg else "") + '<itemref idref="title-page"/>' + "".join(f'<itemref idref="{p[:-6]}"/>' for p, _ in chapters)
    authors = doc.metadata.get("authors", ())
    package = (
        f'<?xml version="1.0" encoding="UTF-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="pub-id" xml:lang="{x(language)}">'
        f'<metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="pub-id">{esc(meta["identifier"])}</dc:identifier><dc:title>{esc(title)}</dc:title><dc:language>{esc(language)}</dc:language>'
        + "".join(f"<dc:creator>{esc(a)}</dc:creator>" for a in authors)
        + f'<meta property="dcterms:modified">{meta["modified"]}</meta></metadata><manifest>{manifest}</manifest><spine>{spine}</spine></package>'
    )
    container = '<?xml version="1.0" encoding="UTF-8"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    subtitle = f'<p class="subtitle">{esc(doc.metadata["subtitle"])}</p>' if doc.metadata.get("subtitle") else ""
    files = [
        ("mimetype", b"application/epub+zip"),
        ("META-INF/container.xml", container.encode()),
        ("EPUB/package.opf", package.encode()),
        ("EPUB/nav.xhtml", page("Contents", f'<nav epub:type="toc" id="toc"><h1>Contents</h1><ol>{items}</ol></nav>', ops)),
        ("EPUB/styles.css", STYLES.encode()),
    ]
    if cover_svg:
        files += [("EPUB/cover.svg", cover_svg.encode()), ("EPUB/cover.xhtml", page(f"Cover for {title}", f'<section epub:type="cover"><img src="cover.svg" alt="Cover for {x(title)}"/></section>', ops))]
    files.append(("EPUB/title.xhtml", page(title, f'<section epub:type="titlepage"><h1>{esc(title)}</h1>{subtitle}' + "".join(f'<p class="author">{esc(a)}</p>' for a in authors) + "</section>", ops)))
    files += [(f"EPUB/{p}", data) for p, data in chapters] + [(f"EPUB/{p}", doc.assets[a]["data"]) for a, p in paths.items()]
    return zipped(files, stored=("mimetype",))


_OUTPUT = "format:string,mode:string,data:binary,error:string,files:array<string>,warnings:array<struct<code:string,severity:string,message:string,ord:long>>"
OUTPUTS = f"doc_id string, outputs array<struct<{_OUTPUT}>>"


def convert(documents: DataFrame, format: str, mode: str = "single", formula: str = "mathml", cover: dict | None = None, explicit: tuple[str, ...] = ()) -> DataFrame:
    """Convert documents (doc_id, error, model, mapping, metadata, assets, warnings, modified) to html, markdown or epub: one row
    (doc_id, format, mode, data, error, files, warnings) for each.

    `model` is the JSON of blocks, notes and equations, `mapping` a map of style to meaning, `metadata` a JSON object,
    `warnings` come before the writer's. A document with an error keeps it, one that can't be converted gets one, and null
    data; a null model has the error `invalid-model`. `cover` holds settings of a cover for EPUB, `explicit` the styles that
    the user has mapped.
    """
    return convert_each(documents, [(format, mode)], formula, cover, explicit).select("doc_id", F.col("outputs")[0]["format"].alias("format"), *[F.col("outputs")[0][c].alias(c) for c in ("mode", "data", "error", "files", "warnings")])


def convert_each(documents: DataFrame, outputs: Sequence[tuple[str, str]], formula: str = "mathml", cover: dict | None = None, explicit: tuple[str, ...] = ()) -> DataFrame:
    """Several outputs of each document in one pass, as convert() makes them: (doc_id, outputs), in the order of `outputs`, pairs of
    format and mode."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(OUTPUTS))

    def one(row: dict, format: str, mode: str) -> dict:
        out = {"format": format, "mode": mode, "data": None, "error": row["error"], "files": [], "warnings": row["warnings"] or []}
        if row["error"] or row["model"] is None:
            return out | {"error": row["error"] or "invalid-model"}
        try:
            model, mapping = json.loads(row["model"]), dict(row["mapping"] or ())
            doc = Doc(map_styles(model["blocks"], mapping), model.get("notes", {}), model.get("equations", {}), json.loads(row["metadata"] or "{}"), {a["asset_id"]: a for a in row["assets"] or ()})
            if format == "html":
                out["data"] = write_html(doc, mode, formula)
            elif format == "markdown":
                out["data"], more = write_markdown(doc, mode, formula, explicit)
                out["warnings"] = [*out["warnings"], *[w | {"ord": len(out["warnings"]) + i} for i, w in enumerate(more)]]
            else:
                svg = draw_cover(doc.metadata.get("title") or "", doc.metadata.get("authors") or (), subtitle=doc.metadata.get("subtitle"), **cover) if cover is not None else None
                out["data"] = write_epub(doc, row["modified"] or "", formula, svg)
            if out["data"][:4] == b"PK\x03\x04":
                out["files"] = sorted(zipfile.ZipFile(io.BytesIO(out["data"])).namelist())
        except EpubError:
            out["error"] = "invalid-model"
        except (KeyError, ValueError, TypeError, RecursionError):
            out["error"] = "conversion-failed"
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple[dict, int]]:
            for row in rows_of(batches):
                each = [one(row, *o) for o in outputs]
                yield {"doc_id": row["doc_id"], "outputs": each}, sum(len(o["data"] or b"") for o in each)

        yield from batches_of(made(), schema)

    return small_batches(documents).select("doc_id", "error", "model", "mapping", "metadata", "assets", "warnings", "modified").mapInArrow(run, OUTPUTS)


ENTRY = "doc_id string, position int, name string, data binary"


def entries(outputs: DataFrame, *kept: str) -> DataFrame:
    """Entries of the archives among converted documents, in their order: (doc_id, position, name, data), and columns of text that
    are kept."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    columns = ", ".join([ENTRY, *[f"{c} string" for c in kept]])
    schema = to_arrow_schema(_parse_datatype_string(columns))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[dict, int]]:
            for row in rows_of(batches):
                with zipfile.ZipFile(io.BytesIO(row.pop("data"))) as z:
                    for k, i in enumerate(z.infolist()):
                        yield {**row, "position": k, "name": i.filename, "data": z.read(i)}, i.file_size

        yield from batches_of(found(), schema)

    return small_batches(outputs).filter(F.substring("data", 1, 4) == F.lit(b"PK\x03\x04")).select("doc_id", "data", *kept).mapInArrow(unpack, columns)


def ordered_html(blocks: DataFrame, doc: str, order: str, tag) -> DataFrame:
    """(doc, html): blocks as elements in order, of built-ins alone; `tag` is an expression, `text` the content."""
    element = F.concat(F.lit("<"), tag, F.lit(">"), escape_html(F.col("text")), F.lit("</"), tag, F.lit(">"))
    held = blocks.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), element.alias("e")))).alias("parts"))
    return held.select(doc, F.array_join(F.transform("parts", lambda p: p["e"]), "").alias("html"))


def gfm_rows(rows: DataFrame, group: str, order: str, cells: list[str]) -> DataFrame:
    """(group, table): a GitHub table of each group's rows in order, with the column names as header."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), " {2}\n|\n+", "<br>")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in cells]), F.lit(" |"))
    head = "| " + " | ".join(cells) + " |\n| " + " | ".join("---" for _ in cells) + " |\n"
    held = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("lines"))
    return held.select(group, F.concat(F.lit(head), F.array_join(F.transform("lines", lambda x: x["l"]), "\n")).alias("table"))


def contents(anchored: DataFrame, doc: str, order: str) -> DataFrame:
    """(doc, toc): the list of a document's headings (anchor, text); no row where it has none."""
    item = F.concat(F.lit('<li><a href="#'), F.col("anchor"), F.lit('">'), escape_html(F.col("text")), F.lit("</a></li>"))
    held = anchored.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i")))).alias("items"))
    return held.select(doc, F.concat(F.lit("<nav><ol>"), F.array_join(F.transform("items", lambda x: x["i"]), ""), F.lit("</ol></nav>")).alias("toc"))


def file_order(name) -> object:
    """Rank of a file in an EPUB listing: mimetype, container, package, contents, styles, cover, title, chapters, the rest."""
    kinds = ["^mimetype$", "^META-INF/", "package[.]opf$", "nav[.]xhtml$", "styles[.]css$", "cover[.]", "title[.]xhtml$", "chapter-[0-9]+[.]xhtml$"]
    found = F.lit(len(kinds))
    for k in range(len(kinds) - 1, -1, -1):
        found = F.when(name.rlike(kinds[k]), k).otherwise(found)
    return found


def ranked_files(outputs: DataFrame) -> DataFrame:
    """(doc_id, position, name) of the files of converted documents in reading order."""
    files = outputs.select("doc_id", F.explode("files").alias("name"))
    return files.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy(file_order(F.col("name")), "name")))
