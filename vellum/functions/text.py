"""Scalar functions over text columns, all of built-in expressions that stay inside code generation."""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities of each escape, in the order in which they apply.
TEXT_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
ATTRIBUTE_ENTITIES = (*TEXT_ENTITIES, ('"', "&quot;"), ("'", "&#39;"))
XML_ENTITIES = (*TEXT_ENTITIES, ('"', "&quot;"), ("'", "&apos;"))

# Media types that may be embedded or packed, with the extension of each.
IMAGE_TYPES = {"image/avif": "avif", "image/gif": "gif", "image/jpeg": "jpg", "image/png": "png", "image/webp": "webp"}
FONT_TYPES = {"font/otf": "otf", "font/ttf": "ttf", "font/woff": "woff", "font/woff2": "woff2"}

# Windows language codes.
LCIDS = {
    1029: "cs-CZ", 1030: "da-DK", 1031: "de-DE", 1033: "en-US", 1034: "es-ES", 1035: "fi-FI", 1036: "fr-FR", 1038: "hu-HU",
    1040: "it-IT", 1043: "nl-NL", 1044: "nb-NO", 1045: "pl-PL", 1046: "pt-BR", 1049: "ru-RU", 1053: "sv-SE", 1055: "tr-TR",
    2057: "en-GB", 3082: "es-ES",
}

LANGUAGE_TAG = "^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$"
HTML_HREF = "(?i)^(https?:|mailto:|#[A-Za-z0-9_.:-]+$)"
MARKDOWN_HREF = r"^([Hh][Tt][Tt][Pp][Ss]?:|[Mm][Aa][Ii][Ll][Tt][Oo]:|#[A-Za-z0-9_.:-]+$|(\.\.?/|/)?[^\s\\:]+(/[^\s\\]*)?$)"
EPUB_HREF = "^#[A-Za-z0-9_.:-]+$"


def escaped(text: Column, entities: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), entities, text)


def escape_html(text: Column) -> Column:
    return escaped(text, TEXT_ENTITIES)


def escape_attribute(text: Column) -> Column:
    return escaped(text, ATTRIBUTE_ENTITIES)


def escape_xml(text: Column) -> Column:
    return escaped(text, XML_ENTITIES)


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_\[\]<>#])", r"\\$1")


def normal_space(text: Column) -> Column:
    """Trimmed, with runs of white space as one space."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def normal_text(text: Column) -> Column:
    return F.lower(normal_space(text))


def token(text: Column) -> Column:
    """A class or label token: anything but letters, digits, `_` and `-` becomes `-`; `unknown` if nothing is left."""
    cleaned = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9_-]+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("unknown"))


def _class(chars: list[str]) -> str:
    """A regular expression's class of those characters, as ranges."""
    ranges: list[list[int]] = []
    for c in map(ord, chars):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in ranges) + "]"


@functools.cache
def _decomposed() -> tuple[str, str, str, str, dict[str, str]]:
    """What compatibility decomposition makes letters and digits of, by kind: the class of characters that are one with marks after
    it, characters that are one (with or without marks) and these, the class and the decomposition of all others."""
    plain = lambda x: x.isascii() and x.isalnum()
    apart = {c: unicodedata.normalize("NFKD", c) for c in map(chr, (*range(0xA0, 0xD800), *range(0xF900, 0x1F252)))}
    apart = {c: x for c, x in apart.items() if any(map(plain, x)) and c != x}
    marked = [c for c, x in apart.items() if len(x) > 1 and plain(x[0]) and not any(map(plain, x[1:]))]
    single = [c for c, x in apart.items() if len(x) == 1]
    others = {c: x for c, x in apart.items() if c not in set(marked) | set(single)}
    return _class(marked), "".join([*marked, *single]), "".join(apart[c][0] for c in [*marked, *single]), _class(list(others)), others


def slug(text: Column) -> Column:
    """An anchor of ASCII letters and digits of the compatibility decomposition with `-` between; `section` if none is left."""
    marked, chars, letters, several, parts = _decomposed()
    table = F.from_json(F.lit(json.dumps(parts, ensure_ascii=False)), "map<string,string>")
    rare = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    plain = F.when(text.rlike(f"(?=[^\\x00-\\x7f]){several}"), rare).otherwise(text)
    plain = F.translate(F.regexp_replace(plain, f"(?=[^\\x00-\\x7f])({marked})", "$1-"), chars, letters)
    cleaned = F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("section"))


def safe_href(href: Column, policy: str) -> Column:
    """The target if the output format may link to it, else null: `html`, `markdown` or `epub`."""
    pattern = {"html": HTML_HREF, "markdown": MARKDOWN_HREF, "epub": EPUB_HREF}[policy]
    return F.when(F.trim(href).rlike(pattern), F.trim(href))


def href_scheme(href: Column) -> Column:
    found = F.lower(F.regexp_extract(F.trim(href), "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("relative"))


def media_extension(media_type: Column, fonts: bool) -> Column:
    """Extension under which an asset of that type is packed; null if it may not be."""
    types = IMAGE_TYPES | (FONT_TYPES if fonts else {})
    return F.element_at(F.create_map(*[F.lit(x) for kv in types.items() for x in kv]), F.lower(media_type))


def language_tag(language: Column) -> Column:
    """Language tags as they are, Windows language codes as tags, anything else unchanged."""
    codes = F.create_map(*[F.lit(str(x)) for kv in LCIDS.items() for x in kv])
    return F.when(language.rlike(LANGUAGE_TAG), language).when(language.rlike("^[0-9]{3,5}$"), F.coalesce(F.element_at(codes, F.regexp_replace(language, "^0+", "")), language)).otherwise(language)


def html_language(language: Column) -> Column:
    return F.when(language.rlike(LANGUAGE_TAG), language).otherwise("en")


def data_url(media_type: Column, data: Column) -> Column:
    """A data URL; Spark's base64 breaks lines, which a URL can't have."""
    return F.concat(F.lit("data:"), F.lower(media_type), F.lit(";base64,"), F.regexp_replace(F.base64(data), "[\r\n]", ""))


def plain_text(html: Column) -> Column:
    """Text of markup: scripts, styles, comments and tags gone, the common entities decoded, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, "<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return normal_space(bare)


def body_of(html: Column) -> Column:
    """What stands inside the first body element, else all."""
    inner = F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)</body>", 1)
    return F.when(html.rlike(r"(?is)<body[^>]*>.*?</body>"), inner).otherwise(html)


def base_name(path: Column) -> Column:
    """Last segment of a path of either slash, without its last extension; `document` if nothing is left."""
    name = F.regexp_replace(F.trim(F.element_at(F.split(path, r"[/\\]"), -1)), r"\.[^.]+$", "")
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("document"))


def output_name(path: Column, format: str, mode: str) -> Column:
    """Name of an output: `-html.zip` and `-markdown.zip` for archives, else `.html`, `.md` or `.epub`."""
    suffix = ".epub" if format == "epub" else f"-{format}.zip" if mode == "zip" else {"html": ".html", "markdown": ".md"}[format]
    return F.concat(base_name(path), F.lit(suffix))


def fence(text: Column) -> Column:
    """Backticks that can enclose a code block: one more than its longest run of them, three at least."""
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))


def math_kind(text: Column) -> Column:
    """What a formula token is: number, operator, identifier or text; the same as formula.token_kind()."""
    return (
        F.when(text.rlike(r"^\p{N}+([.,]\p{N}+)?$"), "number")
        .when(text.rlike(r"^[+\-−=<>≤≥×÷±∓∞∫∑∏√∂∇≈≠∈∉∪∩]+$"), "operator")
        .when(text.rlike(r"^[\p{L}\p{Nl}]+$"), "identifier")
        .otherwise("text")
    )


def title_in_name(title: Column, name: Column, share: float = 0.6) -> Column:
    """Whether a name already says the title: of two or more words of three letters or digits, that share is in it."""
    words = F.regexp_extract_all(F.lower(title), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0))
    held = F.filter(words, lambda w: F.contains(F.lower(name), w))
    return (F.size(words) >= 2) & (F.size(held) >= F.size(words) * share)


def utc_seconds(date: Column) -> Column:
    """`YYYY-MM-DD` at midnight UTC, and timestamps without their fraction; null if it is neither."""
    return F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(date, F.lit("T00:00:00Z"))).when(date.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"), F.regexp_replace(date, r"\.\d+Z$", "Z"))


def admission_issue(name: Column, media_type: Column) -> Column:
    """Why a file is not taken, by name and stated media type; null if it is."""
    accepted = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
    return F.when(~F.coalesce(F.lower(name), F.lit("")).endswith(".docx"), "not-a-docx-name").when(~F.coalesce(media_type, F.lit("")).isin("", accepted), "not-a-docx-type")


def publication_issues(title: Column, identifier: Column, language: Column) -> Column:
    """Names of the fields that an EPUB requires and that are blank or not well formed, in that order."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.array_compact(F.array(F.when(blank(title), "title"), F.when(blank(identifier), "identifier"), F.when(~F.coalesce(language, F.lit("")).rlike(LANGUAGE_TAG), "language")))


# The entities of XML.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def decoded(text: str) -> str:
    """A text with its named and numeric entities decoded, once; what is no entity or no character stays."""

    def char(m: re.Match) -> str:
        name = m[1].lower()
        if name in NAMED:
            return NAMED[name]
        code = int(name[2:], 16) if name[1] == "x" else int(name[1:])
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return re.sub(r"&(#x[0-9a-f]{1,8}|#[0-9]{1,9}|amp|lt|gt|quot|apos);", char, text, flags=re.IGNORECASE) if "&" in text else text


def decode_entities(text: Column) -> Column:
    """decoded() in Arrow batches; null stays null."""

    def decode(text: pd.Series) -> pd.Series:
        return text.map(decoded, na_action="ignore")

    return F.pandas_udf(decode, "string")(text)
