"""Covers: text that is wrapped by estimated widths, laid out as SVG; checks of images."""

from __future__ import annotations

import base64
import re
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE_BYTES, IMAGE_PIXELS = 10 << 20, 40_000_000
LAYOUTS = ("image-only", "overlay", "title-panel", "typographic")
# Widths of characters in parts of the font size.
SPACE, NARROW, WIDE, USUAL = 0.34, 0.28, 0.9, 0.62
NARROW_CHARS, WIDE_CHARS = "ilI.,:;'|!", "MWmw@%"


def text_width(text: str, size: float) -> float:
    units = (SPACE if c == " " else NARROW if c in NARROW_CHARS else WIDE if c in WIDE_CHARS else USUAL for c in text)
    return sum(units) * size


def wrap(text: str, size: float, width: float) -> list[str]:
    """Lines of words no wider than `width`; a word that is wider alone is split."""
    lines, line = [], ""
    for word in text.split():
        joined = f"{line} {word}".strip()
        if text_width(joined, size) <= width:
            line = joined
            continue
        if line:
            lines.append(line)
        while text_width(word, size) > width and len(word) > 1:
            n = next((k for k in range(len(word), 1, -1) if text_width(word[:k], size) <= width), 1)
            lines.append(word[:n])
            word = word[n:]
        line = word
    return [*lines, line] if line else lines


def _xml(text: str) -> str:
    return escape(text, {'"': "&quot;", "'": "&apos;"})


def _number(x: float) -> str:
    """A number as short as it can be written."""
    return str(int(x)) if x == int(x) else repr(float(x))


# Elements and targets that a cover's SVG may not hold.
_ACTIVE = "script|style|foreignObject|iframe|object|embed|use"
_TARGETS = r"https?:|javascript:|data:text/html"


def clean_svg(svg: str) -> str:
    """An SVG image without elements that run or load something, event handlers and outside targets."""
    if not re.match(r"\s*<svg[\s>]", svg, re.IGNORECASE):
        raise ValueError("the image is no SVG")
    for pattern in (
        rf"<(?:{_ACTIVE})\b[^>]*>.*?</(?:{_ACTIVE})\s*>",
        rf"</?(?:{_ACTIVE})\b[^>]*>",
        r"""\s+on[a-z]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""",
        rf"""\s+(?:xlink:)?href\s*=\s*(?:"(?:{_TARGETS})[^"]*"|'(?:{_TARGETS})[^']*'|(?:{_TARGETS})[^\s>]*)""",
    ):
        svg = re.sub(pattern, "", svg, flags=re.IGNORECASE | re.DOTALL)
    return svg


def prepared_image(media_type: str, data: bytes, width: int | None = None, height: int | None = None) -> str:
    """The data URL of an image that may be a cover; SVG is cleaned. An error if it is too large."""
    if len(data) > IMAGE_BYTES or (width or 0) * (height or 0) > IMAGE_PIXELS:
        raise ValueError("the image is too large")
    if media_type == "image/svg+xml":
        data = clean_svg(data.decode("utf-8", "replace")).encode()
    return f"data:{media_type};base64,{base64.b64encode(data).decode()}"


def cover_svg(
    title: str, authors=(), subtitle: str | None = None, layout: str = "typographic", width: int = 1600, height: int = 2560, alignment: str = "center",
    title_position: float = 18, author_position: float = 86, title_size: float = 112, author_size: float = 54, text_color: str = "light", panel: str = "dark",
    panel_opacity: float = 0.56, image_opacity: float = 1, margin: float = 8, crop: str = "cover", image: str | None = None,
) -> str:
    """A cover: an image alone, with text over it, with the text on a panel, or the text alone. `image` is a data URL; positions
    and the margin are parts of a hundred."""
    ranges = ((title_position, 100), (author_position, 100), (panel_opacity, 1), (image_opacity, 1), (margin, 25))
    if layout not in LAYOUTS or not (isinstance(width, int) and isinstance(height, int) and width > 0 and height > 0) or not all(0 <= x <= most for x, most in ranges):
        raise ValueError("the composition is out of range")
    edge = width * margin / 100
    x, anchor = {"left": (edge, "start"), "right": (width - edge, "end")}.get(alignment, (width / 2, "middle"))
    fill, ground = ("#fff", "#172033") if text_color == "light" else ("#111", "#f1ede4")
    n = _number
    parts = [f'<rect width="100%" height="100%" fill="{ground}"/>']
    if image:
        fit = {"cover": "xMidYMid slice", "contain": "xMidYMid meet"}.get(crop, "none")
        parts.append(f'<image width="{width}" height="{height}" opacity="{n(image_opacity)}" preserveAspectRatio="{fit}" href="{image}"/>')
    if layout != "image-only":
        lines, step, top = wrap(title, title_size, max(80, width - edge * 2)), title_size * 0.95, height * title_position / 100
        rows = max(1, len(lines))
        if panel != "none":
            tall = title_size * (0.95 + rows * 0.95 + (0.95 if subtitle else 0))
            parts.append(f'<rect x="{n(edge / 2)}" y="{n(top - title_size * 1.15)}" width="{n(width - edge)}" height="{n(tall)}" rx="24" fill="{"#000" if panel == "dark" else "#fff"}" opacity="{n(panel_opacity)}"/>')
        spans = "".join(f'<tspan x="{n(x)}" dy="{n(step) if k else 0}">{_xml(line)}</tspan>' for k, line in enumerate(lines or [""]))
        parts.append(f'<text x="{n(x)}" y="{n(top)}" text-anchor="{anchor}" font-family="Georgia,serif" font-size="{n(title_size)}" font-weight="700" fill="{fill}">{spans}</text>')
        for at, text in ((top + step * rows, subtitle or None), (height * author_position / 100, " · ".join(authors))):
            if text is not None:
                parts.append(f'<text x="{n(x)}" y="{n(at)}" text-anchor="{anchor}" font-family="Arial,sans-serif" font-size="{n(author_size)}" fill="{fill}">{_xml(text)}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}">{"".join(parts)}</svg>'


def cover_settings(source: str, image: str | None = None, aspect: str = "book", **chosen) -> dict | None:
    """Settings for cover_svg() from what a user chose: none, generated, or an image that was uploaded or found."""
    if source == "none" or source in ("upload", "extracted") and not image:
        return None
    layout = "typographic" if source == "generated" else chosen.pop("layout", "image-only")
    return {**chosen, "layout": layout, "width": 1600, "height": 1600 if aspect == "square" else 2560} | ({"image": image} if image else {})


def file_issue(media_type: Column, size: Column) -> Column:
    """Why a file can't be a cover; null if it can."""
    known = media_type.isin("image/jpeg", "image/png", "image/webp", "image/svg+xml")
    return F.when(~F.coalesce(known, F.lit(False)), "unsupported-format").when(size > IMAGE_BYTES, "resource-limit")


def image_issue(size: Column, pixels: Column) -> Column:
    """Code of what forbids an image as a cover, from its bytes and pixels (columns); null if nothing does."""
    return F.when(size > IMAGE_BYTES, "resource-limit").when(pixels > IMAGE_PIXELS, "resource-limit").when(size <= 0, "invalid-input")


def cover_lines(title: Column, size: Column, width: Column) -> Column:
    def lines(title: pd.Series, size: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([wrap(t or "", s, w) for t, s, w in zip(title, size, width, strict=True)])

    return F.pandas_udf(lines, "array<string>")(title, size, width)


def cover(title: Column, author: Column) -> Column:
    def drawn(title: pd.Series, author: pd.Series) -> pd.Series:
        return pd.Series([cover_svg(t or "", [a] if a else []) for t, a in zip(title, author, strict=True)])

    return F.pandas_udf(drawn, "string")(title, author)


def drawn_cover(title: Column, authors: Column, light: Column) -> Column:
    """Covers with light text on a panel, or dark text without one."""

    def drawn(title: pd.Series, authors: pd.Series, light: pd.Series) -> pd.Series:
        settings = {True: {}, False: {"text_color": "dark", "panel": "none"}}
        return pd.Series([cover_svg(t or "", list(a), **settings[bool(x)]) for t, a, x in zip(title, authors, light, strict=True)])

    return F.pandas_udf(drawn, "string")(title, authors, light)


def cleaned_svg(svg: Column) -> Column:
    """clean_svg() of each text; null where it is no SVG."""

    def clean(svg: pd.Series) -> pd.Series:
        def one(text):
            try:
                return clean_svg(text)
            except (TypeError, ValueError):
                return None

        return svg.map(one)

    return F.pandas_udf(clean, "string")(svg)
