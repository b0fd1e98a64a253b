"""Sanitising of markup for a preview: a tokenizer and lists of what may stay. What is on no list goes.

Built-in expressions can't tell tags from text safely, so this runs in Arrow batches.
"""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that may stay, elements that go with all they hold, attributes that may stay, and those that hold targets.
ELEMENTS = frozenset(
    "a abbr acronym address area article aside b bdi bdo big blockquote br caption center cite code col colgroup data dd del details dfn dialog dir div dl dt em fieldset figcaption figure "
    "font footer h1 h2 h3 h4 h5 h6 header hgroup hr i img ins kbd label legend li main map mark menu meter nav nobr ol optgroup option output p picture pre progress q rp rt ruby s samp "
    "search section select small span strike strong sub summary sup table tbody td textarea tfoot th thead time tr tt u ul var wbr "
    "math menclose merror mfenced mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover".split()
)
WITH_CONTENT = frozenset("annotation-xml audio desc foreignobject iframe noembed noframes noscript object plaintext script style svg template title video xmp".split())
ATTRIBUTES = frozenset(
    "abbr align alt axis border cellpadding cellspacing checked cite class clear color cols colspan coords datetime default dir disabled display download face headers height hidden high href hreflang "
    "id ismap label lang loading low max media min name noshade nowrap open optimum pattern placeholder readonly rel required rev reversed role rows rowspan scope selected shape size sizes span "
    "spellcheck src start summary tabindex title type usemap valign value width xmlns".split()
)
TARGETS = frozenset(("href", "src", "cite"))
#: A target within the page or of the same place, or an image that is in the target itself.
TARGET = re.compile(r"data:image/(avif|gif|jpeg|png|webp);base64,|#|[^a-z][^:]*$", re.IGNORECASE)
_EMPTY = frozenset("area br col hr img wbr".split())
_UNSEEN = re.compile(r"[\x00-\x20  ᠎ -  　]")


class _Cleaner(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.inside: list[str] = []  # elements that go with their content and are open
        self.lines = [0]  # where each line of the markup starts

    def feed(self, data: str) -> None:
        self.html = data
        self.lines += [m.end() for m in re.finditer("\n", data)]
        super().feed(data)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in WITH_CONTENT:
            self.inside.append(tag)
        elif not self.inside and tag in ELEMENTS:
            self.out.append(f"<{tag}{''.join(self._attribute(*a) for a in attrs)}>")

    def _attribute(self, name: str, value: str | None) -> str:
        if name not in ATTRIBUTES and not re.fullmatch(r"(aria|data)-[a-z0-9_.-]+", name):
            return ""
        if name in TARGETS and not TARGET.match(_UNSEEN.sub("", value or "")):
            return ""
        return f' {name}="{escape(value or "").replace("&#x27;", "&#39;")}"'

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in WITH_CONTENT or tag not in _EMPTY:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.inside:
            del self.inside[len(self.inside) - 1 - self.inside[::-1].index(tag) :]
        elif not self.inside and tag in ELEMENTS and tag not in _EMPTY:
            self.out.append(f"</{tag}>")

    def _text(self, text: str) -> None:
        if not self.inside:
            self.out.append(text)

    def handle_data(self, data: str) -> None:
        self._text(data.replace("<", "&lt;").replace(">", "&gt;"))

    def _reference(self, text: str) -> None:
        """A reference as it stands: one that no semicolon ends gets none."""
        line, column = self.getpos()
        self._text(text + ";" if self.html.startswith(";", self.lines[line - 1] + column + len(text)) else text)

    def handle_entityref(self, name: str) -> None:
        self._reference(f"&{name}")

    def handle_charref(self, name: str) -> None:
        self._reference(f"&#{name}")


def clean(html: str) -> str:
    """Markup of ELEMENTS and ATTRIBUTES alone, in the order of the tokens; comments, instructions and document types go."""
    cleaner = _Cleaner()
    cleaner.feed(html)
    cleaner.close()
    return "".join(cleaner.out)


def sanitise(html: Column) -> Column:
    """Markup without active elements, event handlers, inline styles, and targets of any other place; null stays null."""

    def cleaned(html: pd.Series) -> pd.Series:
        return html.map(clean, na_action="ignore")

    return F.pandas_udf(cleaned, "string")(html)
