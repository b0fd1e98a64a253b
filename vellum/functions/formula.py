"""Office formulas (OMML) to TeX and MathML.

A formula is a small tree of tuples: ("row", [..]), ("token", kind, text), ("frac", a, b), ("root", body, degree or None),
("script", base, sub or None, sup or None), ("matrix", [[..]]), ("bad", name, text). Everything is a pure function of a
string, for use inside Arrow functions.
"""

from __future__ import annotations

import re
import unicodedata
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import decoded
from vellum.sources.xml import Element, XmlError, parse_lenient

ROWS = {"oMath", "oMathPara", "e", "num", "den", "deg", "sub", "sup"}
# Characters that make an operator.
OPERATORS = set("+-−=<>≤≥×÷±∓∞∫∑∏√∂∇≈≠∈∉∪∩")
RESULT = "tex string, mathml string, complete boolean, unsupported array<string>, fallback string"


def token_kind(text: str) -> str:
    """number (digits of any script, with one point or comma inside), operator, identifier (letters alone) or text."""
    kinds = [unicodedata.category(c) for c in text]
    whole, _, rest = text.replace(",", ".", 1).partition(".") if text.count(".") + text.count(",") == 1 else (text, "", None)
    if all(part and all(unicodedata.category(c)[0] == "N" for c in part) for part in (whole, rest) if part is not None):
        return "number"
    if text and all(c in OPERATORS for c in text):
        return "operator"
    return "identifier" if text and all(k[0] == "L" or k == "Nl" for k in kinds) else "text"


def _row(parts: list):
    """Parts in a row; one part is itself."""
    return parts[0] if len(parts) == 1 else ("row", parts)


def _child(node: Element, name: str):
    found = node.first(name)
    return normal(found) if found is not None else ("bad", f"missing-{name}", "")


def normal(node: Element):
    """The tree of a formula element; property elements are empty, unknown ones are kept as what they say."""
    name = node.local
    if name in ROWS:
        return _row([normal(c) for c in node.elements()])
    if name == "r":
        return ("token", token_kind(node.text()), node.text())
    if name == "f":
        return ("frac", _child(node, "num"), _child(node, "den"))
    if name == "rad":
        degree = node.first("deg")
        return ("root", _child(node, "e"), normal(degree) if degree is not None and degree.text().strip() else None)
    if name in ("sSup", "sSub", "sSubSup"):
        return ("script", _child(node, "e"), *[normal(node.first(x)) if node.first(x) is not None else None for x in ("sub", "sup")])
    if name == "m":
        return ("matrix", [[normal(e) for e in row.elements("e")] for row in node.elements("mr")])
    if name == "mr":
        return _row([normal(e) for e in node.elements("e")])
    if name.endswith("Pr"):
        return ("row", [])
    return ("bad", name, node.text())


def _diagnostic(text: str) -> str:
    """Text without control characters and angle brackets, 500 characters at most."""
    return re.sub(r"[\x00-\x1f\x7f<>]", "", text)[:500].strip()


def _tex_text(text: str) -> str:
    """Text for TeX, each special character by its own command; angle brackets go."""
    return re.sub(r"[#$%&_{}]|\\", lambda m: r"\textbackslash{}" if m[0] == "\\" else f"\\{m[0]}", re.sub("[<>]", "", text))


def tex(tree) -> str:
    kind = tree[0]
    if kind == "row":
        return "".join(map(tex, tree[1]))
    if kind == "token":
        return rf"\text{{{_tex_text(tree[2])}}}" if tree[1] == "text" else tree[2]
    if kind == "frac":
        return rf"\frac{{{tex(tree[1])}}}{{{tex(tree[2])}}}"
    if kind == "root":
        return rf"\sqrt[{tex(tree[2])}]{{{tex(tree[1])}}}" if tree[2] else rf"\sqrt{{{tex(tree[1])}}}"
    if kind == "script":
        return tex(tree[1]) + (f"_{{{tex(tree[2])}}}" if tree[2] else "") + (f"^{{{tex(tree[3])}}}" if tree[3] else "")
    if kind == "matrix":
        return r"\begin{matrix}" + r" \\ ".join(" & ".join(map(tex, row)) for row in tree[1]) + r"\end{matrix}"
    return rf"\text{{{_tex_text(_diagnostic(tree[2]) or tree[1])}}}"


def mathml(tree) -> str:
    kind = tree[0]
    if kind == "row":
        return f"<mrow>{''.join(map(mathml, tree[1]))}</mrow>"
    if kind == "token":
        tag = {"number": "mn", "operator": "mo", "identifier": "mi", "text": "mtext"}[tree[1]]
        return f"<{tag}>{escape(tree[2])}</{tag}>"
    if kind == "frac":
        return f"<mfrac>{mathml(tree[1])}{mathml(tree[2])}</mfrac>"
    if kind == "root":
        return f"<mroot>{mathml(tree[1])}{mathml(tree[2])}</mroot>" if tree[2] else f"<msqrt>{mathml(tree[1])}</msqrt>"
    if kind == "script":
        tag = "msubsup" if tree[2] and tree[3] else "msub" if tree[2] else "msup"
        shown = [tree[1], *filter(None, tree[2:])] if tree[2] or tree[3] else [tree[1], ("token", "text", "")]
        return f"<{tag}>{''.join(map(mathml, shown))}</{tag}>"
    if kind == "matrix":
        rows = "".join("<mtr>" + "".join(f"<mtd>{mathml(c)}</mtd>" for c in row) + "</mtr>" for row in tree[1])
        return f"<mtable>{rows}</mtable>"
    return f"<merror><mtext>{escape(f'Unsupported {tree[1]}: {_diagnostic(tree[2])}')}</mtext></merror>"


def spoken(tree) -> str:
    """Plain text of a formula."""
    kind = tree[0]
    if kind == "row":
        return "".join(map(spoken, tree[1]))
    if kind == "token":
        return tree[2]
    if kind == "frac":
        return f"{spoken(tree[1])}/{spoken(tree[2])}"
    if kind == "root":
        return f"root {spoken(tree[1])}"
    if kind == "script":
        return " ".join(filter(None, (spoken(x) for x in tree[1:] if x)))
    if kind == "matrix":
        return "; ".join(" ".join(map(spoken, row)) for row in tree[1])
    return tree[2]


def unsupported(tree) -> list[str]:
    """Names of what could not be converted, in the order met, once each."""
    if tree[0] == "bad":
        return [tree[1]]
    parts = tree[1] if tree[0] == "row" else [c for row in tree[1] for c in row] if tree[0] == "matrix" else [x for x in tree[1:] if isinstance(x, tuple)]
    return list(dict.fromkeys(n for p in parts for n in unsupported(p)))


def _parsed(omml: str):
    try:
        return normal(parse_lenient(omml))
    except XmlError:
        return ("bad", "malformed-omml", _without_tags(omml))


def _without_tags(markup: str) -> str:
    return " ".join(decoded(re.sub("<[^>]*>", " ", markup)).split())


def _fallback(tree) -> str:
    names = unsupported(tree)
    return (f"Unsupported formula ({', '.join(names)}): " if names else "") + _diagnostic(spoken(tree))


def convert(omml: str) -> dict:
    """TeX, MathML and fallback text of a formula; a malformed one is `malformed-omml`, and complete says whether all of it
    is there. The fallback has no control characters and no angle brackets."""
    tree = _parsed(omml)
    bad = unsupported(tree)
    return {
        "tex": tex(tree),
        "mathml": f'<math xmlns="http://www.w3.org/1998/Math/MathML">{mathml(tree)}</math>',
        "complete": not bad,
        "unsupported": bad,
        "fallback": _fallback(tree),
    }


def render(equation: dict | None, mode: str, display: bool) -> str:
    """Markup of an equation: disabled, source, mathml or katex. There is no TeX engine here, so katex shows MathML, and what
    comes as TeX alone shows its source."""
    if mode == "disabled":
        return ""
    if not equation:
        return '<span class="formula-error" role="math">Equation unavailable</span>'
    source = equation["source"]
    if source["format"] != "omml":
        shown = equation.get("tex") or (_without_tags(source["value"]) if source["format"] == "mathml" else source["value"])
        return escape(shown) if mode == "source" else f'<span class="formula-source" role="math">{escape(shown)}</span>'
    tree = _parsed(source["value"])
    label = escape(_diagnostic(spoken(tree)) or "Formula", {'"': "&quot;", "'": "&#39;"})
    if mode == "source":
        return f'<span class="formula-source" role="math" aria-label="{label}">{escape(_without_tags(_fallback(tree)))}</span>'
    block = ' display="block"' if display and mode == "katex" else ""
    return f'<span class="formula-mathml" role="math" aria-label="{label}"><math xmlns="http://www.w3.org/1998/Math/MathML"{block}>{mathml(tree)}</math></span>'


def omml_to_struct(omml: Column) -> Column:
    """RESULT of each formula, in Arrow batches."""
    made = lambda x: pd.DataFrame([convert(v or "") for v in x], columns=["tex", "mathml", "complete", "unsupported", "fallback"])

    def struct(omml: pd.Series) -> pd.DataFrame:
        return made(omml)

    return F.pandas_udf(struct, RESULT)(omml)


def shown(omml: Column, mode: str) -> Column:
    """Markup of formulas in a mode; null is an equation that is missing."""

    def markup(omml: pd.Series) -> pd.Series:
        return pd.Series([render({"source": {"format": "omml", "value": x}} if x is not None else None, mode, False) for x in omml])

    return F.pandas_udf(markup, "string")(omml)
