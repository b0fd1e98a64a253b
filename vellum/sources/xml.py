"""A strict XML reader that keeps mixed content in order, ignores namespaces, and lets no document type in."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from functools import lru_cache
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

from vellum.functions.text import decoded


class XmlError(ValueError):
    pass


_local = lru_cache(4096)(lambda name: name.rpartition(":")[2])


class Element:
    __slots__ = ("name", "local", "attributes", "children")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.local, self.attributes = name, _local(name), attributes
        self.children: list = []

    def elements(self, local: str | None = None) -> list[Element]:
        return [c for c in self.children if c.__class__ is Element and (local is None or c.local == local)]

    def first(self, local: str) -> Element | None:
        for c in self.children:
            if c.__class__ is Element and c.local == local:
                return c
        return None

    def descendants(self, *locals_: str) -> Iterator[Element]:
        """Those of any of the names, in document order."""
        todo = self.children[::-1]
        while todo:
            c = todo.pop()
            if c.__class__ is Element:
                if c.local in locals_:
                    yield c
                if (inner := c.children) and (len(inner) > 1 or inner[0].__class__ is Element):
                    todo += inner[::-1]

    def holds(self, locals_: Collection[str]) -> bool:
        """Whether an element of any of the names is among the descendants."""
        todo = [self.children]
        while todo:
            for c in todo.pop():
                if c.__class__ is Element:
                    if c.local in locals_:
                        return True
                    if c.children:
                        todo.append(c.children)
        return False

    def get(self, local: str) -> str | None:
        """The attribute of that name, whatever its prefix."""
        if not self.attributes or local in self.attributes:
            return self.attributes.get(local)
        return next((v for k, v in self.attributes.items() if k.endswith(f":{local}")), None)

    def at(self, *path: str) -> Element | None:
        node: Element | None = self
        for name in path:
            node = node.first(name) if node is not None else None
        return node

    def text(self) -> str:
        if len(self.children) == 1 and self.children[0].__class__ is str:
            return self.children[0]
        return "".join([c if c.__class__ is str else c.text() for c in self.children])

    def serialise(self) -> str:
        attributes = "".join([f" {k}={quoteattr(v)}" for k, v in self.attributes.items()])
        inner = "".join([escape(c) if c.__class__ is str else c.serialise() for c in self.children])
        return f"<{self.name}{attributes}>{inner}</{self.name}>"


def parse(data: bytes | str) -> Element:
    """The root element. Document types and entities beyond the five, and anything not well formed, are errors."""
    top = Element("", {})
    open_ = [top.children]
    reader = expat.ParserCreate()
    reader.buffer_text = True

    def refuse(*_):
        raise XmlError("a document type is not allowed")

    def start(name: str, attributes: dict[str, str]) -> None:
        node = Element(name, attributes)
        open_[-1].append(node)
        open_.append(node.children)

    reader.StartDoctypeDeclHandler = refuse
    reader.StartElementHandler = start
    reader.EndElementHandler = lambda _: open_.pop()
    reader.CharacterDataHandler = lambda text: open_[-1].append(text)
    try:
        reader.Parse(data, True)
    except expat.ExpatError as e:
        raise XmlError(str(e)) from None
    return top.elements()[0]


_TOKEN = re.compile(r"<(?P<tag>[^>]+)>|(?P<text>[^<]+)")


def parse_lenient(text: str) -> Element:
    """The first element of a text whose tags match each other. Attributes are not read, entities that are none stay, and what
    comes beside that element is ignored; document types and tags that don't match are errors."""
    if re.search("<!DOCTYPE|<!ENTITY", text, re.IGNORECASE):
        raise XmlError("a document type is not allowed")
    open_ = [Element("", {})]
    for tag, words in _TOKEN.findall(text):
        tag = tag.strip()
        if words:
            open_[-1].children.append(decoded(words))
        elif not tag or tag[0] in "?!":
            continue
        elif tag[0] == "/":
            if len(open_) == 1 or open_.pop().local != tag[1:].strip().rpartition(":")[2]:
                raise XmlError("the tags don't match")
        else:
            node = Element((tag.rstrip("/").split(None, 1) or [""])[0], {})
            open_[-1].children.append(node)
            if not tag.endswith("/"):
                open_.append(node)
    if len(open_) > 1 or not open_[0].elements():
        raise XmlError("an element is not closed, or there is none")
    return open_[0].elements()[0]
