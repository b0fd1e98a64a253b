"""Word-processing packages: what they may hold is checked on the zip directory before anything is inflated."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

from .xml import Element, XmlError, parse

MAGIC = b"PK\x03\x04"
MAIN = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
MACRO = "application/vnd.ms-word.document.macroEnabled.main+xml"
AUTOMATION = re.compile(r"word/(_rels/)?vba(project|data).*|word/activex/.*|customui/.*", re.IGNORECASE | re.DOTALL)
# Elements that make an SVG active.
ACTIVE_SVG = {"script", "style", "foreignobject", "iframe", "object", "embed", "use", "animate", "set", "audio", "video"}


#: Fields of the end of a directory, of an entry in it, and of the header before a part.
_END, _ENTRY, _LOCAL = struct.Struct("<4s4H2LH"), struct.Struct("<4s2x3H4x3L4H6xL"), struct.Struct("<4s2xH18x2H")


class PackageError(Exception):
    """`code` is one of the kinds of failure; the message never holds text or names of the document."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Limits:
    compressed: int = 50 << 20
    expanded: int = 200 << 20
    entries: int = 1000
    ratio: int = 100
    image: int = 25 << 20


def inspect(data: bytes, limits: Limits) -> list[str]:
    """Names of the entries, if the directory breaks no rule. The first broken rule, in this order, is the error."""
    if data[:4] != MAGIC:
        raise PackageError("unsupported-format", "The file is not a zip package.")
    if len(data) > limits.compressed:
        raise PackageError("resource-limit", "The package is too large.")
    end = data.rfind(b"PK\x05\x06", max(0, len(data) - 65_557))
    if end < 0 or end + 22 > len(data):
        raise PackageError("invalid-input", "The package has no directory.")
    count, size, at = struct.unpack("<HII", data[end + 10 : end + 20])
    if count > limits.entries:
        raise PackageError("resource-limit", "The package has too many entries.")
    if at + size > end:
        raise PackageError("invalid-input", "The directory of the package is damaged.")
    names, total = [], 0
    for _ in range(count):
        if len(data) - at < 46 or data[at : at + 4] != b"PK\x01\x02":
            raise PackageError("invalid-input", "The directory of the package is damaged.")
        _, _, flags, _, _, packed, plain, name, extra, comment, _, _ = _ENTRY.unpack_from(data, at)
        if flags & 1:
            raise PackageError("encrypted-document", "The package is encrypted.")
        path = data[at + 46 : at + 46 + name].decode("utf-8", "replace").replace("\\", "/")
        if path.startswith("/") or re.match(r"[A-Za-z]:", path) or ".." in path.split("/"):
            raise PackageError("invalid-input", "An entry has an unsafe path.")
        total += plain
        if total > limits.expanded:
            raise PackageError("resource-limit", "The package expands too far.")
        if plain and (not packed or plain > packed * limits.ratio):
            raise PackageError("resource-limit", "An entry is packed too tightly.")
        names.append(path)
        at += 46 + name + extra + comment
    return names


def passive_svg(data: bytes) -> bool:
    """Whether an SVG neither runs nor loads anything."""
    try:
        if re.search(rb"<\?(?!xml\s)", data) or re.search(rb"@import|expression\(|-moz-binding", data, re.IGNORECASE):
            return False
        root = parse(data)
    except XmlError:
        return False

    def passive(node: Element) -> bool:
        for key, value in node.attributes.items():
            key = key.rpartition(":")[2].lower()
            if key.startswith("on") or key in ("href", "src") and not value.strip().startswith("#"):
                return False
            if re.search(r"url\(\s*['\"]?(?!#)", value, re.IGNORECASE):
                return False
        return node.local.lower() not in ACTIVE_SVG and all(passive(c) for c in node.elements())

    return root.local == "svg" and passive(root)


#: Entries of so many bytes at most are held inflated, as packages of one template share them.
SMALL = 1 << 11


def _regular(data: bytes) -> dict[str, tuple[int, int, int, int, int, int, int]] | None:
    """(flags, method, CRC, packed and plain size, where it starts, where the next one does) of each entry of an archive that has
    nothing special: one directory that ends with the data, no comments and no extra fields, plain names once each, entries in
    order. None for others."""
    end = len(data) - 22
    if end < 0 or (end >= 20 and data[end - 20 : end - 16] == b"PK\x06\x07"):
        return None
    magic, disk, first, here, count, size, at, comment = _END.unpack_from(data, end)
    if magic != b"PK\x05\x06" or disk or first or here != count or comment or at + size != end:
        return None
    begin, last, found = at, -1, []
    for _ in range(count):
        if at + 46 > end:
            return None
        magic, version, flags, method, crc, packed, plain, length, extra, remark, disk, start = _ENTRY.unpack_from(data, at)
        name = data[at + 46 : at + 46 + length]
        if magic != b"PK\x01\x02" or version > 45 or extra or remark or disk or start <= last or start >= begin or not name.isascii() or not name:
            return None
        path = name.decode()
        if not path.isprintable() or "\\" in path or path.endswith("/"):
            return None
        found.append((path, (flags, method, crc, packed, plain, start)))
        last = start
        at += 46 + length
    ends = [e[5] for _, e in found[1:]] + [begin]
    entries = {path: (*e, stop) for (path, e), stop in zip(found, ends)}
    return entries if at == end and len(entries) == count else None


@lru_cache(64)
def _inflated(packed: bytes, size: int, crc: int) -> bytes | None:
    """What is packed, if it is whole and right."""
    unpack = zlib.decompressobj(-15)
    found = unpack.decompress(packed, size + 1)
    return found if unpack.eof and len(found) == size and zlib.crc32(found) == crc and not unpack.unused_data else None


class Parts:
    """The parts of an archive by name; one is inflated when it is first asked for."""

    def __init__(self, data: bytes):
        self.data = data
        self.entries = _regular(data)
        names = self.entries if self.entries is not None else [i.filename for i in self.archive.infolist() if not i.is_dir()]
        self.held: dict[str, bytes | None] = dict.fromkeys(names)

    @cached_property
    def archive(self) -> zipfile.ZipFile:
        return zipfile.ZipFile(io.BytesIO(self.data))

    def __iter__(self):
        return iter(self.held)

    def __contains__(self, name: str) -> bool:
        return name in self.held

    def drop(self, name: str) -> None:
        del self.held[name]

    def _plain(self, name: str) -> bytes | None:
        """A deflated entry without anything special, whole and right; None leaves it to the zip reader, which says what is wrong."""
        if self.entries is None:
            return None
        flags, method, crc, packed, plain, at, end = self.entries[name]
        if method != zipfile.ZIP_DEFLATED or flags & ~0x806 or at + 30 > len(self.data):
            return None
        magic, own, length, extra = _LOCAL.unpack_from(self.data, at)
        path = name.encode()
        at += 30
        if magic != MAGIC or own != flags or self.data[at : at + length] != path:
            return None
        at += length + extra
        if at + packed > end:  # it reaches into the next one
            return None
        return (_inflated if packed <= SMALL else _inflated.__wrapped__)(self.data[at : at + packed], plain, crc)

    def get(self, name: str) -> bytes | None:
        if name in self.held and self.held[name] is None:
            try:
                self.held[name] = self._plain(name) or self.archive.read(name)
            except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError, RuntimeError):
                raise PackageError("invalid-input", "The package can't be unpacked.") from None
        return self.held.get(name)


#: Trees of parts of so many bytes at most are held, as packages of one template share them. Nobody changes a tree.
SHARED = 1 << 15
_shared = lru_cache(32)(parse)


@dataclass
class Package:
    parts: Parts
    quarantined: bool
    trees: dict[str, Element] = field(default_factory=dict)

    def xml(self, name: str) -> Element | None:
        """The tree of a part, parsed when it is first asked for."""
        if name not in self.trees:
            data = self.parts.get(name)
            if data is None:
                return None
            try:
                self.trees[name] = _shared(data) if len(data) <= SHARED and name != "word/document.xml" else parse(data)
            except XmlError:
                raise PackageError("invalid-input", "A part of the package is not well formed.") from None
        return self.trees[name]


def _media_type(name: str, types: Element) -> str | None:
    for o in types.elements("Override"):
        if o.get("PartName") == f"/{name}":
            return o.get("ContentType")
    extension = name.rpartition(".")[2].lower()
    return next((d.get("ContentType") for d in types.elements("Default") if (d.get("Extension") or "").lower() == extension), None)


def open_package(data: bytes, limits: Limits) -> Package:
    """The parts of a package, without those that could run. Only parts that are read are inflated."""
    names = inspect(data, limits)
    if {"EncryptedPackage", "EncryptionInfo"} & set(names):
        raise PackageError("encrypted-document", "The package is encrypted.")
    try:
        parts = Parts(data)
    except (zipfile.BadZipFile, NotImplementedError, EOFError, RuntimeError):
        raise PackageError("invalid-input", "The package can't be unpacked.") from None
    package = Package(parts, False)
    for name in [n for n in parts if AUTOMATION.fullmatch(n)]:
        parts.drop(name)
        package.quarantined = True
    types = package.xml("[Content_Types].xml")
    if types is None:
        raise PackageError("invalid-input", "The package has no content types.")
    if _media_type("word/document.xml", types) not in (MAIN, MACRO):
        raise PackageError("unsupported-format", "The package holds no text document.")
    for name in list(parts):
        media = (_media_type(name, types) or "").lower()
        active = media in ("text/html", "application/xhtml+xml") or name.lower().endswith((".html", ".xhtml", ".htm"))
        if active or (media == "image/svg+xml" or name.lower().endswith(".svg")) and not passive_svg(parts.get(name) or b""):
            parts.drop(name)
            package.quarantined = True
    return package
