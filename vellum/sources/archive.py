"""Zip archives written in one go, byte for byte as zipfile writes them with the first date that a zip can state."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Collection, Iterable
from functools import lru_cache

EPOCH = (1980, 1, 1, 0, 0, 0)
#: Parts of so many bytes at most are held in deflated form, as archives of one template share them.
SHARED = 1 << 12


@lru_cache(64)
def _deflated(data: bytes, level: int) -> tuple[int, bytes]:
    return zlib.crc32(data), zlib.compress(data, level, -15)


def zip_of(files: Iterable[tuple[str, bytes | str]], level: int = -1, stored: Collection[str] = ()) -> bytes:
    """An archive of files, whose bytes depend on them alone; those named in `stored` are not deflated."""
    held = [(name, data.encode() if isinstance(data, str) else data) for name, data in files]
    if len(held) > 0xFFFF or sum(len(d) for _, d in held) >= 1 << 30 or not all(n.isascii() and n.isprintable() and not n.endswith("/") and len(n) <= 0xFFFF for n, _ in held):
        return _by_zipfile(held, level, stored)
    parts, directory, at = [], [], 0
    for name, data in held:
        if name in stored:
            method, crc, packed = zipfile.ZIP_STORED, zlib.crc32(data), data
        else:
            method, (crc, packed) = zipfile.ZIP_DEFLATED, (_deflated if len(data) <= SHARED else _deflated.__wrapped__)(data, level)
        path = name.encode()
        common = struct.pack("<4H3L2H", 0, method, 0, 33, crc, len(packed), len(data), len(path), 0)
        parts += (b"PK\x03\x04\x14\x00", common, path, packed)
        directory += (b"PK\x01\x02\x14\x03\x14\x00", common, struct.pack("<3H2L", 0, 0, 0, 0o600 << 16, at), path)
        at += 30 + len(path) + len(packed)
    listed = b"".join(directory)
    return b"".join([*parts, listed, struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, len(held), len(held), len(listed), at, 0)])


def _by_zipfile(files: list[tuple[str, bytes]], level: int, stored: Collection[str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files:
            info = zipfile.ZipInfo(name, EPOCH)
            info.create_system = 3
            z.writestr(info, data, zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED, level)
    return out.getvalue()
