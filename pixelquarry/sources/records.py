"""Records of image containers, walked by ranges: only the bytes that a walk asks for are read.

A walk takes a ``read(at, n)`` function, over a file in memory or over a remote one, and yields records one
at a time with the first bytes of their payload. A cut-off file ends the walk.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

#: Bytes of a record's payload that are given out.
HEAD = 32
Read = Callable[[int, int], bytes]


class Record(NamedTuple):
    container: str
    type: str
    offset: int
    length: int
    head: bytes


class Window:
    """``read`` over a source of ranges, with read-ahead; counts what it fetches."""

    def __init__(self, fetch: Read, size: int, step: int = 4096):
        self.fetch, self.size, self.step = fetch, size, step
        self.begin, self.held, self.bytes_read, self.reads = 0, b"", 0, 0

    def __call__(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if n and not (self.begin <= at and at + n <= self.begin + len(self.held)):
            self.begin, self.held = at, self.fetch(at, min(max(n, self.step), self.size - at))
            self.bytes_read += len(self.held)
            self.reads += 1
        return self.held[at - self.begin : at - self.begin + n]


def in_memory(content) -> Read:
    """``read`` over bytes or a buffer."""
    view = memoryview(content)
    return lambda at, n: bytes(view[at : at + n])


def _png(read: Read) -> Iterator[Record]:
    at = 8
    while len(lead := read(at, 8)) == 8:
        length = int.from_bytes(lead[:4], "big")
        yield Record("png", lead[4:].decode("latin-1"), at, length, read(at + 8, min(HEAD, length)))
        at += 12 + length


def _riff(read: Read) -> Iterator[Record]:
    at = 12
    while len(lead := read(at, 8)) == 8:
        length = int.from_bytes(lead[4:], "little")
        yield Record("riff", lead[:4].decode("latin-1"), at, length, read(at + 8, min(HEAD, length)))
        at += 8 + length + length % 2


def _jpeg(read: Read) -> Iterator[Record]:
    at = 0
    while len(lead := read(at, 2)) == 2:
        kind = lead[1]
        if lead[0] != 0xFF or kind == 0xFF:  # between records, or fill
            at += 1
        elif kind in (0xD8, 0x01, 0x00):
            at += 2
        elif kind == 0xD9 or 0xD0 <= kind <= 0xD7:
            yield Record("jpeg", f"{kind:02X}", at, 0, b"")
            if kind == 0xD9:
                return
            at += 2
        else:
            size = read(at + 2, 2)
            if len(size) < 2:
                return
            length = int.from_bytes(size, "big")
            yield Record("jpeg", f"{kind:02X}", at, length, read(at + 4, min(HEAD, max(0, length - 2))))
            if kind == 0xDA or length < 2:  # after the start of a scan come coded bytes
                return
            at += 2 + length


def _gif(read: Read) -> Iterator[Record]:
    """Blocks; their head starts at the block itself, so a control block's holds its label and flags."""
    screen = read(0, 13)
    if len(screen) < 13:
        return
    at = 13 + (3 << (screen[10] & 7) + 1 if screen[10] & 0x80 else 0)
    while lead := read(at, 10):
        start, kind = at, lead[0]
        if kind == 0x2C and len(lead) == 10:
            at += 11 + (3 << (lead[9] & 7) + 1 if lead[9] & 0x80 else 0)
        elif kind == 0x21:
            at += 2
        else:
            yield Record("gif", f"{kind:02X}", at, 1, lead[:1])
            return
        while (size := read(at, 1)) and size[0]:
            at += 1 + size[0]
        at += 1
        yield Record("gif", f"{kind:02X}", start, at - start, read(start, min(HEAD, at - start)))


def _pic(read: Read) -> Iterator[Record]:
    at = 104
    while len(packet := read(at, 4)) == 4:
        yield Record("pic", "packet", at, 4, packet)
        if not packet[0]:
            return
        at += 4


def container(mark: bytes) -> str | None:
    """The container that the first 12 bytes of a file announce."""
    if mark[:8] == b"\x89PNG\r\n\x1a\n":
        return "png"
    if mark[:4] == b"RIFF":
        return "riff"
    if re.match(b"\xff+\xd8", mark) or re.match(b"\xff{12}", mark):
        return "jpeg"
    if mark[:3] == b"GIF":
        return "gif"
    return "pic" if mark[:4] == b"\x53\x80\xf6\x34" else None


_WALKS = {"png": _png, "riff": _riff, "jpeg": _jpeg, "gif": _gif, "pic": _pic}


def walk(read: Read) -> Iterator[Record]:
    """The records of a file; none if it is no container."""
    kind = container(read(0, 12))
    return _WALKS[kind](read) if kind else iter(())


# what the header rules need to know of the records


def _uint(part: bytes, order: str) -> int | None:
    return int.from_bytes(part, order) if part else None


def _frame_fault(length: int, found: dict, entries: bytes) -> str | None:
    """The first rule that a JPEG frame record breaks; bytes that the file does not hold break none.

    ``entries`` has three bytes a component: its id, its sampling factors (H, V) and its table.
    """
    n = found["components"]
    if length < 11:
        return "bad SOF len"
    broken = [(found["bits"] not in (8, None), "only 8-bit"), (found["height"] == 0, "no header height"), (found["width"] == 0, "0 width"), (n not in (1, 3, 4, None), "bad component count")]
    broken += [(len(entries) > 0 and length != 8 + 3 * n, "bad SOF len")]  # a file that ends at the count has no entries to compare
    across, down = [x >> 4 for x in entries[1::3]], [x & 15 for x in entries[1::3]]
    for h, v, table in zip(across, down, entries[2::3].ljust(len(across), b"\0")):
        broken += [(not 1 <= h <= 4, "bad H"), (not 1 <= v <= 4, "bad V"), (table > 3, "bad TQ")]
    for h, v in zip(across, down):  # planes are whole fractions of the largest
        broken += [(h and max(across) % h, "bad H"), (v and max(down) % v, "bad V")]
    return next((text for bad, text in broken if bad), None)


def _jpeg_facts(read: Read) -> dict:
    """The fields of the first frame record and the first rule that it breaks, as far as the file goes."""
    for r in _jpeg(read):
        if r.type in ("C0", "C1", "C2"):
            h = r.head
            found = {"kind": r.type, "bits": _uint(h[:1], "big"), "height": _uint(h[1:3] if len(h) >= 3 else b"", "big"), "width": _uint(h[3:5] if len(h) >= 5 else b"", "big"), "components": _uint(h[5:6], "big")}
            return {**found, "fault": _frame_fault(r.length, found, h[6:])}
    return {}


def _png_facts(read: Read) -> dict:
    """Whether a tRNS record stands before the first IDAT; an unknown critical record ends the search."""
    for r in _png(read):
        if r.type in ("IDAT", "IEND") or (r.type[0] < "a" and r.type not in ("IHDR", "PLTE", "CgBI", "tRNS")):
            return {"clear": False}
        if r.type == "tRNS":
            return {"clear": True}
    return {"clear": False}


def _lossy(r: Record) -> dict:
    h = r.head
    if len(h) < 10:
        return {"kind": "VP8"}
    tag, size = int.from_bytes(h[:3], "little"), {"width": int.from_bytes(h[6:8], "little") & 0x3FFF, "height": int.from_bytes(h[8:10], "little") & 0x3FFF}
    broken = [(tag & 1, "VP8 inter frame"), (tag >> 1 & 7 > 3, "VP8 profile"), (tag >> 5 >= r.length, "VP8 partition size"), (h[3:6] != b"\x9d\x01\x2a", "VP8 signature")]
    return {"kind": "VP8", **size, "fault": next((text for bad, text in broken if bad), None)}


def _lossless(r: Record) -> dict:
    h = r.head
    if len(h) < 5:
        return {"kind": "VP8L"}
    packed = int.from_bytes(h[1:5], "little")
    broken = [(h[0] != 0x2F, "VP8L signature"), (packed >> 29 > 0, "VP8L version")]
    return {"kind": "VP8L", "width": (packed & 0x3FFF) + 1, "height": (packed >> 14 & 0x3FFF) + 1, "clear": bool(packed >> 28 & 1), "fault": next((text for bad, text in broken if bad), None)}


def _webp_facts(read: Read) -> dict:
    """Kind, size and first broken rule of the first image record, which may follow others."""
    for r in _riff(read):
        if r.type in ("VP8 ", "VP8L"):
            return _lossy(r) if r.type == "VP8 " else _lossless(r)
    return {}


def _pic_facts(read: Read) -> dict:
    """Whether a chained packet has alpha; packets are of 8 bits, ten at most, and the last one says so."""
    clear, n, open_ = False, 0, True
    for r in _pic(read):
        n += 1
        if n > 10:
            return {"clear": clear, "fault": "too many packets"}
        clear |= bool(r.head[3] & 0x10)
        if r.head[1] != 8:
            return {"clear": clear, "fault": "bad packet size"}
        open_ = r.head[0] != 0
    return {"clear": clear, "fault": "truncated packets" if open_ else None}


_FACTS = {"jpeg": _jpeg_facts, "png": _png_facts, "webp": _webp_facts, "pic": _pic_facts}


def facts(form: str, read: Read) -> dict | None:
    """kind, bits, height, width, components, clear and fault of a file of this format; null for formats without records."""
    return _FACTS[form](read) if form in _FACTS else None


def text_end(read: Read, form: str) -> int:
    """Where the text header of a PNM or HDR file ends; the end of the file if it does not."""
    at = found = 0
    text = b""
    while part := read(at, 4096):
        text += part
        at += len(part)
        done = _PNM.match(text) if form == "pnm" else _HDR.search(text, found)
        if done and done.end() < len(text):
            return done.end()
        found = max(0, len(text) - 256)
    return len(text)


_PNM = re.compile(rb"P[56](?:(?:\s|#[^\n\r]*)*+\d++){3}\s")
_HDR = re.compile(rb"\n\n[^\n]*\n")
