"""Media columns: storing payloads as media, and sniffing what stored bytes really are.

An Aho-Corasick pass finds the magic bytes of all known formats; a validator
for each format then checks structure and lengths, so a chance match of a few
bytes is no finding. The format found at the start corrects the declared type,
and valid media inside the payload are carved out with their place and length.

Payloads are stored as 8-bit mono WAVE: a RIFF header and the bytes as samples.

Work is linear in the payload: a PDF's marks are paired once for all of them,
nested up to ``NESTED`` deep, and compressed data are checked in blocks, of
which one at a time is held.

Defined results: null is an empty text, stored as 64 zero samples; texts are
stored whole, whatever their length; bytes of no known format are
``application/octet-stream`` with nothing carved; equal bytes give equal
results; an empty table gives an empty result; only the id and the text are
read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.common import stored

BLOCK, RATE = 64, 8000
UNKNOWN = "application/octet-stream"
#: Bytes taken in and given out at once while compressed data are checked; PDFs within each other that are told apart.
INFLATED, NESTED = 1 << 16, 32

# The magic bytes of public formats and how far from the start they stand.
MAGICS = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"BM", 0, "image/bmp"),
    (b"RIFF", 0, "riff"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "application/ogg"),
    (b"MThd", 0, "audio/midi"),
    (b"ftyp", 4, "video/mp4"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
)
_RIFF_KINDS = {b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo", b"WEBP": "image/webp"}


class Found(NamedTuple):
    kind: str
    start: int
    length: int


def wave(payload: bytes, rate: int = RATE) -> bytes:
    """The payload as 8-bit mono samples behind a RIFF header."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def wave_samples(media: bytes) -> bytes:
    """The samples of a WAVE file; ValueError if it isn't one."""
    if _valid("riff", media, 0, {})[0] != "audio/wav":
        raise ValueError("not a WAVE file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _valid(kind: str, raw: bytes, at: int, ends: dict) -> tuple[str, int]:
    """The type and length of a well-formed medium at a place, length 0 if there is none. ends: what is found once for all places."""
    left = len(raw) - at
    if kind == "riff" and left >= 20:
        size, form = struct.unpack_from("<I4s", raw, at + 4)
        first = struct.unpack_from("<I", raw, at + 16)[0]
        if form in _RIFF_KINDS and 12 <= size + 8 <= left and first + 20 <= size + 8:
            return _RIFF_KINDS[form], size + 8
    elif kind == "image/png" and left >= 45:
        pos, ihdr = at + 8, False
        while pos + 12 <= len(raw):
            size, name = struct.unpack_from(">I4s", raw, pos)
            if pos + 12 + size > len(raw) or (not ihdr and name != b"IHDR") or zlib.crc32(raw[pos + 4 : pos + 8 + size]) != struct.unpack_from(">I", raw, pos + 8 + size)[0]:
                break
            ihdr, pos = True, pos + 12 + size
            if name == b"IEND":
                return kind, pos - at
    elif kind == "image/jpeg":
        pos = at + 2
        while pos + 4 <= len(raw) and raw[pos] == 0xFF and raw[pos + 1] in range(0xC0, 0xFF) and not 0xD0 <= raw[pos + 1] <= 0xD8:
            if raw[pos + 1] == 0xD9:
                break
            scan, pos = raw[pos + 1] == 0xDA, pos + 2 + max(2, struct.unpack_from(">H", raw, pos + 2)[0])
            if scan:  # coded data go on to the next marker that is no restart and no escaped FF
                mark = _JPEG_MARK.search(raw, pos)
                pos = mark.start() if mark else len(raw)
        if pos > at + 2 and raw[pos : pos + 2] == b"\xff\xd9":
            return kind, pos + 2 - at
    elif kind == "image/gif" and left >= 14:
        table = lambda flags: 3 << (flags & 7) + 1 if flags & 0x80 else 0
        pos = at + 13 + table(raw[at + 10])
        while all(struct.unpack_from("<HH", raw, at + 6)) and pos < len(raw):
            if raw[pos] == 0x3B:
                return kind, pos + 1 - at
            if raw[pos] == 0x21:
                pos += 2
            elif raw[pos] == 0x2C and pos + 10 <= len(raw):
                pos += 11 + table(raw[pos + 9])
            else:
                break
            while pos < len(raw) and raw[pos]:
                pos += 1 + raw[pos]
            pos += 1
    elif kind == "image/bmp" and left >= 54:
        size, zero, offset, head = struct.unpack_from("<IIII", raw, at + 2)
        if zero == 0 and head in (12, 40, 52, 56, 108, 124) and 14 + head <= offset <= size <= left:
            return kind, size
    elif kind == "audio/flac" and left >= 42:
        if raw[at + 4] & 0x7F == 0 and raw[at + 5 : at + 8] == b"\x00\x00\x22":
            return kind, left
    elif kind == "application/ogg" and left >= 27:
        pos = at
        while pos + 27 <= len(raw) and raw[pos : pos + 5] == b"OggS\x00":
            table = raw[pos + 27 : pos + 27 + raw[pos + 26]]
            if pos + 27 + len(table) + sum(table) > len(raw):
                break
            pos += 27 + len(table) + sum(table)
        return kind, pos - at
    elif kind == "audio/midi" and left >= 14:
        size, form, tracks = struct.unpack_from(">IHH", raw, at + 4)
        pos, seen = at + 8 + size, 0
        while size == 6 and form <= 2 and seen < tracks and raw[pos : pos + 4] == b"MTrk" and pos + 8 <= len(raw):
            pos, seen = pos + 8 + struct.unpack_from(">I", raw, pos + 4)[0], seen + 1
        if tracks and seen == tracks and pos <= len(raw):
            return kind, pos - at
    elif kind == "video/mp4" and left >= 16:
        pos = at
        while pos + 8 <= len(raw):
            size, name = struct.unpack_from(">I4s", raw, pos)
            if size < 8 or pos + size > len(raw) or not name.isalnum():
                break
            pos += size
        return kind, pos - at
    elif kind == "application/pdf":
        if at not in ends:
            ends |= _pdf_ends(raw)
        return kind, ends.get(at, at) - at
    elif kind == "application/zip" and left >= 52:
        if None not in ends:  # where an archive that each record of an end tells would begin: one within has a record of its own
            ends[None] = {}
            for m in re.finditer(rb"PK\x05\x06", raw):
                if m.start() + 22 <= len(raw):
                    size, offset, extra = struct.unpack_from("<IIH", raw, m.start() + 12)
                    if m.start() + 22 + extra <= len(raw):
                        ends[None].setdefault(m.start() - offset - size, m.start() + 22 + extra)
        return kind, ends[None].get(at, at) - at
    elif kind == "application/gzip" and left >= 18 and not raw[at + 3] & 0xE0:
        tool, pos = zlib.decompressobj(31), at
        try:
            while not tool.eof and pos < len(raw):
                more = raw[pos : pos + INFLATED]
                pos += len(more)
                while more and not tool.eof:  # what comes out is checked by its own sum and let go
                    tool.decompress(more, INFLATED)
                    more = tool.unconsumed_tail
        except zlib.error:
            return kind, 0
        if tool.eof:
            return kind, pos - len(tool.unused_data) - at
    return kind, 0


def _pdf_ends(raw: bytes) -> dict[int, int]:
    """The end of each PDF by its start; its own start where it has none.

    Each save ends in a mark of its own, behind the place of its
    cross-references: the last that fits counts, else the first mark. A mark
    belongs to the innermost PDF that it fits, and ends those within.
    """
    heads = [m.start() for m in re.finditer(rb"%PDF-", raw)]
    out, first = {}, 0
    for at in heads:
        if first >= 0:
            first = raw.find(b"%%EOF", max(first, at))
        out[at] = first + 5 if first > 0 and raw[at + 5 : at + 6].isdigit() else at
    opened: list[int] = []
    after = iter(heads)
    head = next(after, None)
    for m in _PDF_END.finditer(raw):
        while head is not None and head < m.start():
            opened.append(head)
            head = next(after, None)
        for depth in range(1, min(NESTED, len(opened)) + 1):
            at = opened[-depth]
            place = at + int(m[1])
            if out[at] > at and max(opened[-1], at) < place < m.start() and (raw[place : place + 4] == b"xref" or raw[place : place + 1].isdigit()):
                out[at] = m.end()
                del opened[len(opened) - depth + 1 :]
                break
    return out


_PDF_END = re.compile(rb"startxref\s{1,4}(\d{1,12})\s{1,4}%%EOF")
_JPEG_MARK = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]", re.S)
_automata: list = []


def _automaton():
    if not _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for k, (magic, _, _) in enumerate(MAGICS):
            a.add_word(magic.decode("latin-1"), k)
        a.make_automaton()
        _automata.append(a)
    return _automata[0]


def sniff(raw: bytes) -> list[Found]:
    """All valid media in the bytes in order, outermost only at each place; one in another is listed too."""
    found: list[Found] = []
    ends: dict = {}
    for end, k in _automaton().iter(raw.decode("latin-1")):
        magic, offset, kind = MAGICS[k]
        start = end + 1 - len(magic) - offset
        if start >= 0:
            kind, length = _valid(kind, raw, start, ends)
            if length:
                found.append(Found(kind, start, length))
    return sorted(found, key=lambda x: (x.start, -x.length))


def described(media: bytes, declared: str) -> tuple[str, list[Found]]:
    """The corrected type and the media carved from inside."""
    found = sniff(media)
    whole = next((f for f in found if f.start == 0), None)
    # A type that only a name tells, such as text, stays; a type with a signature must show it.
    signed = {k for _, _, k in MAGICS} | set(_RIFF_KINDS.values())
    kind = whole.kind if whole else UNKNOWN if declared in signed else declared
    return kind, [f for f in found if f is not whole]


def as_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, declared and media: each text in UTF-8, zero-padded to a positive multiple of 64, as WAVE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, n, out = b.slice(at, 256), [], []
                for t in part.column(1):
                    raw = (t.as_py() or "").encode()
                    n.append(len(raw))
                    out.append(wave(raw.ljust(max(1, -(-len(raw) // BLOCK)) * BLOCK, b"\0")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array([UNKNOWN] * len(n)), pa.array(out, pa.binary())], ["doc_id", "n_bytes", "declared", "media"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(f"`{doc_id}`", f"`{text}`").mapInArrow(run, f"doc_id {kind}, n_bytes long, declared string, media binary")


def inspected(media: DataFrame) -> DataFrame:
    """The digests of the stored bytes and of the payload read back from them, the corrected type and what was carved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw, declared in zip(b.column("media"), b.column("declared"), strict=True):
                raw = raw.as_py()
                payload = wave_samples(raw)
                kind, inside = described(raw, declared.as_py())
                carved = ",".join(f"{f.kind}@{f.start}+{f.length}" for f in inside)
                feature = f"type={kind};declared={declared.as_py()};samples={len(payload)};carved={len(inside)}" + (f"[{carved}]" if inside else "")
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(raw), hashlib.sha256(raw).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "n_bytes", *names])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "declared", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def store_and_inspect(docs: DataFrame) -> DataFrame:
    """Write the media to the shared folder, read the stored bytes back and inspect them."""
    return inspected(stored(as_media(docs), "media"))
