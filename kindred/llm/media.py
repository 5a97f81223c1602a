"""Media columns: signature sniffing of stored bytes.

Aho-Corasick finds magic bytes anywhere in a value, validators confirm structure and lengths, declared types are corrected
by what is there, and media embedded in other bytes are carved out.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Found:
    """A confirmed medium at [start, end) with the span of its samples or first data."""

    kind: str
    start: int
    end: int
    detail: str
    data: tuple[int, int]


class Value:
    """A value's bytes, and what is found out about them once for all magic bytes in them, so that scans stay linear."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.places: dict[bytes, list[int]] = {}
        #: Places of a chain of blocks, by kind and end, from which it is known to fail.
        self.dead: dict[tuple[str, int], set[int]] = {}

    def _places(self, word: bytes) -> list[int]:
        if word not in self.places:
            at, out = self.data.find(word), []
            while at >= 0:
                out.append(at)
                at = self.data.find(word, at + 1)
            self.places[word] = out
        return self.places[word]

    def first(self, word: bytes, at: int, stop: int) -> int:
        """Where word is first found whole in [at, stop), or -1."""
        found = self._places(word)
        k = bisect.bisect_left(found, at)
        return found[k] if k < len(found) and found[k] + len(word) <= stop else -1

    def last(self, word: bytes, at: int, stop: int) -> int:
        found = self._places(word)
        k = bisect.bisect_right(found, stop - len(word)) - 1
        return found[k] if k >= 0 and found[k] >= at else -1


def _wav(v: Value, at: int, stop: int) -> Found | None:
    """RIFF/WAVE: chunk sizes must add up, fmt must come before data and agree with itself."""
    b = v.data
    if stop < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > stop:
        return None
    k, fmt, data = at + 12, None, None
    while k + 8 <= end:
        name, size = b[k : k + 4], struct.unpack_from("<I", b, k + 4)[0]
        if k + 8 + size > end:
            return None
        if name == b"fmt " and size >= 16:
            fmt = struct.unpack_from("<HHIIHH", b, k + 8)
        elif name == b"data" and fmt:
            data = (k + 8, k + 8 + size)
        k += 8 + size + size % 2
    if not fmt or not data or k < end:
        return None
    _, channels, rate, per_second, block, bits = fmt
    if not channels or block != channels * bits // 8 or per_second != rate * block or (data[1] - data[0]) % max(block, 1):
        return None
    return Found("audio/wav", at, end, f"{channels}x{bits}@{rate}/{(data[1] - data[0]) // block}", data)


def _png(v: Value, at: int, stop: int) -> Found | None:
    """PNG: every chunk's checksum must hold, from IHDR to IEND."""
    b = v.data
    k, size, first = at + 8, "", True
    while k + 12 <= stop:
        n, name = struct.unpack_from(">I", b, k)[0], b[k + 4 : k + 8]
        if k + 12 + n > stop or zlib.crc32(memoryview(b)[k + 4 : k + 8 + n]) != struct.unpack_from(">I", b, k + 8 + n)[0]:
            return None
        if first:
            if name != b"IHDR" or n != 13:
                return None
            size, first = "x".join(map(str, struct.unpack_from(">II", b, k + 8))), False
        k += 12 + n
        if name == b"IEND":
            return Found("image/png", at, k, size, (at, k))
    return None


def _gif(v: Value, at: int, stop: int) -> Found | None:
    """GIF: blocks must run to the trailer."""
    b = v.data
    if stop < at + 13:
        return None
    wide, high, flags = struct.unpack_from("<HHB", b, at + 6)
    k = at + 13 + (3 << (flags % 8 + 1) if flags & 128 else 0)
    dead, path = v.dead.setdefault(("gif", stop), set()), []
    while k < stop and k not in dead:
        path.append(k)
        if b[k] == 0x3B:
            return Found("image/gif", at, k + 1, f"{wide}x{high}", (at, k + 1))
        if b[k] == 0x2C and k + 10 <= stop:
            k += 11 + (3 << (b[k + 9] % 8 + 1) if b[k + 9] & 128 else 0)
        elif b[k] == 0x21:
            k += 2
        else:
            break
        # Sub-blocks are part of the chain, and of other chains that come upon them.
        while k < stop and b[k] and -k not in dead:
            path.append(-k)
            k += 1 + b[k]
        if -k in dead:
            break
        k += 1
    dead.update(path)
    return None


def _jpeg(v: Value, at: int, stop: int) -> Found | None:
    """JPEG: segment lengths must lead from the start marker to a scan, and the scan to the end marker."""
    b, k = v.data, at + 2
    dead, path = v.dead.setdefault(("jpeg", stop), set()), []
    while k + 4 <= stop and b[k] == 0xFF and k not in dead:
        path.append(k)
        mark, n = b[k + 1], struct.unpack_from(">H", b, k + 2)[0]
        if n < 2 or not 0xC0 <= mark <= 0xFE or mark in (0xD8, 0xD9):
            break
        k += 2 + n
        if mark == 0xDA:
            end = v.first(b"\xff\xd9", k, stop)
            if end >= 0:
                return Found("image/jpeg", at, end + 2, "", (at, end + 2))
            break
    dead.update(path)
    return None


def _bmp(v: Value, at: int, stop: int) -> Found | None:
    b = v.data
    if stop < at + 30:
        return None
    size, zero, offset, header = struct.unpack_from("<IIII", b, at + 2)
    planes, bits = struct.unpack_from("<HH", b, at + 26)
    if zero or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or header not in (40, 52, 56, 108, 124):
        return None
    if not 14 + header <= offset <= size or at + size > stop:
        return None
    wide, high = struct.unpack_from("<ii", b, at + 18)
    return Found("image/bmp", at, at + size, f"{wide}x{abs(high)}", (at + offset, at + size))


def _pdf(v: Value, at: int, stop: int) -> Found | None:
    """PDF: from the header to the last end marker, with a pointer to the cross-references in between."""
    end = v.last(b"%%EOF", at, stop)
    if end < 0 or v.last(b"startxref", at, end) < 0:
        return None
    return Found("application/pdf", at, end + 5, "", (at, end + 5))


def _gzip(v: Value, at: int, stop: int) -> Found | None:
    """gzip: the stream must inflate and its checksum hold; inflated in pieces, so memory stays bounded."""
    b = v.data
    unpack, k, n = zlib.decompressobj(31), at, 0
    try:
        while not unpack.eof:
            piece = unpack.unconsumed_tail or b[k : min(stop, k + 65536)]
            if not piece:
                return None
            k += 0 if unpack.unconsumed_tail else len(piece)
            n += len(unpack.decompress(piece, 1 << 20))
    except zlib.error:
        return None
    end = k - len(unpack.unused_data)
    return Found("application/gzip", at, end, str(n), (at, end))


MAGIC: dict[bytes, Callable[[Value, int, int], Found | None]] = {
    b"RIFF": _wav, b"\x89PNG\r\n\x1a\n": _png, b"GIF87a": _gif, b"GIF89a": _gif, b"\xff\xd8\xff": _jpeg, b"BM": _bmp, b"%PDF-": _pdf, b"\x1f\x8b\x08": _gzip,
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic in MAGIC:
        found.add_word(magic.decode("latin-1"), magic)
    found.make_automaton()
    return found


def locate(data: bytes, magic: ahocorasick.Automaton, inside: bool = True) -> Iterator[Found]:
    """Confirmed media from left to right, in one scan: what lies inside one is passed over, but for the samples of a container,
    which are searched as a value of their own if inside is asked for, to any depth."""
    value, skip = Value(data), 0
    #: (end, whether it is searched) of what the scan is in, outermost first.
    zones = [(len(data), True)]
    for last, word in magic.iter(data.decode("latin-1")):
        at = last - len(word) + 1
        while at >= zones[-1][0]:
            zones.pop()
        stop, searched = zones[-1]
        if not searched or at < skip or at + len(word) > stop:
            continue
        if found := MAGIC[word](value, at, stop):
            yield found
            skip = found.end
            if inside and found.kind == "audio/wav":
                skip = found.data[0]
                zones += [(found.end, False), (found.data[1], True)]


def sniff(data: bytes, magic: ahocorasick.Automaton) -> list[Found]:
    """Confirmed media from left to right; what lies inside one that is confirmed is not listed again."""
    return list(locate(data, magic, inside=False))


def carve(data: bytes, magic: ahocorasick.Automaton) -> list[bytes]:
    """The embedded media themselves, with those inside a container's samples."""
    return [data[found.start : found.end] for found in locate(data, magic)]


def corrected_type(data: bytes, declared: str | None, magic: ahocorasick.Automaton) -> str | None:
    """The type of a medium that fills the value from its first byte; else what was declared."""
    found = next(locate(data, magic, inside=False), None)
    return found.kind if found and found.start == 0 and found.end == len(data) else declared


def padded(raw: bytes, unit: int = 64) -> bytes:
    return raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw))


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """One channel of unsigned 8-bit samples, uncompressed: each byte is a sample, so nothing is lost."""
    pad = len(payload) % 2
    head = b"RIFF" + struct.pack("<I", 36 + len(payload) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    return head + b"data" + struct.pack("<I", len(payload)) + payload + bytes(pad)


def store_text(df: DataFrame, key: str = "doc_id", text: str = "text", media: str = "media") -> DataFrame:
    """key, n_bytes and the stored medium (binary) of each whole text; null is an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [(x or "").encode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, raws), pa.int64()), pa.array([to_wav(padded(r)) for r in raws], pa.binary())],
                names=["key", "n_bytes", "media"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"key {kind}, n_bytes bigint, media binary").toDF(key, "n_bytes", media)


def describe(df: DataFrame, key: str = "doc_id", media: str = "media", declared: str = "application/octet-stream", keep: tuple[str, ...] = ("n_bytes",)) -> DataFrame:
    """Reads stored media back: the payload's digests, the stored form's, and what sniffing says.

    feature: ``declared>corrected type, detail, entropy in bits a byte, number of carved media inside the samples``. A value
    that isn't a whole WAV file is described as its own payload. Nulls count as empty values; each row stands alone, so ties
    and repeated rows are described alike, whatever other columns there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        magic = automaton()
        for batch in batches:
            out: list[tuple] = []
            for data in batch.column(1).to_pylist():
                data = data or b""
                found = next(locate(data, magic, inside=False), None)
                whole = found is not None and found.start == 0 and found.end == len(data)
                kind = found.kind if whole else declared
                whole = whole and found.kind == "audio/wav"
                payload = data[found.data[0] : found.data[1]] if whole else data
                counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                p = counts[counts > 0] / max(1, len(payload))
                inside = sum(1 for _ in locate(payload, magic, inside=whole))
                feature = f"{declared}>{kind} {found.detail if whole else ''} {abs(float(-(p * np.log2(p)).sum())):.4f} {inside}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            cols = list(zip(*out)) or [()] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            rest = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *rest, *[pa.array(c, t) for c, t in zip(cols, types)]], names=["key", *keep, *names]
            )

    schema = f"key {df.schema[key].dataType.simpleString()}, " + "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in keep)
    schema += "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return df.select(key, F.col(media), *keep).mapInArrow(run, schema).withColumnRenamed("key", key)
