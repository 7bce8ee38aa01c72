"""Signature sniffing of media columns: types corrected, embedded media carved.

One Aho-Corasick pass over a value's bytes finds every magic number; a format's
validator then reads the header there and confirms structure and lengths. What
a validator does not confirm is not reported.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import ship

BLOCK = 64
RATE = 8000


class Found:
    """A confirmed medium: its format, span, and the span of its samples."""

    __slots__ = ("kind", "start", "end", "data", "data_end")

    def __init__(self, kind: str, start: int, end: int, data: int, data_end: int):
        self.kind, self.start, self.end, self.data, self.data_end = kind, start, end, data, data_end


def _wav(b: bytes, at: int) -> Found | None:
    """RIFF: a size, WAVE, a fmt chunk, a data chunk; chunks are padded to even."""
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    p, fmt = at + 12, False
    while p + 8 <= end:
        name, size = b[p : p + 4], struct.unpack_from("<I", b, p + 4)[0]
        if p + 8 + size > end:
            return None
        if name == b"fmt ":
            if size < 16:
                return None
            kind, channels, rate, per_second, align, bits = struct.unpack_from("<HHIIHH", b, p + 8)
            fmt = kind == 1 and channels > 0 and bits in (8, 16, 24, 32) and align == channels * bits // 8 and per_second == rate * align
        elif name == b"data":
            return Found("audio/wav", at, end, p + 8, p + 8 + size) if fmt else None
        p += 8 + size + size % 2
    return None


def _au(b: bytes, at: int) -> Found | None:
    """Big-endian header: offset, data size, encoding, rate, channels."""
    if len(b) < at + 24:
        return None
    offset, size, encoding, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    start, end = at + offset, at + offset + size
    if offset < 24 or end > len(b) or encoding not in (1, 2, 3) or not rate or not 0 < channels < 256:
        return None
    return Found("audio/basic", at, end, start, end)


_PNM = re.compile(rb"P5\s+(\d{1,9})\s+(\d{1,9})\s+(\d{1,5})\s")


def _pgm(b: bytes, at: int) -> Found | None:
    """P5, width, height, largest value below 256, then one byte for each pixel."""
    m = _PNM.match(b, at, at + 40)
    if not m:
        return None
    w, h, top = map(int, m.groups())
    end = m.end() + w * h
    if not w or not h or not 0 < top < 256 or end > len(b):
        return None
    return Found("image/x-portable-graymap", at, end, m.end(), end)


def _png(b: bytes, at: int) -> Found | None:
    """Chunks with checksums from IHDR to IEND."""
    p, first = at + 8, True
    while p + 12 <= len(b):
        size, name = struct.unpack_from(">I", b, p)[0], b[p + 4 : p + 8]
        if p + 12 + size > len(b) or first != (name == b"IHDR") or zlib.crc32(b[p + 4 : p + 8 + size]) != struct.unpack_from(">I", b, p + 8 + size)[0]:
            return None
        p, first = p + 12 + size, False
        if name == b"IEND":
            return Found("image/png", at, p, at, p)
    return None


def _gif(b: bytes, at: int) -> Found | None:
    """Header, colour tables, blocks in sub-blocks, trailer."""
    if len(b) < at + 13 or b[at : at + 6] not in (b"GIF87a", b"GIF89a"):
        return None
    p = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 128 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return Found("image/gif", at, p + 1, at, p + 1)
        if b[p] == 0x21:
            p += 2
        elif b[p] == 0x2C and p + 10 < len(b):
            p += 10 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 128 else 0) + 1
        else:
            return None
        while p < len(b) and b[p]:
            p += b[p] + 1
        p += 1
    return None


def _bmp(b: bytes, at: int) -> Found | None:
    """File size, offset of the pixels and an information header that agree."""
    if len(b) < at + 30:
        return None
    size, _, offset, header = struct.unpack_from("<IIII", b, at + 2)
    if header not in (12, 40, 52, 56, 108, 124) or not 14 + header <= offset <= size or at + size > len(b):
        return None
    return Found("image/bmp", at, at + size, at + offset, at + size)


MAGIC: dict[bytes, Callable[[bytes, int], Found | None]] = {b"RIFF": _wav, b".snd": _au, b"P5": _pgm, b"\x89PNG\r\n\x1a\n": _png, b"GIF8": _gif, b"BM": _bmp}


def _automaton():
    a = ahocorasick.Automaton()
    for magic in MAGIC:
        a.add_word(magic.decode("latin-1"), magic)
    a.make_automaton()
    return a


_MACHINE: list = []


def sniff(data: bytes) -> list[Found]:
    """Confirmed media in order of place; what lies inside one is not looked for."""
    if not _MACHINE:
        _MACHINE.append(_automaton())
    found: list[Found] = []
    for last, magic in _MACHINE[0].iter(data.decode("latin-1")):
        at = last - len(magic) + 1
        if found and at < found[-1].end:
            continue
        if (x := MAGIC[magic](data, at)) is not None:
            found.append(x)
    return found


def sniff_column(df: DataFrame, value: str, declared: str, key: str) -> DataFrame:
    """(key, declared, corrected, media) for each row of df.

    corrected: the format of a medium that begins at byte 0, else the declared
    type. media: all confirmed spans, each with its bytes carved out. A null or
    empty value has none and keeps its declared type.
    """
    kind = "array<struct<kind: string, start: bigint, end: bigint, bytes: binary>>"
    key_type = df.select(key).schema[0].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            hits = [sniff(v or b"") for v in pdf["value"]]
            yield pd.DataFrame({
                "key": pdf["key"],
                "declared": pdf["declared"],
                "corrected": [h[0].kind if h and h[0].start == 0 else d for h, d in zip(hits, pdf["declared"], strict=True)],
                "media": [[{"kind": x.kind, "start": x.start, "end": x.end, "bytes": v[x.start : x.end]} for x in h] for h, v in zip(hits, pdf["value"], strict=True)],
            })

    ship(df.sparkSession)
    plain = df.select(F.col(key).alias("key"), F.col(declared).cast("string").alias("declared"), F.col(value).cast("binary").alias("value"))
    return plain.mapInPandas(run, f"key {key_type}, declared string, corrected string, media {kind}").withColumnRenamed("key", key)


def store(payload: bytes) -> bytes:
    """The payload as 8-bit samples: WAV, AU or PGM, chosen by its checksum.

    A payload is a positive multiple of BLOCK bytes, which a PGM has as rows.
    """
    n, which = len(payload), zlib.crc32(payload) % 3
    if which == 0:
        return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + payload
    if which == 1:
        return b".snd" + struct.pack(">IIIII", 24, n, 2, RATE, 1) + payload
    return b"P5\n%d %d\n255\n" % (BLOCK, n // BLOCK) + payload


def features(kind: str, samples: bytes) -> str:
    """Format, count, mean, spread and share of steps that cross the mean."""
    x = np.frombuffer(samples, np.uint8)
    mean = float(x.mean())
    crossings = float((np.diff(x > mean) != 0).mean()) if len(x) > 1 else 0.0
    return f"{kind};n={len(x)};mean={mean:.4f};std={float(x.std()):.4f};cross={crossings:.4f}"


def store_and_read(docs: DataFrame) -> DataFrame:
    """Stores each whole text as a medium under a wrong type and reads it back.

    The stored form goes through sniff(): its format and the span of its samples
    come from the confirmed header only. A null text counts as empty, whose
    payload is BLOCK zero bytes. Equal texts give equal values.
    """

    def one(data: bytes) -> tuple:
        payload = data + b"\0" * (-len(data) % BLOCK or (0 if data else BLOCK))
        stored = store(payload)
        media = sniff(stored)
        if not media or media[0].start or media[0].end != len(stored):
            raise ValueError("a stored medium was not recognised")
        back = stored[media[0].data : media[0].data_end]
        return (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), features(media[0].kind, back), media[0].kind)

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type"]

    def run(batches):
        for pdf in batches:
            out = pd.DataFrame([one(x or b"") for x in pdf["data"]], columns=names)
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            yield out

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("data")).mapInPandas(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, media_type string")


def op7_media(spark, sf_dir) -> DataFrame:
    """The contract's query over all documents."""
    return store_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet"))
