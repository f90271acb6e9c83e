"""Media columns: what stored bytes really are, by signature and structure, and how documents are kept as 8-bit samples.

An Aho-Corasick automaton finds every magic number in one pass; a hit counts only when the format's validator can follow the
structure to its end. The outermost valid object at byte 0 corrects the declared type, the others are carved as embedded media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import intake

SAMPLE_RATE = 8000
BLOCK = 64


class Found(NamedTuple):
    mime: str
    start: int
    end: int


def png_end(data: bytes, start: int) -> int | None:
    """The end of a PNG whose chunks all have right checksums, from IHDR to IEND."""
    at, first = start + 8, True
    while at + 12 <= len(data):
        length, kind = struct.unpack_from(">I4s", data, at)
        end = at + 12 + length
        if end > len(data) or (first and kind != b"IHDR") or zlib.crc32(data[at + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return None
        if kind == b"IEND":
            return end
        at, first = end, False
    return None


def riff_end(data: bytes, start: int) -> int | None:
    """The end of a RIFF form of WAVE, WEBP or AVI whose chunks fill it exactly."""
    if start + 12 > len(data) or data[start + 8 : start + 12] not in (b"WAVE", b"WEBP", b"AVI "):
        return None
    end, at = start + 8 + struct.unpack_from("<I", data, start + 4)[0], start + 12
    if end > len(data) or at + 8 > end:
        return None
    while at + 8 <= end:
        at += 8 + (n := struct.unpack_from("<I", data, at + 4)[0]) + n % 2
    return end if at == end else None


def gif_end(data: bytes, start: int) -> int | None:
    """The end of a GIF, over its colour tables and blocks to the trailer."""
    if start + 13 > len(data):
        return None
    at = start + 13 + (3 << (data[start + 10] & 7) + 1 if data[start + 10] & 0x80 else 0)
    while at < len(data):
        mark = data[at]
        if mark == 0x3B:
            return at + 1
        if mark == 0x21:
            at += 2
        elif mark == 0x2C and at + 10 <= len(data):
            at += 11 + (3 << (data[at + 9] & 7) + 1 if data[at + 9] & 0x80 else 0)
        else:
            return None
        while at < len(data) and data[at]:
            at += 1 + data[at]
        at += 1
    return None


def jpeg_end(data: bytes, start: int) -> int | None:
    """The end of a JPEG: marker segments up to the scan, then the entropy-coded part up to EOI."""
    at, scanned = start + 2, False
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            return None
        mark = data[at + 1]
        if mark == 0xD9:
            return at + 2 if scanned else None
        if at + 4 > len(data) or not 0xC0 <= mark <= 0xFE:
            return None
        at += 2 + max(2, struct.unpack_from(">H", data, at + 2)[0])
        if mark == 0xDA:
            scanned = True
            while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data) and (data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7):
                at += 2
            if at < 0:
                return None
    return None


def bmp_end(data: bytes, start: int) -> int | None:
    """The end of a BMP whose header sizes agree with one another."""
    if start + 30 > len(data):
        return None
    size, reserved, pixels, header = struct.unpack_from("<IIII", data, start + 2)
    planes = struct.unpack_from("<H", data, start + 26)[0]
    return start + size if reserved == 0 and planes == 1 and header in (40, 108, 124) and 54 <= pixels < size <= len(data) - start else None


def pdf_end(data: bytes, start: int) -> int | None:
    """The end of a PDF: its last %%EOF before another header, after a cross-reference pointer. So updates at its end belong to it, and
    each stretch between headers is searched once."""
    following = data.find(b"%PDF-", start + 5)
    end = data.rfind(b"%%EOF", start, following if following >= 0 else len(data))
    return end + 5 if end >= 0 and data.rfind(b"startxref", start, end) >= 0 else None


#: Magic numbers, the media types they announce, and who confirms them.
SIGNATURES = (
    (b"\x89PNG\r\n\x1a\n", "image/png", png_end),
    (b"GIF87a", "image/gif", gif_end),
    (b"GIF89a", "image/gif", gif_end),
    (b"\xff\xd8\xff", "image/jpeg", jpeg_end),
    (b"RIFF", "riff", riff_end),
    (b"BM", "image/bmp", bmp_end),
    (b"%PDF-", "application/pdf", pdf_end),
)
RIFF_KINDS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, (magic, _, _) in enumerate(SIGNATURES):
        found.add_word(magic.decode("latin-1"), (k, len(magic)))
    found.make_automaton()
    return found


def sniff(data: bytes) -> list[Found]:
    """The confirmed media objects in `data`, by start; those inside another one are listed too."""
    out = []
    for last, (k, width) in automaton().iter(data.decode("latin-1")):
        start = last + 1 - width
        if end := SIGNATURES[k][2](data, start):
            mime = SIGNATURES[k][1]
            out.append(Found(RIFF_KINDS[data[start + 8 : start + 12]] if mime == "riff" else mime, start, end))
    return sorted(out, key=lambda x: (x.start, -x.end))


def corrected(data: bytes, declared: str | None) -> tuple[str, list[Found]]:
    """The type that the structure confirms (else the declared one, else octets) and the embedded objects."""
    found = sniff(data)
    whole = [x for x in found if x.start == 0]
    return (whole[0].mime if whole else declared or "application/octet-stream"), [x for x in found if x.start]


def wav_of(payload: bytes) -> bytes:
    """`payload` as 8-bit mono PCM, a sample per byte."""
    n = len(payload)
    return b"".join((b"RIFF", struct.pack("<I", 36 + n + n % 2), b"WAVEfmt ", struct.pack("<IHHIIHH", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8), b"data", struct.pack("<I", n), payload, b"\0" * (n % 2)))


def samples_of(wav: bytes) -> bytes:
    """The samples of a WAV, found by walking its chunks."""
    at = 12
    while at + 8 <= len(wav):
        kind, n = struct.unpack_from("<4sI", wav, at)
        if kind == b"data":
            return wav[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("a WAV without samples")


def sniff_media(df: DataFrame, id_col: str, bytes_col: str, declared_col: str | None = None) -> DataFrame:
    """A row per input row: id, n_bytes, mime (corrected), and embedded: [(mime, start, end, object bytes)].

    Null bytes are zero bytes; a null or missing declared type is application/octet-stream unless the structure says more.
    """
    chosen = df.select(id_col, bytes_col, *([declared_col] if declared_col else []))
    id_field = chosen.schema[0]
    embedded = pa.list_(pa.struct([("mime", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("object", pa.binary())]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            declared = batch.column(2).to_pylist() if declared_col else [None] * batch.num_rows
            for value, kind in zip(batch.column(1), declared, strict=True):
                data = value.as_py() or b""
                mime, inner = corrected(bytes(data), kind)
                rows.append((len(data), mime, [{"mime": x.mime, "start": x.start, "end": x.end, "object": data[x.start : x.end]} for x in inner]))
            n, mimes, inners = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(mimes, pa.string()), pa.array(inners, embedded)], names=["id", "n_bytes", "mime", "embedded"])

    out = chosen.mapInArrow(look, f"id {id_field.dataType.simpleString()}, n_bytes long, mime string, embedded array<struct<mime:string,start:long,`end`:long,object:binary>>")
    return out.withColumnRenamed("id", id_col)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media_digest(docs: DataFrame) -> DataFrame:
    """Each text as a stored 8-bit WAV, sniffed and read back (`DIGEST`).

    A text's UTF-8 bytes are followed by zero bytes up to a positive multiple of 64; null is the empty text. The feature has the
    confirmed type, what is embedded, and the mean, deviation and zero crossings of the samples read back. Rows are independent, so
    repeated rows give repeated results, and no data is shuffled.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                stored = wav_of(raw + b"\0" * (BLOCK - len(raw) % BLOCK if len(raw) % BLOCK or not raw else 0))
                mime, inner = corrected(stored, "application/octet-stream")
                back = samples_of(stored)
                x = np.frombuffer(back, np.uint8)
                crossings = int(np.count_nonzero(np.diff((x >= 128).view(np.int8))))
                feature = f"{mime};embedded={','.join(f'{e.mime}@{e.start}-{e.end}' for e in inner) or '-'};mean={x.mean():.4f};dev={x.std():.4f};crossings={crossings}"
                rows.append((doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in DIGEST.split(", ")])

    return intake(docs).mapInArrow(digest, DIGEST)
