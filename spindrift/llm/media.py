"""Media columns: signature sniffing, validation, type correction and carving.

A blob of any length is searched whole.  An Aho-Corasick automaton finds all magic bytes of a blob in one pass; a validator of each format then
walks its structure and confirms the length, so a chance match of a few bytes is no file.  The file at
offset 0 gives the true type, which corrects the declared one; confirmed files further on are carved.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import struct
import sys
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from spindrift.llm import textkit as tk
from spindrift.llm.cluster import columns_only

MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png", b"GIF87a": "image/gif", b"GIF89a": "image/gif", b"\xff\xd8\xff": "image/jpeg",
    b"BM": "image/bmp", b"RIFF": "riff", b"%PDF-": "application/pdf", b"PK\x03\x04": "application/zip",
    b"\x1f\x8b\x08": "application/gzip", b"OggS": "audio/ogg", b"fLaC": "audio/flac", b"ftyp": "video/mp4",
}
#: Ends that validators look up instead of searching again for each start.
ENDS = (b"%%EOF", b"PK\x05\x06")
UNIT, RATE = 64, 8000


def _png(d: bytes, at: int, ends: dict) -> int:
    i, first = at + 8, True
    while i + 12 <= len(d):
        (n,) = struct.unpack_from(">I", d, i)
        kind = d[i + 4 : i + 8]
        if i + 12 + n > len(d) or first != (kind == b"IHDR") or zlib.crc32(d[i + 4 : i + 8 + n]) != struct.unpack_from(">I", d, i + 8 + n)[0]:
            return 0
        i, first = i + 12 + n, False
        if kind == b"IEND":
            return i - at
    return 0


def _gif(d: bytes, at: int, ends: dict) -> int:
    if at + 13 > len(d):
        return 0
    i = at + 13 + (3 << ((d[at + 10] & 7) + 1) if d[at + 10] & 0x80 else 0)
    while i < len(d):
        if d[i] == 0x3B:
            return i + 1 - at
        if d[i] == 0x21:
            i += 2
        elif d[i] == 0x2C and i + 10 <= len(d):
            i += 11 + (3 << ((d[i + 9] & 7) + 1) if d[i + 9] & 0x80 else 0)
        else:
            return 0
        while i < len(d) and d[i]:
            i += d[i] + 1
        i += 1
    return 0


def _next(ends: dict, mark: bytes, at: int) -> int:
    places = ends.get(mark, [])
    k = bisect.bisect_left(places, at)
    return places[k] if k < len(places) else -1


def _jpeg(d: bytes, at: int, ends: dict) -> int:
    i, scan = at + 2, False
    while i + 4 <= len(d):
        if scan:
            # in a scan a mark is 0xff but before a stuffed 0, a restart or another 0xff
            i = d.find(b"\xff", i)
            if i < 0 or i + 2 > len(d):
                return 0
            if d[i + 1] in (0, 0xFF) or 0xD0 <= d[i + 1] <= 0xD7:
                i += 1 + (d[i + 1] != 0xFF)
                continue
        if d[i] != 0xFF:
            return 0
        if d[i + 1] == 0xD9:
            break
        scan = d[i + 1] == 0xDA
        i += 2 + struct.unpack_from(">H", d, i + 2)[0] if i + 4 <= len(d) else 2
    return i + 2 - at if d[i : i + 2] == b"\xff\xd9" else 0


def _bmp(d: bytes, at: int, ends: dict) -> int:
    if at + 54 > len(d):
        return 0
    size, reserved, offset, header = struct.unpack_from("<IIII", d, at + 2)
    planes, bits = struct.unpack_from("<HH", d, at + 26)
    return size if not reserved and header in (12, 40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + header <= offset <= size <= len(d) - at else 0


def _riff(d: bytes, at: int, ends: dict) -> int:
    if at + 12 > len(d):
        return 0
    (n,) = struct.unpack_from("<I", d, at + 4)
    if n < 4 or at + 8 + n > len(d) or d[at + 8 : at + 12] not in (b"WAVE", b"AVI ", b"WEBP"):
        return 0
    i = at + 12
    while i < at + 8 + n:
        if i + 8 > at + 8 + n:
            return 0
        (m,) = struct.unpack_from("<I", d, i + 4)
        i += 8 + m + (m & 1)
    return 8 + n if i in (at + 8 + n, at + 9 + n) else 0


_UPDATE = re.compile(rb"\s*(?:%(?!PDF-)|\d+\s+\d+\s+obj\b|xref\b|startxref\b)")


def _pdf(d: bytes, at: int, ends: dict) -> int:
    end = _next(ends, b"%%EOF", at)
    if end < 0 or not d[at + 5 : at + 8].replace(b".", b"").isdigit():
        return 0
    # an update follows an end at once and brings an end of its own
    while (more := _next(ends, b"%%EOF", end + 5)) >= 0 and _UPDATE.match(d, end + 5) and d.find(b"%PDF-", end + 5, more) < 0:
        end = more
    return end + 5 - at


def _zip(d: bytes, at: int, ends: dict) -> int:
    if at + 30 > len(d) or struct.unpack_from("<H", d, at + 8)[0] not in (0, 8, 9, 12, 14, 93, 95):
        return 0
    if "zip" not in ends:
        # each end record says where its archive begins, so one that is stored inside another is told apart
        ends["zip"] = {}
        for end in ends.get(b"PK\x05\x06", []):
            if end + 22 <= len(d):
                size, offset, note = struct.unpack_from("<IIH", d, end + 12)
                if end + 22 + note <= len(d) and end - size - offset >= 0 and (not size or d[end - size : end - size + 4] == b"PK\x01\x02"):
                    ends["zip"].setdefault(end - size - offset, end + 22 + note)
    return ends["zip"].get(at, at) - at


def _gzip(d: bytes, at: int, ends: dict) -> int:
    if at + 18 > len(d) or d[at + 3] & 0xE0:
        return 0
    z, i = zlib.decompressobj(31), at
    try:
        while not z.eof and i < len(d):
            data = d[i : i + (1 << 16)]
            i += len(data)
            while data and not z.eof:
                z.decompress(data, 1 << 20)
                data = z.unconsumed_tail
    except zlib.error:
        return 0
    return i - len(z.unused_data) - at if z.eof else 0


def _ogg(d: bytes, at: int, ends: dict) -> int:
    i = at
    while i + 27 <= len(d) and d[i : i + 5] == b"OggS\x00":
        n = d[i + 26]
        i += 27 + n + sum(d[i + 27 : i + 27 + n])
    return i - at if at < i <= len(d) else 0


def _crc_table(poly: int, bits: int) -> list[int]:
    out, top, full = [], 1 << (bits - 1), (1 << bits) - 1
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1 ^ poly if x & top else x << 1) & full
        out.append(x)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _flac_head(d: bytes, at: int) -> tuple[int, int] | None:
    """(bytes of a frame's header, its samples), None if there is none."""
    if at + 6 > len(d) or d[at] != 0xFF or d[at + 1] & 0xFE != 0xF8 or d[at + 3] & 1:
        return None
    block, rate = d[at + 2] >> 4, d[at + 2] & 15
    lead = d[at + 4]
    wide = 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() if lead != 0xFF else 8
    i = at + 4 + wide
    extra = {6: 1, 7: 2}.get(block, 0)
    end = i + extra + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if block == 0 or rate == 15 or 0x80 <= lead < 0xC0 or end >= len(d):
        return None
    crc = 0
    for x in d[at:end]:
        crc = _CRC8[crc ^ x]
    samples = 192 if block == 1 else 576 << (block - 2) if block < 6 else int.from_bytes(d[i : i + extra]) + 1 if block < 8 else 256 << (block - 8)
    return (end + 1 - at, samples) if crc == d[end] else None


def _flac(d: bytes, at: int, ends: dict) -> int:
    i, last, info = at + 4, 0, b""
    while not last:
        if i + 4 > len(d) or d[i] & 0x7F == 127:
            return 0
        last, kind, n = d[i] & 0x80, d[i] & 0x7F, int.from_bytes(d[i + 1 : i + 4])
        if (kind == 0) != (not info) or kind == 0 and n != 34 or i + 4 + n > len(d):
            return 0
        info = info or d[i + 4 : i + 4 + n]
        i += 4 + n
    total, done = int.from_bytes(info[10:18]) & (1 << 36) - 1, 0
    while (head := _flac_head(d, i)) and not (total and done >= total):
        # a frame ends where its checksum is 0 and another begins, or the samples or the bytes are at their end
        done += head[1]
        crc, end = 0, 0
        for j in range(i, len(d)):
            crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ d[j]]
            if crc == 0 and j >= i + head[0] + 2 and (total and done >= total or j + 1 == len(d) or _flac_head(d, j + 1)):
                end = j + 1
                break
        if not end:
            return 0
        i = end
    return i - at if done >= total else 0


def _mp4(d: bytes, at: int, ends: dict) -> int:
    i = start = at - 4
    while start >= 0 and i + 8 <= len(d) and d[i + 4 : i + 8].isalnum():
        (n,) = struct.unpack_from(">I", d, i)
        if n == 1 and i + 16 <= len(d):
            (n,) = struct.unpack_from(">Q", d, i + 8)
            least = 16
        else:
            # a box of size 0 is the last and takes what is left
            n, least = n or len(d) - i, 8
        if n < least or i + n > len(d):
            break
        i += n
    return i - start if start >= 0 and i > start else 0


VALIDATE = {
    "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "riff": _riff, "application/pdf": _pdf,
    "application/zip": _zip, "application/gzip": _gzip, "audio/ogg": _ogg, "audio/flac": _flac, "video/mp4": _mp4,
}
RIFF_TYPES = {b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo", b"WEBP": "image/webp"}


def automaton():
    found = ahocorasick.Automaton()
    for magic in (*MAGIC, *ENDS):
        found.add_word(magic.decode("latin-1"), magic)
    found.make_automaton()
    return found


def sniff(data: bytes, auto) -> list[tuple[str, int, int]]:
    """[(type, offset, length)] of the confirmed files in ``data``, by offset; files inside a file at offset 0 are listed, deeper ones are not."""
    starts: list[tuple[int, str]] = []
    ends: dict[bytes, list[int]] = {}
    for last, magic in auto.iter(data.decode("latin-1")):
        at = last + 1 - len(magic)
        if magic in MAGIC:
            starts.append((at, MAGIC[magic]))
        else:
            ends.setdefault(magic, []).append(at)
    out, free = [], 0
    for at, kind in sorted(starts):
        if at < free:
            continue
        n = VALIDATE[kind](data, at, ends)
        if n:
            begin = at - 4 if kind == "video/mp4" else at
            out.append((RIFF_TYPES[data[at + 8 : at + 12]] if kind == "riff" else kind, begin, n))
            free = begin + n if begin else 1
    return out


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """The bytes as unsigned 8-bit mono samples of a WAV file; an odd payload gets the format's pad byte."""
    pad = len(payload) & 1
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + b"\x00" * pad


def wav_samples(data: bytes) -> bytes:
    """The data chunk of a confirmed WAV file."""
    i = 12
    while i + 8 <= len(data):
        kind, n = struct.unpack_from("<4sI", data, i)
        if kind == b"data":
            return data[i + 8 : i + 8 + n]
        i += 8 + n + (n & 1)
    return b""


def encode(docs: DataFrame, declared: str = "application/octet-stream") -> DataFrame:
    """(doc_id, n_bytes, declared, media): each text's UTF-8 bytes, null as empty, padded with zeros to a positive multiple of 64, as a WAV file.

    Texts of any length are stored whole; repeated rows each; a null doc_id stays null; an empty table gives an
    empty result; extra columns are ignored.
    """

    def run(batches):
        for batch in tk.pieces(batches):
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            media = [wav(b + b"\x00" * (-len(b) % UNIT if b else UNIT)) for b in raw]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(b) for b in raw], pa.int64()), pa.array([declared] * len(raw), pa.string()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "declared", "media"])

    return columns_only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, declared string, media binary")


def inspect(media: DataFrame) -> DataFrame:
    """Sniffs a media column: (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, true_type, corrected, carved, feature).

    ``carved`` lists (type, offset, length) of files embedded behind the first byte.  The payload is the
    sample data of a WAV file, the whole blob for any other type.  A null blob counts as empty, type
    application/octet-stream; repeated rows are inspected each; an empty table gives an empty result.
    """

    def run(batches):
        auto = automaton()
        for batch in tk.pieces(batches):
            got = []
            for data, declared in zip(batch.column("media").to_pylist(), batch.column("declared").to_pylist(), strict=True):
                data = data or b""
                found = sniff(data, auto)
                true = next((kind for kind, at, _ in found if at == 0), "application/octet-stream")
                payload = wav_samples(data) if true == "audio/wav" else data
                carved = [x for x in found if x[1] > 0]
                share = np.bincount(np.frombuffer(payload, np.uint8), minlength=256) / max(1, len(payload))
                entropy = -float(sum(p * math.log2(p) for p in share if p))
                feature = f"{true};declared={declared};units={len(payload)};entropy={entropy:.4f};carved=" + ",".join(f"{k}@{a}+{n}" for k, a, n in carved)
                got.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), true, true != declared, [{"type": k, "at": a, "length": n} for k, a, n in carved], feature))
            cols = list(zip(*got, strict=True)) or [()] * 9
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.struct([("type", pa.string()), ("at", pa.int64()), ("length", pa.int64())])), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "true_type", "corrected", "carved", "feature"],
            )

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, true_type string, corrected boolean, carved array<struct<type:string,at:bigint,length:bigint>>, feature string")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
