"""Media columns as MPEG audio: frames that carry a payload, and a parser for any such stream.

write_stream lays a payload out as the ancillary bytes of MPEG-1 Layer III
frames (mono, 48 kHz, checksummed, silent), 192 bytes to a frame, at two bit
rates, behind an ID3v2 tag and a frame with a Xing table.  read_stream parses
tags at either end (ID3v2, ID3v1, APE), finds frame headers, resynchronises
after foreign bytes (a header that does not directly follow a frame counts only
if another one or the end follows its own frame), checks the checksums of
Layers I and III (what one of Layer II covers depends on its allocation, so
those frames count as not checked), reads the Xing or VBRI table and holds its
marks against the frames, and gives exact durations (samples and rate) and the
byte offset of every frame, which is the seek table.

Edge cases: null and empty texts are 192 spaces; equal texts give equal bytes;
a stream without any frame has no frames, rate 0 and an empty payload; a null
stream counts as empty; extra columns are ignored.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import slices
from ._spark import map_batches

UNIT = 192

# Fixed values of the MPEG audio format: bit rates in kbit/s by (version 1 or 2, layer), sample rates by version bits.
BIT_RATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    layer: int
    kbps: int
    rate: int
    samples: int
    size: int
    checked: bool
    side: int
    #: Bytes behind the checksum that it covers; 0 if that is not known.
    covered: int


@cache
def header_of(b1: int, b2: int, b3: int) -> Header | None:
    """The header whose first byte is 0xFF; None if it is not one (free-format streams are not read)."""
    if b1 & 0xE0 != 0xE0:
        return None
    version, layer, rate_index, kbps_index = b1 >> 3 & 3, 4 - (b1 >> 1 & 3), b2 >> 2 & 3, b2 >> 4
    if version == 1 or layer == 4 or rate_index == 3 or kbps_index in (0, 15) or b3 & 3 == 2:
        return None
    major = 1 if version == 3 else 2
    kbps, rate, padding = BIT_RATES[major, layer][kbps_index - 1], SAMPLE_RATES[version][rate_index], b2 >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and major == 2 else 1152
    size = (samples // 32 * kbps * 1000 // rate + padding) * 4 if layer == 1 else samples // 8 * kbps * 1000 // rate + padding
    mono = b3 >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if major == 1 else (9 if mono else 17)
    bound = 4 * (b3 >> 4 & 3) + 4 if b3 >> 6 == 1 else 32  # from here on both channels share their allocation
    covered = {1: 16 if mono else bound + (32 - bound) // 2, 2: 0, 3: side}[layer]
    return Header(layer, kbps, rate, samples, size, not b1 & 1, side, covered)


@cache
def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, table << 1 ^ 0x8005, table << 1) & 0xFFFF
    return table


def crc16(rows: np.ndarray) -> np.ndarray:
    """Of each row of bytes: polynomial 0x8005 from 0xFFFF."""
    crc = np.full(len(rows), 0xFFFF, np.uint32)
    for column in rows.T:
        crc = (crc << 8 & 0xFFFF) ^ _crc_table()[(crc >> 8) ^ column]
    return crc


def _tag(text: str) -> bytes:
    body = b"\x00" + text.encode("latin-1")
    frame = b"TSSE" + struct.pack(">I", len(body)) + b"\0\0" + body
    n = len(frame)
    return b"ID3\x03\0\0" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + frame


_HEAD = {80: bytes((0xFF, 0xFA, 0x64, 0xC0)), 96: bytes((0xFF, 0xFA, 0x74, 0xC0))}
_DATA = 4 + 2 + 17


def write_stream(payload: bytes) -> bytes:
    """A stream for a payload of a positive multiple of UNIT bytes; every eighth frame has the higher bit rate."""
    n = len(payload) // UNIT
    high = np.arange(n) % 8 == 7
    sizes = np.where(high, 288, 240)
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(at[-1], np.uint8)
    heads = np.stack([np.frombuffer(_HEAD[k], np.uint8) for k in (80, 96)])[high.astype(int)]
    out[at[:-1, None] + np.arange(4)] = heads
    crc = crc16(np.concatenate([heads[:, 2:], np.zeros((n, 17), np.uint8)], 1))
    out[at[:-1] + 4], out[at[:-1] + 5] = crc >> 8, crc & 255
    out[at[:-1, None] + _DATA + np.arange(UNIT)] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    toc = np.searchsorted(np.arange(n + 1) * 100, np.arange(100) * n, side="right") - 1
    total = 240 + int(at[-1])
    marks = bytes(np.minimum(255, (240 + at[toc]) * 256 // total).astype(np.uint8))
    xing = bytes((0xFF, 0xFB, 0x64, 0xC0)) + bytes(17) + b"Xing" + struct.pack(">III", 7, n, total) + marks
    return _tag("tapewright") + xing.ljust(240, b"\0") + out.tobytes()


@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    skipped: int = 0
    bad_crc: int = 0
    checked: int = 0
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    toc: bytes = b""
    #: How far a mark of the table is from its frame at most, in 256ths of the stream; None without a table.
    toc_off: int | None = None
    payload: bytes = b""

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def rate(self) -> int:
        return self.headers[0].rate if self.headers else 0

    def frame_at(self, seconds: float) -> int | None:
        """The byte offset of the frame that sounds at a time; None outside the stream."""
        at = np.searchsorted(np.cumsum([h.samples for h in self.headers]), seconds * self.rate, side="right")
        return self.offsets[at] if seconds >= 0 and at < len(self.offsets) else None


def _header_at(data: bytes, at: int) -> Header | None:
    return header_of(data[at + 1], data[at + 2], data[at + 3]) if at + 4 <= len(data) and data[at] == 0xFF else None


def read_stream(data: bytes) -> Stream:
    s, at, end = Stream(), 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        n = 0
        for b in data[at + 6 : at + 10]:
            n = n << 7 | b & 127
        s.tags.append(f"ID3v2.{data[at + 3]}")
        at += 10 + n + 10 * (data[at + 5] >> 4 & 1)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        s.tags.append("ID3v1")
        end -= 128
    if end - at >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, flags = (int.from_bytes(data[end - k : end - k + 4], "little") for k in (20, 12))
        size += 32 * (flags >> 31)
        if 32 <= size <= end - at:
            s.tags.append("APE")
            end -= size
    first, synced, begin = True, False, at
    while at < end:
        h = _header_at(data, at)
        after = at + h.size if h else 0
        if h is None or after > end or not synced and after < end and _header_at(data, after) is None:
            onward = data.find(b"\xff", at + 1, end)
            onward = end if onward < 0 else onward
            s.skipped += onward - at
            at, synced = onward, False
            continue
        mark = at + 4 + 2 * h.checked + h.side
        if first and data[mark : mark + 4] in (b"Xing", b"Info"):
            flags, mark = int.from_bytes(data[mark + 4 : mark + 8], "big"), mark + 8
            if flags & 1:
                s.vbr_frames, mark = int.from_bytes(data[mark : mark + 4], "big"), mark + 4
            if flags & 2:
                s.vbr_bytes, mark = int.from_bytes(data[mark : mark + 4], "big"), mark + 4
            if flags & 4:
                s.toc = data[mark : mark + 100]
            begin = at
        elif first and data[at + 36 : at + 40] == b"VBRI":
            s.vbr_bytes, s.vbr_frames = (int.from_bytes(data[at + 46 + k : at + 50 + k], "big") for k in (0, 4))
        else:
            s.offsets.append(at)
            s.headers.append(h)
        first, synced, at = False, True, after
    _check(s, data)
    if len(s.toc) == 100 and s.offsets:
        n = len(s.offsets)
        exact = (np.array(s.offsets)[np.arange(100) * n // 100] - begin) * 256 // max(1, s.vbr_bytes or end - begin)
        s.toc_off = int(np.abs(np.minimum(255, exact) - np.frombuffer(s.toc, np.uint8)).max())
    return s


def _check(s: Stream, data: bytes) -> None:
    """Checksums of frames, and the payload of those that have room for it."""
    raw, at = np.frombuffer(data, np.uint8), np.array(s.offsets, np.int64)
    sizes = np.array([h.covered if h.checked and h.covered and h.size >= 6 + h.covered else 0 for h in s.headers], np.int64)
    for n in {int(x) for x in sizes if x > 0}:
        own = at[sizes == n]
        stored = raw[own + 4].astype(np.uint32) << 8 | raw[own + 5]
        covered = np.concatenate([raw[own[:, None] + np.arange(2, 4)], raw[own[:, None] + 6 + np.arange(n)]], 1)
        s.checked += len(own)
        s.bad_crc += int((crc16(covered) != stored).sum())
    roomy = at[np.array([h.checked and h.side == 17 and h.size >= _DATA + UNIT for h in s.headers], bool)] if s.headers else at
    s.payload = raw[roomy[:, None] + _DATA + np.arange(UNIT)].tobytes() if len(roomy) else b""


def padded(text: bytes) -> bytes:
    """Spaces appended up to a positive multiple of UNIT."""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b" ")


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media, the stream that holds it."""

    def work(batch: pa.RecordBatch):
        for a, b, texts in slices(batch.column(1)):
            yield {"doc_id": batch.column(0).slice(a, b - a), "n_bytes": [len(t) for t in texts], "media": pa.array([write_stream(padded(t)) for t in texts], pa.binary())}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, "doc_id long, n_bytes long, media binary")


def read(media: DataFrame) -> DataFrame:
    """media (doc_id, n_bytes, media) with what parsing the stored bytes gives."""

    def work(batch: pa.RecordBatch):
        for a, b, streams in slices(batch.column(2)):
            s = [read_stream(x) for x in streams]
            ends = np.concatenate([[0], np.cumsum([len(x.offsets) for x in s])]).astype(np.int32)
            yield {
                "doc_id": batch.column(0).slice(a, b - a), "n_bytes": batch.column(1).slice(a, b - a), "media": batch.column(2).slice(a, b - a),
                "payload": pa.array([x.payload for x in s], pa.binary()), "frames": [len(x.offsets) for x in s], "samples": [x.samples for x in s], "rate": [x.rate for x in s], "seconds": [x.samples / x.rate if x.rate else 0.0 for x in s], "toc_off": [x.toc_off for x in s],
                "kbps": [sorted({h.kbps for h in x.headers}) for x in s], "checked": [x.checked for x in s], "bad_crc": [x.bad_crc for x in s], "skipped": [x.skipped for x in s], "tags": [x.tags for x in s],
                "vbr_frames": [x.vbr_frames for x in s], "vbr_bytes": [x.vbr_bytes for x in s], "toc": pa.array([x.toc for x in s], pa.binary()),
                "seek": pa.ListArray.from_arrays(ends, np.concatenate([np.array(x.offsets, np.int64) for x in s])),
            }

    return map_batches(media.select("doc_id", "n_bytes", "media"), work, "doc_id long, n_bytes long, media binary, payload binary, frames long, samples long, rate long, seconds double, toc_off long, kbps array<int>, checked long, bad_crc long, skipped long, tags array<string>, vbr_frames long, vbr_bytes long, toc binary, seek array<long>")
