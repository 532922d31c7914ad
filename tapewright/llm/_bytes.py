"""Word and shingle hashing over whole Arrow batches of UTF-8 text.

Words are found on the bytes themselves: both word definitions used in this
subpackage are closed under UTF-8 (every byte of a code point from U+0080 on
is itself at least 0x80), so no text is decoded.  A word's hash is a
polynomial over random byte values modulo 2**64, taken for all words of a
block at once from one running sum, and then mixed.  Only a slice of a batch
is held as Python objects, and only a block of a slice as 64-bit numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_UPPER = bytes(range(65, 91))
FOLD = bytes.maketrans(_UPPER, _UPPER.lower())


def _byte_class(inside) -> bytes:
    return bytes(int(inside(b)) for b in range(256))


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after folding: digits, a-z and all beyond ASCII.
ALNUM = _byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: ``[^\x20\x09-\x0D]``: all but ASCII white space.
NOT_SPACE = _byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_STEPS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Bytes of text taken out of a batch at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 18
#: Bytes of text hashed at once; a longer word is a block of its own.
BLOCK_BYTES = 1 << 16


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INVERSE):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


_up, _down = _powers_to(BLOCK_BYTES + 1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; those beyond a block aren't kept."""
    return (_up[:n], _down[:n]) if n <= len(_up) else _powers_to(n)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of rows of at most `limit` bytes together, or of one row, and their texts as UTF-8 (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    first, held = 0, 0
    for i, size in enumerate([*sizes, None]):
        if size is None or held and held + size > limit:
            if i > first:
                yield first, i, [x or b"" for x in column.slice(first, i - first).to_pylist()]
            first, held = i, 0
        held += (size or 0) + 1


@dataclass
class Words:
    """Words of some texts, in order: byte spans in `blob`, hashes, and bounds[i]:bounds[i + 1] for text i."""

    blob: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    def word(self, i: int) -> bytes:
        return self.blob[self.starts[i] : self.ends[i]]


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, i, n = np.zeros(len(starts), np.uint64), 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, side="right")))
        base = starts[i]
        up, down = powers(int(ends[j - 1] - base) + 1)
        sums = np.zeros(len(up), np.uint64)
        np.multiply(_BYTE_VALUES[raw[base : ends[j - 1]]], up[:-1], out=sums[1:])
        np.cumsum(sums, out=sums)
        begin = starts[i:j] - base
        out[i:j] = (sums[ends[i:j] - base] - sums[begin]) * down[begin]
        i = j
    return mix64(out)


def words_of(texts: list[bytes], inside: bytes = ALNUM, fold: bool = True) -> Words:
    """Lower-cases A-Z (if fold) and finds the maximal runs of bytes in the class."""
    blob = b"\n".join([*texts, b""])
    blob = blob.translate(FOLD) if fold else blob
    n = len(blob)
    ends_of_text = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    flags = np.zeros(n + 2, np.int8)
    flags[1:-1] = np.frombuffer(blob.translate(inside), np.int8)
    edges = np.flatnonzero(np.diff(flags))
    starts, ends = edges[::2], edges[1::2]
    hashes = _word_hashes(np.frombuffer(blob, np.uint8), starts, ends)
    bounds = np.concatenate([[0], np.searchsorted(starts, ends_of_text)]).astype(np.int64)
    return Words(blob, starts, ends, hashes, bounds)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words, in order; with fewer words, none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return hashes[:0]
    out = np.full(n, (k * 0x632BE59BD9B4E019) % 2**64, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * _STEPS[j]
    return mix64(out)


def signed(h: np.ndarray) -> np.ndarray:
    """uint64 as the long that Spark has."""
    return h.view(np.int64)
