"""Byte-level BPE: encoding and decoding of whole texts, and token counts by section.

The tokenizers library runs over Arrow batches.  Its vocabulary is built from a
file of ranks: each byte of a token is written as one printable character, and
each way to split a token into two others is a merge of the token's rank.
Offsets follow from the ids, as the tokens' bytes joined are exactly the
text's: a token reaches from the character that its first byte belongs to, to
the one that its last byte belongs to.  Decoding gathers the ids' bytes from
the reversed byte table; a character split over tokens is whole again once
their bytes are joined.

Edge cases: null and empty texts have no tokens; a text is never cut; extra
columns are ignored; rows are returned one for one, repeated ones too; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import os
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import slices
from ._spark import map_batches

#: Bytes of text encoded at once; a longer text is a slice of its own.
CHUNK = 1 << 19


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next free one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(others)}
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> bytes:
    """The file of ranks, on the driver; its size bounds what is broadcast."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}


class ByteBPE:
    """Each match of `pattern` is encoded by itself; matches met before come from a bounded memory."""

    #: Matches of either of two generations, and the longest match that is remembered.
    REMEMBERED, LONGEST = 100_000, 64

    def __init__(self, content: bytes, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = parse_ranks(content)
        shown = byte_characters()
        name = {t: "".join(shown[b] for b in t) for t in ranks}
        merges = [(name[t[:i]], name[t[i:]]) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.tokenizer = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, cache_capacity=0))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.find = regex.compile(pattern).findall
        self.young: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.old: dict[str, bytes] = {}
        back = {c: b for b, c in enumerate(shown)}
        pieces = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            pieces[r] = bytes(back[c] for c in name[t])
        #: Of each id: how many bytes it stands for, and where they begin in `table`.
        self.lengths = np.array([len(x) for x in pieces], np.int32)
        self.begins = (np.cumsum(self.lengths) - self.lengths).astype(np.int32)
        self.table = np.frombuffer(b"".join(pieces), np.uint8)

    def _learn(self, found: set[str]) -> dict[str, bytes]:
        """The ids of all matches of a slice; what isn't in use any more is forgotten by generations."""
        if len(self.young) > self.REMEMBERED:
            self.young, self.old = {}, self.young
        known = self.young
        if old := found.intersection(self.old):
            known.update((m, self.old[m]) for m in old)
        new = list(found.difference(known))
        extra = {}
        for i in range(0, len(new), 1000):
            part = new[i : i + 1000]
            # One call for all: each match is a word of its own, and ends where its bytes do.
            ids = np.array(self.tokenizer.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int32)
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(m.encode()) for m in part])) + 1
            for m, a, b in zip(part, [0, *ends.tolist()], ends.tolist()):
                (known if len(m) <= self.LONGEST else extra)[m] = ids[a:b].tobytes()
        return {**known, **extra} if extra else known

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        matches = [self.find(t) for t in texts]
        ids = self._learn(set(chain.from_iterable(matches))).__getitem__
        return [np.frombuffer(b"".join(map(ids, m)), np.int32) for m in matches]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for, gathered from the table at once."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.begins[ids] - (ends - sizes), sizes)
        at += np.arange(len(at))
        return self.table[at].tobytes()

    def offsets(self, raw: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token of a text: its first character, the end of its last one, and whether it begins or ends amid a character."""
        ends = np.cumsum(self.lengths[ids])
        begins = ends - self.lengths[ids]
        if len(raw) == 0 or raw.isascii():
            return begins, ends, np.zeros(len(ids), bool)
        head = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        char_of = np.cumsum(head) - 1
        whole = np.append(head, True)
        return char_of[begins], char_of[ends - 1] + 1, ~(whole[begins] & whole[ends])


@cache
def _loaded(content: bytes, pattern: str) -> ByteBPE:
    return ByteBPE(content, pattern)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.asarray(v, np.int32) for v in values])))


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id, the ids of the whole text, and each token's first character, for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def work(batch: pa.RecordBatch):
        bpe = _loaded(*shared.value)
        for a, b, raw in slices(batch.column(1), CHUNK):
            ids = bpe.encode([t.decode() for t in raw])
            yield {"doc_id": batch.column(0).slice(a, b - a), "ids": _lists(ids), "starts": _lists([bpe.offsets(t, x)[0] for t, x in zip(raw, ids)])}

    return map_batches(_documents(docs), work, "doc_id long, ids array<int>, starts array<int>")


def decode(encoded: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """encoded (doc_id, ids) with the bytes that the ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast((ranks, pattern))

    def work(batch: pa.RecordBatch):
        bpe = _loaded(*shared.value)
        ids = batch.column(1)
        for a in range(0, len(ids), 256):
            part = ids.slice(a, 256)
            data = [bpe.decode(np.asarray(x, np.int32)) for x in part.to_pylist()]
            yield {"doc_id": batch.column(0).slice(a, len(part)), "ids": part, "decoded": pa.array(data, pa.binary())}

    return map_batches(encoded.select("doc_id", "ids"), work, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id, ids, decoded (what decode() makes of these ids) and n_split (tokens that begin or end amid a character), for each row of docs, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def work(batch: pa.RecordBatch):
        bpe = _loaded(*shared.value)
        for a, b, raw in slices(batch.column(1), CHUNK):
            ids = bpe.encode([t.decode() for t in raw])
            split = [int(bpe.offsets(t, x)[2].sum()) for t, x in zip(raw, ids)]
            yield {"doc_id": batch.column(0).slice(a, b - a), "ids": _lists(ids), "decoded": pa.array([bpe.decode(x) for x in ids], pa.binary()), "n_split": split}

    return map_batches(_documents(docs), work, "doc_id long, ids array<int>, decoded binary, n_split long")


def section_counts(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """Tokens of each section of each text, from one encoding of the whole text.

    Sections are the text's lines, each with its line break.  A token belongs
    to the section in which its first character begins; one that starts amid a
    character counts where that character begins.  n_crossing counts tokens
    that reach into a later section.  Gives doc_id, n_tokens, n_sections,
    n_crossing, n_split (tokens that begin or end amid a character), starts
    (first character of each section) and tokens (of each section, adding up
    to n_tokens).
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def work(batch: pa.RecordBatch):
        bpe = _loaded(*shared.value)
        for a, b, raw in slices(batch.column(1), CHUNK):
            rows = [attribute(t, bpe.offsets(t, ids)) for t, ids in zip(raw, bpe.encode([t.decode() for t in raw]))]
            n_tokens, n_crossing, n_split, starts, tokens = zip(*rows)
            yield {"doc_id": batch.column(0).slice(a, b - a), "n_tokens": list(n_tokens), "n_sections": [len(s) for s in starts], "n_crossing": list(n_crossing), "n_split": list(n_split), "starts": _lists(list(starts)), "tokens": _lists(list(tokens))}

    return map_batches(_documents(docs), work, "doc_id long, n_tokens long, n_sections long, n_crossing long, n_split long, starts array<int>, tokens array<int>")


def attribute(raw: bytes, offsets: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    """Joins the character spans of tokens to the lines of one text; see section_counts."""
    first, end, split = offsets
    data = np.frombuffer(raw, np.uint8)
    breaks = np.flatnonzero(data == 10)
    if len(breaks) and not raw.isascii():
        breaks = (np.cumsum((data & 0xC0) != 0x80) - 1)[breaks]
    starts = np.concatenate([[0], breaks + 1]).astype(np.int64)
    home, reach = np.searchsorted(starts, first, side="right") - 1, np.searchsorted(starts, end - 1, side="right") - 1
    return len(first), int((reach > home).sum()), int(split.sum()), starts, np.bincount(home, minlength=len(starts))
