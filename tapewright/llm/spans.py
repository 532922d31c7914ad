"""Substring dedup over sliding runs of consecutive sentences.

A sentence ends at a line break or at . ! ? before white space.  A stretch of
8 places between words without such an end is cut at the place where the hash
of the two words beside it is least, so that cuts depend on nearby words only
and come together again inside any repeated passage.  From every piece the
shortest run of at least 27 words that begins there, and the shortest that ends
there, are hashed over their words (A-Z lower-cased, punctuation left out).
Runs are joined globally on the hash.  Those that several documents hold stay in
the one with the least doc_id; in the others every piece that such a run covers
is removed, if 34 words or more go together.  With `within` every run counts, and
what a document itself has said before goes as well: of equal runs in a text the
first stays, and those that begin behind its end are removed.  Without it, what
only one document repeats stays, and so do a few words repeated to no end (runs
of which over nine tenths stand among the eight words before), also where several
documents have them, since each document repeats them by itself.

Any 50 words that two documents share hold a run of both: of their 49 places,
the first cut that both have is among the first 8, one that ends the run from
it is at most 34 places on, and cuts are equal from the 8th to the 42nd place.
Of a passage of over 50 words at most 8 words stay at either end, and none at
an end that is a sentence's.

Edge cases: null texts give empty ones; a text without words stays as it is;
rows that share a doc_id count as one document, of which each row loses what
was found in its own text (also with `within`, which looks at each row alone);
rows without a doc_id stay as they are and count for nothing; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import ALNUM, mix64, powers, signed, slices, words_of
from ._spark import BitFilter, map_batches, settle

#: LEAST_WORDS + 3 * REACH <= 51, and LEAST_GONE + 2 * REACH <= 50; REACH is a power of 2.
REACH, LEAST_WORDS, LEAST_GONE = 8, 27, 34
#: A word is said again if it is among so many before it.
NEAR = 8
_END = bytes(int(b in b".!?") for b in range(256))
_BREAK = bytes(int(b in b" \t\n\r\x0b\x0c\"')]") for b in range(256))


@dataclass
class Sentences:
    """Of some texts: byte spans in `blob` from the first word on, sentence bounds by text, and runs first..last with their hashes."""

    blob: bytes
    starts: np.ndarray
    bounds: np.ndarray
    first: np.ndarray
    last: np.ndarray
    hashes: np.ndarray
    words: np.ndarray

    def owners(self) -> np.ndarray:
        """The text of each run, ascending."""
        return np.searchsorted(self.bounds, self.first, side="right") - 1


def _least_places(new: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places (before each word) that are least in any REACH neighbouring ones; a sentence's start is less than all others."""
    n = len(words)
    key = np.zeros(n, np.uint64)
    key[1:] = mix64(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) | np.uint64(1)
    key[new] = 0
    if n < REACH:
        return new
    least, step = key, 1
    while step < REACH:
        least, step = np.minimum(least[:-step], least[step:]), 2 * step
    most = np.concatenate([np.zeros(REACH - 1, np.uint64), least, np.zeros(REACH - 1, np.uint64)])
    step = 1
    while step < REACH:
        most, step = np.maximum(most[:-step], most[step:]), 2 * step
    return most == key


def sentences_of(texts: list[bytes], within: bool) -> Sentences:
    w = words_of(texts, ALNUM)
    n = len(w.starts)
    ends = np.frombuffer(w.blob.translate(_END), np.uint8).astype(bool)
    breaks = np.frombuffer(w.blob.translate(_BREAK), np.uint8).astype(bool)
    mark = ends.copy()
    mark[:-1] &= breaks[1:]
    mark |= np.frombuffer(w.blob, np.uint8) == 10
    count = np.concatenate([[0], np.cumsum(mark)])
    new = np.ones(n, bool)
    new[1:] = count[w.starts[1:]] > count[w.ends[:-1]]
    if n:
        new[w.bounds[:-1][np.diff(w.bounds) > 0]] = True
        new |= _least_places(new, w.hashes)
    at = np.flatnonzero(new)
    size = np.diff(np.concatenate([at, [n]]))
    if not n:
        none = np.zeros(0, np.int64)
        return Sentences(w.blob, none, np.zeros(len(texts) + 1, np.int64), none, none, none.view(np.uint64), none)
    bounds = np.searchsorted(at, w.bounds)
    total = np.concatenate([[0], np.cumsum(size)])
    m = len(at)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    each = np.arange(m)
    forth = np.searchsorted(total, total[:-1] + LEAST_WORDS) - 1
    ok = forth < bounds[owner + 1]
    back = np.searchsorted(total, total[1:] - LEAST_WORDS, side="right") - 1
    ok_back = back >= bounds[owner]
    pair = np.unique(np.concatenate([each[ok] * m + forth[ok], back[ok_back] * m + each[ok_back]]))
    first, last = pair // m, pair % m
    if not within:
        again = np.concatenate([[0], np.cumsum(_said_again(w.hashes, w.bounds))])
        begin, end = total[first], total[last + 1]
        telling = 10 * (again[end] - again[begin]) <= 9 * (end - begin)
        first, last = first[telling], last[telling]
    up, down = powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hashes * up[:n], dtype=np.uint64)])
    begin, end = total[first], total[last + 1]
    hashes = mix64((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return Sentences(w.blob, w.starts[at], bounds, first, last, hashes, size)


def _said_again(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which words stand among the NEAR before them in their text."""
    place = np.arange(len(words)) - np.repeat(bounds[:-1], np.diff(bounds))
    out = np.zeros(len(words), bool)
    for lag in range(1, min(NEAR, len(words) - 1) + 1):
        out[lag:] |= (words[lag:] == words[:-lag]) & (place[lag:] >= lag)
    return out


def _alike(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal runs of a text stand side by side, in the order of the text, and which of them are the first."""
    order = np.lexsort((hashes, owner))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(owner[order]) != 0) | (np.diff(hashes[order]) != 0)
    return order, new


def _said_before(s: Sentences) -> np.ndarray:
    """Which runs begin behind the end of an equal one of their text, its first."""
    order, new = _alike(s.owners(), s.hashes)
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    out = np.zeros(len(order), bool)
    out[order] = s.first[order] > s.last[head]
    return out


def _runs(docs: DataFrame, within: bool, wanted: BitFilter | None = None) -> DataFrame:
    """(doc_id, h): hashes of the runs of each document, each once for a row, or only those that may be wanted."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def work(batch: pa.RecordBatch):
        ids = batch.column(0).to_numpy()
        for a, b, texts in slices(batch.column(1)):
            s = sentences_of(texts, within)
            at = np.flatnonzero(shared.value.may_hold(s.hashes)) if shared.value else np.arange(len(s.hashes))
            owner = s.owners()[at]
            order, new = _alike(owner, s.hashes[at])
            once = order[new]
            yield {"doc_id": ids[a:b][owner[once]], "h": signed(s.hashes[at[once]])}

    return map_batches(docs.filter("doc_id is not null").select("doc_id", "text"), work, "doc_id long, h long")


def _long_enough(gone: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Without stretches of fewer than LEAST_GONE words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8)))
    total = np.concatenate([[0], np.cumsum(words)])
    for a, b in zip(edges[::2], edges[1::2]):
        gone[a:b] = total[b] - total[a] >= LEAST_GONE
    return gone


def dedup_spans(docs: DataFrame, within: bool = False) -> DataFrame:
    """doc_id, the text that stays, n_sentences, n_removed and n_words_removed for each row of docs; within: every run counts, and repeats inside one document go as well."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = _runs(docs, within).groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first <> last").drop("last")
    first = settle(first, "repeats")
    later = _runs(docs, within, BitFilter(first.select("h"), 8, 25)).join(first, "h").filter("doc_id <> first")
    later = later.groupBy("doc_id").agg(F.collect_set("h").alias("h"))
    joined = docs.join(later.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "h")

    def work(batch: pa.RecordBatch):
        ids, held = batch.column(0), batch.column(2)
        for a, b, texts in slices(batch.column(1)):
            s = sentences_of(texts, within)
            said = _said_before(s) if within else np.zeros(len(s.hashes), bool)
            of = np.searchsorted(s.owners(), np.arange(b - a + 1))
            out, n_removed, n_words = [], np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
            ends = np.cumsum([len(t) + 1 for t in texts])
            for x in range(b - a):
                text, runs = texts[x], slice(of[x], of[x + 1])
                base, top = int(s.bounds[x]), int(s.bounds[x + 1])
                if held[a + x].is_valid:
                    said[runs] |= np.isin(signed(s.hashes[runs]), held[a + x].values.to_numpy())
                if ids[a + x].is_valid and said[runs].any():
                    edges = np.zeros(top - base + 1, np.int64)
                    np.add.at(edges, s.first[runs][said[runs]] - base, 1)
                    np.add.at(edges, s.last[runs][said[runs]] - base + 1, -1)
                    gone = _long_enough(np.cumsum(edges[:-1]) > 0, s.words[base:top])
                    n_removed[x], n_words[x] = gone.sum(), s.words[base:top][gone].sum()
                    begin = ends[x] - len(text) - 1
                    cuts = [0, *(s.starts[base + 1 : top] - begin).tolist(), len(text)]
                    text = b"".join(text[cuts[u] : cuts[u + 1]] for u in range(top - base) if not gone[u])
                out.append(text.decode("utf-8", "replace"))
            yield {"doc_id": ids.slice(a, b - a), "text": pa.array(out, pa.string()), "n_sentences": np.diff(s.bounds), "n_removed": n_removed, "n_words_removed": n_words}

    return map_batches(joined, work, "doc_id long, text string, n_sentences long, n_removed long, n_words_removed long")
