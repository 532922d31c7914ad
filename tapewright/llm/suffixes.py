"""Removal of repeated byte strings by distributed prefix doubling.

Every byte covered by a string of `least` bytes that also starts somewhere else
goes.  Positions are ranked by strings of growing length, 64, 128, 192 and at
last `least` bytes: a string is named by the pair of ranks of two shorter ones,
one at the position and one at an offset behind it (64 is 32 at 0 and at 32,
128 is 64 at 0 and 64, 192 is 128 at 0 and 64, 200 is 192 at 0 and 8).  Spark
groups the pairs of all documents; positions whose pair is unique drop out, and
the rest are ranked again at the next length, until it reaches the threshold.

Two things keep the rows few.  At lengths below the threshold only sampled
positions are ranked: those whose name is the least among the positions that a
string of `least` bytes leaves for it.  The choice hangs on that string's bytes
alone, so wherever it stands, the same place in it is sampled, and none is
missed.  And a sampled position whose whole surroundings (all strings of
`least` bytes around it, at most 336 bytes) stand elsewhere too is settled at
once.  What goes on to the next length are the strings around positions that
share their name with others but not their surroundings, and around one position
of each kind of surroundings among these, as their partner.  At the last length
every position left is ranked, and nothing is left open.

Names are 64-bit hashes; two of them, of different hash functions, decide that
strings are equal.  Texts are UTF-8 bytes, so a cut may fall inside a character.

Edge cases: a null text is empty and stays null; texts under `least` bytes lose
nothing; copies lose all they have, and so do repeated rows, also under one
doc_id; a text repeating itself (a run of one character, say) loses what is
covered by strings that start at two places in it; long texts are worked on in
chunks; an empty table gives an empty result; extra columns stay, whatever
their names, but for the new ones, which replace them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import mix64, powers, slices
from ._spark import BitFilter, columns_of, discard, map_batches, settle, whole_row

LEAST = 200
#: Lengths ranked below the threshold; the pair's second rank stands at (length - part) of this part: half, or the length before.
LENGTHS = (64, 128, 192)
#: Starts of strings looked at together; a longer text is taken in such chunks.
CHUNK = 1 << 16

_rng = np.random.Generator(np.random.PCG64(5077))
_FIRST, _SECOND = (_rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


_RANKS = "id long, off long, k long, c long, b long, e long"
_PIECES = "id long, off long, text binary, b array<long>, e array<long>"


class Names:
    """Hashes of any substring of some bytes, by running sums; `kind` tells two hash functions apart."""

    def __init__(self, raw: np.ndarray, kind: np.ndarray):
        up, self.down = powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(kind[raw] * up[: len(raw)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[begin]) * self.down[begin])

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix64((self.sums[length:] - self.sums[:n]) * self.down[:n])


def _extreme(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over every `width` consecutive values."""
    n = len(x) - width + 1
    if width == 1:
        return x
    fill = np.full(-len(x) % width, np.uint64(2**64 - 1) if op is np.minimum else np.uint64(0))
    rows = np.concatenate([x, fill]).reshape(-1, width)
    ahead = op.accumulate(rows, axis=1).ravel()
    behind = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:n], ahead[width - 1 : width - 1 + n])


def sampled(names: np.ndarray, width: int, asked: np.ndarray | None = None) -> np.ndarray:
    """Places that are the least of some `width` consecutive ones (of those that begin where asked); equal ones all count."""
    names = np.maximum(names, np.uint64(1))
    least = _extreme(names, width, np.minimum)
    if asked is not None:
        least = np.where(asked, least, np.uint64(0))
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_extreme(np.concatenate([edge, least, edge]), width, np.maximum) == names)


def _ranked(text: bytes, length: int, part: int, least: int, asked: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """By chunk: name, name of the surroundings, and where these begin and end, of the sampled positions of a text.

    asked: whether the string of `least` bytes that starts here is still open; None: all are.
    """
    n, reach = len(text), least - length
    whole = n - least + 1
    for at in range(0, whole, CHUNK):
        last = min(at + CHUNK, whole)  # strings that start at at .. last - 1
        if asked is not None and not asked[at:last].any():
            continue
        low, high = max(0, at - reach), min(n, last - 1 + least + reach)
        raw = np.frombuffer(text, np.uint8, high - low, low)
        first, second = Names(raw, _FIRST), Names(raw, _SECOND)
        half = first.every(part)
        name = lambda a, b: mix64(half[a - low : b - low] * np.uint64(3) + half[a - low + length - part : b - low + length - part])  # noqa: E731, B023
        names = name(at, last + reach)
        place = sampled(names, reach + 1, None if asked is None else asked[at:last]) + at
        if at and reach:  # a place in two chunks is sampled in each by itself; the second one must not count it again
            place = place[~np.isin(place, sampled(name(low, at + reach), reach + 1, None if asked is None else asked[low:at]) + low)]
        begin, end = np.maximum(place - reach, 0), np.minimum(place, whole - 1)
        if asked is not None:  # from the first open string around the place to the last one
            near = np.flatnonzero(asked[low : last + reach]) + low
            begin, end = near[np.searchsorted(near, begin)], near[np.searchsorted(near, end, side="right") - 1]
        end = end + least
        around = second.of(begin - low, end - low) + (place - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        yield names[place - at], mix64(around), begin, end


def _positions(pieces: DataFrame, length: int, part: int, least: int) -> DataFrame:
    """(id, off, k, c, b, e) of the sampled positions of pieces (id, off, text, b, e): name, surroundings' name, where these begin and end in the document.

    b, e of a piece: the stretches whose strings are open (null: all of it).
    """

    def work(batch: pa.RecordBatch):
        ids, offs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for a, b, texts in slices(batch.column(2)):
            # Texts are ranked end to end; no string that crosses from one to the next is open.
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            starts = np.cumsum(sizes) - sizes
            edges = np.zeros(int(sizes.sum()) + 2, np.int32)
            of = np.arange(len(texts))
            whole = batch.column(3).slice(a, b - a).is_null().to_numpy(zero_copy_only=False)
            listed = np.repeat(of, np.where(whole, 0, batch.column(3).slice(a, b - a).value_lengths().fill_null(0).to_numpy()))
            begin, end = (batch.column(c).slice(a, b - a).flatten().to_numpy() - offs[a:b][listed] + starts[listed] for c in (3, 4))
            np.add.at(edges, np.concatenate([starts[whole], begin]), 1)
            np.add.at(edges, np.concatenate([(starts + sizes)[whole], end]) - least + 1, -1)
            asked = np.cumsum(edges)[: max(0, len(edges) - 2 - least + 1)] > 0
            for k, c, x, y in _ranked(b"".join(texts), length, part, least, asked):
                i = np.searchsorted(starts, x, side="right") - 1
                move = offs[a + i] - starts[i]
                yield {"id": ids[a + i], "off": offs[a + i], "k": k.view(np.int64), "c": c.view(np.int64), "b": x + move, "e": y + move}

    return map_batches(pieces.filter(F.octet_length("text") >= least), work, _RANKS)


def _cut(pieces: DataFrame, zones: DataFrame) -> DataFrame:
    """The zones (id, off, b, e) of pieces as pieces of their own: bytes of zones that overlap are one piece, which lists them."""
    held = zones.groupBy("id", "off").agg(F.sort_array(F.collect_list(F.struct("b", "e"))).alias("zones"))
    joined = pieces.select("id", "off", "text").join(held.hint("shuffle_hash"), ["id", "off"]).select("id", "off", "text", F.col("zones.b").alias("b"), F.col("zones.e").alias("e"))

    def work(batch: pa.RecordBatch):
        ids, offs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for a, b, texts in slices(batch.column(2)):
            out: dict[str, list] = {"id": [], "off": [], "text": [], "b": [], "e": []}
            for i, text in enumerate(texts):
                begin, end = (batch.column(c)[a + i].values.to_numpy() for c in (3, 4))
                for x, y in zip(*merged(begin, end)):
                    own = slice(*np.searchsorted(begin, [x, y]))
                    out["id"].append(ids[a + i]), out["off"].append(x), out["text"].append(text[x - offs[a + i] : y - offs[a + i]])
                    out["b"].append(begin[own]), out["e"].append(end[own])
            yield out

    return map_batches(joined, work, _PIECES)


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals sorted by begin, joined where they overlap or touch."""
    if not len(begin):
        return begin, end
    most = np.maximum.accumulate(end)
    new = np.concatenate([[True], begin[1:] > most[:-1]])
    return begin[new], np.concatenate([most[:-1][new[1:]], most[-1:]])


def repeated_spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(id, b, e): spans of bytes of docs (id, text) that hold a string of `least` bytes found elsewhere, overlapping; ids are distinct."""
    spans = None
    all_of_it = F.lit(None).cast("array<long>")
    pieces = docs.select("id", F.lit(0).cast("long").alias("off"), F.col("text").cast("binary").alias("text"), all_of_it.alias("b"), all_of_it.alias("e"))
    shorter = [x for x in LENGTHS if x < least]
    for i, length in enumerate([*shorter, least]):
        shorter_by_one = shorter[i - 1] if i else 0
        part = shorter_by_one if 2 * shorter_by_one >= length else -(-length // 2)
        ranks = settle(_positions(pieces, length, part, least), f"ranks{length}", "zstd")
        several = settle(ranks.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k"), "shared")
        shared = settle(_maybe(ranks, BitFilter(several.select(F.col("k").alias("h")), 16)).join(several, "k", "left_semi"), "sharing")
        kinds = settle(shared.groupBy("k", "c").agg(F.count("*").alias("n"), F.min(F.struct("id", "off", "b", "e")).alias("one")), "kinds")
        discard(ranks, several)
        found = settle(shared.join(kinds.filter("n > 1").select("k", "c"), ["k", "c"], "left_semi").select("id", "b", "e"), "spans")
        spans = found if spans is None else spans.union(found)
        discard(shared)
        if length == least:
            discard(kinds, pieces)
            return spans
        lone = kinds.filter("n = 1")
        zones = lone.union(kinds.filter("n > 1").join(lone.select("k").distinct(), "k", "left_semi")).select("one.*")
        pieces, before = settle(_cut(pieces, zones), f"pieces{length}", "zstd"), pieces
        discard(kinds, before)
    return spans


def _maybe(ranks: DataFrame, filter_: BitFilter) -> DataFrame:
    """Without most rows whose name is no shared one, so that fewer are shuffled; past the filter's bound more stay, to be dropped by the join."""
    shared = ranks.sparkSession.sparkContext.broadcast(filter_)

    def work(batch: pa.RecordBatch):
        keep = shared.value.may_hold(batch.column("k").to_numpy())
        yield {n: batch.column(n).filter(pa.array(keep)) for n in batch.schema.names}

    return map_batches(ranks, work, _RANKS)


def drop_repeated_bytes(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with kept (the bytes that stay, null for a null text), n_bytes, n_removed and n_spans (maximal removed runs) behind the other columns."""
    new = ("kept", "n_bytes", "n_removed", "n_spans")
    rows = docs.select(F.monotonically_increasing_id().alias("id"), F.col("text").cast("string").alias("text"), whole_row(docs.drop("text")).alias("row"))
    rows = settle(rows, "texts", "zstd")  # ids are those of this table from now on
    spans = repeated_spans(rows.select("id", "text"), least)
    held = spans.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("b", "e"))).alias("spans"))
    joined = rows.select("id", "text", "row").join(held.hint("shuffle_hash"), "id", "left")
    joined = joined.select("text", F.col("spans.b").alias("b"), F.col("spans.e").alias("e"), "row")

    def work(batch: pa.RecordBatch):
        for a, b, texts in slices(batch.column(0)):
            kept, removed, runs = [], [], []
            for i, text in enumerate(texts):
                begin, end = batch.column(1)[a + i], batch.column(2)[a + i]
                if begin.is_valid:
                    x, y = merged(begin.values.to_numpy(), end.values.to_numpy())
                    cuts = [0, *np.stack([x, y], 1).ravel().tolist(), len(text)]
                    kept.append(b"".join(text[p:q] for p, q in zip(cuts[::2], cuts[1::2])))
                    removed.append(int((y - x).sum())), runs.append(len(x))
                else:
                    kept.append(text), removed.append(0), runs.append(0)
            blank = batch.column(0).slice(a, b - a).is_null().to_pylist()
            yield {"kept": [None if z else k for z, k in zip(blank, kept)], "n_bytes": [len(t) for t in texts], "n_removed": removed, "n_spans": runs, "text": batch.column(0).slice(a, b - a), "row": batch.column(3).slice(a, b - a)}

    schema = T.StructType([T.StructField("kept", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in new[1:]), joined.schema["text"], joined.schema["row"]])
    out = map_batches(joined, work, schema)
    columns = [c for c in docs.columns if c not in new]
    placed = [F.col("text") if c == "text" else columns_of(F.col("row"), [c])[0] for c in columns]
    return out.select(*placed, *new)
