"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of ten consecutive words (a shorter item
is one window).  A window is a set of five-word shingles, and containment
needs all of them, so the necessary prefix is one: its rarest shingle in the
corpus.  Documents first give the positions of shingles that may occur in the
benchmark (a bit filter that grows with it, to 16 MB at most); their counts
order the shingles, each window is joined on its rarest one, its place in the
window bounds where the window would begin and end in the document, and the
words there are then compared with the window's.

Edge cases: null or wordless texts have no words and no hits; wordless items
have no window; an item listed twice counts once; rows that repeat a document
are each returned, and rows that share a doc_id are judged each by its own text;
null item ids are ignored; extra columns are ignored, or kept by
drop_contaminated, whatever their names; empty tables on either side give no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import ALNUM, shingles, signed, slices, words_of
from ._spark import BitFilter, columns_of, map_batches, settle, whole_row

WINDOW, SHINGLE = 10, 5


def benchmark_windows(items: DataFrame, window: int = WINDOW, k: int = SHINGLE) -> DataFrame:
    """item_id, win (its words joined by a space), m (words) and the shingles of each window of each item."""

    def work(batch: pa.RecordBatch):
        ids = batch.column(0).to_pylist()
        for a, b, texts in slices(batch.column(1)):
            w = words_of(texts, ALNUM)
            for i in range(b - a):
                first, last = w.bounds[i], w.bounds[i + 1]
                m = int(min(window, last - first))
                if m:
                    h = signed(shingles(w.hashes[first:last], min(k, m)))
                    n = last - first - m + 1
                    per = m - min(k, m) + 1
                    yield {"item_id": [ids[a + i]] * n, "win": [b" ".join(w.word(first + j + x) for x in range(m)).decode("utf-8", "replace") for j in range(n)], "m": [m] * n, "hs": [h[j : j + per].tolist() for j in range(n)]}

    return map_batches(items.select(F.col("item_id").cast("string"), "text").filter("item_id is not null"), work, "item_id string, win string, m int, hs array<long>")


def _positions(docs: DataFrame, maybe: BitFilter, sizes: list[int], window: int) -> DataFrame:
    """For each row its words, and the shingles that may be a window's: hash, place, and the words around it from `back` words before."""
    shared = docs.sparkSession.sparkContext.broadcast(maybe)

    def work(batch: pa.RecordBatch):
        rids, ids, maybe = batch.column(0), batch.column(1), shared.value
        for a, b, texts in slices(batch.column(2)):
            w = words_of(texts, ALNUM)
            counts = np.diff(w.bounds)
            text_of = np.repeat(np.arange(b - a), counts)
            at, h, k_of = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for k in sizes:
                s = shingles(w.hashes, k)
                if len(s):
                    hit = np.flatnonzero(maybe.may_hold(s) & (text_of[: len(s)] == text_of[k - 1 :]))
                    at.append(hit), h.append(s[hit]), k_of.append(np.full(len(hit), k))
            at, h, k_of = np.concatenate(at), np.concatenate(h), np.concatenate(k_of)
            order = np.argsort(text_of[at], kind="stable") if len(at) else at
            at, h, k_of = at[order], h[order], k_of[order]
            owner = text_of[at] if len(at) else at
            first, last = w.bounds[owner], w.bounds[owner + 1]
            begin, end = np.maximum(first, at - (window - k_of)), np.minimum(last, at + window)
            around = [b" ".join(w.word(x) for x in range(p, q)).decode("utf-8", "replace") for p, q in zip(begin.tolist(), end.tolist())]
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=b - a))]).astype(np.int32)
            lists = {"h": signed(h), "at": (at - first).astype(np.int32), "back": (at - begin).astype(np.int32), "around": pa.array(around, pa.string())}
            yield {"rid": rids.slice(a, b - a), "doc_id": ids.slice(a, b - a), "n_words": counts} | {c: pa.ListArray.from_arrays(ends, x) for c, x in lists.items()}

    return map_batches(docs, work, f"rid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, h array<long>, at array<int>, back array<int>, around array<string>")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted item ids as strings) and spans (start, m) of window occurrences for each row of docs."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _contained(rows, items, window, k)


def _contained(docs: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    """contamination() for rows (rid, doc_id, text), each with a rid of its own; doc_id is only passed on and may be of any type."""
    windows = settle(benchmark_windows(items, window, k), "windows")
    parts = windows.select("win", "m", F.size("hs").alias("per"), F.posexplode("hs").alias("o", "h")).distinct()
    sizes = sorted(m - per + 1 for m, per in parts.select("m", "per").distinct().collect())
    found = settle(_positions(docs, BitFilter(parts.select("h").distinct(), 1024), sorted(set(sizes)), window), "positions")
    hits = found.select("rid", "n_words", F.inline(F.arrays_zip("h", "at", "back", "around")))
    counts = hits.groupBy("h").agg(F.count("*").alias("held"))
    # A shingle that no document holds rules its window out.
    prefix = parts.join(counts, "h", "left").groupBy("win", "m").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "h", "o")).alias("rarest")).filter("rarest.held > 0").select("win", "m", "rarest.h", "rarest.o")
    begin = F.col("at") - F.col("o")
    near = hits.join(prefix, "h").filter((begin >= 0) & (begin + F.col("m") <= F.col("n_words")))
    there = F.array_join(F.slice(F.split("around", " "), F.col("back") - F.col("o") + 1, F.col("m")), " ")
    sure = settle(near.filter((F.col("back") >= F.col("o")) & (there == F.col("win"))).select("rid", begin.alias("start"), "m", "win").distinct(), "contained")
    spans = sure.groupBy("rid").agg(F.collect_set(F.struct("start", "m")).alias("spans"))
    named = sure.select("rid", "win").distinct().join(windows.select("win", "item_id").distinct(), "win")
    named = named.groupBy("rid").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    words = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["m"] - 1))))
    out = found.select("rid", "doc_id", "n_words").join(spans, "rid", "left").join(named, "rid", "left")
    none: Column = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", F.coalesce(F.size(words), F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), "spans")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows whose own text holds a benchmark window; all columns are kept."""
    text = F.col("row.text").cast("string")
    rows = docs.select(whole_row(docs).alias("row")).withColumn("digest", F.unhex(F.md5(text.cast("binary"))))
    found = _contained(rows.select(F.monotonically_increasing_id().alias("rid"), F.col("digest").alias("doc_id"), text.alias("text")), items, WINDOW, SHINGLE)
    bad = settle(found.filter("n_hit > 0").select(F.col("doc_id").alias("digest")).distinct(), "contaminated")
    return rows.join(bad, "digest", "left_anti").select(*columns_of(F.col("row"), docs.columns))
