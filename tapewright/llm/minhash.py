"""Near-duplicate documents by one-permutation MinHash.

One hash per shingle is dealt into ``bands * rows`` bins, the least of each bin
is kept, and empty bins are filled by optimal densification (every empty bin
walks its own fixed random order of bins to the first filled one).  Bands of
`rows` bins are bucket keys.  Inside a bucket candidates form a star, never all
pairs: its most central document is compared with the others, on full shingle
sets.  Links between two others that the star can't show are then found from
what their sets share outside the centre (see _rest), so no candidate of a
bucket is lost.

Edge cases: null or blank texts have no shingles, stay alone and are kept;
documents with equal sets are one class and are compared once; rows that share
a doc_id count as one document (their links are united, each row is returned;
of those that stay and have equal texts too, drop_near_duplicates keeps one);
rows without a doc_id stay alone with a null component_id and are kept; extra
columns are ignored, or kept by drop_near_duplicates, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import NOT_SPACE, mix64, shingles, signed, slices, words_of
from ._graph import components
from ._spark import MOST_BITS, BitFilter, columns_of, map_batches, settle, whole_row


#: A shingle outside its centre is rare if at most so many documents of a star hold it.
RARE = 32


@dataclass(frozen=True)
class MinHash:
    """At a similarity of 0.75, 32 bands of 4 rows miss a pair with probability (1 - 0.75**4)**32 = 5e-6."""

    words: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4


def _sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; fewer than k words make one shingle."""
    found = words_of(texts, NOT_SPACE)
    out = []
    for i in range(len(texts)):
        h = found.hashes[found.bounds[i] : found.bounds[i + 1]]
        out.append(np.unique(shingles(h, min(k, len(h)))) if len(h) else h)
    return out


def _probes(k: int) -> np.ndarray:
    """For each bin a fixed random order of the bins."""
    rng = np.random.Generator(np.random.PCG64(7))
    return np.stack([rng.permutation(k) for _ in range(k)])


def one_permutation(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Densified signatures, a row for each set; sets must not be empty."""
    n = len(sets)
    flat = np.concatenate(sets)
    cell = np.repeat(np.arange(n) * bins, [len(s) for s in sets]) + (((flat >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(flat), bool)
    first[1:] = cell[1:] != cell[:-1]
    least, filled = np.zeros(n * bins, np.uint64), np.zeros(n * bins, bool)
    least[cell[first]], filled[cell[first]] = flat[first], True
    least, filled = least.reshape(n, bins), filled.reshape(n, bins)
    out, have, open_rows, probes = least.copy(), filled.copy(), np.flatnonzero(~filled.all(1)), _probes(bins)
    for step in range(bins):
        if not len(open_rows):
            break
        at = probes[:, step]
        take = ~have[open_rows] & filled[open_rows][:, at]
        out[open_rows] = np.where(take, least[open_rows][:, at], out[open_rows])
        have[open_rows] |= take
        open_rows = open_rows[~have[open_rows].all(1)]
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407), (len(signature), 1))
    for j in range(rows):
        key = mix64(key + parts[:, :, j] * np.uint64(2 * j + 0x9FB21C651E98DF25))
    return key


def _signatures(docs: DataFrame, p: MinHash) -> DataFrame:
    """doc_id, n_shingles, s1 and s2 (the set's 128-bit digest) and band keys for each row."""

    def work(batch: pa.RecordBatch):
        ids = batch.column(0)
        for a, b, texts in slices(batch.column(1)):
            sets = _sets(texts, p.words)
            n = np.array([len(s) for s in sets])
            digests, keys = np.zeros((2, b - a), np.uint64), np.zeros((b - a, p.bands), np.uint64)
            if some := np.flatnonzero(n).tolist():
                full = [sets[i] for i in some]
                at = np.concatenate([[0], np.cumsum(n[some])[:-1]])
                flat = np.concatenate(full)
                for j, salt in enumerate((0x8CB92BA72F3D8DD7, 0xC13FA9A902A6328F)):
                    digests[j, some] = np.add.reduceat(mix64(flat * np.uint64(salt)), at)
                keys[some] = band_keys(one_permutation(full, p.bands * p.rows), p.bands, p.rows)
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, p.bands, 0))]).astype(np.int32)
            yield {"doc_id": ids.slice(a, b - a), "n_shingles": n, "s1": signed(digests[0]), "s2": signed(digests[1]), "bands": pa.ListArray.from_arrays(ends, signed(keys[n > 0].ravel()))}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")


def shingle_sets(docs: DataFrame, words: int = 5, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id and its sorted distinct shingle hashes, for documents that have any; wanted (doc_id) leaves out most others, by a bit filter, so that no text is shuffled."""
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    maybe = wanted and BitFilter(wanted.select(F.xxhash64("doc_id").alias("h")))
    if maybe and maybe.held > 2 ** (MOST_BITS - 3):
        # The filter would let too many pass.
        docs, maybe = docs.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi"), None
    shared = docs.sparkSession.sparkContext.broadcast(maybe)

    def work(batch: pa.RecordBatch):
        if shared.value:
            batch = batch.filter(pa.array(shared.value.may_hold(batch.column(2).to_numpy())))
        ids = batch.column(0)
        for a, b, texts in slices(batch.column(1)):
            sets = _sets(texts, words)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield {"doc_id": ids.slice(a, b - a), "shingles": pa.ListArray.from_arrays(ends, signed(np.concatenate(sets)))}

    return map_batches(docs.select("doc_id", "text", "h"), work, "doc_id long, shingles array<long>").filter(F.size("shingles") > 0)


def _beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with both full sets."""
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"s_{c}")) for c in "ab")
    return pairs.join(right, "b").join(left, "a")


def _enough(shared, united, percent: int):
    """Whether so many shared shingles of two sets, whose sizes sum to `united`, make a link."""
    return (100 + percent) * shared >= percent * united


def near_duplicates(docs: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = settle(_signatures(docs, p), "signatures")
    classes = rows.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = settle(classes, "classes")
    keyed = rows.join(classes, ["s1", "s2", "n_shingles"]).filter(F.col("doc_id") == F.col("rep"))
    members = keyed.select(F.explode("bands").alias("key"), F.col("doc_id").alias("doc"))
    shared = members.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("held")).filter("first < last")
    buckets = settle(members.join(shared.select("key", "held"), "key"), "buckets")
    # The document with most company in all its buckets is the likely original of its copies: it is the star's centre.
    company = buckets.groupBy("doc").agg(F.sum("held").alias("company"))
    buckets = buckets.join(company, "doc").withColumn("rank", F.struct("company", (-F.col("doc")).alias("d")))
    centres = buckets.groupBy("key").agg(F.max("rank").alias("top")).select("key", (-F.col("top.d")).alias("a"), F.col("top.company").alias("company"))
    stars = buckets.select("key", F.col("doc").alias("b")).join(centres, "key").filter("a <> b").groupBy("a", "b").agg(F.first("company").alias("company"))
    stars = settle(stars, "stars")
    wanted = settle(stars.select(F.col("a").alias("doc_id")).union(stars.select("b")).distinct(), "wanted")
    sets = settle(shingle_sets(docs, p.words, wanted), "sets")

    scored = _beside(stars, sets).select("a", "b", F.size("s_a").alias("na"), F.size("s_b").alias("nb"), F.size(F.array_intersect("s_a", "s_b")).alias("shared"))
    # Dealt anew by both, as all rows of a star would else be grouped in the task that joined its centre.
    scored = scored.repartition("a", "b").groupBy("a", "b").agg(*(F.max(c).alias(c) for c in ("na", "nb", "shared")))
    scored = settle(scored.withColumn("linked", _enough(F.col("shared"), F.col("na") + F.col("nb"), p.percent)), "scored")
    links = scored.filter("linked").select("a", "b")
    labels = components(links)
    rest = settle(_rest(scored, stars, labels, sets, p.percent), "rest")
    if not rest.isEmpty():
        links = links.unionByName(rest)
        labels = components(links)

    placed = rows.select("doc_id", "n_shingles", "s1", "s2").join(classes, ["s1", "s2", "n_shingles"], "left")
    # A doc_id with several rows may have several classes: they are one document.
    again = placed.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    doubled = placed.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").drop("c")
    extra = again.join(doubled.withColumnRenamed("doc_id", "a"), "a", "left_semi")
    if not extra.isEmpty():
        labels = components(links.unionByName(extra).distinct())
    placed = placed.withColumn("id", F.coalesce("rep", "doc_id")).join(labels, "id", "left")
    placed = placed.withColumn("component_id", F.coalesce("component", "id"))
    return placed.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _rest(scored: DataFrame, stars: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between documents of one star that neither their centre nor other links have brought together.

    Two sets share at most the lesser of what they share with the centre, and
    besides that what they share outside it.  So a pair can only link if it
    shares a shingle that the centre lacks and few of the star hold (found by an
    equi-join on these), or if what both share with the centre and the shingles
    that many hold are enough; the bound then leaves few pairs to confirm on
    full sets.  Two documents that are in several stars together are
    looked at in one: a document's home is the star with the most central
    centre, and pairs with one home are left to it.
    """
    homes = stars.groupBy("b").agg(F.max_by("a", F.struct("company", (-F.col("a")).alias("d"))).alias("home"))
    named = labels.select(F.col("id").alias("b"), F.col("component").alias("of_b"))
    centre = labels.select(F.col("id").alias("a"), F.col("component").alias("of_a"))
    stars = scored.join(homes, "b").join(named, "b", "left").join(centre, "a", "left")
    stars = stars.select("a", "b", "nb", "shared", "home", F.coalesce("of_b", "b").alias("of_b"), (F.coalesce("of_b", "b") != F.coalesce("of_a", "a")).alias("apart"))
    # Settled, so that a star's rows aren't counted in the task that joined its centre.
    stars = settle(stars, "placed")
    split = stars.groupBy("a").agg(F.max("apart").alias("some"), F.count("*").alias("held"), F.min("home").alias("h1"), F.max("home").alias("h2")).filter("some and held > 1 and (h1 <> h2 or h1 = a)").select("a")
    split = settle(split, "split")
    stars = settle(stars.join(split, "a", "left_semi"), "apart")
    outside = _beside(stars, sets).select("a", "b", "nb", "shared", "home", "of_b", "apart", F.explode(F.array_except("s_b", "s_a")).alias("h"))
    outside = settle(outside, "outside")
    counts = outside.groupBy("a", "h").agg(F.count("*").alias("held"), F.max("apart").alias("some")).filter("held > 1 and some")
    counts = settle(counts.select("a", "h", "held"), "shared")
    rare, common = (counts.filter(f"held {op} {RARE}").select("a", "h") for op in ("<=", ">"))
    # What each document has of the shingles that many of the star hold outside the centre, and whether that could make a link with any other.
    held = outside.join(common, ["a", "h"], "left_semi").groupBy("a", "b").agg(F.collect_set("h").alias("common"))
    least = stars.groupBy("a").agg(F.min("nb").alias("least"))
    stars = stars.join(held, ["a", "b"], "left").join(least, "a").withColumn("common", F.coalesce("common", F.array().cast("array<long>"))).withColumn("q", F.size("common"))
    viable = _enough(F.col("shared") + F.col("q"), F.col("nb") + F.col("least"), percent)
    stars = settle(stars.withColumn("viable", viable).drop("least"), "apart")
    names = ("b", "nb", "shared", "of_b", "home", "q", "common")
    one, other = (["a", *(F.col(c).alias(f"{c}_{k}") for c in names)] for k in (1, 2))
    new = "of_b_1 <> of_b_2 and (home_1 <> home_2 or home_1 = a)"
    most, united = F.least("shared_1", "shared_2"), F.col("nb_1") + F.col("nb_2")
    near = stars.filter("apart and viable").select(*one).join(stars.filter("viable").select(*other), "a").filter(new).filter(_enough(most + F.least("q_1", "q_2"), united, percent))
    near = near.filter(_enough(most + F.size(F.array_intersect("common_1", "common_2")), united, percent)).select("b_1", "b_2")
    lists = outside.join(rare, ["a", "h"], "left_semi").select("a", "h", "b", "apart").join(stars.drop("apart", "common"), ["a", "b"])
    one, other = (["a", "h", *(F.col(c).alias(f"{c}_{k}") for c in names[:-1])] for k in (1, 2))
    together = lists.filter("apart").select(*one).join(lists.select(*other), ["a", "h"]).filter(new)
    together = together.groupBy("a", "b_1", "b_2", "nb_1", "nb_2", "shared_1", "shared_2", "q_1", "q_2").agg(F.count("*").alias("beyond"))
    together = together.filter(_enough(most + F.col("beyond") + F.least("q_1", "q_2"), united, percent)).select("b_1", "b_2")
    pairs = together.union(near).select(F.least("b_1", "b_2").alias("a"), F.greatest("b_1", "b_2").alias("b")).distinct()
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return _beside(pairs, sets).filter(_enough(shared, F.size("s_a") + F.size("s_b"), percent)).select("a", "b").distinct()


def drop_near_duplicates(docs: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """docs without the documents of which another one of the same component stays; all columns are kept."""
    found = settle(near_duplicates(docs, p), "near")
    gone = settle(found.filter("not kept").select("doc_id").distinct(), "gone")
    twice = settle(found.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select("doc_id"), "twice")
    rows = docs.select(whole_row(docs).alias("row")).withColumn("doc_id", F.col("row.doc_id").cast("long")).join(gone, "doc_id", "left_anti")
    if not twice.isEmpty():
        again = rows.join(twice, "doc_id", "left_semi").groupBy("doc_id", F.md5(F.col("row.text").cast("string").cast("binary")).alias("digest")).agg(F.first("row").alias("row"))
        rows = rows.join(twice, "doc_id", "left_anti").select("row").unionByName(again.select("row"))
    return rows.select(*columns_of(F.col("row"), docs.columns))
