"""Centroid clustering by an incremental distance matrix of exact integers.

Each vector keeps the integer dot products with all centroids, in a table of
the shared folder.  When centroids move, only their components that changed
are multiplied: dot(v, new) = dot(v, old) + sum of v[j] * (new[j] - old[j]) over
changed j.  With the vector's and the centroid's own squares that gives squared
distances, and the least one is the assignment; nothing is rounded anywhere.
Every round is one pass over the table that gives, for each batch of vectors,
a count and a sum for each cluster; Spark adds these up, and the driver gets
`k` rows.  The table is written anew when more than `rewrite` of all components
have changed since it was: until then the changes since are few, and cheaper to
multiply than the table is to write.

Edge cases: vectors of another size or with a null or non-finite component
aren't clustered; components whose integer is beyond 2**26 are held there, as
squared distances must fit a long; rows that share a vec_id are vectors of their
own; a null vec_id is clustered but starts no centroid; with fewer than `k`
vectors that have an id, each starts a centroid; with none, or an empty table,
the result is empty; equal vectors may start several centroids, of which the
first takes all; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import map_batches, settle

#: Integers of components lie within this bound on either side.
MOST = 2**26


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", size: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component of the vectors that count."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.select(F.col(id_col).alias("vec_id"), F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("v"))
    rows = rows.filter((F.size("v") == size) & F.forall("v", finite))
    held = lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x * scale, F.lit(1e9)), F.lit(-1e9))), F.lit(MOST)), F.lit(-MOST)).cast("int")
    return rows.select("vec_id", F.transform("v", held).alias("v"))


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors whose salted id has the smallest SHA-256, in its order; of rows that share an id, by their components."""
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    best = vectors.filter("vec_id is not null").select(key.alias("key"), "v").orderBy("key", "v").limit(k)
    return np.array([r.v for r in best.collect()], np.int64)


def _matrix(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


class Distances:
    """Distances of the vectors of a table (vec_id, v, dots) to centroids that may have moved since it was written."""

    def __init__(self, then: np.ndarray, now: np.ndarray):
        self.now = now
        self.k, self.size = now.shape
        change = now - then
        self.moved = [(i, np.flatnonzero(row)) for i, row in enumerate(change) if row.any()]
        self.change = change

    def dots(self, batch: pa.RecordBatch, x: np.ndarray) -> np.ndarray:
        out = _matrix(batch, "dots", self.k)
        for i, at in self.moved:
            out[:, i] += x[:, at] @ self.change[i, at]
        return out

    def nearest(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Vectors, their new dot products, the nearest centroid (of equals the first), and its squared distance."""
        x = _matrix(batch, "v", self.size)
        dots = self.dots(batch, x)
        far = (x * x).sum(1)[:, None] - 2 * dots + (self.now * self.now).sum(1)
        cluster = far.argmin(1)
        return x, dots, cluster, far[np.arange(len(x)), cluster]


def _sums(table: DataFrame, d: Distances) -> dict[int, tuple[int, list[int]]]:
    """Of each cluster that has vectors, their count and componentwise sum."""

    def work(batch: pa.RecordBatch):
        x, _, cluster, _ = d.nearest(batch)
        there = np.unique(cluster)
        yield {"cluster": there, "n": np.bincount(cluster)[there], "sums": [x[cluster == c].sum(0).tolist() for c in there]}

    parts = map_batches(table.select("v", "dots"), work, "cluster int, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[j].cast("decimal(20,0)")).alias(f"s{j}") for j in range(d.size)))
    return {r.cluster: (r.n, [int(r[f"s{j}"]) for j in range(d.size)]) for r in total.collect()}  # k rows


def _with_dots(table: DataFrame, d: Distances) -> DataFrame:
    def work(batch: pa.RecordBatch):
        x = _matrix(batch, "v", d.size)
        flat = pa.array(d.dots(batch, x).ravel())
        yield {"vec_id": batch.column("vec_id"), "v": batch.column("v"), "dots": pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, d.k, dtype=np.int32), flat)}

    kind = T.StructType([table.schema["vec_id"], T.StructField("v", T.ArrayType(T.IntegerType())), T.StructField("dots", T.ArrayType(T.LongType()))])
    return map_batches(table.select("vec_id", "v", "dots"), work, kind)


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, salt: str = "3:", rewrite: float = 0.25) -> DataFrame:
    """(vec_id, cluster, distance (squared), centroid (its integers), cluster_inertia, inertia) of every vector that counts."""
    spark = df.sparkSession
    vectors = settle(whole_vectors(df, id_col, vec_col, size, scale), "vectors")
    now = first_centroids(vectors, k, salt)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not len(now):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, centroid array<long>, cluster_inertia long, inertia long")
    k = len(now)
    zero = np.zeros_like(now)
    blank = vectors.withColumn("dots", F.array_repeat(F.lit(0).cast("long"), k))
    then, table = now, settle(_with_dots(blank, Distances(zero, now)), "dots")
    for _ in range(rounds):
        found = _sums(table, Distances(then, now))
        now = np.array([[s // found[c][0] for s in found[c][1]] if c in found else now[c] for c in range(k)], np.int64)
        if np.count_nonzero(now != then) > rewrite * now.size:
            then, table = now, settle(_with_dots(table, Distances(then, now)), "dots")
    d = Distances(then, now)

    def work(batch: pa.RecordBatch):
        _, _, cluster, distance = d.nearest(batch)
        yield {"vec_id": batch.column("vec_id"), "cluster": cluster, "distance": distance}

    schema = T.StructType([table.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    placed = settle(map_batches(table, work, schema), "clusters")
    sums = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    totals = {r.cluster: r.cluster_inertia for r in sums.collect()}  # k rows
    of_cluster = [(c, now[c].tolist(), totals[c], sum(totals.values())) for c in totals]
    about = spark.createDataFrame(of_cluster, "cluster int, centroid array<long>, cluster_inertia long, inertia long")
    return placed.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "centroid", "cluster_inertia", "inertia")
