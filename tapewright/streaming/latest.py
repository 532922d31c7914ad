"""Keyed state of a stream: the newest arrival of every key, and a log of what replaced what.

A row passes only if it is newer than what its key has and says something else,
so repeats and stale arrivals end here, and the log grows by changes, not by
input; no batch rewrites what stands.  Reading takes the last change of a key.

The state of a key is a digest of the key (128 bits), a moment, a digest, a
version and when it was seen, whatever the row's width.  It lies in the session's
state store (set RocksDB there for many keys) with those of the keys that share
its bucket, so that Python is called for a bucket, not for every key; a batch
writes the buckets it touches.  A key goes `keep_ms` after it was last seen.  A row that comes later still is taken as new;
readers then let the column `arrived` decide, where there is one, and else the
order of changes.  Null keys count as equal; rows of one batch without `arrived`
that share a key count in the order of their content.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapewright.functions.columns import col


#: Columns of the state, all of 64 bits.
_HELD = ("a", "b", "moment", "digest", "version", "seen")


def _newest(keep_ms: int | None):
    """Passes the newest row of each key of a bucket in a batch on, if it replaces what stands; the key's digest, moment and digest come with the rows."""

    def work(bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = int(time.time() * 1000)
        held = np.frombuffer(state.get[0], np.int64).reshape(-1, len(_HELD)).tolist() if state.exists else []
        if keep_ms:
            held = [h for h in held if h[5] + keep_ms > now]
        out = None if state.hasTimedOut else _replace(held, frames, now)
        if held:
            state.update((np.array(held, np.int64).tobytes(),))
            if keep_ms:
                state.setTimeoutDuration(max(1, min(h[5] for h in held) + keep_ms - now))
        elif state.exists:
            state.remove()
        if out is not None and len(out):
            yield out

    return work


def _replace(held: list[list[int]], frames: Iterator[pd.DataFrame], now: int) -> pd.DataFrame | None:
    """Brings held up to date; the rows that replace what stood, with their version."""
    best = None
    for frame in frames:
        both = frame if best is None else pd.concat([best, frame])
        a, b, moment, digest = (both[c].to_numpy() for c in _HELD[:4])
        order = np.lexsort((digest, moment, b, a))
        last = np.ones(len(order), bool)
        last[:-1] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
        best = both.iloc[order[last]]
    if best is None:
        return None
    known = {(h[0], h[1]): h for h in held}
    changed, versions = [], []
    for i, (a, b, moment, digest) in enumerate(zip(*(best[c].tolist() for c in _HELD[:4]))):
        h = known.get((a, b))
        if h is None:
            held.append([a, b, moment, digest, now, now])
            changed.append(i)
            versions.append(now)
            continue
        h[5] = now
        if moment >= h[2]:
            if digest != h[3]:
                h[4] = max(now, h[4] + 1)
                changed.append(i)
                versions.append(h[4])
            h[2], h[3] = moment, digest
    return best.iloc[changed].assign(version=versions)


def changes(rows: DataFrame, key: tuple[str, ...], arrived: str = "arrived", keep_ms: int | None = None, buckets: int = 1 << 12) -> DataFrame:
    """The rows of a stream that replace what stands of their key, with _version, rising by key.

    buckets: of keys, fixed for the life of a checkpoint; some hundred to some thousand keys in each are good.
    """
    moment = F.coalesce(F.unix_micros(col(arrived).cast("timestamp")), F.lit(-(2**62))) if arrived in rows.columns else F.lit(0)
    said = [col(c) for c in rows.columns if c != arrived]
    text = lambda columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    # Columns go under plain names, whatever theirs are.
    plain = [col(c).alias(f"c{i}") for i, c in enumerate(rows.columns)]
    marked = rows.select(*plain, F.md5(text([col(k) for k in key])).alias("key"), moment.cast("long").alias("moment"), F.xxhash64(text(said)).alias("digest"))
    half = lambda at: F.conv(F.substring("key", at, 16), 16, -10).cast("long")
    marked = marked.withColumns({"a": half(1), "b": half(17)}).drop("key").withColumn("bucket", F.pmod("a", F.lit(buckets)))
    schema = T.StructType([*marked.schema.fields, T.StructField("version", T.LongType())])
    state = T.StructType([T.StructField("held", T.BinaryType())])
    timeout = GroupStateTimeout.ProcessingTimeTimeout if keep_ms else GroupStateTimeout.NoTimeout
    out = marked.groupBy("bucket").applyInPandasWithState(_newest(keep_ms), schema, state, "append", timeout)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(rows.columns)), F.col("version").alias("_version"))


def log_changes(rows: DataFrame, target: str, checkpoint: str, key: tuple[str, ...], arrived: str = "arrived", keep_ms: int | None = None) -> StreamingQuery:
    """Appends what changes to a Parquet log, until the stream's present input is read."""
    return changes(rows, key, arrived, keep_ms).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def standing(log: DataFrame, key: tuple[str, ...], arrived: str = "arrived") -> DataFrame:
    """The last change of every key."""
    order = [*([col(arrived).desc_nulls_last()] if arrived in log.columns else []), F.desc("_version")]
    place = F.row_number().over(Window.partitionBy(*(col(k) for k in key)).orderBy(*order))
    return log.withColumn("_place", place).filter("_place = 1").drop("_place", "_version")


def compact(log: DataFrame, target: str, key: tuple[str, ...], arrived: str = "arrived") -> None:
    """Writes the last change of every key to a new folder, with the versions it had, for readers to use with the log's later files."""
    order = [*([col(arrived)] if arrived in log.columns else []), F.col("_version")]
    last = F.max(F.struct(*order)).over(Window.partitionBy(*(col(k) for k in key)))
    log.withColumn("_last", last).filter(F.struct(*order) == F.col("_last")).drop("_last").write.parquet(target)
