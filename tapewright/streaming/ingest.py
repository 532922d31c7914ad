"""Incremental ingest with Structured Streaming."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapewright.functions.columns import col
from tapewright.sources.files import FLAT, asset_class, canonical_bars
from tapewright.sources.sinks import upsert


def stream_bars(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Flat files as they land in a folder, oldest first, as canonical bars with the time at which their file arrived."""
    raw = spark.readStream.schema(FLAT).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(path)
    raw = raw.select("*", F.col("_metadata.file_modification_time").alias("arrived"))
    bars = canonical_bars(raw, asset_class(F.col("ticker")), "arrived")
    return bars.filter("AssetClass is not null")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def upsert_stream(rows: DataFrame, target: str, checkpoint: str, key: tuple[str, ...] = ("Ticker", "Date"), arrived: str = "arrived", buckets: int = 16) -> StreamingQuery:
    """Merges every micro-batch into a Parquet table by key; the later arrival of a key wins, also a late correction of an old row.

    The table lies in `buckets` partitions by a hash of the key, and a batch
    rewrites only those that it touches, by way of a staged copy.  Between rows
    of one batch the column `arrived` decides, where there is one.  A batch that
    is run again after a failure gives the same table.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("_bucket", F.pmod(F.xxhash64(*(col(k) for k in key)), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # `buckets` at most
        if not touched:
            return
        stored = None
        if _exists(spark, target):
            stored = spark.read.schema(new.schema).parquet(target).filter(F.col("_bucket").isin(*touched))
        order = [F.col(arrived).desc_nulls_last()] if arrived in batch.columns else None
        staged = f"{target.rstrip('/')}_staged/batch={batch_id}"
        upsert(stored, new, list(key), order).write.mode("overwrite").parquet(staged)
        out = spark.read.parquet(staged).repartition("_bucket")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(target)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_table(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """The Parquet files of a folder whose names match the pattern, as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def stream_root(spark: SparkSession) -> str:
    """A new folder for a stream's table and progress, below the shared one of spark.checkpoint.dir; an own one only where none is set on a local master, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tapewright-")
    return f"{named.rstrip('/')}/stream-{uuid.uuid4().hex[:12]}"


def append_stream(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_repeats(events: DataFrame, columns: list[str], time: str = "ts", delay: str = "1 day") -> DataFrame:
    """A stream without rows that repeat an earlier one in all the given columns, as far as the watermark reaches back; a corrected row differs and stays."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(columns)


def row_checks(bars: DataFrame) -> DataFrame:
    """Row-local checks on a stream or a table of bars or market data: (Ticker, Date, CheckName) for each that fails."""
    o, h, low, c = (F.col(x) for x in "OHLC")
    bonds = (F.col("AssetClass") == "bonds") if "AssetClass" in bars.columns else F.lit(False)
    positive = [o, h, low, c, *([F.col("AC")] if "AC" in bars.columns else [])]
    tests = {
        "nonpositive_price": ~bonds & F.exists(F.array(*(x.cast("double") for x in positive)), lambda x: x <= 0),
        "ohlc_inconsistent": (h < low) | (o > h) | (o < low) | (c > h) | (c < low),
        "bond_yield_bound": bonds & (F.abs(c) > 50),
    }
    if "V" in bars.columns:
        tests["negative_volume"] = F.col("V") < 0
    names = F.filter(F.array(*(F.when(t, n) for n, t in tests.items())), lambda x: x.isNotNull())
    return bars.select("Ticker", "Date", F.explode(names).alias("CheckName"))
