"""Shared pieces of the corpus operators: scratch tables and Arrow mapping."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of an Arrow batch, in sessions that leave Spark's default of 10,000.
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; an own one only where none is set on a local master, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tapewright-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/tapewright-{spark.sparkContext.applicationId}"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of the session get at most BATCH_ROWS rows, so that workers hold little text at once; a session's own setting stands."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def give_back() -> None:
    """Returns what this worker has freed to the system (where its C library can): workers live on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def columns_of(row: Column, names: list[str]) -> list[Column]:
    """The fields of a struct under their own names: rows travel as one struct, so that no name of theirs meets an inner one."""
    return [row.getField(c).alias(c) for c in names]


def whole_row(docs: DataFrame) -> Column:
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))


#: A bit filter has at most 2**MOST_BITS bits: 16 MB at the driver and at each worker.
MOST_BITS = 27


class BitFilter:
    """Which 64-bit hashes may be among given ones: about `each` bits for each (so one in `each` passes falsely), within a fixed bound, beyond which more do."""

    def __init__(self, hashes: DataFrame, each: int = 32, most: int = MOST_BITS):
        """hashes: distinct values of a long column h; Spark ors them to 64-bit words, of which at most 2**(most - 6) come to the driver."""
        self.held = hashes.count()
        self.bits = min(most, max(16, (each * self.held - 1).bit_length()))
        slot = F.col("h").bitwiseAND(2**self.bits - 1)
        words = hashes.select(F.shiftright(slot, 6).alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("word")).toArrow()
        packed = np.zeros(2 ** (self.bits - 6), np.int64)
        packed[words.column(0).to_numpy()] = words.column(1).to_numpy()
        self.packed = packed.astype("<i8").view(np.uint8)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes.view(np.uint64) & np.uint64(2**self.bits - 1)
        return (self.packed[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def settle(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df as a table in the shared scratch folder and reads it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of settle() that nothing will read again; other DataFrames are left alone."""
    for df in tables:
        if path := vars(df).get("scratch_path"):
            _delete(df.sparkSession, path)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what settle() has written in this application; its results can't be read afterwards."""
    _delete(spark, scratch_root(spark))


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[dict]], schema: str | StructType) -> DataFrame:
    """mapInArrow where `work` gives column lists or arrays for a batch; they are cast to `schema`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    bounded_batches(df.sparkSession)
    target = to_arrow_schema(schema if isinstance(schema, StructType) else _parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for columns in work(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in target], schema=target)
        give_back()

    return df.mapInArrow(run, schema)
