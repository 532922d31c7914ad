"""Labelled data sets from windows: labels, splits without leaks, class indexes and weights, group order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.columns import col


def attach_labels(windows: DataFrame, labels: DataFrame) -> DataFrame:
    """Windows of tickers that have a label (Ticker, label)."""
    return windows.join(labels, "Ticker")


def ticker_labels(companies: DataFrame, column: str) -> DataFrame:
    return companies.filter(col(column).isNotNull() & (F.trim(col(column)) != "")).select("Ticker", col(column).alias("label"))


def demean_by_date(df: DataFrame, value: str = "label", date: str = "end_date") -> DataFrame:
    return df.withColumn("excess", F.col(value) - F.avg(value).over(Window.partitionBy(date)))


def _last_n(df: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("Ticker").orderBy(F.col("start_date").desc(), F.col("end_date").desc())
    df = df.withColumn("_test", F.row_number().over(order) <= n)
    first = F.min(F.when(F.col("_test"), F.col("start_date"))).over(Window.partitionBy("Ticker"))
    # Windows that reach into the test span belong to neither side.
    return df.withColumn("_pool", ~F.col("_test") & F.coalesce(F.col("end_date") < first, F.lit(True)))


def split_windows(windows: DataFrame, valid_frac: float = 0.2, method: str = "recent", test_n: int = 1, seed: int = 0) -> DataFrame:
    """windows with split: test is each ticker's last test_n; valid the most recent fraction or a random one; the rest train.

    Windows that straddle a border are dropped, and so are tickers that have no train window.
    """
    df = _last_n(windows, test_n)
    if method == "recent":
        end = F.unix_micros(F.col("end_date").cast("timestamp"))
        cutoffs = df.filter("_pool").groupBy("Ticker").agg(F.percentile(end, F.lit(1 - valid_frac)).alias("_cut"))
        df = df.join(cutoffs, "Ticker", "left")
        start = F.unix_micros(F.col("start_date").cast("timestamp"))
        side = F.when(start > F.col("_cut"), "valid").when(end <= F.col("_cut"), "train")
    elif method == "random":
        # The first 32 bits of a digest: the same draw wherever it runs.
        name = F.concat_ws("|", F.lit(str(seed)), "Ticker", F.col("start_date").cast("string"), F.col("end_date").cast("string"))
        draw = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") / 2**32
        side = F.when(draw < valid_frac, "valid").otherwise("train")
    else:
        raise ValueError(f"unknown method: {method}")
    df = df.withColumn("split", F.when(F.col("_test"), "test").when(F.col("_pool"), side)).filter("split is not null")
    trained = F.max((F.col("split") == "train").cast("int")).over(Window.partitionBy("Ticker"))
    return df.withColumn("_some", trained).filter("_some = 1").select(*windows.columns, "split")


def encode_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """df with label_index: place among the sorted labels seen in train, else -1."""
    seen = df.filter("split = 'train'").select(F.col(label)).distinct()
    seen = seen.withColumn("label_index", F.row_number().over(Window.orderBy(label)) - 1)  # one row for each class
    return df.join(seen, label, "left").withColumn("label_index", F.coalesce("label_index", F.lit(-1)))


def class_weights(df: DataFrame, label: str = "label_index") -> DataFrame:
    """(label, weight): rows over classes times rows of the class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("_n"), F.count("*").alias("_k")))
    return counts.crossJoin(total).select(label, (F.col("_n") / (F.col("_k") * F.col("n"))).alias("weight"))


def group_ids(df: DataFrame, date: str = "end_date") -> DataFrame:
    """df with qid, dense by date; ids come from the distinct dates, and rows are range-partitioned by date."""
    ids = df.select(date).distinct().withColumn("qid", F.row_number().over(Window.orderBy(date)) - 1)
    return df.join(ids, date).repartitionByRange(date).sortWithinPartitions(date)


def relevance_grades(df: DataFrame, value: str, group: str, n_grades: int = 5) -> DataFrame:
    from tapewright.functions.columns import pct_rank

    return df.withColumn("grade", F.least(F.floor(pct_rank(value, [group]) * n_grades), F.lit(n_grades - 1)).cast("int"))
