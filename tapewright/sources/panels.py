"""Scans of stored panels: predicates, discovery, samples and plans for the next increment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.columns import col, in_range
from tapewright.functions.places import row_places

CLASSES = ("stocks", "bonds", "currencies", "indices")


def ohlcv_series(prices: DataFrame, tickers=None, exclude=(), start=None, end=None) -> DataFrame:
    df = prices.filter(in_range("Date", start, end))
    df = df if tickers is None else df.filter(F.col("Ticker").isin(*tickers))
    return (df.filter(~F.col("Ticker").isin(*exclude)) if exclude else df).select("Ticker", "Date", "O", "H", "L", "C", "V", "AC")


def price_series(prices: DataFrame, market_data: DataFrame, tickers=None, start=None, end=None) -> DataFrame:
    """(Ticker, Date, AssetClass, Price): adjusted closes of stocks and closes of all else; nulls are dropped."""
    a = prices.select("Ticker", "Date", F.lit("stocks").alias("AssetClass"), F.col("AC").alias("Price"))
    b = market_data.select("Ticker", "Date", "AssetClass", F.col("C").alias("Price"))
    df = a.unionByName(b).filter(in_range("Date", start, end)).filter("Price is not null")
    return df if tickers is None else df.filter(F.col("Ticker").isin(*tickers))


def list_tickers(prices: DataFrame, market_data: DataFrame, classes=CLASSES) -> DataFrame:
    if unknown := set(classes) - set(CLASSES):
        raise ValueError(f"unknown classes: {sorted(unknown)}")
    out = market_data.filter(F.col("AssetClass").isin(*classes)).select("Ticker")
    return (out.union(prices.select("Ticker")) if "stocks" in classes else out).distinct().orderBy("Ticker")


def sample_tickers(prices: DataFrame, n: int, seed: int = 0, exclude=()) -> DataFrame:
    """n tickers in the order of a seeded digest: the same ones wherever it runs."""
    t = prices.select("Ticker").distinct()
    t = t.filter(~F.col("Ticker").isin(*exclude)) if exclude else t
    return t.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("Ticker")).cast("binary")), "Ticker").limit(n)


def sample_rows(df: DataFrame, n: int, where=None, seed: int = 0) -> DataFrame:
    return (df if where is None else df.filter(where)).orderBy(F.rand(seed)).limit(n)


def rows_of(df: DataFrame, ticker: str) -> DataFrame:
    return df.filter(col("Ticker") == ticker)


def plan_increments(prices: DataFrame, symbols: DataFrame, batch: int = 75, refetch_days: int = 5) -> DataFrame:
    """(Ticker, last, batch, start): stalest first in batches; a batch starts refetch_days before its earliest last date, or has no start if any of it was never loaded."""
    last = prices.groupBy("Ticker").agg(F.max("Date").alias("last"))
    order = [F.col("last").asc_nulls_first(), F.col("Ticker").asc()]
    df = row_places(symbols.select("Ticker").distinct().join(last, "Ticker", "left"), order, "_place")
    df = df.withColumn("batch", F.floor((F.col("_place") - 1) / batch).cast("long")).drop("_place")
    own = Window.partitionBy("batch")
    start = F.when(F.count_if(F.col("last").isNull()).over(own) == 0, F.date_sub(F.min("last").over(own), refetch_days))
    return df.withColumn("start", start)


def due(fetched: DataFrame, refresh_days: int, today) -> DataFrame:
    return fetched.filter(F.col("FetchedOn").isNull() | (F.datediff(F.lit(today).cast("date"), "FetchedOn") >= refresh_days))


def todo(symbols: DataFrame, *done: DataFrame) -> DataFrame:
    """Symbols that are in none of the given lists (ledger, dead, loaded)."""
    out = symbols.select("Ticker").distinct()
    for d in done:
        out = out.join(d.select("Ticker"), "Ticker", "left_anti")
    return out


def needs_readjustment(prices: DataFrame, new_dividends: DataFrame) -> DataFrame:
    """Full history of the tickers that have a new dividend, for which adjusted closes are computed anew."""
    return prices.join(new_dividends.select("Ticker").distinct(), "Ticker", "left_semi")
