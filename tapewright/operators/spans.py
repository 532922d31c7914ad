"""Series operators for tickers with very many rows: two passes over spans of days instead of one window over a ticker.

Rows are grouped by (Ticker, span), so a single ticker keeps all cores busy.  The
first pass gives one row for each span (its product, maximum, runs begun, last
close); these are carried along the spans of a ticker, and the second pass adds
what is carried to windows within spans.  Results are those of the operators of
the same name in series and quality, up to the last digit of products.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Days of a span: about a thousand sessions.
DAYS = 1461


def _in_span() -> WindowSpec:
    return Window.partitionBy("Ticker", "_span").orderBy("Date")


def _of_ticker() -> WindowSpec:
    return Window.partitionBy("Ticker").orderBy("_span")


def _before() -> WindowSpec:
    return _of_ticker().rowsBetween(Window.unboundedPreceding, -1)


def _spanned(df: DataFrame, days: int) -> DataFrame:
    return df.withColumn("_span", F.floor(F.datediff("Date", F.lit("1970-01-01").cast("date")) / days))


def _carried(df: DataFrame, partial: Column, carry) -> DataFrame:
    """df with _carried: what `carry` makes of the spans' partial results for each span."""
    parts = df.groupBy("Ticker", "_span").agg(partial.alias("_part"))
    return df.join(parts.select("Ticker", "_span", carry(F.col("_part")).alias("_carried")), ["Ticker", "_span"])


def _with_previous(df: DataFrame, name: str) -> DataFrame:
    """df with the close of the ticker's row before, whichever span that is in; spanned."""
    df = _carried(df, F.max_by(F.struct("C"), F.col("Date")), lambda last: F.lag(last).over(_of_ticker()))
    first = F.row_number().over(_in_span()) == 1
    return df.withColumn(name, F.when(first, F.col("_carried.C")).otherwise(F.lag("C").over(_in_span()))).drop("_carried")


def adjusted_close(prices: DataFrame, dividends: DataFrame, days: int = DAYS) -> DataFrame:
    """prices with AC, as series.adjusted_close."""
    paid = dividends.groupBy("Ticker", "Date").agg(F.sum("Dividend").alias("_div"))
    df = _with_previous(_spanned(prices.join(paid, ["Ticker", "Date"], "left"), days), "_before")
    df = df.withColumn("_f", F.coalesce(F.when(F.col("_div").isNotNull(), 1 - F.try_divide("_div", "_before")), F.lit(1.0)))
    df = _carried(df, F.product("_f"), lambda p: F.coalesce(F.product(p).over(_of_ticker().rowsBetween(1, Window.unboundedFollowing)), F.lit(1.0)))
    later = F.coalesce(F.product("_f").over(_in_span().rowsBetween(1, Window.unboundedFollowing)), F.lit(1.0))
    return df.withColumn("AC", F.col("C") * later * F.col("_carried")).select(*(c for c in prices.columns if c != "AC"), "AC")


def drawdown(history: DataFrame, days: int = DAYS) -> DataFrame:
    """(Ticker, Date, drawdown), as series.drawdown."""
    df = _carried(_spanned(history.select("Ticker", "Date", "AC"), days), F.max("AC"), lambda m: F.max(m).over(_before()))
    peak = F.greatest(F.max("AC").over(_in_span().rowsBetween(Window.unboundedPreceding, 0)), "_carried")
    return df.select("Ticker", "Date", (F.try_divide("AC", peak) - 1).alias("drawdown"))


def runs(prices: DataFrame, days: int = DAYS) -> DataFrame:
    """(Ticker, run, n, Date, C): runs of equal closes with their number of rows, last date and close; a null close is a run of its own."""
    df = _with_previous(_spanned(prices.select("Ticker", "Date", "C"), days), "_before")
    df = df.withColumn("_new", F.when(F.col("C") == F.col("_before"), 0).otherwise(1))
    df = _carried(df, F.sum("_new"), lambda n: F.coalesce(F.sum(n).over(_before()), F.lit(0)))
    df = df.withColumn("run", F.sum("_new").over(_in_span()) + F.col("_carried"))
    return df.groupBy("Ticker", "run").agg(F.count("*").alias("n"), F.max("Date").alias("Date"), F.max("C").alias("C"))
