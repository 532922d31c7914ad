"""Two passes over spans equal one window over a ticker."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tapewright.operators import quality, series, spans


@pytest.fixture(scope="module")
def history(spark):
    r = random.Random(3)
    rows, paid = [], []
    for t in ("long", "short", "gaps"):
        day = dt.date(1999, 12, 20)
        for _ in range({"long": 700, "short": 3, "gaps": 60}[t]):
            day += dt.timedelta(days=r.choice([1, 1, 3]) if t != "gaps" else r.randint(1, 200))
            rows.append((t, day, r.choice([None, 10.0, 10.0, 10.0, 11.0, r.random() * 20 + 1])))
            if r.random() < 0.1:
                paid.append((t, day, r.random()))
    prices = spark.createDataFrame(rows, "Ticker string, Date date, C double").cache()
    return prices, spark.createDataFrame(paid, "Ticker string, Date date, Dividend double").cache()


@pytest.mark.parametrize("days", [7, 100, 100_000])
def test_spans_equal_windows(history, days):
    prices, paid = history
    want, got = ({(x.Ticker, x.Date): x.AC for x in df.collect()} for df in (series.adjusted_close(prices, paid), spans.adjusted_close(prices, paid, days)))
    assert got == pytest.approx(want)
    some = prices.select("Ticker", "Date", F.col("C").alias("AC"))
    want, got = ({(x.Ticker, x.Date): x.drawdown for x in df.collect()} for df in (series.drawdown(some), spans.drawdown(some, days)))
    assert got == want
    want, got = (sorted(map(tuple, df.select("Ticker", "Date", "Details").collect())) for df in (quality.stale_run(prices, 3), quality.stale_run(prices, 3, days=days)))
    assert got == want and len(want) > 10
