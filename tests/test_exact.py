"""Texts and sums that must not hang on the engine's formatter or on the order of rows."""

import datetime as dt

from tapewright.functions.columns import fixed
from tapewright.operators import quality, screening, statements
from tapewright.plans import registry
from tapewright.sources.panel import Panel


def test_fixed_rounds_as_python_does(spark):
    numbers = [0.25, 0.35, 0.15, 0.05, 0.5, 1.5, 2.5, 928.5, -82.5, -0.3, 9.96, 99.95, 56.25, 0.00015, 2.0**52 + 0.5, 123456789.05] + [k / 8 for k in range(200)] + [k / 100000 for k in range(1, 100000, 97)]
    df = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", *(fixed("x", d).alias(f"d{d}") for d in range(5)))
    assert [tuple(r)[1:] for r in df.collect()] == [tuple(f"{x:.{d}f}" for d in range(5)) for x in numbers]


def test_halfway_percentages_go_to_the_even_digit(spark):
    day = dt.date(2020, 1, 1)
    bars = spark.createDataFrame([("a", day + dt.timedelta(i), c) for i, c in enumerate((800.0, 8228.0, 8228.0))], "Ticker string, Date date, C double")
    splits = spark.createDataFrame([], "Ticker string, Date date")
    assert [r.Details for r in quality.extreme_return(bars, splits).collect()] == ["ret=928 %"]  # 928.5
    paid = spark.createDataFrame([("a", day, 450.0)], "Ticker string, Date date, Dividend double")
    assert [r.Details for r in quality.oversized_dividend(paid, bars).collect()] == ["56.2 % of close"]  # 56.25


def test_sums_of_a_quarter_do_not_hang_on_the_order_of_rows(spark, tmp_path):
    """Amounts that add up to one half exactly, in orders whose sums of doubles fall on either side of it."""
    prices, revenue = [3766.63, 52406.09, 51635.1, 2655.73, 74784.23, 67638.54, 1000.18], []
    rows = [(1, 1, 1, 1, 1.0, x, 0.0, 0.0, "N", "O", dt.datetime(1998, 1, 5)) for x in prices]
    fields = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    for i in range(len(rows)):
        spark.createDataFrame(rows[i:] + rows[:i], fields).coalesce(1).write.parquet(f"{tmp_path}/{i}/lineitem.parquet")
        revenue += [r.rev for r in Panel(spark, f"{tmp_path}/{i}").quarters.collect()]
    assert set(revenue) == {253887}  # 253886.5


def test_common_size_keeps_lines_without_a_value(spark):
    row = ("A", "us", "Q", False, 2020, "Q1", dt.date(2020, 3, 28), 1000, None)
    df = spark.createDataFrame([row], "Ticker string, Market string, Period string, IsRestated boolean, `Fiscal Year` long, `Fiscal Period` string, `Report Date` date, `Total Assets` long, `Short Term Debt` long")
    assert {r["item"]: r.value for r in statements.common_size(df, "balance").collect()} == {"Total Assets": 100.0, "Short Term Debt": None}


def test_peers_of_a_scope_by_places_equal_pairs(spark):
    """Ties, missing values, a scope of one and tickers without a scope."""
    rows = [(f"t{i}", "s" if i % 3 else "r", float(i), float(i * 7 % 5), None if i % 4 == 0 else float(i % 3)) for i in range(40)]
    pool = spark.createDataFrame(rows + [("x", "unknown", 1.0, 1.0, 1.0), ("y", None, 1.0, 1.0, 1.0), ("z", "alone", 1.0, 1.0, 1.0)], "Ticker string, sector string, mcap double, size double, vol_252 double")
    by_pairs = screening.own_vs_peers(screening.scope_peer_group(pool, "sector", 1000), ["size", "vol_252"])
    by_places = screening.own_vs_scope(pool, "sector", ["size", "vol_252"])
    shown = lambda df: sorted((r.Ticker, r.factor, round(r.percentile, 9), r.verdict) for r in df.collect())
    assert shown(by_places) == shown(by_pairs) and len(shown(by_places)) > 60


def test_market_caps_of_large_ticker_numbers_do_not_overflow(spark, tmp_path):
    for table, row, fields in (("supplier", (59999, "Supplier#000059999", 0), "s_suppkey long, s_name string, s_nationkey int"), ("nation", (0, "N", 0), "n_nationkey int, n_name string, n_regionkey int"), ("region", (0, "R"), "r_regionkey int, r_name string")):
        spark.createDataFrame([row], fields).write.parquet(f"{tmp_path}/{table}.parquet")
    assert [(r.subject, r.Ticker, r.place) for r in registry.queries()["m9_peer_groups"](spark, str(tmp_path)).collect()] == [("59999", "59999", 1)]
