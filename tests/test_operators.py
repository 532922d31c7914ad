"""Hand-computed cases of the panel operators."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tapewright.operators import cleaning, factors, joins, mldata, quality, reporting, screening, series, similarity, statements, windows, neighbours
from tapewright.sources import files, panels, sinks
from tapewright.streaming import ingest

D = dt.date


def bars(spark, closes, ticker="A", start=D(2026, 1, 1)):
    rows = [(ticker, start + dt.timedelta(i), *[float(c)] * 4, 100, float(c)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "Ticker string, Date date, O double, H double, L double, C double, V bigint, AC double")


def splits(spark, *days):
    return spark.createDataFrame([("A", d, 2.0) for d in days], "Ticker string, Date date, Ratio double")


def test_extreme_return_skips_split_days_and_tags_reverts(spark):
    found = quality.extreme_return(bars(spark, [10.0, 10, 30, 30]), splits(spark)).collect()
    assert [(r.Date, r.Details) for r in found] == [(D(2026, 1, 3), "ret=200 %")]
    assert quality.extreme_return(bars(spark, [40.0, 40, 10, 10]), splits(spark, D(2026, 1, 3))).count() == 0
    tagged = {r.Date: "spike" in r.Details for r in quality.extreme_return(bars(spark, [10.0, 30, 10, 10]), splits(spark)).collect()}
    assert tagged == {D(2026, 1, 2): True, D(2026, 1, 3): False}


def test_stale_run_and_gap(spark):
    df = bars(spark, [5.0] * 20).unionByName(bars(spark, [5.0] * 19, "B"))
    assert [(r.Ticker, r.Date) for r in quality.stale_run(df).collect()] == [("A", D(2026, 1, 20))]
    gaps = spark.createDataFrame([("A", D(2026, 1, 1)), ("A", D(2026, 2, 20)), ("B", D(2026, 1, 1)), ("B", D(2026, 1, 31))], "Ticker string, Date date")
    assert [r.Ticker for r in quality.date_gap(gaps).collect()] == ["A"]


def test_adjusted_close(spark):
    paid = spark.createDataFrame([("A", D(2026, 1, 3), 0.5)], "Ticker string, Date date, Dividend double")
    ac = [r.AC for r in series.adjusted_close(bars(spark, [10.0, 11, 12]).drop("AC"), paid).orderBy("Date").collect()]
    assert ac == pytest.approx([10 * (1 - 0.5 / 11), 11 * (1 - 0.5 / 11), 12])
    paid = spark.createDataFrame([("A", D(2026, 1, 2), 500.0), ("A", D(2026, 1, 4), 10.0)], "Ticker string, Date date, Dividend double")
    ac = [r.AC for r in series.robust_adjusted_close(bars(spark, [100.0] * 4).drop("AC"), paid).orderBy("Date").collect()]
    assert ac == pytest.approx([90, 90, 90, 100])


def test_drawdown_and_rebase(spark):
    got = [r.drawdown for r in series.drawdown(bars(spark, [100.0, 110, 99, 110])).orderBy("Date").collect()]
    assert got == pytest.approx([0, 0, -0.1, 0])
    h = bars(spark, [10.0, 80, 160, 320]).withColumn("Market", F.lit(1.0))
    assert [r.AC for r in series.rebased(h, 3).orderBy("Date").collect()] == pytest.approx([100, 200, 400])


def test_repairs_in_order_and_idempotent(spark):
    df = bars(spark, [5.0, 6.0]).withColumns({"L": F.lit(0.0), "O": F.when(F.col("C") == 5, 0.0).otherwise(F.col("O"))})
    fixes = [cleaning.Fix("repair_zero_low", "prices"), cleaning.Fix("repair_zero_open", "prices")]
    once = cleaning.apply_all(df, fixes)
    assert [(r.O, r.L) for r in once.orderBy("Date").collect()] == [(5, 5), (6, 6)]
    assert all(cleaning.detect(once, f) == 0 for f in fixes) and cleaning.detect(df, fixes[0]) == 2
    assert cleaning.apply_fix(df, cleaning.Fix("delete_date_range", "prices")).count() == 2
    with pytest.raises(ValueError):
        cleaning.detect(df, cleaning.Fix("set_value", "prices", column="x;y"))


def test_percentile_ranks(spark):
    df = spark.createDataFrame([("a", 0.10, 0.2), ("b", 0.05, 0.4), ("c", None, 0.3)], "Ticker string, earnings_yield double, vol_252 double")
    got = {r.Ticker: (r.rank_earnings_yield, r.rank_vol_252) for r in screening.compute_ranks(df, ["earnings_yield", "vol_252"]).collect()}
    assert got["a"] == (100, 100) and got["b"] == (50, pytest.approx(100 / 3)) and got["c"][0] is None
    score = screening.composite_score(screening.compute_ranks(df, ["earnings_yield", "vol_252"]), ["earnings_yield", "vol_252"])
    assert {r.Ticker: r.score for r in score.collect()}["c"] == pytest.approx(200 / 3)


def test_buckets_are_right_closed(spark):
    df = spark.createDataFrame([(50e6,), (50e6 + 1,), (3e11,), (0.0,), (None,)], "m double")
    assert [r.b for r in df.select(screening.mcap_bucket(F.col("m")).alias("b")).collect()] == ["nano", "micro", "mega", "nano", None]


def test_upsert_is_idempotent_and_keeps_absent_columns(spark):
    old = spark.createDataFrame([("A", 1, 1.5, "x"), ("B", 1, 2.0, "y")], "k string, d int, c double, note string")
    new = spark.createDataFrame([("A", 1, 9.9), ("C", 1, 3.0)], "k string, d int, c double")
    once = sinks.upsert(old, new, ["k", "d"])
    want = [("A", 1, 9.9, "x"), ("B", 1, 2.0, "y"), ("C", 1, 3.0, None)]
    assert sorted(map(tuple, once.collect())) == want and sorted(map(tuple, sinks.upsert(once, new, ["k", "d"]).collect())) == want


def test_findings_are_replaced_by_check(spark, tmp_path):
    found = quality.negative_volume(bars(spark, [1.0, 2.0, 3.0]).withColumn("V", F.lit(-1)))
    assert sinks.replace_findings(spark, str(tmp_path), "a", "error", found) == 3
    assert sinks.replace_findings(spark, str(tmp_path), "b", "warn", found.limit(2)) == 2
    assert sinks.replace_findings(spark, str(tmp_path), "a", "error", found.limit(1)) == 1
    assert {r.CheckName: r["count"] for r in spark.read.parquet(str(tmp_path)).groupBy("CheckName").count().collect()} == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        sinks.replace_findings(spark, str(tmp_path), "a", "error", found.drop("Key"))


def test_ledger_and_lists(spark, tmp_path):
    ledger = spark.createDataFrame([("X", "us", 2, D(2026, 1, 1), D(2026, 1, 1)), ("Y", "us", 1, D(2026, 1, 1), D(2026, 1, 1))], "ticker string, market string, attempts int, first_blacklisted date, last_checked date")
    out = sinks.ledger_recheck(ledger, spark.createDataFrame([("X", False), ("Y", True)], "ticker string, ok boolean"), "2026-02-01")
    assert [(r.ticker, r.attempts) for r in out["dead"].collect()] == [("X", 3)] and [r.ticker for r in out["revived"].collect()] == ["Y"] and out["ledger"].count() == 0
    sinks.save_list(spark.createDataFrame([("NA",), ("B",)], "Ticker string"), str(tmp_path), "my list!")
    assert [r.Ticker for r in sinks.load_list(spark, str(tmp_path), "my list!").collect()] == ["B", "NA"]
    with pytest.raises(ValueError):
        sinks.list_name("!!")


def test_increment_plan(spark):
    prices = spark.createDataFrame([("A", D(2024, 3, 20)), ("B", D(2024, 3, 22))], "Ticker string, Date date")
    plan = panels.plan_increments(prices, prices.select("Ticker"))
    assert {(r.batch, r.start) for r in plan.collect()} == {(0, D(2024, 3, 15))}


def test_windows_drop_unsound_ones(spark):
    values = [1.0, float("nan"), 3, 4, 0.0, 6, 7, 8, 9]
    df = bars(spark, values).select("Ticker", "Date", F.col("C").alias("Price"))
    assert [r.offset for r in windows.build_segments(df, 3, 3).collect()] == [6]
    with pytest.raises(ValueError):
        windows.build_segments(df, 0, 1)
    flat = windows.encode(windows.build_segments(bars(spark, [5.0] * 3).select("Ticker", "Date", F.col("C").alias("Price")), 3, 3), "zscore", 3)
    assert flat.first().xh == [0, 0, 0]


def test_splits_do_not_leak(spark):
    rows = [("A", D(2026, 1, 1) + dt.timedelta(i), D(2026, 1, 1) + dt.timedelta(i + 9)) for i in range(0, 200, 5)]
    out = mldata.split_windows(spark.createDataFrame(rows, "Ticker string, start_date date, end_date date"), 0.25, "recent", 2)
    span = {r.split: (r.a, r.b) for r in out.groupBy("split").agg(F.min("start_date").alias("a"), F.max("end_date").alias("b")).collect()}
    assert span["train"][1] < span["valid"][0] and span["valid"][1] < span["test"][0]


def test_pca_and_neighbours(spark):
    df = spark.createDataFrame([(i, [float(i * i), 2.0 * i * i, 1.0]) for i in range(5)], "id long, v array<double>")
    assert len(similarity.pca_reduce(df, "v", variance=0.999).first().reduced) == 1
    near = {r.id: (r.other, r.distance) for r in neighbours.nearest_others(df, "id", "v", pivots=3).collect()}
    assert near[4][0] == 3 and near[0] == (1, pytest.approx(5**0.5))


def test_statement_views(spark):
    keys = "Ticker string, Market string, Period string, IsRestated boolean, `Fiscal Year` bigint, `Fiscal Period` string, `Report Date` date, `Net Income` double"
    df = spark.createDataFrame([("A", "us", "A", True, 2023, "FY", D(2023, 12, 31), -5e6), ("A", "us", "A", True, 2024, "FY", D(2024, 12, 31), 15e6)], keys)
    out = {r.label: r.value for r in statements.yoy(statements.line_items(df)).collect()}
    assert out == {"FY 2023": None, "FY 2024": 400.0}


def test_decoding_and_files(spark, tmp_path):
    t = spark.createDataFrame([("^SPX",), ("10YUSY",), ("EURUSD",), ("^NOTREAL",)], "Ticker string")
    curated = spark.createDataFrame([("^SPX", "S&P 500", "United States")], "Ticker string, Name string, Country string")
    countries = spark.createDataFrame([("US", "United States")], "code string, country string")
    currencies = spark.createDataFrame([("EUR", "Euro"), ("USD", "US dollar")], "code string, currency string")
    got = {r.Ticker: (r.Name, r.Country) for r in reporting.decode_instruments(t, curated, countries, currencies).collect()}
    assert got == {"^SPX": ("S&P 500", "United States"), "10YUSY": ("10-year government bond yield", "United States"), "EURUSD": ("Euro/US dollar exchange rate", None), "^NOTREAL": (None, None)}
    (tmp_path / "u.csv").write_text("<TICKER>,<PER>,<DATE>,<TIME>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>,<OPENINT>\neurusd,D,20260102,0,1,2,0.5,1.5,0,0\naapl.us,D,20260102,0,1,2,0.5,1.5,9,0\n10YUSY.B,D,20260102,0,4,4,4,4,0,0\n")
    assert sorted((r.Ticker, r.AssetClass, r.C) for r in files.read_update_file(spark, f"{tmp_path}/u.csv").collect()) == [("10YUSY", "bonds", 4.0), ("EURUSD", "currencies", 1.5)]


def test_profiles_and_officers(spark):
    docs = spark.createDataFrame([("A", '{"longName": "Acme", "companyOfficers": [{"name": "N", "age": 50}]}', D(2026, 1, 1)), ("B", "{}", None)], "Ticker string, info string, FetchedOn date")
    assert [(r.Ticker, r.longName, r.city) for r in files.to_profiles(docs).collect()] == [("A", "Acme", None), ("B", None, None)]
    assert [(r.Ticker, r.name, r.age) for r in files.to_officers(docs).collect()] == [("A", "N", 50)]


HEAD = "<TICKER>,<PER>,<DATE>,<TIME>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>,<OPENINT>\n"


def test_stream_upsert_keeps_the_later_arrival(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def land(name, rows, at):
        (src / name).write_text(HEAD + "".join(f"{t},D,{d},0,1,20,0.5,{c},0,0\n" for t, d, c in rows))
        os.utime(src / name, (at, at))

    def run(files):
        ingest.upsert_stream(ingest.stream_bars(spark, str(src), files), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
        return {(r.Ticker, r.Date.day): r.C for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    # Two files of one batch: the later one wins, whatever its values or name.
    land("b.csv", [("eurusd", 20260102, 9.9), ("eurusd", 20260103, 3.0)], 1_700_000_000)
    land("a.csv", [("eurusd", 20260102, 1.5)], 1_700_000_100)
    assert run(1000) == {("EURUSD", 2): 1.5, ("EURUSD", 3): 3.0}
    # Later batches: a late correction of an old day, then another, and a new day.
    land("c.csv", [("eurusd", 20260103, 7.5)], 1_700_000_200)
    land("d.csv", [("eurusd", 20260103, 2.5), ("usdjpy", 20260104, 4.0)], 1_700_000_300)
    want = {("EURUSD", 2): 1.5, ("EURUSD", 3): 2.5, ("USDJPY", 4): 4.0}
    assert run(1) == want and run(1) == want


def test_upsert_order_decides_between_incoming_rows(spark):
    new = spark.createDataFrame([("A", 9.9, 1), ("A", 1.5, 2)], "k string, c double, arrived int")
    assert sinks.upsert(None, new, ["k"], [F.col("arrived").desc()]).first().c == 1.5


def test_repeats_go_within_the_watermark_and_row_checks_see_volume(spark, tmp_path):
    rows = [(1, 2.0, dt.datetime(2026, 1, 1)), (1, 2.0, dt.datetime(2026, 1, 1)), (1, 3.0, dt.datetime(2026, 1, 1))]
    df = spark.createDataFrame(rows, "id int, v double, ts timestamp")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    once = ingest.without_repeats(ingest.stream_table(spark, f"{tmp_path}/in", "*.parquet", df.schema), ["id", "v", "ts"])
    ingest.append_stream(once, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [2.0, 3.0]
    bad = bars(spark, [1.0, 2.0]).withColumns({"V": F.when(F.col("C") == 1, -1).otherwise(5), "AC": F.when(F.col("C") == 2, -1.0).otherwise(1.0)})
    assert {(r.Date.day, r.CheckName) for r in ingest.row_checks(bad).collect()} == {(1, "negative_volume"), (2, "nonpositive_price")}


def test_nearest_filing_by_report_then_by_filing_date(spark):
    left = spark.createDataFrame([(1, "c", D(2024, 12, 31), "FY"), (2, "c", D(2024, 3, 31), "Q1"), (3, "c", D(2020, 12, 31), "FY"), (4, "c", D(2020, 3, 31), "Q1"), (5, "x", D(2024, 3, 31), "Q1")], "id int, cik string, day date, fp string")
    rows = [
        (1, "10-K", D(2024, 12, 25), D(2025, 2, 1)), (2, "10-K405", D(2025, 1, 6), D(2025, 3, 1)), (3, "10-Q", D(2024, 12, 31), D(2025, 2, 1)), (4, "10-Q", D(2024, 4, 9), D(2024, 5, 1)), (5, "10-Q", D(2024, 4, 11), D(2024, 5, 2)),
        (6, "10-K", None, D(2021, 5, 30)), (7, "10-K", D(2019, 1, 1), D(2021, 5, 29)), (8, "10-Q", None, D(2020, 5, 31)),
    ]
    filings = spark.createDataFrame([("c", *r) for r in rows], "cik string, seq int, form string, report_date date, filing_date date")
    got = {r.id: (r.seq, r["match"]) for r in joins.nearest_filing(left, filings, ["cik"], "id", "day", "fp").collect()}
    # Six days either way: the first wins; 150 days for a year's report, 60 for a quarter's (61 are too many).
    assert got == {1: (1, "report"), 2: (4, "report"), 3: (7, "filing"), 4: (None, None), 5: (None, None)}


def test_metadata_filters_and_detail(spark):
    rows = [("AAA", "Alpha", "s", "i", "small", 5e6, 3.0, True, 0), ("BBB", "Beta", "s", "j", "mega", 1e6, 1.0, False, 9), ("CCC", "alphabet", "t", "i", "small", 2e6, 2.0, True, 1)]
    df = spark.createDataFrame(rows, "Ticker string, name string, sector string, industry string, mcap_bucket string, dollar_vol double, years double, active boolean, n_anomalies int")
    found = lambda **kw: sorted(r.Ticker for r in screening.apply_metadata_filters(df, **kw).collect())
    assert found(search=" alpha ") == ["AAA", "CCC"] and found(search="  ") == ["AAA", "BBB", "CCC"] and found(search="b.b") == []
    assert found(sectors=["s"], status="active") == ["AAA"] and found(status="delisted") == ["BBB"] and found(min_dollar_vol_mn=2.0) == ["AAA", "CCC"]
    assert found(min_years=2.0, max_anomalies=0) == ["AAA"] and found(buckets=["mega"]) == ["BBB"] and found(industries=["i"], min_years=2.5) == ["AAA"]


def test_dividend_growth_is_null_without_recent_dividends(spark):
    paid = spark.createDataFrame([("A", D(2024, 1, 5), 1.0), ("B", D(2024, 1, 5), 1.0), ("B", D(2025, 1, 2), 1.25)], "Ticker string, Date date, Dividend double")
    assert dict(factors.dividend_growth(paid, bars(spark, [1.0], start=D(2025, 6, 1))).collect()) == {"A": None, "B": pytest.approx(0.25)}


def test_statement_variants_and_companies(spark, tmp_path):
    (tmp_path / "q").write_text("Ticker;SimFinId;Fiscal Year;Fiscal Period;Report Date;Revenue\nA;7;2024;Q1;2024-03-31;12\n")
    (tmp_path / "a").write_text("Ticker;SimFinId;Fiscal Year;Fiscal Period;Revenue;Net Income\nA;7;2024;FY;;3\n")
    out = files.read_statements(spark, {("Q", True): f"{tmp_path}/q", ("A", True): f"{tmp_path}/a", ("Q", False): None})
    assert sorted((r.Period, r.SrcId, r.Revenue, r["Net Income"]) for r in out.collect()) == [("A", 7, None, 3.0), ("Q", 7, 12.0, None)]
    assert files.read_statements(spark, {("Q", True): None}).count() == 0
    (tmp_path / "c").write_text('Ticker;SimFinId;Company Name;IndustryId;Business Summary\nA;1;"A; Inc";10;"two\nlines ""and quotes"""\nB;2;B;99;\n')
    (tmp_path / "i").write_text("IndustryId;Industry;Sector\n10;Chips;Tech\n")
    got = {r.Ticker: (r.CompanyName, r.Sector, r.BusinessSummary) for r in files.read_companies(spark, f"{tmp_path}/c", f"{tmp_path}/i").collect()}
    assert got == {"A": ("A; Inc", "Tech", 'two\nlines "and quotes"'), "B": ("B", None, None)}


def test_beta_by_construction(spark):
    n = 300
    closes = [100.0]
    market = [100.0]
    for i in range(n):
        r = 0.01 if i % 2 else -0.008
        market.append(market[-1] * (1 + r))
        closes.append(closes[-1] * (1 + 2 * r))
    m = bars(spark, market).select("Date", "C")
    out = factors.price_factors(bars(spark, closes), m).first()
    assert out.beta == pytest.approx(2.0) and out.vol_252 is not None


def test_neighbours_break_ties_by_id_and_pairs_are_all_pairs(spark):
    rows = [(i, [float(i % 3), 0.1 * (i % 3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {}
    for r in neighbours.nearest_others(df, "id", "v", 4, block_rows=20).collect():
        got.setdefault(r.id, {})[r.place] = r.other
    for i, _ in rows:
        same = [j for j, _ in rows if j % 3 == i % 3 and j != i]
        assert [got[i][k] for k in range(1, 5)] == same[:4]
    line = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [1.5]), (3, [10.0])], "id long, v array<double>")
    pairs = similarity.closest_pairs(neighbours.nearest_others(line, "id", "v", 3), 3).collect()
    assert [(r.i, r.j, r.distance) for r in pairs] == [(1, 2, 0.5), (0, 1, 1.0), (0, 2, 1.5)]
