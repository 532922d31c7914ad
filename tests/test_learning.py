"""Boosting, exact neighbours, peers and guards on planted cases."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.operators import boosting, cleaning, joins, mldata, mleval, neighbours, screening, statements
from tapewright.sources import files


def accuracy(df):
    return df.filter("split = 'test'").agg(F.avg((F.col("prediction") == F.col("label_index")).cast("double"))).first()[0]


@pytest.fixture(scope="module")
def classes(spark):
    r = np.random.default_rng(3)
    n = 2000
    x = r.normal(size=(n, 6))
    y = (x @ r.normal(size=(6, 3)) + 0.4 * r.normal(size=(n, 3))).argmax(1)
    part = np.where(r.random(n) < 0.6, "train", np.where(r.random(n) < 0.5, "valid", "test"))
    rows = [(str(p), x[i].tolist(), int(y[i]), 1.0 + float(y[i] == 0)) for i, p in enumerate(part)]
    rows += [("train", None, 1, 1.0), ("train", [1.0, 2.0], 1, 1.0), ("test", None, 1, 1.0), ("train", [float("nan")] * 6, 1, 1.0), ("train", [0.0] * 6, -1, 1.0)]
    return spark.createDataFrame(rows, "split string, flat array<double>, label_index int, weight double").cache()


def test_booster_beats_the_forest(classes):
    model = boosting.fit_classifier(classes, 3, settings=boosting.Settings(rounds=14, rate=0.5, depth=3))
    assert model.history[-1] < 0.6 * model.history[0] and len(model.rounds) <= 14
    found = boosting.predict(model, classes)
    whole = classes.filter("size(flat) = 6 and label_index >= 0 and not isnan(flat[0])")
    forest = mleval.predict(mleval.fit_classifier(whole, trees=20), whole)
    assert accuracy(found) > accuracy(forest)
    assert found.filter("flat is null or size(flat) = 2").select("prediction").distinct().collect() == [(None,)]


def test_trees_do_not_depend_on_partitions(classes):
    settings = boosting.Settings(rounds=2, depth=2)
    one, other = (boosting.fit_classifier(df, 3, settings=settings) for df in (classes.coalesce(1), classes.repartition(7)))
    for a, b in zip(one.rounds, other.rounds):
        for s, t in zip(a, b):
            assert (s.feature == t.feature).all() and (s.cut == t.cut).all() and np.allclose(s.value, t.value, atol=1e-5)


def test_booster_stops_early_on_noise(spark):
    r = np.random.default_rng(5)
    rows = [("train" if i % 2 else "valid", r.normal(size=3).tolist(), int(r.integers(0, 2))) for i in range(400)]
    df = spark.createDataFrame(rows, "split string, flat array<double>, label_index int")
    model = boosting.fit_classifier(df, 2, weight=None, settings=boosting.Settings(rounds=50, patience=2, rate=0.5, depth=2))
    assert len(model.history) < 15 and len(model.rounds) == max(1, int(np.argmin(model.history)))


def test_ranker_beats_the_pointwise_model(spark):
    """The level of a feature moves from date to date; only its order within a date tells."""
    r = np.random.default_rng(4)
    dates, k = 50, 40
    n = dates * k
    x, date = r.normal(size=(n, 4)), np.repeat(np.arange(dates), k)
    score = x[:, 0] + 0.7 * x[:, 1] * x[:, 2] + 0.3 * r.normal(size=n)
    x[:, 0] += 3 * r.normal(size=dates)[date]
    part = np.where(date < 32, "train", np.where(date < 41, "valid", "test"))
    rows = [(f"T{i % k:02d}", int(date[i]), str(part[i]), x[i].tolist(), float(score[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "Ticker string, end_date int, split string, flat array<double>, excess double")
    df = mldata.relevance_grades(df, "excess", "end_date", 10).cache()
    model = boosting.fit_ranker(df, settings=boosting.Settings(rounds=8, patience=3, rate=0.4, depth=3, top=16, **boosting.OF_PAIRS))
    assert max(model.history) == model.history[len(model.rounds)]
    test = df.filter("split = 'test'")
    got = boosting.ndcg(boosting.predict(model, test), top=16).first()
    pointwise = boosting.ndcg(mleval.predict(mleval.fit_ranker(df, rounds=8), test), top=16).first()
    assert got.groups == 9 and got.ndcg > pointwise.ndcg
    with pytest.raises(ValueError):
        boosting.fit_ranker(df, objective="other")


def test_ndcg_by_hand(spark):
    df = spark.createDataFrame([("a", 1, 0.9, 0), ("b", 1, 0.5, 2), ("c", 1, 0.1, 1), ("d", 2, 0.3, 0)], "Ticker string, end_date int, prediction double, grade int")
    want = (3 / np.log2(3) + 1 / 2) / (3 + 1 / np.log2(3))
    got = boosting.ndcg(df).first()
    assert got.ndcg == pytest.approx(want) and got.groups == 1


def test_neighbours_equal_brute_force_and_skip_blocks(spark):
    r = np.random.default_rng(1)
    v = (r.normal(size=(12, 8)) * 10)[r.integers(0, 12, 600)] + r.normal(size=(600, 8))
    v[50:180] = v[50]  # copies beyond a block
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame([*rows, (900, None), (None, [0.0] * 8), (901, [float("nan")] * 8)], "id long, v array<double>")
    got = {}
    for x in neighbours.nearest_others(df, "id", "v", 4, block_rows=64).collect():
        got.setdefault(x.id, {})[x.place] = (x.other, x.distance)
    for i in range(600):
        d = np.sqrt(((v - v[i]) ** 2).sum(1))
        d[i] = np.inf
        order = np.lexsort((np.arange(600), d))[:4]
        assert [got[i][k][0] for k in range(1, 5)] == order.tolist()
    assert set(got) == set(range(600))
    report = neighbours.search_report(df, "id", "v", 4, block_rows=64).first()
    assert report.compared < 0.35 and report.meetings < report.all_meetings
    asked = spark.createDataFrame([(5, v[5].tolist()), (7000, (v[9] + 0.1).tolist())], "id long, v array<double>")
    assert {x.id: x.other for x in neighbours.nearest_others(df, "id", "v", 1, asked, block_rows=64).collect()}[7000] == 9


def test_nothing_to_search(spark):
    df = spark.createDataFrame([], "id long, v array<double>")
    assert neighbours.nearest_others(df, "id", "v").collect() == []
    one = spark.createDataFrame([(1, [1.0])], "id long, v array<double>")
    assert neighbours.nearest_others(one, "id", "v").collect() == []


def brute_peers(pool, cap):
    out = set()
    for t, scope, m in pool:
        own = [(x, y) for x, s, y in pool if x != t and s == scope and scope not in (None, "unknown")]
        gap = lambda y: abs(np.log10(y) - np.log10(m)) if y and y > 0 and m and m > 0 else np.inf  # noqa: E731, B023
        own.sort(key=lambda x: (gap(x[1]), x[0]))
        out |= {(t, t, 1)} | {(t, x, i + 2) for i, (x, _) in enumerate(own[: cap - 1])}
    return out


def test_peers_are_the_nearest_by_cap(spark):
    r = random.Random(2)
    pool = [(f"T{i:03d}", r.choice(["tech", "tech", "oil", "unknown", None]), r.choice([None, 0.0, -1.0, 5.0, 5.0, 5.0, 10.0 ** r.randint(1, 4), r.random() * 1e6])) for i in range(160)]
    df = spark.createDataFrame(pool, "Ticker string, industry string, mcap double")
    for cap in (4, 12, 500):
        assert {(x.subject, x.Ticker, x.place) for x in screening.scope_peer_group(df, cap=cap).collect()} == brute_peers(pool, cap)


D = dt.date


def test_fixes_are_guarded(spark):
    schema = "SrcTable string, Ticker string, Date date"
    undated = spark.createDataFrame([("income", "A", None)], schema)
    dated = spark.createDataFrame([("prices", "A", D(2024, 1, 2)), ("prices", "B", D(2024, 1, 2))], schema)
    for action in ("delete_rows", "delete_span", "clear_value", "set_value"):
        with pytest.raises(ValueError, match="dates"):
            cleaning.fix_entries(action, undated, "V", 1, "why")
    bad = [
        ("delete_rows", spark.createDataFrame([("prices", "A", None)], schema), None, None, "why"), ("delete_rows", dated.limit(0), None, None, "why"), ("delete_ticker", spark.createDataFrame([(None, "A", None)], schema), None, None, "why"),
        ("set_value", dated, "V", 1, "why"), ("set_value", dated.limit(1), "V", None, "why"), ("set_value", dated.limit(1), None, 1, "why"), ("clear_value", dated, None, None, "why"),
        ("rebuild_adjusted_close", undated, None, None, "why"), ("delete_rows", dated, None, None, "  "), ("other", dated, None, None, "why"),
    ]
    for action, found, column, value, reason in bad:
        with pytest.raises(ValueError):
            cleaning.fix_entries(action, found, column, value, reason)
    out = cleaning.fix_entries("delete_rows", dated, reason=" why ").first()
    assert (out.fix_type, out.tickers, out.start, out.end, out.reason) == ("delete_date_range", ["A", "B"], D(2024, 1, 2), D(2024, 1, 2), "why")


def test_lower_is_better_takes_the_rest_of_the_share(spark):
    rows = [("a", t, v, v) for t, v in (("a", 1.0), ("b", 1.0), ("c", 2.0))]
    peers = spark.createDataFrame(rows, "subject string, Ticker string, vol_252 double, size double")
    got = {r.factor: (r.percentile, r.verdict) for r in screening.own_vs_peers(peers, ["vol_252", "size"]).collect()}
    assert got == {"vol_252": (50.0, "average"), "size": (50.0, None)}


def test_fences_widen_to_the_own_value(spark):
    df = spark.createDataFrame([("g", float(x)) for x in (1, 2, 3, 4, 100)], "g string, v double")
    own = spark.createDataFrame([("g", -5.0)], "g string, own double")
    fences = screening.robust_fences(df, "g", "v", own)
    assert tuple(fences.first()) == ("g", -5.0, 7.0)
    assert sorted((r.v, r.shown, r.beyond) for r in screening.flag_outliers(df, fences, "g", "v").collect())[-1] == (100.0, 7.0, 1)
    flat = screening.robust_fences(spark.createDataFrame([("g", 2.0), ("g", 2.0)], "g string, v double"), "g", "v")
    assert tuple(flat.first()) == ("g", None, None)


def test_levels_follow_the_statement(spark):
    keys = "Ticker string, Market string, Period string, IsRestated boolean, `Fiscal Year` bigint, `Fiscal Period` string, `Report Date` date, Revenue double, `Operating Income (Loss)` double, `Net Income` double, Other double"
    df = spark.createDataFrame([("A", "us", "A", True, 2024, "FY", D(2024, 12, 31), 9.0, 3.0, 2.0, 1.0)], keys)
    assert {r["item"]: r["level"] for r in statements.line_items(df).collect()} == {"Revenue": 1, "Operating Income (Loss)": 0, "Net Income": 0, "Other": 2}
    assert [r["item"] for r in statements.summary_lines(statements.line_items(df), "income").orderBy("place").collect()] == ["Revenue", "Operating Income (Loss)", "Net Income"]


def test_vendor_tickers(spark):
    given = {"ABCDEF.US": None, "USD_I": None, "SHORT.B": "bonds", "^SPX": "indices", "eurusd": "currencies", "BTC.V": None, "ABCDEFG": None, "^X.B": "bonds"}
    df = spark.createDataFrame([(t,) for t in given], "t string")
    assert {r.t: r.c for r in df.select("t", files.asset_class(F.col("t")).alias("c")).collect()} == given


def test_late_corrections_of_old_periods_do_not_hide_new_ones(spark):
    day = lambda m, d: D(2024, m, d)
    rows = [("A", day(1, 31), day(2, 10), False, 1.0), ("A", day(2, 29), day(3, 10), False, 2.0), ("A", day(1, 31), day(4, 1), True, 1.5), ("A", day(2, 29), day(5, 1), True, 2.5), ("A", None, day(1, 1), False, 9.0), ("A", day(3, 31), None, False, 9.0)]
    right = spark.createDataFrame(rows, "Ticker string, period date, known date, restated boolean, `v a` double")
    left = spark.createDataFrame([("A", d) for d in (day(2, 1), day(2, 10), day(3, 9), day(3, 10), day(4, 2), day(5, 1), None)] + [("B", day(5, 1))], "Ticker string, Date date")
    got = {(r.Ticker, r.Date): r["v a"] for r in joins.point_in_time(left, right, ["Ticker"], "Date", "period", "known", "restated").collect()}
    assert got == {("A", day(2, 1)): None, ("A", day(2, 10)): 1.0, ("A", day(3, 9)): 1.0, ("A", day(3, 10)): 2.0, ("A", day(4, 2)): 2.0, ("A", day(5, 1)): 2.5, ("A", None): None, ("B", day(5, 1)): None}


def test_splits_on_the_driver_equal_those_in_spark(spark):
    rng = np.random.default_rng(4)
    cells = [(t, n, f, b) for t in (0, 1) for n in range(4) for f in range(5) for b in range(8) if (b * 7 + n) % 5]
    rows = [(*c, int(g), int(h), 3) for part in range(2) for c, g, h in zip(cells, rng.integers(-(2**26), 2**26, len(cells)), rng.integers(2**20, 2**26, len(cells)))]
    # Two features alike: of equal gains the first counts; a node whose hessians are too small; the row of the loss.
    rows += [(2, 0, f, b, g << 24, 2 << 24, 2) for f in (3, 4) for b, g in ((1, 5), (4, -6))] + [(2, 1, 0, b, 1, 1, 1) for b in range(3)] + [(-1, 0, 0, 0, 7, 9, 0)]
    sums, s = spark.createDataFrame(rows, boosting._SUMS), boosting.Settings(bins=8)
    plain = lambda r: (r.tree, r.node, None if r.split is None else tuple(r.split), None if 0 <= r.tree < 2 else (r.g, r.h))
    here = sorted(map(plain, boosting._splits_here(sums, s, 5)), key=str)
    assert here == sorted(map(plain, boosting._best_splits(sums, s).collect()), key=str) and len(here) == 11
    assert any(x[:2] == (2, 0) and x[2][:2] == (3, 1) for x in here)


def test_channels_left_behind_still_tell_unsound_windows(spark):
    from tapewright.operators import windows

    rows = [("A", D(2024, 1, 1) + dt.timedelta(i), None if i == 3 else 1.0 + i, 2.0 + i, 3.0 + i) for i in range(20)]
    bars = spark.createDataFrame(rows, "Ticker string, Date date, O double, C double, AC double")
    whole = windows.build_windows_with_future_return(bars, 3, 1, 2, channels=("O", "C"))
    part = windows.build_windows_with_future_return(bars, 3, 1, 2, channels=("O", "C"), gathered=("C",))
    assert part.columns == ["Ticker", "start_date", "end_date", "label", "C"]
    assert sorted(part.collect()) == sorted(whole.drop("O").collect()) and part.count() == 13


@pytest.mark.parametrize("lot", [1, 1 << 26])
def test_neighbours_by_lots_equal_brute_force_and_write_little(spark, monkeypatch, lot):
    """Vectors without clusters, copies and ties among them: every query meets every block, and no table holds the meetings."""
    rng = np.random.default_rng(9)
    v = np.round(rng.normal(size=(600, 5)), 1)
    v[300:330], v[400:410] = v[:30], v[0]
    monkeypatch.setattr(neighbours, "LOT_BYTES", lot)
    written, settle = {}, neighbours.settle

    def counted(df, name):
        out = settle(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(neighbours, "settle", counted)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {}
    for r in neighbours.nearest_others(df, "id", "v", 3, block_rows=64, pivots=10).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append(r.other)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert got == {i: sorted(range(600), key=lambda j: (d[i, j], j))[:3] for i in range(600)}
    assert max(written.values()) <= 600 * 3
