"""Fixed windows over series as array columns, and their encodings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.columns import dbl
from tapewright.functions.places import running_sums


def _checked(length: int, stride: int) -> None:
    if length <= 0 or stride <= 0:
        raise ValueError("window length and stride must be positive")


def _windows(df: DataFrame, channels: list[str], length: int, stride: int, ends: Column, keep: tuple[str, ...] = (), gathered: list[str] | None = None) -> DataFrame:
    """Windows of `length` rows that end at rows where `ends` holds (given the row number _n), all channels positive numbers throughout; with the columns `keep` of their last row, and of the channels only those `gathered`.

    A ticker's rows, one for each of its dates, are gathered once, in the
    partition that the row numbers need anyway; each window is a slice of them.
    """
    by_date = Window.partitionBy("Ticker").orderBy("Date")
    good = F.lit(True)
    for c in channels:
        good = good & F.coalesce((dbl(c) > 0) & ~F.isnan(dbl(c)), F.lit(False))
    df = df.withColumn("_n", F.row_number().over(by_date)).withColumn("_good", good.cast("int"))
    df = df.withColumn("_sound", F.sum("_good").over(by_date.rowsBetween(1 - length, 0)))
    df = df.withColumn("_cut", F.coalesce((F.col("_n") >= length) & (F.col("_sound") == length) & ends, F.lit(False)))
    channels = gathered or channels
    row = F.struct("_n", "Date", "_cut", F.struct(*(F.col(c) for c in channels)).alias("_v"), F.when(F.col("_cut"), F.struct(F.lit(True).alias("_"), *keep)).alias("_keep"))
    rows = df.groupBy("Ticker").agg(F.array_sort(F.collect_list(row), lambda a, b: a["_n"] - b["_n"]).alias("_rows"))
    cut = rows.select("Ticker", "_rows", F.explode(F.filter("_rows", lambda r: r["_cut"])).alias("_e"))
    cut = cut.select("Ticker", (F.col("_e._n") - length).cast("long").alias("offset"), F.col("_e.Date").alias("end_date"), *(F.col(f"_e._keep.{c}").alias(c) for c in keep), F.slice("_rows", F.col("_e._n") - length + 1, F.lit(length)).alias("_w"))
    channel = lambda c: F.transform("_w", lambda r: r["_v"][c])
    return cut.withColumn("start_date", F.element_at("_w", 1)["Date"]).withColumns({f"w_{c}": channel(c) for c in channels}).drop("_w")


def build_segments(series: DataFrame, length: int, stride: int) -> DataFrame:
    """(Ticker, AssetClass?, offset, start_date, end_date, w): windows at offsets 0, stride, ... of Price; unsound ones are left out."""
    _checked(length, stride)
    extra = [c for c in ("AssetClass",) if c in series.columns]
    out = _windows(series, ["Price"], length, stride, (F.col("_n") - length) % stride == 0, tuple(extra))
    return out.select("Ticker", *extra, "offset", "start_date", "end_date", F.col("w_Price").alias("w"))


def with_window_id(windows: DataFrame) -> DataFrame:
    """Dense ids in (Ticker, offset) order, by counts of windows per ticker; no global sort of the arrays."""
    counts = windows.groupBy("Ticker").agg(F.count("*").alias("_c"))
    before = running_sums(counts, [F.col("Ticker").asc()], "_c", "_before")
    place = F.row_number().over(Window.partitionBy("Ticker").orderBy("offset"))
    return windows.join(before.select("Ticker", "_before"), "Ticker").withColumn("window_id", F.col("_before") + place - 1).drop("_before")


def build_windows(series: DataFrame, length: int, stride: int, channels: tuple[str, ...] = ("O", "H", "L", "C", "V")) -> DataFrame:
    """As build_segments over several channels: a column of 32-bit arrays for each."""
    _checked(length, stride)
    out = _windows(series, list(channels), length, stride, (F.col("_n") - length) % stride == 0)
    return out.select("Ticker", "offset", "start_date", "end_date", *(F.col(f"w_{c}").cast("array<float>").alias(c) for c in channels))


def build_windows_with_future_return(series: DataFrame, length: int, stride: int, horizon: int, label: str = "point", exit_halfwidth: int = 0, channels: tuple[str, ...] = ("O", "H", "L", "C", "V"), gathered: tuple[str, ...] | None = None) -> DataFrame:
    """Windows that end on shared reference dates (every stride-th trading date from the length-th on), with a label from AC after their end.

    point: AC at +horizon over AC at the end, less 1.  mean_exit: the mean of AC
    over +horizon -/+ exit_halfwidth instead.  vol_scaled: mean_exit over the
    population deviation of log returns in the window.  trend: slope times R2
    of log AC against the step over 1..horizon.  gathered: the channels that
    come out, if not all; the others are only looked at for soundness.
    """
    _checked(length, stride)
    if label not in ("point", "mean_exit", "vol_scaled", "trend"):
        raise ValueError(f"unknown label: {label}")
    if horizon < 1 or not 0 <= exit_halfwidth < horizon:
        raise ValueError("0 <= exit_halfwidth < horizon is needed")
    half = exit_halfwidth if label in ("mean_exit", "vol_scaled") else 0
    by_date = Window.partitionBy("Ticker").orderBy("Date")
    dates = series.select("Date").distinct()
    # One row for each trading date, far fewer than rows of the panel.
    order = Window.orderBy("Date")
    dates = dates.withColumn("_d", F.row_number().over(order)).withColumn("_all", F.count("*").over(Window.partitionBy()))
    dates = dates.filter((F.col("_d") >= length) & (F.col("_d") <= F.col("_all") - horizon) & ((F.col("_d") - length) % stride == 0)).select("Date", F.lit(True).alias("_ref"))
    df = series.join(dates, "Date", "left")
    after = by_date.rowsBetween(1, horizon + half)
    ok = F.coalesce((F.col("AC") > 0) & ~F.isnan("AC"), F.lit(False)).cast("int")
    df = df.withColumn("_ok", ok).withColumn("_later", F.sum("_ok").over(after))
    log_ac = F.log(F.when(F.col("_ok") == 1, F.col("AC")))
    df = df.withColumn("_log", log_ac).withColumn("_step", F.col("_log") - F.lag("_log").over(by_date))
    exit_ = F.lead("AC", horizon).over(by_date) if half == 0 else F.avg("AC").over(by_date.rowsBetween(horizon - half, horizon + half))
    ret = F.try_divide(exit_, "AC") - 1
    if label == "vol_scaled":
        ret = F.when(F.stddev_pop("_step").over(by_date.rowsBetween(2 - length, 0)) > 0, ret / F.stddev_pop("_step").over(by_date.rowsBetween(2 - length, 0)))
    elif label == "trend":
        h, ahead = horizon, by_date.rowsBetween(1, horizon)
        place = F.row_number().over(by_date).cast("double")
        df = df.withColumn("_x", place).withColumn("_xy", F.col("_x") * F.col("_log")).withColumn("_yy", F.col("_log") * F.col("_log"))
        y, xy, yy = (F.sum(c).over(ahead) for c in ("_log", "_xy", "_yy"))
        mean_x = F.col("_x") + (h + 1) / 2
        cov, var_x, var_y = xy - mean_x * y, F.lit(h * (h * h - 1) / 12), yy - y * y / h
        ret = F.when(var_y > 1e-12, F.pow(cov, F.lit(3)) / (F.pow(var_x, F.lit(2)) * var_y)).otherwise(0.0)
    df = df.withColumn("_label", ret)
    out = _windows(df, list(channels), length, stride, F.col("_ref").isNotNull() & (F.col("_ok") == 1) & (F.col("_later") == horizon + half) & F.col("_label").isNotNull(), ("_label",), list(gathered or channels))
    return out.select("Ticker", "start_date", "end_date", F.col("_label").alias("label"), *(F.col(f"w_{c}").cast("array<float>").alias(c) for c in gathered or channels))


def split_history(w: Column, history: int) -> tuple[Column, Column]:
    return F.slice(w, 1, history), F.slice(w, F.lit(history + 1), F.greatest(F.size(w) - history, F.lit(0)))


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _std(a: Column, mean: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(a))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value bound: it is computed once, not again for each element of an array that body maps."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _or_one(d: Column) -> Column:
    return F.when(d > 0, d).otherwise(1.0)


def zscore(h: Column, w: Column) -> Column:
    """w by mean and deviation of its history h; a flat history divides by 1."""
    return _let(_mean(h), lambda m: _let(_or_one(_std(h, m)), lambda s: F.transform(w, lambda x: (x - m) / s)))


def minmax(h: Column, w: Column) -> Column:
    return _let(F.array_min(h), lambda lo: _let(_or_one(F.array_max(h) - lo), lambda d: F.transform(w, lambda x: (x - lo) / d)))


def demean(h: Column, w: Column) -> Column:
    return _let(_mean(h), lambda m: F.transform(w, lambda x: x - m))


def rebase(to: float) -> Callable[[Column, Column], Column]:
    return lambda h, w: F.transform(w, lambda x: F.try_divide(x, F.element_at(h, 1)) * to)


def log_returns(h: Column, w: Column) -> Column:
    """Steps of logs; for a future, bridged from the last value of its history (w is then history and future joined)."""
    return F.zip_with(F.slice(w, F.lit(2), F.size(w) - 1), F.slice(w, F.lit(1), F.size(w) - 1), lambda b, a: F.log(b / a))


ENCODERS: dict[str, Callable[[Column, Column], Column]] = {"zscore": zscore, "minmax": minmax, "demean": demean, "rebase_100": rebase(100.0), "rebase_1": rebase(1.0), "log_returns": log_returns}


def encode(windows: DataFrame, encoder: str, history: int, column: str = "w") -> DataFrame:
    """windows with xh and xf: its encoded history and future; the future uses the history's statistics."""
    w = F.transform(F.col(column), lambda x: x.cast("double"))
    df = windows.withColumn("_w", w).withColumn("_h", F.slice("_w", 1, history))
    whole = ENCODERS[encoder](F.col("_h"), F.col("_w"))
    n = history - 1 if encoder == "log_returns" else history
    return df.withColumn("_x", whole).withColumn("xh", F.slice("_x", 1, n)).withColumn("xf", F.slice("_x", F.lit(n + 1), F.greatest(F.size("_x") - n, F.lit(0)))).drop("_w", "_h", "_x")


def encode_flat(windows: DataFrame, encoder: str, channels: list[str]) -> DataFrame:
    """windows with flat: each channel encoded over its whole length, joined, in 32 bits."""
    parts = []
    for c in channels:
        w = F.transform(F.col(c), lambda x: x.cast("double"))
        parts.append(ENCODERS[encoder](w, w))
    return windows.withColumn("flat", F.concat(*parts).cast("array<float>"))
