"""Time-series operators over all tickers at once: windows by Ticker ordered by Date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapewright.functions.columns import col, dbl, ratio_if_positive

from . import spans

HORIZONS = {"1m": 21, "3m": 63, "6m": 126, "1y": 252, "3y": 756, "5y": 1260}


def by_date() -> WindowSpec:
    return Window.partitionBy("Ticker").orderBy("Date")


def by_date_desc() -> WindowSpec:
    return Window.partitionBy("Ticker").orderBy(F.col("Date").desc())


def _with_factor(prices: DataFrame, dividends: DataFrame) -> DataFrame:
    paid = dividends.groupBy("Ticker", "Date").agg(F.sum("Dividend").alias("_div"))
    joined = prices.join(paid, ["Ticker", "Date"], "left")
    return joined.withColumn("_before", F.lag("C").over(by_date())).withColumn("_factor", F.when(F.col("_div").isNotNull(), 1 - F.try_divide("_div", "_before")))


def _adjusted(df: DataFrame, factor: Column) -> DataFrame:
    later = F.product("_f").over(by_date().rowsBetween(1, Window.unboundedFollowing))
    return df.withColumn("_f", F.coalesce(factor, F.lit(1.0))).withColumn("AC", F.col("C") * F.coalesce(later, F.lit(1.0))).drop("_div", "_before", "_factor", "_f")


def adjusted_close(prices: DataFrame, dividends: DataFrame) -> DataFrame:
    """prices with AC: the close times the factors 1 - dividend / previous close of all later ex-days."""
    return _adjusted(_with_factor(prices, dividends), F.col("_factor"))


def robust_adjusted_close(prices: DataFrame, dividends: DataFrame) -> DataFrame:
    """As adjusted_close, but factors that are not positive count 1."""
    return _adjusted(_with_factor(prices, dividends), F.when(F.col("_factor") > 0, F.col("_factor")))


def excluded_dividends(prices: DataFrame, dividends: DataFrame) -> DataFrame:
    """The dividends that robust_adjusted_close leaves out."""
    return _with_factor(prices, dividends).filter("_div is not null and coalesce(_factor <= 0, true)").select("Ticker", "Date", F.col("_div").alias("Dividend"))


def max_difference(derived: DataFrame, vendor: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Per ticker the greatest relative difference of AC over shared dates, 0 if none, and whether it exceeds the tolerance."""
    pairs = derived.select("Ticker", "Date", F.col("AC").alias("d")).join(vendor.select("Ticker", "Date", F.col("AC").alias("y")), ["Ticker", "Date"], "left")
    out = pairs.groupBy("Ticker").agg(F.coalesce(F.max(F.when(F.col("y") > 0, F.abs(F.col("d") - F.col("y")) / F.col("y"))), F.lit(0.0)).alias("max_diff"))
    return out.withColumn("exceeds", F.col("max_diff") > tolerance)


def benchmark_history(prices: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(Ticker, Date, AC, Market) on dates that the benchmark (Date, C) shares."""
    return prices.filter("AC is not null").select("Ticker", "Date", "AC").join(benchmark.select("Date", F.col("C").alias("Market")), "Date").select("Ticker", "Date", "AC", "Market")


def rebased(history: DataFrame, sessions: int | None = None) -> DataFrame:
    """Both series over the last `sessions` rows (None or 0: all), 100 at the first."""
    if sessions:
        history = history.withColumn("_r", F.row_number().over(by_date_desc())).filter(F.col("_r") <= sessions).drop("_r")
    first = by_date().rowsBetween(Window.unboundedPreceding, 0)
    return history.select("Ticker", "Date", *((F.try_divide(c, F.first(c).over(first)) * 100).alias(c) for c in ("AC", "Market")))


def drawdown(history: DataFrame) -> DataFrame:
    peak = F.max("AC").over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    return history.select("Ticker", "Date", (F.try_divide("AC", peak) - 1).alias("drawdown"))


def drawdown_summary(history: DataFrame, days: int | None = None) -> DataFrame:
    """days: by spans of so many, for tickers of very many rows."""
    each = spans.drawdown(history, days) if days else drawdown(history)
    return each.groupBy("Ticker").agg(F.min("drawdown").alias("max_drawdown"), F.max_by("drawdown", "Date").alias("current_drawdown"))


def trailing_returns(history: DataFrame) -> DataFrame:
    """(Ticker, horizon, ret, market_ret) for each horizon; null where there are not more rows than it has sessions."""
    ranked = history.withColumn("_r", F.row_number().over(by_date_desc()))
    at = lambda c, n: F.max(F.when(F.col("_r") == n + 1, F.col(c)))
    wide = ranked.filter(F.col("_r") <= max(HORIZONS.values()) + 1).groupBy("Ticker").agg(*(at(c, n).alias(f"{c}_{n}") for c in ("AC", "Market") for n in (0, *HORIZONS.values())))
    rows = F.array(*(F.struct(F.lit(h).alias("horizon"), (F.try_divide("AC_0", f"AC_{n}") - 1).alias("ret"), (F.try_divide("Market_0", f"Market_{n}") - 1).alias("market_ret")) for h, n in HORIZONS.items()))
    return wide.select("Ticker", F.inline(rows))


FLOWS = ["Revenue", "Gross Profit", "Operating Income (Loss)", "Net Income (Common)", "Net Cash from Operating Activities", "Change in Fixed Assets & Intangibles"]


#: Names of the balance item for cash, the widest first.
CASH = ["Cash, Cash Equivalents & Short Term Investments", "Cash & Cash Equivalents"]


def fundamentals_history(income: DataFrame, balance: DataFrame, cashflow: DataFrame) -> DataFrame:
    """Restated quarterly items of the three statements, full-joined on Ticker and Report Date."""
    keys, out = ["Ticker", "Report Date"], None
    wanted = ((income, [*FLOWS[:4], "Shares (Diluted)"]), (cashflow, FLOWS[4:]), (balance, ["Short Term Debt", "Long Term Debt", "Total Equity"]))
    for df, items in wanted:
        values = {i: dbl(i) for i in items}
        if df is balance:
            values["cash"] = F.coalesce(F.lit(None).cast("double"), *(dbl(c) for c in CASH if c in df.columns))
        part = df.filter((col("Period") == "Q") & col("IsRestated")).select(*(col(k) for k in keys), *(v.alias(i) for i, v in values.items()))
        out = part if out is None else out.join(part, keys, "full")
    return out


def ttm_history(quarters: DataFrame) -> DataFrame:
    """Rolling sums of four quarters beside shares and equity of the row, margins, per-share items and debt; the first three rows of a ticker are left out."""
    order = Window.partitionBy("Ticker").orderBy(col("Report Date"))
    four = order.rowsBetween(-3, 0)
    ttm = {i: F.when(F.count(col(i)).over(four) == 4, F.sum(col(i)).over(four)) for i in FLOWS}
    names = dict(zip(FLOWS, ("revenue", "gross_profit", "op_income", "net_income", "cfo", "capex")))
    df = quarters.withColumn("_n", F.row_number().over(order))
    stocks = {"shares": "Shares (Diluted)", "equity": "Total Equity", "cash": "cash", "_s": "Short Term Debt", "_l": "Long Term Debt"}
    df = df.select("Ticker", col("Report Date").alias("report_date"), "_n", *(col(c).alias(n) for n, c in stocks.items()), *(v.alias(names[i]) for i, v in ttm.items())).filter("_n > 3")
    fcf = F.col("cfo") + F.col("capex")
    debt = F.when(F.col("_s").isNotNull() | F.col("_l").isNotNull(), F.coalesce("_s", F.lit(0.0)) + F.coalesce("_l", F.lit(0.0)))
    return df.select(
        "Ticker", "report_date", *names.values(), "shares", "equity", "cash", fcf.alias("fcf"),
        *(ratio_if_positive(c, "revenue").alias(n) for c, n in (("gross_profit", "gross_margin"), ("op_income", "op_margin"), ("net_income", "net_margin"))),
        ratio_if_positive("net_income", "shares").alias("eps"), ratio_if_positive(fcf, "shares").alias("fcf_per_share"), debt.alias("debt"),
    )


def window_around(findings: DataFrame, prices: DataFrame, days: int = 120, last: int = 500) -> DataFrame:
    """Prices within `days` of each dated finding; for undated ones the ticker's last rows."""
    marks = findings.select("Ticker", F.col("Date").alias("flagged")).distinct()
    # Dates meet by spans of time, so a ticker's findings aren't set against its whole history.
    spans = F.sequence(*(F.floor(F.unix_date(F.date_add("flagged", d)) / (2 * days + 1)) for d in (-days, days)))
    dated = marks.filter("flagged is not null").withColumn("_span", F.explode(spans))
    placed = prices.withColumn("_span", F.floor(F.unix_date("Date") / (2 * days + 1)))
    near = dated.join(placed, ["Ticker", "_span"]).drop("_span").filter(F.col("Date").between(F.date_sub("flagged", days), F.date_add("flagged", days)))
    tail = prices.withColumn("_r", F.row_number().over(by_date_desc())).filter(F.col("_r") <= last).drop("_r")
    return near.unionByName(marks.filter("flagged is null").join(tail, "Ticker"))


def neighbouring_periods(flagged: DataFrame, statements: DataFrame, reach: int = 2) -> DataFrame:
    """Statement rows up to `reach` places by Report Date from each flagged row (Ticker, Period, IsRestated, Report Date)."""
    keys = ["Ticker", "Period", "IsRestated"]
    placed = statements.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(col("Report Date"))))
    marks = flagged.select(*keys, col("Report Date")).distinct().join(placed.select(*keys, col("Report Date"), F.col("_n").alias("_m")), [*keys, "Report Date"])
    marks = marks.select(*keys, col("Report Date").alias("flagged"), "_m")
    return marks.join(placed, keys).filter(F.abs(F.col("_n") - F.col("_m")) <= reach).withColumn("offset", F.col("_n") - F.col("_m")).drop("_n", "_m")
