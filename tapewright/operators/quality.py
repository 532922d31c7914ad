"""Data-quality checks: each gives findings (SrcTable, Ticker, Date, Key, Details) over all tickers at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.columns import col, dbl, fixed

from . import spans
from .series import by_date

FINDINGS = ["SrcTable", "Ticker", "Date", "Key", "Details"]


def _findings(df: DataFrame, table: str, details: Column, date: str | None = "Date", key: Column | None = None) -> DataFrame:
    return df.select(F.lit(table).alias("SrcTable"), "Ticker", (col(date) if date else F.lit(None)).cast("date").alias("Date"), (F.lit(None) if key is None else key).cast("string").alias("Key"), F.coalesce(details, F.lit("")).alias("Details"))


def _both(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _ohlc(df: DataFrame) -> Column:
    return F.concat_ws(" ", *(F.concat(F.lit(f"{c}="), F.coalesce(col(c).cast("string"), F.lit("null"))) for c in "OHLC" if c in df.columns))


def nonpositive_price(prices: DataFrame, market_data: DataFrame) -> DataFrame:
    bad = lambda df, names: reduce(lambda a, b: a | b, (F.col(c) <= 0 for c in names))
    own = prices.filter(bad(prices, ["O", "H", "L", "C", "AC"]))
    other = market_data.filter((F.col("AssetClass") != "bonds") & bad(market_data, ["O", "H", "L", "C"]))
    return _both(_findings(own, "prices", _ohlc(own)), _findings(other, "market_data", _ohlc(other)))


def ohlc_inconsistent(prices: DataFrame, market_data: DataFrame) -> DataFrame:
    o, h, low, c = (F.col(x) for x in "OHLC")
    bad = (h < low) | (o > h) | (o < low) | (c > h) | (c < low)
    return _both(*(_findings(df.filter(bad), name, _ohlc(df)) for df, name in ((prices, "prices"), (market_data, "market_data"))))


def negative_volume(prices: DataFrame) -> DataFrame:
    return _findings(prices.filter("V < 0"), "prices", F.concat(F.lit("V="), F.col("V").cast("string")))


def bond_yield_bound(market_data: DataFrame, max_abs_yield: float = 50.0) -> DataFrame:
    return _findings(market_data.filter((F.col("AssetClass") == "bonds") & (F.abs("C") > max_abs_yield)), "market_data", F.concat(F.lit("C="), fixed("C", 4)))


def extreme_return(prices: DataFrame, splits: DataFrame, max_abs_log_return: float = log(2)) -> DataFrame:
    steps = prices.filter("C > 0").select("Ticker", "Date", "C", F.lag("C").over(by_date()).alias("before"), F.lead("C").over(by_date()).alias("after"))
    move, back = F.log(F.col("C") / F.col("before")), F.log(F.col("after") / F.col("before"))
    found = steps.filter(F.abs(move) > max_abs_log_return).join(splits.select("Ticker", "Date"), ["Ticker", "Date"], "left_anti")
    tag = F.when(F.abs(back) < 0.25 * F.abs(move), " spike-and-revert").otherwise("")
    return _findings(found, "prices", F.concat(F.lit("ret="), fixed((F.col("C") / F.col("before") - 1) * 100, 0), F.lit(" %"), tag))


def stale_run(prices: DataFrame, min_stale_run: int = 20, days: int | None = None) -> DataFrame:
    """days: by spans of so many, for tickers of very many rows."""
    if days:
        runs = spans.runs(prices, days)
    else:
        new = F.when(F.col("C") == F.lag("C").over(by_date()), 0).otherwise(1)
        runs = prices.select("Ticker", "Date", "C", new.alias("new")).withColumn("run", F.sum("new").over(by_date()))
        runs = runs.groupBy("Ticker", "run").agg(F.count("*").alias("n"), F.max("Date").alias("Date"), F.max("C").alias("C"))
    runs = runs.filter(F.col("n") >= min_stale_run)
    return _findings(runs, "prices", F.concat(F.col("n").cast("string"), F.lit(" equal closes")))


def date_gap(prices: DataFrame, max_gap_days: int = 30) -> DataFrame:
    gaps = prices.select("Ticker", "Date", F.datediff("Date", F.lag("Date").over(by_date())).alias("days")).filter(F.col("days") > max_gap_days)
    return _findings(gaps, "prices", F.concat(F.col("days").cast("string"), F.lit(" days")))


def nonpositive_dividend(dividends: DataFrame) -> DataFrame:
    return _findings(dividends.filter("Dividend <= 0"), "dividends", F.concat(F.lit("Dividend="), F.col("Dividend").cast("string")))


def oversized_dividend(dividends: DataFrame, prices: DataFrame, max_dividend_frac: float = 0.25) -> DataFrame:
    found = dividends.join(prices.select("Ticker", "Date", "C"), ["Ticker", "Date"]).filter((F.col("C") > 0) & (F.col("Dividend") > max_dividend_frac * F.col("C")))
    return _findings(found, "dividends", F.concat(fixed(F.col("Dividend") / F.col("C") * 100, 1), F.lit(" % of close")))


def invalid_split_ratio(splits: DataFrame) -> DataFrame:
    return _findings(splits.filter("Ratio <= 0 or Ratio = 1"), "splits", F.concat(F.lit("Ratio="), F.col("Ratio").cast("string")))


def row_key() -> Column:
    """Market|Period|year|period|restated; null if any part is."""
    return F.concat(col("Market"), F.lit("|"), col("Period"), F.lit("|"), col("Fiscal Year").cast("string"), F.lit("|"), col("Fiscal Period"), F.lit("|"), col("IsRestated").cast("string"))


def sum_check(df: DataFrame, table: str, required: list[str], optional: list[str], total: str, label: str, rel_tol: float = 0.01, abs_floor: float = 100_000) -> DataFrame:
    """Rows where the parts miss the total by more than the tolerance; optional parts count 0 where null."""
    parts = reduce(lambda a, b: a + b, [dbl(c) for c in required] + [F.coalesce(dbl(c), F.lit(0.0)) for c in optional if c in df.columns])
    off = F.abs(parts - dbl(total))
    found = df.filter(off > F.greatest(rel_tol * F.abs(dbl(total)), F.lit(float(abs_floor))))
    return _findings(found, table, F.concat(F.lit(f"{label}: off by "), fixed(F.coalesce(F.try_divide(off, F.abs(dbl(total))) * 100, F.lit(100.0)), 1), F.lit(" %")), None, row_key())


def balance_identity(balance: DataFrame, **kw) -> DataFrame:
    return sum_check(balance, "balance", ["Total Liabilities", "Total Equity"], [], "Total Assets", "L + E vs A", **kw)


def balance_subtotals(balance: DataFrame, **kw) -> DataFrame:
    specs = [(["Total Current Assets", "Total Noncurrent Assets"], "Total Assets", "assets"), (["Total Current Liabilities", "Total Noncurrent Liabilities"], "Total Liabilities", "liabilities")]
    return _both(*(sum_check(balance, "balance", parts, [], total, label, **kw) for parts, total, label in specs if set(parts) <= set(balance.columns)))


def income_chain(income: DataFrame, **kw) -> DataFrame:
    specs = [
        (["Revenue", "Cost of Revenue"], [], "Gross Profit", "gross profit"),
        (["Gross Profit", "Operating Expenses"], ["Other Operating Income"], "Operating Income (Loss)", "operating income"),
        (["Operating Income (Loss)", "Non-Operating Income (Loss)"], [], "Pretax Income (Loss), Adj.", "pretax income"),
    ]
    return _both(*(sum_check(income, "income", req, opt, total, label, **kw) for req, opt, total, label in specs if {*req, total} <= set(income.columns)))


def cashflow_identity(cashflow: DataFrame, **kw) -> DataFrame:
    parts = [f"Net Cash from {x} Activities" for x in ("Operating", "Investing", "Financing")]
    return sum_check(cashflow, "cashflow", parts, ["Effect of Foreign Exchange Rates", "Change in Cash from Disc. Operations and Other"], "Net Change in Cash", "cash flow", **kw)


def hard_invariants(income: DataFrame, balance: DataFrame, cashflow: DataFrame) -> DataFrame:
    out = []
    for df, name in ((income, "income"), (balance, "balance"), (cashflow, "cashflow")):
        shares = [c for c in ("Shares (Basic)", "Shares (Diluted)") if c in df.columns]
        if shares:
            out.append(_findings(df.filter(reduce(lambda a, b: a | b, (col(c) <= 0 for c in shares))), name, F.lit("nonpositive shares"), None, row_key()))
    out.append(_findings(balance.filter(col("Total Assets") < 0), "balance", F.lit("negative assets"), None, row_key()))
    return _both(*out)


def negative_revenue(income: DataFrame) -> DataFrame:
    return _findings(income.filter("Revenue < 0"), "income", F.concat(F.lit("Revenue="), F.col("Revenue").cast("string")), None, row_key())


def quarters_vs_fy(tables: dict[str, DataFrame], rel_tol: float = 0.01, abs_floor: float = 100_000) -> DataFrame:
    """Four quarters that don't add up to the annual row."""
    keys = ["Ticker", "Market", "IsRestated", "Fiscal Year"]
    out = []
    for table, item in (("income", "Revenue"), ("income", "Net Income"), ("cashflow", "Net Cash from Operating Activities")):
        df = tables.get(table)
        if df is None:
            continue
        sums = df.filter((col("Period") == "Q") & col(item).isNotNull()).groupBy(*(col(k) for k in keys)).agg(F.sum(dbl(item)).alias("four"), F.count("*").alias("n")).filter("n = 4")
        year = df.filter(col("Period") == "A").select(*(col(k) for k in keys), col("Period"), col("Fiscal Period"), dbl(item).alias("annual"))
        off = F.abs(F.col("four") - F.col("annual"))
        found = sums.join(year, keys).filter(off > F.greatest(rel_tol * F.abs("annual"), F.lit(float(abs_floor))))
        out.append(_findings(found, table, F.lit(f"{item}: quarters vs year"), None, row_key()))
    return _both(*out)


#: name: (severity, check over a mapping of tables).
CHECKS: dict[str, tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]] = {
    "nonpositive_price": ("error", lambda t: nonpositive_price(t["prices"], t["market_data"])),
    "ohlc_inconsistent": ("error", lambda t: ohlc_inconsistent(t["prices"], t["market_data"])),
    "negative_volume": ("error", lambda t: negative_volume(t["prices"])),
    "bond_yield_bound": ("warn", lambda t: bond_yield_bound(t["market_data"])),
    "extreme_return": ("warn", lambda t: extreme_return(t["prices"], t["splits"])),
    "stale_run": ("warn", lambda t: stale_run(t["prices"])),
    "date_gap": ("warn", lambda t: date_gap(t["prices"])),
    "nonpositive_dividend": ("error", lambda t: nonpositive_dividend(t["dividends"])),
    "oversized_dividend": ("warn", lambda t: oversized_dividend(t["dividends"], t["prices"])),
    "invalid_split_ratio": ("error", lambda t: invalid_split_ratio(t["splits"])),
    "balance_identity": ("warn", lambda t: balance_identity(t["balance"])),
    "balance_subtotals": ("warn", lambda t: balance_subtotals(t["balance"])),
    "income_chain": ("warn", lambda t: income_chain(t["income"])),
    "cashflow_identity": ("warn", lambda t: cashflow_identity(t["cashflow"])),
    "hard_invariants": ("error", lambda t: hard_invariants(t["income"], t["balance"], t["cashflow"])),
    "negative_revenue": ("warn", lambda t: negative_revenue(t["income"])),
    "quarters_vs_fy": ("warn", lambda t: quarters_vs_fy(t)),
}


def run_checks(tables: dict[str, DataFrame], names: list[str] | None = None) -> DataFrame:
    """Findings of the named checks (default: all) with CheckName and Severity, in one plan."""
    chosen = sorted(CHECKS) if names is None else names
    return _both(*(CHECKS[n][1](tables).withColumns({"CheckName": F.lit(n), "Severity": F.lit(CHECKS[n][0])}) for n in chosen))
