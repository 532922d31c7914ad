"""Per-ticker factors from restated statements, prices and dividends; one plan over all tickers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.columns import col, dbl, growth, latest, ratio, ratio_if_positive

FAMILIES = {
    "value": ["earnings_yield", "fcf_yield", "sales_yield", "book_to_market", "ebitda_ev"],
    "momentum": ["ret_12_1", "ret_6m", "high_52w"],
    "risk": ["vol_252", "beta"],
    "quality": ["roe", "roa", "gross_margin", "op_margin", "margin_trend", "accruals", "debt_to_equity", "interest_coverage"],
    "growth": ["revenue_yoy", "revenue_3y", "eps_yoy", "fcf_yoy", "share_change_1y", "div_growth"],
}
FACTORS = [f for family in FAMILIES.values() for f in family]
LOWER_IS_BETTER = ["vol_252", "beta", "accruals", "debt_to_equity", "share_change_1y"]
IDENTITY = ["Ticker", "name", "sector", "industry", "close", "mcap", "mcap_bn"]


def _ranked(df: DataFrame, period: str, most: int, where=None) -> DataFrame:
    df = df.filter((col("Period") == period) & col("IsRestated"))
    df = df if where is None else df.filter(where)
    newest = Window.partitionBy("Ticker").orderBy(col("Report Date").desc())
    return df.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= most)


def ttm(df: DataFrame, items: dict[str, str]) -> DataFrame:
    """Sums of the newest four and the four quarters before them, as name and name_prior; null for windows of fewer rows."""
    out = []
    for first, suffix in ((1, ""), (5, "_prior")):
        own = F.col("_r").between(first, first + 3)
        out += [F.when(F.count_if(own) == 4, F.sum(F.when(own, dbl(c)))).alias(n + suffix) for n, c in items.items()]
    return _ranked(df, "Q", 8).groupBy("Ticker").agg(*out)


def latest_balance(balance: DataFrame) -> DataFrame:
    q = balance.filter((col("Period") == "Q") & col("IsRestated"))
    last = lambda c: latest(dbl(c), "Report Date")
    newest = q.groupBy("Ticker").agg(last("Total Equity").alias("equity"), last("Total Assets").alias("assets"), F.max_by(F.struct(dbl("Short Term Debt").alias("s"), dbl("Long Term Debt").alias("l"), dbl("Cash & Cash Equivalents").alias("c")), col("Report Date")).alias("n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return newest.select("Ticker", "equity", "assets", (zero("n.s") + zero("n.l")).alias("debt"), zero("n.c").alias("cash"))


def shares_by_rank(income: DataFrame) -> DataFrame:
    at = lambda k: F.max(F.when(F.col("_r") == k, dbl("Shares (Diluted)")))
    return _ranked(income, "Q", 5).groupBy("Ticker").agg(at(1).alias("shares"), at(5).alias("shares_prior"))


def revenue_cagr_3y(income: DataFrame) -> DataFrame:
    at = lambda k: F.max(F.when(F.col("_r") == k, dbl("Revenue")))
    out = _ranked(income, "A", 4, col("Revenue").isNotNull()).groupBy("Ticker").agg(at(1).alias("_now"), at(4).alias("_then"))
    return out.select("Ticker", F.when((F.col("_now") > 0) & (F.col("_then") > 0), F.pow(F.col("_now") / F.col("_then"), F.lit(1 / 3)) - 1).alias("revenue_3y"))


def identity(prices: DataFrame, income: DataFrame, companies: DataFrame) -> DataFrame:
    close = prices.groupBy("Ticker").agg(F.max_by("C", "Date").alias("close"))
    basic = F.coalesce(dbl("Shares (Basic)"), dbl("Shares (Diluted)"))
    shares = income.filter((col("Period") == "Q") & col("IsRestated")).groupBy("Ticker").agg(latest(basic, "Report Date").alias("_shares"))
    df = close.join(shares, "Ticker", "left").join(companies, "Ticker", "left").withColumn("mcap", F.col("close") * F.col("_shares"))
    other = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    return df.select("Ticker", other("CompanyName", "").alias("name"), other("Sector", "unknown").alias("sector"), other("Industry", "unknown").alias("industry"), "close", "mcap", F.round(F.col("mcap") / 1e9, 3).alias("mcap_bn"))


def fundamental_factors(ident: DataFrame, income: DataFrame, balance: DataFrame, cashflow: DataFrame) -> DataFrame:
    flows = ttm(income, {"revenue": "Revenue", "gross": "Gross Profit", "op": "Operating Income (Loss)", "da": "Depreciation & Amortization", "interest": "Interest Expense", "net": "Net Income", "common": "Net Income (Common)"})
    cash = ttm(cashflow, {"cfo": "Net Cash from Operating Activities", "capex": "Change in Fixed Assets & Intangibles"})
    parts = [flows, cash, latest_balance(balance), shares_by_rank(income), revenue_cagr_3y(income)]
    df = reduce(lambda a, b: a.join(b, "Ticker", "left"), parts, ident)
    df = df.withColumns({"fcf": F.col("cfo") + F.col("capex"), "fcf_prior": F.col("cfo_prior") + F.col("capex_prior"), "ev": F.col("mcap") + F.col("debt") - F.col("cash")})
    df = df.withColumns({"eps": ratio_if_positive("common", "shares"), "eps_prior": ratio_if_positive("common_prior", "shares_prior"), "op_margin": ratio_if_positive("op", "revenue")})
    ebitda = F.col("op") - F.col("da")
    return df.select(
        "Ticker",
        *(ratio_if_positive(a, "mcap").alias(n) for a, n in (("common", "earnings_yield"), ("fcf", "fcf_yield"), ("revenue", "sales_yield"), ("equity", "book_to_market"))),
        F.when((ebitda > 0) & (F.col("ev") > 0), ebitda / F.col("ev")).alias("ebitda_ev"),
        ratio_if_positive("net", "equity").alias("roe"),
        ratio_if_positive("net", "assets").alias("roa"),
        ratio_if_positive("gross", "revenue").alias("gross_margin"),
        "op_margin",
        (F.col("op_margin") - ratio_if_positive("op_prior", "revenue_prior")).alias("margin_trend"),
        ratio_if_positive(F.col("net") - F.col("cfo"), "assets").alias("accruals"),
        ratio_if_positive("debt", "equity").alias("debt_to_equity"),
        ratio("op", F.abs("interest")).alias("interest_coverage"),
        growth("revenue", "revenue_prior").alias("revenue_yoy"),
        "revenue_3y",
        growth("eps", "eps_prior").alias("eps_yoy"),
        growth("fcf", "fcf_prior").alias("fcf_yoy"),
        growth("shares", "shares_prior").alias("share_change_1y"),
    )


def dividend_growth(dividends: DataFrame, prices: DataFrame) -> DataFrame:
    """Dividends of the last 365 days before the panel's last date against the 365 days before those; null where there are none in either."""
    anchor = F.broadcast(prices.agg(F.max("Date").alias("_d")))
    age = F.datediff("_d", "Date")
    # Sums of decimals don't hang on their order.
    within = lambda lo, hi: F.sum(F.when((age >= lo) & (age < hi), F.col("Dividend").cast("decimal(28,12)")))
    sums = dividends.crossJoin(anchor).groupBy("Ticker").agg(within(0, 365).alias("now"), within(365, 730).alias("prior"))
    return sums.select("Ticker", growth("now", "prior").alias("div_growth"))


def price_factors(prices: DataFrame, market: DataFrame, sessions: int = 253, least: int = 200) -> DataFrame:
    """Momentum, volatility and beta over each ticker's last sessions; market (Date, C) has its own last sessions."""
    newest = Window.partitionBy("Ticker").orderBy(F.col("Date").desc())
    rows = prices.select("Ticker", "Date", "AC").withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= sessions)
    rows = rows.withColumn("ret", F.try_divide("AC", F.lag("AC").over(Window.partitionBy("Ticker").orderBy("Date"))) - 1)
    tail = market.select("Date", "C").orderBy(F.col("Date").desc()).limit(sessions)
    by_date = Window.orderBy("Date")  # at most `sessions` rows
    tail = tail.select("Date", (F.try_divide("C", F.lag("C").over(by_date)) - 1).alias("mret"))
    rows = rows.join(F.broadcast(tail), "Date", "left")
    at = lambda k: F.max(F.when(F.col("_r") == k, F.col("AC")))
    joint = F.col("ret").isNotNull() & F.col("mret").isNotNull()
    r, m = F.when(joint, F.col("ret")), F.when(joint, F.col("mret"))
    out = rows.groupBy("Ticker").agg(
        at(1).alias("p1"), at(22).alias("p22"), at(127).alias("p127"), at(sessions).alias("p253"), F.max("AC").alias("top"), F.stddev_samp("ret").alias("sd"), F.count("ret").alias("n"), F.covar_samp(r, m).alias("cov"), F.var_samp(m).alias("var"), F.count_if(joint).alias("k")
    )
    return out.select(
        "Ticker", (ratio("p22", "p253") - 1).alias("ret_12_1"), (ratio("p1", "p127") - 1).alias("ret_6m"), ratio("p1", "top").alias("high_52w"),
        F.when(F.col("n") >= least, F.col("sd") * 252**0.5).alias("vol_252"), F.when((F.col("k") >= least) & (F.col("var") > 0), F.col("cov") / F.col("var")).alias("beta"),
    )


def build_factors(prices: DataFrame, dividends: DataFrame, market: DataFrame, income: DataFrame, balance: DataFrame, cashflow: DataFrame, companies: DataFrame) -> DataFrame:
    """Identity and all factors, a row for each ticker that has prices."""
    ident = identity(prices, income, companies)
    parts = [fundamental_factors(ident, income, balance, cashflow), price_factors(prices, market), dividend_growth(dividends, prices)]
    return reduce(lambda a, b: a.join(b, "Ticker", "left"), parts, ident).select(*IDENTITY, *FACTORS)
