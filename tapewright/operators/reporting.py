"""Integration and profiling: merged companies, decoded instruments, coverage, lags, restatements, fill rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.columns import col, dbl

#: Company columns that both sources may have; the first source wins.
SHARED = ["Industry", "Sector", "NrEmployees", "CompanyName", "BusinessSummary"]


def merge_companies(first: DataFrame, second: DataFrame) -> DataFrame:
    """Full outer by Ticker with InFirst and InSecond; in shared columns the first source's value wins."""
    a, b = first.withColumn("_a", F.lit(True)).alias("a"), second.withColumn("_b", F.lit(True)).alias("b")
    names = [c for c in dict.fromkeys([*first.columns, *second.columns]) if c != "Ticker"]
    picked = [F.coalesce(*(F.col(f"{s}.`{c}`") for s, df in (("a", first), ("b", second)) if c in df.columns)).alias(c) for c in names]
    joined = a.join(b, F.col("a.Ticker") == F.col("b.Ticker"), "full")
    return joined.select(F.coalesce("a.Ticker", "b.Ticker").alias("Ticker"), F.col("a._a").isNotNull().alias("InFirst"), F.col("b._b").isNotNull().alias("InSecond"), *picked)


def company_counts(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count("*").alias("rows"), F.count_if("InFirst").alias("in_first"), F.count_if("InSecond").alias("in_second"), F.count_if(F.col("InFirst") & F.col("InSecond")).alias("both"))


def decode_instruments(tickers: DataFrame, curated: DataFrame, countries: DataFrame, currencies: DataFrame) -> DataFrame:
    """(Ticker, Name, Country) by a curated list, or by the forms of bond, currency index and currency pair codes; else nulls.

    curated (Ticker, Name, Country), countries (code, country) and currencies
    (code, currency) are lookup tables; a code that isn't in them names itself.
    """
    bond = r"^(\d+)([MY])([A-Z]{2})([YP])$"
    t = tickers.select("Ticker").distinct()
    part = lambda n: F.regexp_extract("Ticker", bond, n)
    pair, special = F.col("Ticker").rlike("^[A-Z]{6}$"), r"^([A-Z]{3})_(I|B|B50)$"
    index, suffix = F.regexp_extract("Ticker", special, 1), F.regexp_extract("Ticker", special, 2)
    t = t.withColumns({"_country": part(3), "_from": F.when(pair, F.substring("Ticker", 1, 3)).otherwise(index), "_to": F.when(pair, F.substring("Ticker", 4, 3))})
    t = t.join(curated.select("Ticker", F.col("Name").alias("_name"), F.col("Country").alias("_where"), F.lit(True).alias("_known")), "Ticker", "left")
    t = t.join(countries.select(F.col("code").alias("_country"), F.col("country").alias("_land")), "_country", "left")
    for side in ("_from", "_to"):
        t = t.join(currencies.select(F.col("code").alias(side), F.col("currency").alias(f"{side}_name")), side, "left")
    first, second = F.coalesce("_from_name", "_from"), F.coalesce("_to_name", "_to")
    # The wording of names.
    bond_name = F.concat(part(1), F.when(part(2) == "M", "-month").otherwise("-year"), F.lit(" government bond "), F.when(part(4) == "Y", "yield").otherwise("price"))
    index_name = F.when(suffix == "I", F.concat(first, F.lit(" index (likely trade-weighted), suffix meaning unconfirmed"))).otherwise(F.concat(first, F.lit(" special variant (_"), suffix, F.lit("), meaning unconfirmed")))
    pair_name = F.concat(first, F.lit("/"), second, F.lit(" exchange rate"))
    is_bond = part(1) != ""
    name = F.when(F.col("_known"), F.col("_name")).when(is_bond, bond_name).when(index != "", index_name).when(pair, pair_name)
    return t.select("Ticker", name.alias("Name"), F.when(F.col("_known"), F.col("_where")).when(is_bond, F.coalesce("_land", "_country")).alias("Country"))


def ticker_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(Ticker, side): tickers that only one of the two has."""
    l, r = (df.select("Ticker") for df in (left, right))
    return l.subtract(r).withColumn("side", F.lit("left")).unionByName(r.subtract(l).withColumn("side", F.lit("right")))


def anomaly_summary(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("CheckName", "Severity").agg(F.count("*").alias("findings"), F.countDistinct("Ticker").alias("tickers"), F.max("DetectedAt").alias("last_run"))


def worst_tickers(anomalies: DataFrame, n: int = 10) -> DataFrame:
    return anomalies.groupBy("Ticker").agg(F.count("*").alias("findings"), F.countDistinct("CheckName").alias("checks")).orderBy(F.desc("findings"), "Ticker").limit(n)


def worst_tickers_of(anomalies: DataFrame, check: str, n: int = 20) -> DataFrame:
    """Tickers with most findings of one check, and from when to when."""
    return anomalies.filter(F.col("CheckName") == check).groupBy("Ticker").agg(F.count("*").alias("findings"), F.min("Date").alias("first"), F.max("Date").alias("last")).orderBy(F.desc("findings"), "Ticker").limit(n)


def worst_findings(anomalies: DataFrame, check: str, n: int = 20) -> DataFrame:
    """Findings of a check, the greatest percentage in Details first."""
    size = F.coalesce(F.expr(r"try_cast(regexp_extract(Details, '(-?[0-9]+\\.?[0-9]*) %', 1) as double)"), F.lit(0.0))
    return anomalies.filter(F.col("CheckName") == check).withColumn("size", size).orderBy(F.desc("size"), "Ticker", "Date", "Key").limit(n)


def open_anomalies(anomalies: DataFrame, triage: DataFrame, stocks: DataFrame, check: str | list[str] | None = None, severity: str | None = None, ticker: str = "", tables: list[str] | None = None) -> DataFrame:
    """Findings without an entry in the triage log (check, ticker, date, key; null dates and keys match nulls), with IsStock."""
    df = anomalies
    for c, v in (("CheckName", check), ("Severity", severity)):
        df = df if v is None else df.filter(F.col(c).isin(*([v] if isinstance(v, str) else v)))
    df = df if tables is None else df.filter(F.col("SrcTable").isin(*tables))
    df = df.filter(F.upper("Ticker").contains(ticker.strip().upper())) if ticker.strip() else df
    log = triage.select(F.col("check").alias("_c"), F.col("ticker").alias("_t"), F.col("date").alias("_d"), F.col("key").alias("_k"))
    df = df.join(log, (F.col("CheckName") == F.col("_c")) & (F.col("Ticker") == F.col("_t")) & F.col("Date").eqNullSafe(F.col("_d")) & F.col("Key").eqNullSafe(F.col("_k")), "left_anti")
    return df.join(stocks.select("Ticker").distinct().withColumn("IsStock", F.lit(True)), "Ticker", "left").withColumn("IsStock", F.coalesce("IsStock", F.lit(False)))


def open_page(anomalies: DataFrame, triage: DataFrame, stocks: DataFrame, limit: int = 500, **filters) -> dict[str, DataFrame]:
    """A page of open findings: rows (the first `limit` by severity, check and ticker), total (all that the filters leave), checks and tables (those of all findings)."""
    found = open_anomalies(anomalies, triage, stocks, **filters)
    return {
        "rows": found.orderBy("Severity", "CheckName", "Ticker", "Date", "Key", "SrcTable").limit(limit),
        "total": found.agg(F.count("*").alias("total")),
        "checks": anomalies.select("CheckName").distinct().orderBy("CheckName"),
        "tables": anomalies.select("SrcTable").distinct().orderBy("SrcTable"),
    }


def freshness(tables: dict[str, tuple[DataFrame, str]], today: Column | None = None) -> DataFrame:
    """(table, last, age_days) of the greatest date of each (table, column)."""
    today = F.current_date() if today is None else today
    parts = [df.agg(F.max(col(c)).cast("date").alias("last")).select(F.lit(n).alias("table"), "last", F.datediff(today, "last").alias("age_days")) for n, (df, c) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items()]).orderBy(F.desc("rows"), "table")


def statement_coverage(df: DataFrame) -> DataFrame:
    return df.groupBy("Period", "IsRestated").agg(F.count("*").alias("rows"), F.countDistinct("Ticker").alias("tickers"))


def coverage_overlap(income: DataFrame, balance: DataFrame, cashflow: DataFrame, prices: DataFrame) -> DataFrame:
    """Counts of tickers with all three statements, with any, and with any but no prices."""
    i, b, c, p = (x.select("Ticker").distinct() for x in (income, balance, cashflow, prices))
    every, some = i.intersect(b).intersect(c), i.union(b).union(c).distinct()
    count = lambda df, n: df.agg(F.count("*").alias("tickers")).select(F.lit(n).alias("kind"), "tickers")
    return count(every, "all three").unionByName(count(some, "any")).unionByName(count(some.join(p, "Ticker", "left_anti"), "no prices"))


def tickers_by_year(df: DataFrame) -> DataFrame:
    return df.filter(col("Period") == "A").groupBy(col("Fiscal Year").alias("year")).agg(F.countDistinct("Ticker").alias("tickers"))


def publish_lag(df: DataFrame) -> DataFrame:
    """Days from Report Date to Publish Date of as-filed rows by Period."""
    lag = F.datediff(col("Publish Date"), col("Report Date"))
    q = lambda p: F.percentile("lag", F.lit(p)).alias(f"p{round(p * 100)}")
    return df.filter(~col("IsRestated")).withColumn("lag", lag).groupBy("Period").agg(F.count("*").alias("rows"), F.count_if(F.col("lag").isNull()).alias("nulls"), q(0.5), q(0.9), q(0.99), F.min("lag").alias("least"), F.max("lag").alias("most"), F.count_if(F.col("lag") < 0).alias("negative"))


def lag_histogram(df: DataFrame, bins: int = 73, top: int = 365) -> DataFrame:
    lag = F.datediff(col("Publish Date"), col("Report Date"))
    return df.filter(~col("IsRestated")).select("Period", F.width_bucket(lag.cast("double"), F.lit(0.0), F.lit(float(top)), F.lit(bins)).alias("bin")).filter(F.col("bin").between(1, bins)).groupBy("Period", "bin").agg(F.count("*").alias("rows"))


def frequent_dates(df: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent publish dates, which may be placeholders."""
    return df.groupBy(col("Publish Date").alias("date")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "date").limit(n)


def restatement_impact(df: DataFrame, items: list[str], rel_tol: float = 0.01, floor: float = 100_000) -> DataFrame:
    """By item, over pairs of as-filed and restated rows: nulls on one side, pairs that differ, and by how much."""
    keys = ["Ticker", "Market", "Period", "Fiscal Year", "Fiscal Period"]
    side = lambda flag, s: df.filter(col("IsRestated") == flag).select(*(col(k) for k in keys), *(dbl(i).alias(f"{s}{n}") for n, i in enumerate(items)))
    pairs = side(False, "f").join(side(True, "r"), keys)
    long = pairs.select(F.inline(F.array(*(F.struct(F.lit(i).alias("item"), F.col(f"f{n}").alias("filed"), F.col(f"r{n}").alias("restated")) for n, i in enumerate(items)))))
    off = F.abs(F.col("restated") - F.col("filed"))
    differs = off > F.greatest(rel_tol * F.abs("filed"), F.lit(float(floor)))
    pct = F.when(differs, F.try_divide(off, F.abs("filed")) * 100)
    return long.groupBy("item").agg(F.count("*").alias("pairs"), F.count_if(F.col("filed").isNull() != F.col("restated").isNull()).alias("one_null"), F.count_if(differs).alias("differ"), F.percentile(pct, F.lit(0.5)).alias("median_pct"), F.percentile(pct, F.lit(0.9)).alias("p90_pct"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*(col(k) for k in keys)).agg(F.count("*").alias("rows")).filter("rows > 1")


def fill_rates(df: DataFrame, by: str = "Period", least: float = 0.6) -> DataFrame:
    """(column, <by> values..., usable): share of rows that have a value; one pass over all columns."""
    names = [c for c in df.columns if c != by]
    shares = df.groupBy(col(by)).agg(*((F.count(col(c)) / F.count("*")).alias(c) for c in names))
    long = shares.unpivot([col(by)], [col(c) for c in names], "column", "fill")
    wide = long.groupBy("column").pivot(by, ["A", "Q"]).agg(F.first("fill"))
    return wide.withColumn("usable", F.coalesce(F.col("Q") >= least, F.lit(False)))


def castability(df: DataFrame) -> DataFrame:
    """(column, filled, castable) of each string column."""
    names = [c for c, t in df.dtypes if t == "string"]
    one = df.agg(*(x for i, c in enumerate(names) for x in (F.count(col(c)).alias(f"n{i}"), F.count(col(c).try_cast("double")).alias(f"c{i}"))))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("filled"), F.col(f"c{i}").alias("castable")) for i, c in enumerate(names)))))


def profile(df: DataFrame, min_fill: float = 0.0) -> DataFrame:
    """(column, n, least, most, mean, std) of numeric columns filled in at least that share of rows."""
    names = [c for c, t in df.dtypes if t in ("bigint", "int", "double", "float")]
    stats = (("n", F.count), ("least", F.min), ("most", F.max), ("mean", F.avg), ("std", F.stddev_samp))
    one = df.agg(F.count("*").alias("_all"), *(f(dbl(c)).cast("long" if s == "n" else "double").alias(f"{s}_{i}") for i, c in enumerate(names) for s, f in stats))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"{s}_{i}").alias(s) for s, _ in stats)) for i, c in enumerate(names)))
    return one.select("_all", F.inline(rows)).filter(F.col("n") >= min_fill * F.col("_all")).drop("_all").orderBy(F.desc("n"), "column")


def rows_before(df: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """(Ticker, rows): rows up to each ticker's cutoff (Ticker, cutoff)."""
    return df.join(cutoffs, "Ticker").filter("Date <= cutoff").groupBy("Ticker").agg(F.count("*").alias("rows"))


def dynamic_range(df: DataFrame, value: str = "C") -> DataFrame:
    """(Ticker, spread, magnitude): greatest over least positive value, and its power of ten."""
    out = df.filter(col(value) > 0).groupBy("Ticker").agg((F.max(col(value)) / F.min(col(value))).alias("spread"))
    return out.withColumn("magnitude", F.floor(F.log10("spread")).cast("long"))


def empty_triage(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "check string, ticker string, date date, key string")
