"""Nearest-date and point-in-time joins: an equi key and a date range, then the best row by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _within(left: DataFrame, right: DataFrame, keys: list[str], left_date: str, right_date: str, before: int, after: int) -> DataFrame:
    """Left rows with all right rows of equal keys whose date lies at most `before` days before theirs and `after` days after it; rows without any stay, with nulls, perhaps twice.

    The range is turned into an equi join on spans of before + after + 1 days,
    of which a left row meets two at most.
    """
    width = before + after + 1
    span = lambda date: F.floor(F.unix_date(date) / width)
    r = right.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys), span(F.col(right_date)).alias("_at"))
    a = left.withColumn("_span", F.explode_outer(F.array_distinct(F.array(span(F.date_sub(left_date, before)), span(F.date_add(left_date, after))))))
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    near = F.col(right_date).between(F.date_sub(left_date, before), F.date_add(left_date, after))
    return a.join(r, [*on, F.col("_span") == F.col("_at"), near], "left").drop("_span", "_at", *(f"_k{i}" for i in range(len(keys))))


def _best(pairs: DataFrame, left_id: str, *order: Column) -> DataFrame:
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy(left_id).orderBy(*order))).filter("_r = 1").drop("_r")


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, left_date: str, right_date: str, tolerance: int, order: list[Column] | None = None) -> DataFrame:
    """Each left row with the right row of equal keys whose date is closest within `tolerance` days; ties by `order`, then date. Unmatched left rows stay."""
    pairs = _within(left, right, keys, left_date, right_date, tolerance, tolerance)
    return _best(pairs, left_id, F.abs(F.datediff(left_date, right_date)).asc_nulls_last(), *(order or []), F.col(right_date))


#: Forms of a year's report and of a quarter's, and days until either is filed at the latest.
FORMS = {"10-K": ("10-K", "10-K405", "10-KSB"), "10-Q": ("10-Q", "10-QSB")}
REACH = {"10-K": 150, "10-Q": 60}


def nearest_filing(left: DataFrame, filings: DataFrame, keys: list[str], left_id: str, left_date: str, fiscal_period: str, tolerance: int = 10) -> DataFrame:
    """Each left row with the filing of its form family whose report date is closest within `tolerance` days; where none is, with the first filed on or after its date within the family's reach.

    Years and fourth quarters have the forms of a year.  filings has form,
    report_date, filing_date and seq, which decides ties; match says by which
    date a filing was found.
    """
    family = F.when(F.col(fiscal_period).isin("FY", "Q4"), "10-K").otherwise("10-Q")
    kind = F.coalesce(*(F.when(F.col("form").isin(*forms), name) for name, forms in FORMS.items()))
    known = filings.withColumn("_family", kind).filter("_family is not null")
    asked = left.withColumn("_family", family)
    on = [*keys, "_family"]
    near = nearest_join(asked, known.filter("report_date is not null"), on, left_id, left_date, "report_date", tolerance, [F.col("seq")])
    hit = near.filter("report_date is not null").withColumn("match", F.lit("report"))
    rest = asked.join(hit.select(left_id), left_id, "left_anti")
    late = _within(rest, known.filter("filing_date is not null"), on, left_date, "filing_date", 0, max(REACH.values()))
    in_reach = F.coalesce(*(F.when(F.col("_family") == name, F.datediff("filing_date", left_date) <= days) for name, days in REACH.items()))
    found = [c for c in known.columns if c not in on]
    late = late.select(*asked.columns, *(F.when(in_reach, F.col(c)).alias(c) for c in found))
    late = _best(late, left_id, F.col("filing_date").asc_nulls_last(), F.col("seq"))
    return hit.unionByName(late.withColumn("match", F.when(F.col("filing_date").isNotNull(), "filing"))).drop("_family")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_date: str, right_date: str) -> DataFrame:
    """Each left row with the latest right row known on its date: one sort of both sides by key and date, no pairs."""
    values = [c for c in right.columns if c not in (*keys, right_date)]
    a = left.select("*", F.col(left_date).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(f"struct<{', '.join(f'`{c}`:{t}' for c, t in right.dtypes if c not in keys)}>").alias("_v"))
    b = right.select(*keys, F.col(right_date).alias("_t"), F.lit(0).alias("_side"), F.struct(right_date, *values).alias("_v"))
    order = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_v", F.last("_v", ignorenulls=True).over(order))
    return both.filter("_side = 1").select(*left.columns, *(F.col("_v")[c].alias(c) for c in (right_date, *values)))


#: Days after its report date by which nine in ten statements of a period are published.
LAGS = {"Q": 72, "A": 400}


def known_on(restated: str = "IsRestated") -> Column:
    """The day a statement row was known: a restated one on its restated date, another on its publish date, or LAGS days after its report date without one."""
    late = F.coalesce(*(F.when(F.col("Period") == period, F.date_add(F.col("`Report Date`"), days)) for period, days in LAGS.items()))
    return F.when(F.col(restated), F.col("`Restated Date`")).otherwise(F.coalesce(F.col("`Publish Date`"), late))


def point_in_time(left: DataFrame, right: DataFrame, keys: list[str], left_date: str, period_date: str, known: str, tie: str | None = None) -> DataFrame:
    """Each left row with the right row of the newest period among those known on its date, in the newest vintage known then.

    Two times count: `known`, when a row came to be known, and `period_date`, what
    it is about.  A correction of an old period that comes late supersedes that
    period's earlier vintage, not a newer period.  Both sides are sorted by key
    and time once, and a running maximum by (period, known, tie) goes along; no
    pairs.  Right rows without either date are never known; left rows without a
    date or without a known row get nulls.
    """
    values = [c for c in right.columns if c not in keys]
    order = [period_date, known, *([tie] if tie else [])]
    quoted = lambda c: F.col(f"`{c}`")
    version = F.struct(*(quoted(c).alias(f"_o{i}") for i, c in enumerate(order)), F.struct(*(quoted(c).alias(f"_v{i}") for i, c in enumerate(values))).alias("_v"))
    b = right.filter(quoted(period_date).isNotNull() & quoted(known).isNotNull()).select(*(quoted(k) for k in keys), quoted(known).alias("_t"), F.lit(0).alias("_side"), version.alias("_best"))
    a = left.select("*", quoted(left_date).alias("_t"), F.lit(1).alias("_side"))
    along = Window.partitionBy(*(quoted(k) for k in keys)).orderBy(F.col("_t").asc_nulls_last(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_best", F.max("_best").over(along)).filter("_side = 1")
    found = F.when(F.col("_t").isNotNull(), F.col("_best._v"))
    return both.select(*(quoted(c) for c in left.columns), *(found.getField(f"_v{i}").alias(c) for i, c in enumerate(values) if c not in left.columns))
