"""Repairs: pure functions from a table to the repaired table, each with the number of rows it would change."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.columns import col, in_range

from .series import robust_adjusted_close


@dataclass(frozen=True)
class Fix:
    fix_type: str
    table: str
    tickers: tuple[str, ...] = ()
    start: str | None = None
    end: str | None = None
    column: str | None = None
    value: float | str | None = None
    reason: str = ""


def _scope(fix: Fix, empty_is_all: bool) -> Column:
    tickers = F.lit(True) if empty_is_all and not fix.tickers else F.col("Ticker").isin(*fix.tickers) if fix.tickers else F.lit(False)
    day = lambda x: None if x is None else F.to_date(F.lit(x))
    return tickers & in_range("Date", day(fix.start), day(fix.end))


def _hit(fix: Fix) -> Column:
    positive = (F.col("H") > 0) & (F.col("C") > 0) & (F.col("AC") > 0)
    if fix.fix_type == "delete_date_range":
        return _scope(fix, False)
    if fix.fix_type == "repair_zero_low":
        return _scope(fix, True) & (F.col("L") <= 0) & positive
    if fix.fix_type == "repair_zero_open":
        return _scope(fix, True) & (F.col("O") <= 0) & positive
    if fix.fix_type == "set_value":
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_ ,.&()/-]*", fix.column or ""):
            raise ValueError(f"bad column name: {fix.column!r}")
        return _scope(fix, True) & ~col(fix.column).eqNullSafe(F.lit(fix.value))
    raise ValueError(f"unknown fix: {fix.fix_type}")


def detect(df: DataFrame, fix: Fix, dividends: DataFrame | None = None) -> int:
    """How many rows the fix would change or delete; 0 after it has been applied."""
    if fix.fix_type == "rebuild_adjusted_close":
        return _rebuilt(df, dividends, fix).filter("changed").count()
    return df.filter(F.coalesce(_hit(fix), F.lit(False))).count()


def apply_fix(df: DataFrame, fix: Fix, dividends: DataFrame | None = None) -> DataFrame:
    if fix.fix_type == "rebuild_adjusted_close":
        return _rebuilt(df, dividends, fix).drop("changed").select(*df.columns)
    hit = F.coalesce(_hit(fix), F.lit(False))
    if fix.fix_type == "delete_date_range":
        return df.filter(~hit)
    if fix.fix_type == "repair_zero_low":
        return df.withColumn("L", F.when(hit, F.when(F.col("O") > 0, F.least("O", "C")).otherwise(F.col("C"))).otherwise(F.col("L")))
    if fix.fix_type == "repair_zero_open":
        return df.withColumn("O", F.when(hit, F.col("C")).otherwise(F.col("O")))
    return df.withColumn(fix.column, F.when(hit, F.lit(fix.value).cast(df.schema[fix.column].dataType)).otherwise(col(fix.column)))


def _rebuilt(df: DataFrame, dividends: DataFrame, fix: Fix) -> DataFrame:
    """AC anew from C and dividends for the listed tickers; only rows that differ by more than rounding change."""
    own = df.filter(F.col("Ticker").isin(*fix.tickers))
    new = robust_adjusted_close(own.select("Ticker", "Date", "C"), dividends).select("Ticker", "Date", F.col("AC").alias("_new"))
    joined = df.join(new, ["Ticker", "Date"], "left")
    changed = F.col("_new").isNotNull() & F.coalesce(F.abs(F.col("AC") - F.col("_new")) > 1e-9 + 1e-6 * F.abs("_new"), F.lit(True))
    return joined.withColumn("changed", changed).withColumn("AC", F.when(F.col("changed"), F.col("_new")).otherwise(F.col("AC"))).drop("_new")


def apply_all(df: DataFrame, fixes: list[Fix], dividends: DataFrame | None = None) -> DataFrame:
    """In the given order: zero lows before zero opens heals bars with both."""
    for fix in fixes:
        df = apply_fix(df, fix, dividends)
    return df


#: Tables whose rows are told by ticker and date.
DATED = ("prices", "market_data", "dividends")
ACTIONS = {"delete_rows": "delete_date_range", "delete_span": "delete_date_range", "delete_ticker": "delete_date_range", "clear_value": "set_value", "set_value": "set_value", "rebuild_adjusted_close": "rebuild_adjusted_close"}


def _guard(action: str, findings: DataFrame, column: str | None, value, reason: str) -> None:
    """Raises unless the findings can be mended that way: a fix without dates would reach a ticker's whole history."""
    if action not in ACTIONS:
        raise ValueError(f"unknown action: {action}")
    if not reason.strip():
        raise ValueError("a reason is needed")
    named = F.coalesce(F.col("SrcTable"), F.lit(""))
    seen = findings.agg(F.count("*").alias("rows"), F.collect_set(named).alias("tables"), F.count_if(F.col("Date").isNull()).alias("undated")).first()
    if not seen.rows:
        raise ValueError("no findings are given")
    if "" in seen.tables:
        raise ValueError("every finding needs a table")
    if action in ("delete_rows", "delete_span", "set_value", "clear_value"):
        if others := sorted(set(seen.tables) - set(DATED)):
            raise ValueError(f"{action} needs tables with dates, not {', '.join(others)}")
        if seen.undated:
            raise ValueError(f"{action} needs a date for every finding")
    if action in ("set_value", "clear_value") and not column:
        raise ValueError("a column is needed")
    if action == "set_value" and seen.rows != 1:
        raise ValueError("set_value takes exactly one finding")
    if action == "set_value" and value is None:
        raise ValueError("set_value needs a value")
    if action == "rebuild_adjusted_close" and seen.tables != ["prices"]:
        raise ValueError("only prices have adjusted closes to rebuild")


def fix_entries(action: str, findings: DataFrame, column: str | None = None, value=None, reason: str = "") -> DataFrame:
    """Selected findings (SrcTable, Ticker, Date) as fix records (fix_type, table, tickers, start, end, column, value, reason)."""
    _guard(action, findings, column, value, reason)
    tickers = F.sort_array(F.collect_set("Ticker")).alias("tickers")
    none = F.lit(None).cast("date")
    if action in ("delete_rows", "clear_value", "set_value"):
        out = findings.groupBy("SrcTable", "Date").agg(tickers).select("SrcTable", "tickers", F.col("Date").alias("start"), F.col("Date").alias("end"))
    elif action == "delete_span":
        out = findings.groupBy("SrcTable", "Ticker").agg(F.min("Date").alias("start"), F.max("Date").alias("end")).select("SrcTable", F.array("Ticker").alias("tickers"), "start", "end")
    else:
        out = findings.groupBy("SrcTable").agg(tickers).select("SrcTable", "tickers", none.alias("start"), none.alias("end"))
    of_values = action in ("set_value", "clear_value")
    return out.select(
        F.lit(ACTIONS[action]).alias("fix_type"), F.col("SrcTable").alias("table"), "tickers", "start", "end", F.lit(column if of_values else None).cast("string").alias("column"),
        F.lit(value if action == "set_value" else None).cast("string").alias("value"), F.lit(reason.strip()).alias("reason"),
    )
