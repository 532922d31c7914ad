"""Sinks: keyed upsert, replace by group, rebuilt tables, named lists and the failure ledger."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.functions.columns import col


def upsert(stored: DataFrame | None, incoming: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """The table after the merge: incoming rows win by key; columns that they lack keep the stored values. Idempotent.

    Of several incoming rows with one key the first by `order` counts; ties and rows without an order go by all columns.
    """
    pick = Window.partitionBy(*(col(k) for k in key)).orderBy(*(order or []), *(col(c) for c in incoming.columns))
    new = incoming.withColumn("_r", F.row_number().over(pick)).filter("_r = 1").drop("_r")
    if stored is None:
        return new
    a, b = stored.withColumn("_old", F.lit(True)).alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    joined = a.join(b, [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in key], "full")
    names = [*stored.columns, *(c for c in new.columns if c not in stored.columns)]
    side = lambda s, df, c: F.col(f"{s}.`{c}`") if c in df.columns else F.lit(None)
    fresh = F.col("b._new").isNotNull()
    return joined.select(*(F.when(fresh, side("b", new, c)).otherwise(side("a", stored, c)).alias(c) if c in new.columns else side("a", stored, c).alias(c) for c in names))


def replace_findings(spark: SparkSession, path: str, check: str, severity: str, findings: DataFrame) -> int:
    """Replaces one check's findings in a table partitioned by CheckName; none clears them. Returns their number."""
    need = ["SrcTable", "Ticker", "Date", "Key", "Details"]
    if findings.columns != need:
        raise ValueError(f"findings need the columns {need}")
    out = findings.select(F.lit(severity).alias("Severity"), *need, F.current_timestamp().alias("DetectedAt"), F.lit(check).alias("CheckName"))
    target = f"{path.rstrip('/')}/CheckName={check}"
    out.drop("CheckName").write.mode("overwrite").parquet(target)
    return spark.read.parquet(target).count()


def rebuild_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Replaces a table of the catalog by df; its files lie at path, or else in the warehouse."""
    out = df.write.mode("overwrite")
    (out.option("path", path) if path else out).saveAsTable(name)


def list_name(name: str) -> str:
    clean = re.sub(r"[^A-Za-z0-9_-]+", "_", name).strip("_")
    if not clean:
        raise ValueError("the list needs a name")
    return clean


def save_list(tickers: DataFrame, root: str, name: str) -> None:
    tickers.select("Ticker").distinct().orderBy("Ticker").coalesce(1).write.mode("overwrite").csv(f"{root}/{list_name(name)}", header=True)


def load_list(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The literal NA is a ticker like any other."""
    return spark.read.schema("Ticker string").csv(f"{root}/{list_name(name)}", header=True, nullValue="\u0000")


def list_universes(spark: SparkSession, root: str) -> list[str]:
    """Names of the lists saved below root, sorted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(s.getPath().getName() for s in files.listStatus(path) if s.isDirectory()) if files.exists(path) else []


def ledger_append(ledger: DataFrame, failed: DataFrame, today) -> DataFrame:
    """New failures (ticker, market) enter with one attempt; tickers that are in it already stay as they are."""
    new = failed.dropDuplicates(["ticker"]).join(ledger.select("ticker"), "ticker", "left_anti")
    day = F.lit(today).cast("date")
    return ledger.unionByName(new.select("ticker", "market", F.lit(1).alias("attempts"), day.alias("first_blacklisted"), day.alias("last_checked")))


def ledger_recheck(ledger: DataFrame, outcomes: DataFrame, today, max_attempts: int = 3) -> dict[str, DataFrame]:
    """After a fetch of ledger tickers (ticker, ok): revived ones, those that stay with one attempt more, and those now dead."""
    df = ledger.join(outcomes.groupBy("ticker").agg(F.max("ok").alias("ok")), "ticker", "left")
    day = F.lit(today).cast("date")
    tried = df.withColumns({"attempts": F.when(F.col("ok").isNotNull(), F.col("attempts") + 1).otherwise(F.col("attempts")), "last_checked": F.when(F.col("ok").isNotNull(), day).otherwise(F.col("last_checked"))})
    failing = tried.filter("ok is null or not ok").drop("ok")
    return {
        "revived": df.filter("ok").select("ticker", "market"),
        "ledger": failing.filter(F.col("attempts") < max_attempts),
        "dead": failing.filter(F.col("attempts") >= max_attempts).select("ticker", "attempts", "first_blacklisted", day.alias("died_on")),
    }
