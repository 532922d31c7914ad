"""Scans of vendor files and documents into the canonical tables."""

from __future__ import annotations

import io
import json
import zipfile
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.columns import col

FLAT = "ticker string, per string, date string, time string, open string, high string, low string, close string, vol string, openint string"


def asset_class(ticker: Column) -> Column:
    """By the form of the whole ticker: suffix .B a bond, ^ in front an index, six letters alone a pair; anything else is out of scope."""
    return F.when(ticker.endswith(".B"), "bonds").when(ticker.startswith("^"), "indices").when(ticker.rlike(r"\A\p{L}{6}\z"), "currencies")


def canonical_bars(raw: DataFrame, asset: Column, *others: str) -> DataFrame:
    number = lambda c: F.col(c).try_cast("double")
    return raw.select(F.upper(F.split("ticker", r"\.")[0]).alias("Ticker"), F.to_date("date", "yyyyMMdd").alias("Date"), *(number(c).alias(n) for c, n in (("open", "O"), ("high", "H"), ("low", "L"), ("close", "C"))), asset.alias("AssetClass"), *others)


def read_update_file(spark: SparkSession, path: str) -> DataFrame:
    """A flat file of many instruments; rows out of scope are dropped."""
    raw = spark.read.schema(FLAT).csv(path, header=True, enforceSchema=True)
    return canonical_bars(raw, asset_class(F.col("ticker"))).filter("AssetClass is not null")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every .txt below folders named bonds, currencies or indices, tagged with the folder."""
    raw = spark.read.schema(FLAT).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").csv(root, header=True, enforceSchema=True)
    folder = F.lower(F.regexp_extract(F.col("_metadata.file_path"), r"(?i)/(bonds|currencies|indices)/", 1))
    return canonical_bars(raw, F.when(folder != "", folder)).filter("AssetClass is not null")


def unzip_rows(zips: DataFrame, schema: str, sep: str = ",") -> DataFrame:
    """Rows of all CSV members of zip archives (a binary column content), in pieces of rows."""
    names = [f.split()[0] for f in schema.split(", ")]

    def unpack(frames):
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(z.namelist()):
                        if not member.endswith("/"):
                            for part in pd.read_csv(z.open(member), sep=sep, dtype=str, header=0, names=names, keep_default_na=False, chunksize=50_000):
                                yield part

    return zips.select("content").mapInPandas(unpack, ", ".join(f"{n} string" for n in names))


def read_zipped(spark: SparkSession, path: str, schema: str, sep: str = ",", part_bytes: int = 16 << 20) -> DataFrame:
    """All CSV members of zip files; many tasks read one archive, by ranges.  Where pyarrow can't reach the files, Spark reads each whole, in one task."""
    from pyarrow import fs

    from .archives import Archives

    files = spark.read.format("binaryFile").load(path)
    paths = [r.path for r in files.select("path").collect()]  # a row for each archive
    try:
        for p in paths[:1]:
            fs.FileSystem.from_uri(p)
    except (pa.ArrowInvalid, OSError):
        return unzip_rows(files, schema, sep)
    spark.dataSource.register(Archives)
    return spark.read.format("archives").schema(schema).options(archives=json.dumps(sorted(paths)), sep=sep, bytes=str(part_bytes)).load()


#: Types of statement columns that are no amounts; amounts are double.
STATEMENT_TYPES = {"Ticker": "string", "SimFinId": "bigint", "Currency": "string", "Fiscal Year": "bigint", "Fiscal Period": "string", "Report Date": "date", "Publish Date": "date", "Restated Date": "date"}


def _typed(df: DataFrame, types: dict[str, str], other: str) -> DataFrame:
    """Text columns cast by name; what can't be cast is null."""
    return df.select(*(col(c).try_cast(types.get(c, other)).alias(c) for c in df.columns))


def read_statements(spark: SparkSession, paths: dict[tuple[str, bool], str], src: str = "vendor", market: str = "us") -> DataFrame:
    """Variants of a ;-separated statement by (period, restated), tagged and stacked by name; missing ones (None) are left out, and with none at all the result is empty."""
    parts = []
    for (period, restated), path in paths.items():
        if path is not None:
            df = _typed(spark.read.csv(path, sep=";", header=True), STATEMENT_TYPES, "double").withColumnRenamed("SimFinId", "SrcId")
            parts.append(df.withColumns({"Src": F.lit(src), "Market": F.lit(market), "Period": F.lit(period), "IsRestated": F.lit(restated)}))
    empty = spark.createDataFrame([], "Ticker string, SrcId bigint, Src string, Market string, Period string, IsRestated boolean")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts or [empty])


def read_companies(spark: SparkSession, companies: str, industries: str) -> DataFrame:
    """Companies with free text over lines, left-joined to their industry."""
    types = {"SimFinId": "bigint", "IndustryId": "bigint", "Number Employees": "bigint"}
    c = _typed(spark.read.csv(companies, sep=";", header=True, multiLine=True, quote='"', escape='"'), types, "string").withColumnsRenamed({"SimFinId": "SrcId", "Company Name": "CompanyName", "Business Summary": "BusinessSummary", "Number Employees": "NrEmployees"})
    i = _typed(spark.read.csv(industries, sep=";", header=True), types, "string")
    return c.join(i, "IndustryId", "left")


def to_prices(vendor: DataFrame) -> DataFrame:
    return vendor.select("Ticker", F.to_date("Date").alias("Date"), *(col(c).cast("double").alias(c[0]) for c in ("Open", "High", "Low", "Close")), col("Volume").cast("long").alias("V"))


def to_dividends(vendor: DataFrame) -> DataFrame:
    return vendor.filter(col("Dividends") > 0).select("Ticker", F.to_date("Date").alias("Date"), col("Dividends").alias("Dividend"))


def to_splits(vendor: DataFrame) -> DataFrame:
    return vendor.filter(col("Stock Splits") > 0).select("Ticker", F.to_date("Date").alias("Date"), col("Stock Splits").alias("Ratio"))


def unpivot_batch(wide: DataFrame, fields: list[str], sep: str = "|") -> DataFrame:
    """A frame with a column TICKER|Field for each pair, as rows of (Ticker, Date, fields); rows without any value are dropped."""
    values = [c for c in wide.columns if sep in c]
    long = wide.select("Date", *(col(c).cast("double").alias(c) for c in values)).unpivot(["Date"], [col(c) for c in values], "name", "value")
    parts = F.split("name", "\\" + sep)
    return long.select("Date", parts[0].alias("Ticker"), parts[1].alias("field"), "value").groupBy("Ticker", "Date").pivot("field", fields).agg(F.first("value", ignorenulls=True)).dropna("all", subset=fields)


PROFILE = ["longName", "sector", "industry", "fullTimeEmployees", "address1", "city", "state", "zip", "country", "phone", "website", "irWebsite", "longBusinessSummary", "currency", "exchange", "quoteType"]
OFFICER = "struct<name:string,title:string,age:int,yearBorn:int,fiscalYear:int,totalPay:double,exercisedValue:double,unexercisedValue:double>"


def _profile_docs(docs: DataFrame) -> DataFrame:
    schema = ", ".join(f"{f} string" for f in PROFILE) + f", companyOfficers array<{OFFICER}>"
    return docs.withColumn("info", F.from_json("info", schema))


def to_profiles(docs: DataFrame) -> DataFrame:
    """docs (Ticker, info as JSON, FetchedOn) as one row each; missing fields are null, never ''."""
    return _profile_docs(docs).select("Ticker", *(F.col(f"info.{f}").alias(f) for f in PROFILE), "FetchedOn")


def to_officers(docs: DataFrame) -> DataFrame:
    return _profile_docs(docs).select("Ticker", F.inline("info.companyOfficers"))


def filings(docs: DataFrame) -> DataFrame:
    """docs (CIK, body as JSON of parallel arrays) as a row for each filing."""
    arrays = "form array<string>, reportDate array<date>, filingDate array<date>, accessionNumber array<string>"
    return docs.withColumn("f", F.from_json("body", arrays)).select("CIK", F.posexplode(F.arrays_zip("f.form", "f.reportDate", "f.filingDate", "f.accessionNumber")).alias("seq", "z")).select("CIK", "seq", "z.*")
