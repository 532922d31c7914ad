"""Panel views over the TPC-H-like tables: prices, corporate actions, statements and companies.

Each view is SQL that Spark and DuckDB both run; names with spaces are double-quoted here and back-quoted for Spark.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

VIEWS = {
    "px0": """select cast(l_suppkey as varchar(20)) Ticker, cast(l_shipdate as date) Date, l_extendedprice/l_quantity u, l_quantity q, l_discount disc, l_linenumber ln, l_returnflag rf,
      row_number() over (partition by l_suppkey, cast(l_shipdate as date) order by l_orderkey,l_linenumber,l_partkey,l_extendedprice,l_quantity,l_discount,l_tax) i,
      count(*) over (partition by l_suppkey, cast(l_shipdate as date)) n from lineitem""",
    "bars": "select Ticker, Date, max(case when i=1 then u end) O, max(u) H, min(u) L, max(case when i=n then u end) C, cast(sum(q) as bigint) V from px0 group by Ticker, Date",
    "dividends": "select Ticker, Date, max(disc)*10 Dividend from px0 where disc > 0.085 group by Ticker, Date",
    "splits": "select Ticker, Date, cast(max(ln) as double) Ratio from px0 where ln = 7 group by Ticker, Date",
    "market_data": "select concat('^', rf) Ticker, Date, min(u) O, max(u) H, min(u) L, round(avg(u) + 1.37e-8, 6) C, case rf when 'R' then 'bonds' when 'A' then 'currencies' else 'indices' end AssetClass from px0 group by rf, Date",
    # The same bars with faults: zero opens and lows, swapped highs, negative volumes, closes rounded so that runs repeat.
    "faulty": """select Ticker, Date, case when k%97=0 then 0 else O end O, case when k%89=0 then L*0.5 else H end H, case when k%97 in (0,1) then 0 else L end L,
      case when k%83=0 then -C else C end C, case when k%101=0 then -V else V end V, case when k%83=0 then -C else C end AC
      from (select *, cast(Ticker as int)*31+dayofyear(Date) k from bars)""",
    "rounded": "select Ticker, Date, round(C/100000)*100000 + 1 C from bars",
    "quarters": """select cast(l_suppkey as varchar(20)) Ticker, cast(year(l_shipdate) as bigint) fy, quarter(l_shipdate) fq, v IsRestated, count(*) n,
      cast(round(sum(case when v or l_linenumber < 7 then l_extendedprice*(1-l_discount) else 0 end)) as bigint) rev,
      cast(round(sum(l_quantity)) as bigint) qty from lineitem cross join (select true v union all select false v) vv group by 1,2,3,4""",
    "income": """select Ticker, 'us' Market, 'Q' Period, IsRestated, fy "Fiscal Year", concat('Q', cast(fq as varchar(1))) "Fiscal Period", make_date(cast(fy as int), cast(fq*3 as int), 28) "Report Date",
      make_date(cast(fy as int), cast(fq*3 as int), 28) + cast(20+qty%60 as int) "Publish Date", make_date(cast(fy as int), cast(fq*3 as int), 28) + cast(90+qty%400 as int) "Restated Date",
      1000+qty "Shares (Basic)", 1010+qty "Shares (Diluted)", rev "Revenue", -(rev*6 div_ 10) "Cost of Revenue", rev-(rev*6 div_ 10) + (case when qty%13=0 then rev div_ 10 else 0 end) "Gross Profit",
      -(rev div_ 5) "Operating Expenses", rev-(rev*6 div_ 10)-(rev div_ 5) "Operating Income (Loss)", -(rev div_ 50) "Depreciation & Amortization", -(rev div_ 100) "Interest Expense",
      (qty%17-3)*rev div_ 100 "Net Income", (qty%17-3)*rev div_ 110 "Net Income (Common)" from quarters
      union all select Ticker, 'us', 'A', IsRestated, fy, 'FY', make_date(cast(fy as int), 12, 28), make_date(cast(fy as int), 12, 28) + cast(30+sum(qty)%60 as int), make_date(cast(fy as int), 12, 28) + cast(120+sum(qty)%400 as int),
      1000+max(qty), 1010+max(qty), cast(sum(rev) as bigint) + (case when sum(qty)%7=0 then 5000000 else 0 end), -cast(sum(rev*6 div_ 10) as bigint), cast(sum(rev-(rev*6 div_ 10)) as bigint), -cast(sum(rev div_ 5) as bigint),
      cast(sum(rev-(rev*6 div_ 10)-(rev div_ 5)) as bigint), -cast(sum(rev div_ 50) as bigint), -cast(sum(rev div_ 100) as bigint), cast(sum((qty%17-3)*rev div_ 100) as bigint), cast(sum((qty%17-3)*rev div_ 110) as bigint) from quarters group by Ticker, IsRestated, fy""",
    "balance": """select Ticker, Market, Period, IsRestated, "Fiscal Year", "Fiscal Period", "Report Date", "Publish Date", "Restated Date", "Shares (Basic)", "Shares (Diluted)", "Revenue"*3 "Total Assets", "Revenue"*2 "Total Current Assets", "Revenue"+(case when "Shares (Basic)"%23=0 then "Revenue" div_ 8 else 0 end) "Total Noncurrent Assets",
      "Revenue"+"Revenue" div_ 2 "Total Liabilities", "Revenue"*3-("Revenue"+"Revenue" div_ 2)-(case when "Shares (Basic)"%11=0 then "Revenue" div_ 4 else 0 end) "Total Equity",
      case when "Shares (Basic)"%5=0 then null else "Revenue" div_ 10 end "Short Term Debt", case when "Shares (Basic)"%3=0 then null else "Revenue" div_ 4 end "Long Term Debt", "Revenue" div_ 8 "Cash & Cash Equivalents" from income""",
    "cashflow": """select Ticker, Market, Period, IsRestated, "Fiscal Year", "Fiscal Period", "Report Date", "Publish Date", "Restated Date", "Shares (Basic)", "Shares (Diluted)", "Net Income"+"Revenue" div_ 20 "Net Cash from Operating Activities",
      -("Revenue" div_ 15) "Change in Fixed Assets & Intangibles", -("Revenue" div_ 12) "Net Cash from Investing Activities", "Revenue" div_ 30 "Net Cash from Financing Activities",
      "Net Income"+"Revenue" div_ 20-("Revenue" div_ 12)+"Revenue" div_ 30+(case when "Shares (Basic)"%19=0 then "Revenue" div_ 9 else 0 end) "Net Change in Cash" from income""",
    "companies": """select cast(s_suppkey as varchar(20)) Ticker, s_name CompanyName, n_name Industry, r_name Sector from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
}

#: Of views that Spark has in another form. Sums of doubles hang on the order of rows, and where they end in one half so does what they are rounded to; decimals don't, and amounts have no more than 8 digits behind the point.
SPARK_VIEWS = {"quarters": VIEWS["quarters"].replace("l_extendedprice*(1-l_discount)", "cast(l_extendedprice*(1-l_discount) as decimal(28,8))")}


#: Only for the oracle: Spark's come from operators.series.adjusted_close.
DUCK_VIEWS = {
    "exdays": """select b.*, case when d.Dividend is not null then 1 - d.Dividend/nullif(lag(C) over (partition by b.Ticker order by b.Date), 0) end f from bars b left join dividends d on b.Ticker=d.Ticker and b.Date=d.Date""",
    "prices": """select Ticker, Date, O, H, L, C, V, C*coalesce(product(coalesce(f,1)) over (partition by Ticker order by Date rows between 1 following and unbounded following),1) AC from exdays""",
}


def spark_sql(text: str) -> str:
    return text.replace('"', "`").replace("div_", "div")


def duck_sql(text: str) -> str:
    return text.replace("div_", "//")


def with_views(sql: str) -> str:
    """DuckDB SQL that has the panel views as common table expressions."""
    if sql.startswith("with "):
        sql = ", " + sql.removeprefix("with ")
    return "with recursive " + ", ".join(f"{name} as ({duck_sql(text)})" for name, text in {**VIEWS, **DUCK_VIEWS}.items()) + " " + sql


class Panel:
    """The views of one folder as DataFrames, by attribute or item."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._known = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in TABLES:
                self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = spark_sql({**VIEWS, **SPARK_VIEWS}[name])
                used = set()

                def named(m: re.Match) -> str:
                    used.add(m[2])
                    return f"{m[1]} {{{m[2]}}}"

                text = re.sub(rf"\b(from|join) ({'|'.join((*TABLES, *VIEWS))})\b", named, text)
                self._known[name] = self.spark.sql(text, **{t: self[t] for t in sorted(used)})
        return self._known[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def settle(self, *names: str) -> Panel:
        """Writes these views once, in the shared scratch folder, for queries that use them many times; views over them then read what is written."""
        from tapewright.streaming.ingest import stream_root

        root = stream_root(self.spark)
        for name in names:
            df = self.prices if name == "prices" else self[name]
            df.write.parquet(f"{root}/{name}")
            self._known[name] = self.spark.read.schema(df.schema).parquet(f"{root}/{name}")
        return self

    @property
    def prices(self) -> DataFrame:
        """Bars with the dividend-adjusted close AC."""
        from tapewright.operators.series import adjusted_close

        if "prices" not in self._known:
            self._known["prices"] = adjusted_close(self["bars"], self["dividends"])
        return self._known["prices"]
