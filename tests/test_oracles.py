"""Every panel query against its SQL in DuckDB over the driver's smallest tables."""

import datetime as dt
import decimal
import math
import os

import pytest

from tapewright.plans import registry
from tapewright.sources.panel import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, dt.datetime) and v.time() == dt.time():
        return v.date()
    if isinstance(v, decimal.Decimal | float):
        return float(v) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    found = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got == want


def test_only_these_have_no_sql():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"o8_pca", "o13_search_report", "q1_excess_regressor", "q2_window_classifier", "q3_ranker"}


def test_sample_of_tickers_repeats_itself(spark):
    drawn = [[r.Ticker for r in registry.queries()["a22_sample_tickers"](spark, SF).collect()] for _ in range(2)]
    known = {str(r[0]) for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey").distinct().collect()}
    assert drawn[0] == drawn[1] and len(set(drawn[0])) == 5 and set(drawn[0]) <= known - {"1"}


def test_components_equal_numpy(spark):
    import numpy as np

    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect())
    v = np.array([r.embedding for r in rows], float)
    centred = v - v.mean(0)
    want = np.abs(centred @ np.linalg.svd(centred, full_matrices=False)[2][:4].T)
    got = {r.vec_id: r["size"] for r in registry.queries()["o8_pca"](spark, SF).collect()}
    assert np.allclose([got[r.vec_id] for r in rows], want, atol=1e-3)


def test_a_panel_without_signal_gives_no_more_than_chance(spark):
    """Windows of the generated panel tell nothing: accuracy and rank correlation stay near chance."""
    sectors = 5
    assert 0 <= registry.queries()["q2_window_classifier"](spark, SF).first().macro_accuracy < 1 / sectors + 0.2  # some 20 windows
    ranked = registry.queries()["q3_ranker"](spark, SF).first()
    assert 0 <= ranked.precision < 1 and 0 < ranked.ndcg < 1
    assert abs(registry.queries()["q1_excess_regressor"](spark, SF).first().spearman) < 0.6


def test_regressor_finds_what_windows_show(spark):
    """A model that learns: excess follows the first value of a window."""
    from pyspark.sql import functions as F

    from tapewright.operators import mleval

    df = spark.range(400).select(F.array(*((F.xxhash64("id", F.lit(k)) % 1000 / 1000).cast("float") for k in range(3))).alias("flat"), (F.col("id") % 20).alias("day"), F.when(F.col("id") < 240, "train").when(F.col("id") < 320, "valid").otherwise("test").alias("split"))
    df = df.withColumn("excess", F.col("flat")[0].cast("double"))
    found = mleval.predict(mleval.fit_regressor(df, rounds=20), df.filter("split = 'test'"))
    assert mleval.spearman_by_group(found, "prediction", "excess", "day").first().spearman > 0.8
