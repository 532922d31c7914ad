"""Places over a whole table, dealt by ranges."""

import random

from pyspark.sql import functions as F

from tapewright.functions import places
from tapewright.operators import mleval


def test_places_ranks_and_sums(spark):
    r = random.Random(1)
    rows = [(i, r.choice([None, 1.0, 2.0, 2.0, 5.0, r.random() * 9]), r.randint(0, 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, v double, n int").repartition(5)
    got = {x.id: x.place for x in places.row_places(df, [F.col("n").asc(), F.col("id").desc()], "place").collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == [x[0] for x in sorted(rows, key=lambda x: (x[2], -x[0]))]
    key = lambda v: (v is None, -(v or 0))
    want = {i: 1 + sum(key(w) < key(v) for _, w, _ in rows) for i, v, _ in rows}
    assert {x.id: x["rank"] for x in places.ranks(df, "v", "rank", descending=True).collect()} == want
    before, total = {}, 0
    for i, _, n in sorted(rows):
        before[i], total = total, total + n
    assert {x.id: x.b for x in places.running_sums(df, [F.col("id").asc()], "n", "b").collect()} == before
    empty = df.limit(0)
    assert places.row_places(empty, [F.col("n").asc()], "p").collect() == places.ranks(empty, "v", "p").collect() == []


def test_no_task_gets_all_rows(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("Ticker"), (F.col("id") % 7).cast("double").alias("a"), F.rand(1).alias("b"))
    out = mleval.rank_success(df, "a", "b")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("BroadcastExchange")[0] or "SinglePartition" not in plan.split("BroadcastExchange")[0]
    assert out.count() == 1000
