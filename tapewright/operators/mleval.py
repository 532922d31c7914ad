"""Ranking and classification metrics as aggregates, and pointwise models from Spark ML."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.columns import pct_rank
from tapewright.functions.places import ranks
from tapewright.sources.scratch import settle


def spearman_by_group(df: DataFrame, pred: str, target: str, group: str) -> DataFrame:
    """One row: mean over groups of the rank correlation; groups under two rows or without variance are left out."""
    ranks = df.select(group, pct_rank(pred, [group]).alias("a"), pct_rank(target, [group]).alias("b"))
    each = ranks.groupBy(group).agg(F.count("*").alias("n"), F.covar_pop("a", "b").alias("c"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"))
    rho = F.when((F.col("n") >= 2) & (F.col("sa") > 0) & (F.col("sb") > 0), F.try_divide("c", F.col("sa") * F.col("sb")))
    return each.agg(F.avg(rho).alias("spearman"), F.count(rho).alias("groups"))


def precision_at_k(df: DataFrame, pred: str, target: str, group: str, k_frac: float, tie: str = "Ticker") -> DataFrame:
    """One row: mean over groups of the share of the top k by prediction that are in the top k by target."""
    n = F.count("*").over(Window.partitionBy(group))
    place = lambda c: F.row_number().over(Window.partitionBy(group).orderBy(F.col(c).desc(), tie))
    df = df.select(group, n.alias("n"), place(pred).alias("p"), place(target).alias("t"))
    df = df.withColumn("k", F.greatest(F.lit(1), F.bround(F.col("n") * k_frac).cast("int")))
    each = df.filter("n >= 2").groupBy(group).agg((F.count_if((F.col("p") <= F.col("k")) & (F.col("t") <= F.col("k"))) / F.first("k")).alias("hit"))
    return each.agg(F.avg("hit").alias("precision"), F.count("*").alias("groups"))


def macro_accuracy(df: DataFrame, pred: str, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.avg((F.col(pred) == F.col(label)).cast("double")).alias("recall")).agg(F.avg("recall").alias("macro_accuracy"))


def confusion_matrix(df: DataFrame, pred: str, label: str) -> DataFrame:
    """(label, pred, n, share of the label's rows)."""
    counts = df.groupBy(label, pred).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.try_divide("n", F.sum("n").over(Window.partitionBy(label))))


def top_confused(df: DataFrame, pred: str, label: str, n: int = 15) -> DataFrame:
    return df.filter(F.col(pred) != F.col(label)).groupBy(label, pred).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label, pred).limit(n)


def worst_predicted(df: DataFrame, pred: str, label: str, n: int = 10) -> DataFrame:
    """Classes predicted wrongly most often, with the number of true classes they come from."""
    return df.filter(F.col(pred) != F.col(label)).groupBy(pred).agg(F.count("*").alias("n"), F.countDistinct(label).alias("sources")).orderBy(F.desc("n"), pred).limit(n)


def rank_success(df: DataFrame, pred: str, target: str, tolerance: float = 0.1) -> DataFrame:
    """(Ticker, pred_rank, true_rank, success): ranks of mean prediction and mean target, near enough or not."""
    means = df.groupBy("Ticker").agg(F.avg(pred).alias("p"), F.avg(target).alias("t"))
    means = settle(means, "means")
    total = F.broadcast(means.agg(F.count("*").alias("_n")))
    out = ranks(ranks(means, "p", "pred_rank", descending=True), "t", "true_rank", descending=True).select("Ticker", "pred_rank", "true_rank").crossJoin(total)
    near = F.abs(F.col("pred_rank") - F.col("true_rank")) <= F.greatest(F.lit(1), F.bround(F.col("_n") * tolerance).cast("int"))
    return out.withColumn("success", near).drop("_n")


def cross_section_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n")).agg(F.median("n").alias("median"), F.max("n").alias("most"))


def _features(df: DataFrame, flat: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector(F.transform(F.col(flat), lambda x: x.cast("double"))))


def fit_regressor(df: DataFrame, flat: str = "flat", target: str = "excess", rounds: int = 500, seed: int = 0):
    """Boosted trees on flat windows; `rounds` is an upper bound, as rows of split valid tell when to stop."""
    from pyspark.ml.regression import GBTRegressor

    rows = _features(df.filter("split in ('train', 'valid')"), flat).withColumn("_valid", F.col("split") == "valid").select("features", target, "_valid")
    return GBTRegressor(featuresCol="features", labelCol=target, maxIter=rounds, maxDepth=4, seed=seed, validationIndicatorCol="_valid").fit(rows)


def fit_classifier(df: DataFrame, flat: str = "flat", label: str = "label_index", trees: int = 100, seed: int = 0):
    """A weighted forest on flat windows of train rows (df has weight)."""
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=6, seed=seed).fit(_features(df.filter("split = 'train'"), flat))


def fit_ranker(df: DataFrame, flat: str = "flat", grade: str = "grade", rounds: int = 500, seed: int = 0):
    """Pointwise: boosted trees on relevance grades; order within a date by their prediction."""
    return fit_regressor(df.withColumn(grade, F.col(grade).cast("double")), flat, grade, rounds, seed)


def predict(model, df: DataFrame, flat: str = "flat") -> DataFrame:
    return model.transform(_features(df, flat)).drop("features", "rawPrediction", "probability")
