"""Histogram gradient boosting: a multi-class classifier with weights, and a ranker by group with lambda gradients.

Features are cut into bins by quantiles over all training rows.  A tree grows
level by level: each task adds up gradients and hessians of its rows by (tree,
node, feature, bin), Spark adds these up by group-by, and running sums over the bins
give every split's gain: on the driver where a level has few cells, else in
Spark, and then one row for each node comes back.  Nothing that grows with the
rows does.  Sums are of whole numbers (gradients in
steps of 2**-24), so the trees are the same however rows are partitioned.

A table of rows keeps bins and margins; trees grown since it was written are
applied in passing, and it is written anew every few rounds.

Missing and NaN features fall in the lowest bin.  Rows whose features are null
or of another size than most don't train and get no prediction; nor do rows with
a null target, label below 0, or (for the ranker) null group train.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.sources.scratch import discard, settle

#: One in whole numbers of the sums.
UNIT = 2.0**24
#: Cells (node, feature, bin) of histograms that a task holds at once; more trees than fit are grown in turns.
CELLS = 1 << 22
#: Cells whose totals come to the driver, some 60 bytes each; splits of more are found in Spark.
FEW_CELLS = 1 << 17


@dataclass
class Settings:
    rounds: int = 500
    patience: int = 10
    depth: int = 4
    rate: float = 0.1
    bins: int = 32
    smoothing: float = 1.0
    least_hessian: float = 1.0
    rewrite: int = 8
    #: Of the ranker: pairs have one row among so many at the top of a group, and NDCG is cut there.
    top: int = 32


#: Weights of pairs are shares of NDCG, and their hessians small.
OF_PAIRS = {"smoothing": 0.1, "least_hessian": 0.01}


@dataclass
class Tree:
    """A tree in heap order: children of node i are 2 i + 1 and 2 i + 2; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def seed(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n))

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            right = bins[rows, np.maximum(f, 0)] > self.cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)


Round = list[Tree]


@dataclass
class Model:
    edges: list[np.ndarray]
    k: int
    rounds: list[Round] = field(default_factory=list)
    #: By round, what early stopping looked at: weighted log loss, or NDCG.
    history: list[float] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """x: rows by features, to bins of 8 bits."""
        out = np.zeros(x.shape, np.uint8)
        for j, edges in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(edges, x[:, j], side="left"))
        return out


def margins(bins: np.ndarray, rounds: list[Round], k: int) -> np.ndarray:
    out = np.zeros((len(bins), k))
    for trees in rounds:
        for i, tree in enumerate(trees):
            out[:, i] += tree.value[tree.leaf(bins)]
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _mapped(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return df.mapInArrow(run, schema)


def _to_batch(columns: dict, schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in target], schema=target)


def bin_edges(df: DataFrame, flat: str, size: int, bins: int) -> list[np.ndarray]:
    """Of each feature, the distinct quantiles that part its bins; size x bins numbers."""
    shares = [i / bins for i in range(1, bins)]
    value = lambda j: F.when(~F.isnan(F.get(flat, F.lit(j))), F.get(flat, F.lit(j)).cast("double"))
    row = df.agg(*(F.approx_percentile(value(j), shares, 50 * bins).alias(f"f{j}") for j in range(size))).first()
    return [np.unique(np.array(row[j] or [], np.float64)) for j in range(size)]


def _prepared(df: DataFrame, flat: str, target: str, weight: str | None, group: str | None, k: int, bins: int) -> tuple[Model, DataFrame]:
    """A model without trees, and the rows of splits train and valid with bins and margins of 0."""
    train = df.filter((F.col("split") == "train") & F.col(flat).isNotNull())
    size = train.groupBy(F.size(flat).alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        raise ValueError("no rows to train on")
    size = size.n
    fit = df.filter(F.col("split").isin("train", "valid") & (F.size(flat) == size) & F.col(target).isNotNull())
    model = Model(bin_edges(fit.filter("split = 'train'"), flat, size, bins), k)
    named = F.concat_ws("|", "split", F.col(group).cast("string")) if group else F.lit("")
    rows = fit if group is None else fit.filter(F.col(group).isNotNull())
    rows = rows.select(F.monotonically_increasing_id().alias("id"), (F.col("split") == "valid").alias("valid"), named.alias("group"), F.col(target).cast("double").alias("target"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("weight"), F.col(flat).cast("array<double>").alias("flat"))
    plain = [rows.schema[c] for c in ("id", "valid", "group", "target", "weight")]
    schema = T.StructType([*plain, T.StructField("bins", T.BinaryType()), T.StructField("margin", T.ArrayType(T.DoubleType()))])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bins = model.binned(_matrix(batch.column("flat"), size))
        columns = {c: batch.column(c) for c in ("id", "valid", "group", "target", "weight")}
        return _to_batch(columns | {"bins": [r.tobytes() for r in bins], "margin": [[0.0] * k] * len(bins)}, schema)

    return model, settle(_mapped(rows, work, schema), "boosting")


def _advanced(rows: DataFrame, model: Model, since: list[Round]) -> DataFrame:
    """rows with the margins that the rounds since give."""
    if not since:
        return rows
    width, k, schema = len(model.edges), model.k, rows.schema

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        now = _matrix(batch.column("margin"), k) + margins(_bytes(batch.column("bins"), width), since, k)
        return _to_batch({c: batch.column(c) for c in batch.schema.names} | {"margin": now.tolist()}, schema)

    return _mapped(rows, work, schema)


Gradients = Callable[[pa.RecordBatch, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
_SUMS = "tree int, node int, feature int, bin int, g long, h long, n long"


def _histograms(rows: DataFrame, model: Model, since: list[Round], trees: dict[int, Tree], level: int, gradients: Gradients, loss: Callable | None, bins: int) -> DataFrame:
    """(tree, node, feature, bin, g, h, n) of the nodes of a level, once for each task; tree -1 holds the loss and weight of the valid rows."""
    width, k, first, nodes = len(model.edges), model.k, 2**level - 1, 2**level
    place = np.arange(width) * bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {t: np.zeros((3, nodes * width * bins), np.int64) for t in trees}
        lost = np.zeros(2, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = _bytes(batch.column("bins"), width)
            now = _matrix(batch.column("margin"), k) + margins(codes, since, k)
            if loss:
                valid = batch.column("valid").to_numpy(zero_copy_only=False).astype(bool)
                each, weight = loss(batch, now)
                lost += [int(np.rint(each[valid] * UNIT).sum()), int(np.rint(weight[valid] * UNIT).sum())]
            g, h, n = gradients(batch, now)
            for t, tree in trees.items():
                at = tree.leaf(codes) - first
                here = np.flatnonzero((at >= 0) & ((g[:, t] != 0) | (h[:, t] != 0) | (n > 0)))
                cell = (at[here, None] * width * bins + place + codes[here]).ravel()
                for s, x in zip(sums[t], (np.rint(g[here, t] * UNIT), np.rint(h[here, t] * UNIT), n[here])):
                    s += np.bincount(cell, np.repeat(x, width), len(s)).astype(np.int64)
        for t, (g, h, n) in sums.items():
            some = np.flatnonzero((g != 0) | (h != 0) | (n != 0))
            node, rest = np.divmod(some, width * bins)
            feature, bin_ = np.divmod(rest, bins)
            columns = [np.full(len(some), t), node, feature, bin_, g[some], h[some], n[some]]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, [pa.int32()] * 4 + [pa.int64()] * 3)], ["tree", "node", "feature", "bin", "g", "h", "n"])
        if loss:
            yield pa.RecordBatch.from_arrays([pa.array([x], y) for x, y in zip([-1, 0, 0, 0, *lost.tolist(), 0], [pa.int32()] * 4 + [pa.int64()] * 3)], ["tree", "node", "feature", "bin", "g", "h", "n"])

    return rows.mapInArrow(run, _SUMS)


def _totals(histograms: DataFrame) -> DataFrame:
    return histograms.groupBy("tree", "node", "feature", "bin").agg(*(F.sum(F.col(c).cast("decimal(20,0)")).cast("double").alias(c) for c in "ghn"))


def _splits_here(histograms: DataFrame, s: Settings, width: int) -> list[Row]:
    """What _best_splits gives, found on the driver: for histograms of few cells, however many rows they are of."""
    total = _totals(histograms).toArrow()
    tree, node, feature, bin_, *sums = (total.column(c).to_numpy() for c in ("tree", "node", "feature", "bin", "g", "h", "n"))
    score = lambda g, h: g * g / (h + s.smoothing * UNIT)
    out = []
    for t, i in np.unique(np.stack([tree, node]), axis=1).T:
        here = (tree == t) & (node == i)
        dense = np.zeros((3, width, s.bins))
        for d, x in zip(dense, sums):
            d[feature[here], bin_[here]] = x[here]
        left = dense.cumsum(2)
        all_ = left[:, :, -1:]
        (gl, hl, nl), (gr, hr, nr) = left, all_ - left
        gain = score(gl, hl) + score(gr, hr) - score(all_[0], all_[1])
        least = s.least_hessian * UNIT
        gain = np.where((nl > 0) & (nr > 0) & (hl >= least) & (hr >= least) & (gain > 1e-6 * UNIT), gain, -np.inf)
        f, b = np.unravel_index(gain.argmax(), gain.shape)
        split = Row(feature=int(f), bin=int(b), gl=float(gl[f, b]), hl=float(hl[f, b])) if np.isfinite(gain[f, b]) else None
        some = np.unique(feature[here])
        out.append(Row(tree=int(t), node=int(i), g=float(all_[0, some].max()), h=float(all_[1, some].max()), split=split))
    return out


def _best_splits(histograms: DataFrame, s: Settings) -> DataFrame:
    """For each (tree, node) its sums and the split of greatest gain: of equals the first feature, then the first bin."""
    total = _totals(histograms)
    of = Window.partitionBy("tree", "node", "feature")
    left = of.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = total.select("*", *(F.sum(c).over(left).alias(f"{c}l") for c in "ghn"), *(F.sum(c).over(of).alias(f"{c}t") for c in "ghn"))
    score = lambda g, h: g * g / (h + s.smoothing * UNIT)
    right = {c: F.col(f"{c}t") - F.col(f"{c}l") for c in "ghn"}
    gain = score(F.col("gl"), F.col("hl")) + score(right["g"], right["h"]) - score(F.col("gt"), F.col("ht"))
    fair = (F.col("nl") > 0) & (right["n"] > 0) & (F.col("hl") >= s.least_hessian * UNIT) & (right["h"] >= s.least_hessian * UNIT) & (gain > 1e-6 * UNIT)
    split = F.struct("feature", "bin", "gl", "hl")
    order = F.when(fair, F.struct(gain, -F.col("feature"), -F.col("bin")))
    return cut.groupBy("tree", "node").agg(F.max("gt").alias("g"), F.max("ht").alias("h"), F.max_by(split, order).alias("split"))


def _grown(rows: DataFrame, model: Model, since: list[Round], s: Settings, gradients: Gradients, loss: Callable | None = None) -> tuple[Round, float | None]:
    """One tree for each of model.k, and the loss of the valid rows before them."""
    trees, lost = {t: Tree.seed(s.depth) for t in range(model.k)}, None
    value = lambda g, h: -s.rate * g / (h + s.smoothing * UNIT)
    open_ = set(trees)
    for level in range(s.depth):
        step = max(1, CELLS // (2**level * len(model.edges) * s.bins))
        growing = sorted(open_)
        open_ = set()
        for i in range(0, len(growing), step):
            part = {t: trees[t] for t in growing[i : i + step]}
            sums = _histograms(rows, model, since, part, level, gradients, loss if level == i == 0 else None, s.bins)
            few = len(part) * 2**level * len(model.edges) * s.bins <= FEW_CELLS
            for r in _splits_here(sums, s, len(model.edges)) if few else _best_splits(sums, s).collect():  # a row for each node
                if r.tree < 0:
                    lost = r.g / r.h if r.h else None
                    continue
                tree, at = trees[r.tree], 2**level - 1 + r.node
                if level == 0:
                    tree.value[at] = value(r.g, r.h)
                if r.split:
                    tree.feature[at], tree.cut[at] = r.split.feature, r.split.bin
                    tree.value[2 * at + 1], tree.value[2 * at + 2] = value(r.split.gl, r.split.hl), value(r.g - r.split.gl, r.h - r.split.hl)
                    open_.add(r.tree)
        if not open_:
            break
    return [trees[t] for t in range(model.k)], lost


def fit_classifier(df: DataFrame, classes: int, flat: str = "flat", label: str = "label_index", weight: str | None = "weight", settings: Settings | None = None) -> Model:
    """Boosted softmax trees on rows of split train, one tree for each class and round, stopped by the weighted log loss of split valid.

    label: 0 .. classes - 1.  The rounds up to the least loss are kept; without valid rows, all.
    """
    s = settings or Settings()
    model, rows = _prepared(df.filter((F.col(label) >= 0) & (F.col(label) < classes)), flat, label, weight, None, classes, s.bins)

    def chances(now: np.ndarray) -> np.ndarray:
        e = np.exp(now - now.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def gradients(batch: pa.RecordBatch, now: np.ndarray):
        p, w = chances(now), batch.column("weight").to_numpy()
        train = ~batch.column("valid").to_numpy(zero_copy_only=False).astype(bool)
        w = np.where(train, w, 0.0)[:, None]
        h = w * np.maximum(2 * p * (1 - p), 1e-6)
        p[np.arange(len(p)), batch.column("target").to_numpy().astype(int)] -= 1
        return w * p, h, train.astype(np.int64)

    def loss(batch: pa.RecordBatch, now: np.ndarray):
        w = batch.column("weight").to_numpy()
        p = chances(now)[np.arange(len(now)), batch.column("target").to_numpy().astype(int)]
        return -w * np.log(np.maximum(p, 1e-12)), w

    since: list[Round] = []
    best = (np.inf, 0)
    for r in range(s.rounds + 1):
        one_more = s if r < s.rounds else replace(s, depth=1)  # the last pass only tells the loss
        trees, lost = _grown(rows, model, since, one_more, gradients, loss)
        model.history.append(lost)
        if lost is not None and lost < best[0]:
            best = (lost, r)
        stop = lost is not None and r - best[1] >= s.patience
        if r == s.rounds or stop or all(t.feature[0] < 0 for t in trees):
            break
        model.rounds.append(trees)
        since.append(trees)
        if len(since) == s.rewrite:
            rows, old, since = settle(_advanced(rows, model, since), "boosting"), rows, []
            discard(old)
    if best[0] < np.inf:
        model.rounds = model.rounds[: max(1, best[1])]
    discard(rows)
    return model


def _gain(grade):
    return F.pow(F.lit(2.0), grade) - 1


def _tops(rows: DataFrame, score: str, top: int) -> DataFrame:
    """Of each group its first rows by score, with place from 1."""
    order = Window.partitionBy("group").orderBy(F.desc(score), "id")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def ndcg(rows: DataFrame, score: str = "prediction", grade: str = "grade", group: str = "end_date", top: int = 32, tie: str = "Ticker") -> DataFrame:
    """One row: the mean over groups of NDCG at `top` (gains 2**grade - 1), and how many groups had a grade above 0."""
    named = rows.select(F.col(group).alias("group"), F.col(tie).alias("id"), F.col(score).alias("score"), F.col(grade).cast("double").alias("target")).filter("group is not null and score is not null")
    return _ndcg(_tops(named, "score", top), _ideal(named, top))


def _ideal(rows: DataFrame, top: int) -> DataFrame:
    return _tops(rows, "target", top).groupBy("group").agg(F.sum(_gain(F.col("target")) / F.log2(F.col("place") + 1)).alias("ideal")).filter("ideal > 0")


def _ndcg(tops: DataFrame, ideal: DataFrame) -> DataFrame:
    got = tops.groupBy("group").agg(F.sum(_gain(F.col("target")) / F.log2(F.col("place") + 1)).alias("dcg"))
    return got.join(ideal, "group").agg(F.avg(F.col("dcg") / F.col("ideal")).alias("ndcg"), F.count("*").alias("groups"))


def fit_ranker(df: DataFrame, flat: str = "flat", grade: str = "grade", group: str = "end_date", objective: str = "ndcg", settings: Settings | None = None) -> Model:
    """Boosted trees that order the rows of a group, by pairs of rows of different grade; stopped by the NDCG of split valid.

    A pair has a row among the group's first `top` by margin and a row behind
    it.  With objective "ndcg" it weighs what swapping the two would change in
    NDCG at `top`, with "pairwise" all weigh the same.  grade: 0 or more.
    """
    if objective not in ("ndcg", "pairwise"):
        raise ValueError(f"unknown objective: {objective}")
    s = settings or Settings(**OF_PAIRS)
    model, rows = _prepared(df, flat, grade, None, group, 1, s.bins)
    ideal = settle(_ideal(rows, s.top), "ideal") if objective == "ndcg" else None
    since: list[Round] = []
    best = (-np.inf, 0)
    plain = lambda batch, now: (batch.column("g").to_numpy()[:, None], batch.column("h").to_numpy()[:, None], batch.column("n").to_numpy())
    for r in range(s.rounds + 1):
        scored = _advanced(rows, model, since).withColumn("score", F.col("margin")[0])
        tops = settle(_tops(scored.select("id", "valid", "group", "target", "score", "bins"), "score", s.top), "tops")
        seen = _ndcg(tops.filter("valid"), ideal if ideal is not None else _ideal(rows.filter("valid"), s.top)).first()
        model.history.append(seen.ndcg)
        if seen.ndcg is not None and seen.ndcg > best[0]:
            best = (seen.ndcg, r)
        if r == s.rounds or seen.ndcg is not None and r - best[1] >= s.patience:
            discard(tops)
            break
        pairs = settle(_lambdas(scored.filter("not valid"), tops.filter("not valid"), ideal, s.top), "lambdas")
        zero = F.array(F.lit(0.0))
        own = pairs.filter("n = 1").select("bins", zero.alias("margin"), "g", "h", "n")
        sides = pairs.filter("n = 0").groupBy("id").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.first("n").alias("n"))
        graded = settle(own.union(sides.join(tops.select("id", "bins"), "id").select("bins", zero.alias("margin"), "g", "h", "n")), "graded")
        trees, _ = _grown(graded, model, [], s, plain)
        discard(tops, pairs, graded)
        if trees[0].feature[0] < 0:
            break
        model.rounds.append(trees)
        since.append(trees)
        if len(since) == s.rewrite:
            rows, old, since = settle(_advanced(rows, model, since), "boosting"), rows, []
            discard(old)
    if best[0] > -np.inf:
        model.rounds = model.rounds[: max(1, best[1])]
    discard(rows, ideal)
    return model


def _lambdas(rows: DataFrame, tops: DataFrame, ideal: DataFrame | None, top: int) -> DataFrame:
    """(id, bins, g, h, n): with n = 1 each row's gradients from pairs with rows at the top before it; with n = 0 what such pairs give the row at the top (id), by task."""
    arrays = tops.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score", "target"))).alias("t"))  # `top` rows at most
    if ideal is not None:
        arrays = arrays.join(ideal, "group", "left")
    arrays = arrays.select("group", F.col("t.id").alias("t_id"), F.col("t.score").alias("t_score"), F.col("t.target").alias("t_target"), (F.coalesce(F.col("ideal"), F.lit(0.0)) if ideal is not None else F.lit(0.0)).alias("ideal"))
    joined = rows.join(arrays, "group").select("id", "score", "target", "bins", "t_id", "t_score", "t_target", "ideal")
    by_swap = ideal is not None
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("bins", T.BinaryType()), T.StructField("g", T.DoubleType()), T.StructField("h", T.DoubleType()), T.StructField("n", T.LongType())])

    def padded(column: pa.Array, blank: float) -> np.ndarray:
        lengths = column.value_lengths().to_numpy()
        out = np.full((len(lengths), top), blank)
        out[np.arange(top) < lengths[:, None]] = column.flatten().to_numpy()
        return out

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, score, target, ideal_ = (batch.column(c).to_numpy() for c in ("id", "score", "target", "ideal"))
        t_id, t_score, t_target = (padded(batch.column(c).cast(pa.list_(pa.float64())) if c != "t_id" else batch.column(c), b) for c, b in (("t_id", -1), ("t_score", 0.0), ("t_target", np.nan)))
        mine = t_id == ids[:, None]
        place = np.where(mine.any(1), mine.argmax(1), top)
        pair = (np.arange(top) < place[:, None]) & (t_target != target[:, None]) & ~np.isnan(t_target)
        sign = np.where(t_target > target[:, None], 1.0, -1.0)
        wrong = 1 / (1 + np.exp(np.clip(sign * (t_score - score[:, None]), -50, 50)))
        weight = np.ones_like(wrong)
        if by_swap:
            discount = np.append(1 / np.log2(np.arange(top) + 2), 0.0)
            change = np.abs(2.0**t_target - 2.0 ** target[:, None]) * np.abs(discount[:top] - discount[place][:, None])
            weight = np.divide(change, ideal_[:, None], out=np.zeros_like(change), where=ideal_[:, None] > 0)
        lam, hess = np.where(pair, weight * wrong, 0.0) * sign, np.where(pair, weight * wrong * (1 - wrong), 0.0)
        # Whole steps, so that sums don't hang on their order.
        lam, hess = np.rint(lam * UNIT) / UNIT, np.rint(hess * UNIT) / UNIT
        some = hess > 0
        top_ids, at = np.unique(t_id[some].astype(np.int64), return_inverse=True)
        sides = [-np.bincount(at, lam[some], len(top_ids)), np.bincount(at, hess[some], len(top_ids))]
        none = [None] * len(top_ids)
        return _to_batch({"id": np.concatenate([ids, top_ids]), "bins": batch.column("bins").to_pylist() + none, "g": np.concatenate([lam.sum(1), sides[0]]), "h": np.concatenate([hess.sum(1), sides[1]]), "n": np.concatenate([np.ones(len(ids), np.int64), np.zeros(len(top_ids), np.int64)])}, schema)

    return _mapped(joined, work, schema)


def predict(model: Model, df: DataFrame, flat: str = "flat") -> DataFrame:
    """df with prediction: the class of the greatest margin (of equals the first), or for a ranker the margin; null where features don't fit."""
    width, k = len(model.edges), model.k
    kind = T.IntegerType() if k > 1 else T.DoubleType()
    schema = T.StructType([*df.schema.fields, T.StructField("prediction", kind)])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(flat)
        fits = np.array([x is not None and x == width for x in column.value_lengths().to_pylist()])
        x = _matrix(column.filter(pa.array(fits)), width)
        m = margins(model.binned(x), model.rounds, k)
        out = np.full(len(fits), None, object)
        out[fits] = m.argmax(1).tolist() if k > 1 else m[:, 0].tolist()
        return _to_batch({c: batch.column(c) for c in batch.schema.names} | {"prediction": out.tolist()}, schema)

    return _mapped(df, work, schema)
