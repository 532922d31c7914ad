"""Line dedup over levelled sorted runs of line keys.

The corpus is taken in batches of ascending doc_id.  Each batch pre-aggregates
its line keys to their first document, anti-joins them with every run that
stands, and adds what is new as a run of its own, ranged and sorted by key.
Whenever `fanout` runs of a level have gathered they are merged into one of
the next level, so few runs stand at any time.  All of it is DataFrame code:
no Python sees a row.

A key is the line without ASCII white space at its ends, A-Z lower-cased.  It
is carried as 128 bits of hash.  Edge cases: a null or empty text is one empty
line; keys under `least` code points are never dropped; rows that share a
doc_id count as one document, of which each row loses those of its own lines
that an earlier document holds; rows without a doc_id neither drop nor are
dropped from; extra columns stay, whatever their names, but for n_lines and
n_dropped, which are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import columns_of, settle, whole_row

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\x0b\x0c\r"
KEY = ["k1", "k2"]


def line_key(line: Column) -> Column:
    """Stripped of ASCII white space, A-Z lower-cased; lower() alone would fold other letters too, so it only serves pure ASCII."""
    bare = F.btrim(line, F.lit(_SPACE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


@dataclass
class LineRuns:
    """The runs that stand, by level: (k1, k2, first_doc) ranged and sorted by key."""

    fanout: int = 4
    levels: list[list[DataFrame]] = field(default_factory=list)

    def add(self, lines: DataFrame) -> None:
        """lines: (doc_id, k1, k2) of a batch whose doc_ids are beyond those of all batches before."""
        new = lines.groupBy(*KEY).agg(F.min("doc_id").alias("first_doc"))
        for run in self.standing():
            new = new.join(run.select(*KEY), KEY, "left_anti")
        self._put(new, 0)

    def _put(self, run: DataFrame, level: int) -> None:
        run = settle(run.sortWithinPartitions(*KEY), f"run{level}")
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            merged, self.levels[level] = self.levels[level], []
            whole = merged[0]
            for other in merged[1:]:
                whole = whole.union(other)
            self._put(whole.repartition(*KEY), level + 1)

    def standing(self) -> list[DataFrame]:
        return [run for level in reversed(self.levels) for run in level]

    def save(self, path: str) -> None:
        """Writes the runs that stand to a new folder, from where a later job takes them up."""
        for level, runs in enumerate(self.levels):
            for i, run in enumerate(runs):
                run.write.parquet(f"{path}/level={level}/run={i}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, fanout: int = 4) -> LineRuns:
        """Runs that save() has written."""
        whole = spark.read.parquet(path)
        places = sorted(tuple(r) for r in whole.select("level", "run").distinct().collect())  # a row for each run
        levels: list[list[DataFrame]] = [[] for _ in range(max((x for x, _ in places), default=-1) + 1)]
        for level, i in places:
            levels[level].append(whole.filter((F.col("level") == level) & (F.col("run") == i)).drop("level", "run"))
        return cls(fanout, levels)

    def keys(self, spark: SparkSession) -> DataFrame:
        out = spark.createDataFrame([], "k1 long, k2 long, first_doc long")
        for run in self.standing():
            out = out.union(run)
        return out


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, at, k1, k2): the keys that count of each line and its place."""
    lines = docs.filter("doc_id is not null").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    lines = lines.filter(F.length("line") >= least).select("doc_id", "at", line_key(F.col("line")).alias("key")).filter(F.length("key") >= least)
    return lines.select("doc_id", "at", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(17), "key").alias("k2"))


def repeated_lines(docs: DataFrame, least: int = 10, batches: int = 4, fanout: int = 3, runs: LineRuns | None = None) -> DataFrame:
    """(doc_id, places): where lines to drop stand in any row of a document, and the first half of their keys.

    runs: those of earlier jobs, whose doc_ids are all less than those of docs; the new ones are added to them.
    """
    lines = settle(_lines(docs, least), "lines")
    cuts = lines.agg(F.expr(f"approx_percentile(doc_id, {'array(' + ', '.join(str(i / batches) for i in range(1, batches)) + ')'}, 1000)").alias("q")).first().q or []
    bounds = sorted(set(cuts))
    runs = LineRuns(fanout) if runs is None else runs
    for low, high in zip([None, *bounds], [*bounds, None]):
        batch = lines if low is None else lines.filter(F.col("doc_id") > low)
        runs.add(batch if high is None else batch.filter(F.col("doc_id") <= high))
    late = lines.join(runs.keys(docs.sparkSession), KEY).filter("doc_id > first_doc")
    return late.groupBy("doc_id").agg(F.collect_set(F.struct("at", "k1")).alias("places"))


def dedup_lines(docs: DataFrame, least: int = 10, batches: int = 4, fanout: int = 3, runs: LineRuns | None = None) -> DataFrame:
    """docs with the text that stays; n_lines and n_dropped come last. A null text stays null. runs: see repeated_lines."""
    places = repeated_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), least, batches, fanout, runs)
    rows = docs.select(whole_row(docs).alias("row")).withColumn("doc_id", F.col("row.doc_id").cast("long"))
    text = F.col("row.text").cast("string")
    joined = rows.join(places.hint("shuffle_hash"), "doc_id", "left").withColumn("lines", F.split(F.coalesce(text, F.lit("")), "\n"))
    # Another row of the document may have other lines at these places.
    own = F.filter("places", lambda p: F.xxhash64(line_key(F.get("lines", p["at"]))) == p["k1"])
    joined = joined.withColumn("gone", F.when(F.col("places").isNotNull(), F.transform(own, lambda p: p["at"])))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.array_join(F.transform(stay, lambda i: F.element_at("lines", i + 1)), "\n")
    new = {"text": F.when(F.size("gone") > 0, kept).otherwise(text), "n_lines": F.size("lines").cast("long"), "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long")}
    joined = joined.select("row", F.struct(*(c.alias(k) for k, c in new.items())).alias("new"))
    columns = dict(zip(docs.columns, columns_of(F.col("row"), docs.columns)))
    for k in ("n_lines", "n_dropped"):
        columns.pop(k, None)  # they come last
    columns |= {k: F.col("new").getField(k).alias(k) for k in new}
    return joined.select(*columns.values())
