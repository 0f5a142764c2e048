"""Peaks of a series and their match with known ones, as long tables: rows (keys, idx), not arrays.

Candidates come from windows, pairs from a join on cells of the tolerance's width, so a place meets only the known places
of its own and the two next cells. What depends on the choice before (which of two near peaks stays, which known place is
still free) is a fold over the sorted candidates or pairs of a series: a task reads them as one stream of Arrow batches and
holds one peak, or the places taken within the tolerance, whatever the number of peaks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.series import KEYS

ROWS = 8192


def _folded(rows: DataFrame, by: list[str], order: list[str], make, out: dict[str, str]) -> DataFrame:
    """Rows (by, out) that the fold ``make()`` gives: ``push`` takes the columns ``order`` of a row and returns a list of
    tuples, ``rest`` ends a series. Rows are dealt out by ``by`` and sorted by ``order`` within it."""
    own = rows.select(*by, *order).repartition(*by).sortWithinPartitions(*by, *order)
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    schema = ", ".join(f"`{c}` {t}" for c, t in {**{c: kinds[c] for c in by}, **out}.items())
    width = len(by)

    def run(batches):
        types, now, fold, done = None, None, None, []

        def let_out():
            made = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(made, [*by, *out])

        for batch in batches:
            types = types or [batch.schema.field(c).type for c in by] + [{"bigint": pa.int64(), "double": pa.float64()}[t] for t in out.values()]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:width] != now:
                    if fold:
                        done.extend((*now, *r) for r in fold.rest())
                    now, fold = row[:width], make()
                done.extend((*now, *r) for r in fold.push(*row[width:]))
                if len(done) >= ROWS:
                    yield let_out()
        if fold:
            done.extend((*now, *r) for r in fold.rest())
        if done:
            yield let_out()

    return own.mapInArrow(run, schema)


class Tallest:
    """Of peaks nearer than ``apart`` to the last one kept the taller stays, else the earlier."""

    def __init__(self, apart: int):
        self.apart, self.last = apart, None

    def push(self, place, value):
        if self.last is None or place - self.last[0] >= self.apart:
            left, self.last = self.rest(), (place, value)
            return left
        if value > self.last[1]:
            self.last = (place, value)
        return []

    def rest(self):
        return [self.last] if self.last else []


class Taken:
    """Each found place in turn takes the nearest known place that is free, or the earliest; ties go to the earlier."""

    def __init__(self, within: int, nearest: bool):
        self.within, self.nearest, self.taken, self.at, self.best = within, nearest, set(), None, None

    def push(self, d, t):
        left = []
        if d != self.at:
            left = self.rest()
            self.taken, self.at, self.best = {u for u in self.taken if u >= d - self.within}, d, None
        far = abs(t - d) if self.nearest else 0
        if t not in self.taken and (self.best is None or far < self.best[0]):
            self.best = (far, t)
        return left

    def rest(self):
        if self.best is None:
            return []
        self.taken.add(self.best[1])
        return [(self.best[1], self.at)]


def peak_places(series: DataFrame, by: list[str] = KEYS, value: str = "value", reach: int = 2, share: float = 0.5, apart: int = 100, of_top: bool = False) -> DataFrame:
    """(by, idx, height): places above min + share * (max - min), or share * max (``of_top``), and not below their ``reach``
    neighbours on either side; of places nearer than ``apart`` the taller, else the earlier, stays. A sample whose value is
    null is no peak."""
    own = Window.partitionBy(*by)
    order = own.orderBy("idx")
    v = F.col(value)
    level = share * F.max(v).over(own) if of_top else F.min(v).over(own) + share * (F.max(v).over(own) - F.min(v).over(own))
    inner = F.lag(v, reach).over(order).isNotNull() & F.lead(v, reach).over(order).isNotNull()
    top = inner & (v > level) & (v >= F.max(v).over(order.rowsBetween(-reach, reach)))
    found = series.withColumn("top__", top).filter("top__").select(*by, F.col("idx").cast("long").alias("idx"), v.cast("double").alias("height"))
    return _folded(found, by, ["idx", "height"], lambda: Tallest(apart), {"idx": "bigint", "height": "double"})


def matched_places(truth: DataFrame, found: DataFrame, keys: list[str] = KEYS, more: list[str] = (), within: int = 15, nearest: bool = True) -> DataFrame:
    """(keys, more, t, d): the known place t that each found place d takes, ``within`` samples at most, in the order of d.
    ``found`` may have more key columns (a method), each with all of the known places to itself. A place that is repeated
    counts once; rows with a null place or key have no match."""
    wide, by = max(within, 1), [*keys, *more]
    cell = lambda c: F.floor(F.col(c) / wide)
    known = truth.select(*keys, F.col("idx").cast("long").alias("t")).distinct().withColumn("cell", cell("t"))
    own = found.select(*by, F.col("idx").cast("long").alias("d")).distinct().withColumn("cell", F.explode(F.sequence(cell("d") - 1, cell("d") + 1)))
    near = own.join(known, [*keys, "cell"]).filter(F.abs(F.col("t") - F.col("d")) <= within)
    return _folded(near, by, ["d", "t"], lambda: Taken(within, nearest), {"t": "bigint", "d": "bigint"})


def match_scores(truth: DataFrame, found: DataFrame, each: DataFrame, keys: list[str] = KEYS, more: list[str] = (), within: int = 15, nearest: bool = True) -> DataFrame:
    """(keys, more, true_positives, false_positives, false_negatives, precision, recall, f1, mean_shift), one row for each
    row of ``each`` (keys, more), also where nothing is found. Scores are null where no place is known."""
    by = [*keys, *more]
    one = F.lit(1).cast("long")
    pairs = matched_places(truth, found, keys, more, within, nearest)
    rows = (
        each.select(*by).distinct().select(*by, F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("seen"), F.lit(0.0).alias("shift"))
        .unionByName(found.select(*by, "idx").filter("idx is not null").distinct().select(*by, F.lit(0).cast("long").alias("hit"), one.alias("seen"), F.lit(0.0).alias("shift")))
        .unionByName(pairs.select(*by, one.alias("hit"), F.lit(0).cast("long").alias("seen"), F.abs(F.col("t") - F.col("d")).cast("double").alias("shift")))
    )
    sums = rows.groupBy(*by).agg(F.sum("hit").alias("hits"), F.sum("seen").alias("seen"), F.sum("shift").alias("shift"))
    known = truth.select(*keys, "idx").filter("idx is not null").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("known"))
    hits, seen = F.col("hits"), F.col("seen")
    d = sums.join(known, keys, "left").withColumn("known", F.coalesce("known", F.lit(0)))
    scored = lambda x: F.when(F.col("known") > 0, x)
    return d.select(
        *by, hits.alias("true_positives"), (seen - hits).alias("false_positives"), (F.col("known") - hits).alias("false_negatives"), scored(F.when(seen > 0, hits / seen).otherwise(0.0)).alias("precision"),
        scored(hits / F.col("known")).alias("recall"), scored(2 * hits / (F.col("known") + seen)).alias("f1"), F.when(hits > 0, F.col("shift") / hits).alias("mean_shift"),
    )
