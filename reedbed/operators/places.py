"""What happens around the places of a series: frequency, extrema, gaps by class, budgets, victims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.series import KEYS
from .select import count_kept, fifo, keep_last, linspace, stride


def ordered():
    return Window.partitionBy(*KEYS).orderBy("idx")


def changes(values: Column, differ) -> Column:
    """How many neighbours of an array ``differ``."""
    n = F.greatest(F.size(values) - 1, F.lit(0))
    return F.size(F.filter(F.zip_with(F.slice(values, 1, n), F.slice(values, 2, n), differ), lambda x: x))


def frequency_weight(series: DataFrame, half: int = 4, gamma: float = 1.0) -> DataFrame:
    """1 + gamma * (crossings of the local mean / steps). The mean is over ``half`` samples either way, the crossings over
    2 * half + 1 steps from the window's start."""
    around = series.select("*", F.avg("value").over(ordered().rowsBetween(-half, half)).alias("mean"), F.collect_list("value").over(ordered().rowsBetween(-half, 2 * half + 1)).alias("own"))
    cut = around.withColumn("own", F.transform(F.slice("own", 1, 2 * half + 2), lambda x: x - F.col("mean")))
    steps = F.size("own") - 1
    crossed = changes(F.col("own"), lambda a, b: a * b < 0)
    return cut.withColumn("weight", F.when(steps > 0, 1 + gamma * crossed / steps).otherwise(1.0)).drop("mean", "own")


def extremum_count(series: DataFrame, half: int = 5) -> DataFrame:
    """Turns of the series within ``half`` samples either way; more than one is a window of several extrema."""
    step = series.withColumn("step", F.signum(F.col("value") - F.lag("value").over(ordered())))
    signs = F.collect_list(F.when(F.col("step") != 0, F.col("step"))).over(ordered().rowsBetween(-half, half))
    return step.withColumn("signs", signs).withColumn("extrema", changes(F.col("signs"), lambda a, b: a != b)).drop("signs", "step")


def gap_by_class(marked: DataFrame, extrema: DataFrame) -> DataFrame:
    """n, mean and deviation of the gaps before kept samples, by method and class of the sample's window."""
    order = Window.partitionBy(*KEYS, "method").orderBy("idx")
    gaps = marked.filter("kept").select(*KEYS, "method", "idx", (F.col("idx") - F.lag("idx").over(order)).alias("gap")).filter("gap is not null")
    both = gaps.join(extrema.select(*KEYS, "idx", F.when(F.col("extrema") > 1, "several").otherwise("single").alias("class")), [*KEYS, "idx"])
    return both.groupBy("method", "class").agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("std_gap"))


def near_position(marked: DataFrame, within: int = 20) -> DataFrame:
    """Kept samples of each series, their share, and how many lie within ``within`` of its middle."""
    near = F.abs(F.col("idx") - F.floor(F.col("n") / 2)) <= within
    g = marked.groupBy(*KEYS, "method").agg(F.sum(F.col("kept").cast("long")).alias("kept"), F.sum((F.col("kept") & near).cast("long")).alias("near"), F.max("n").alias("n"))
    return g.select(*KEYS, "method", "kept", (F.col("kept") / F.col("n")).alias("share"), "near")


def victim(scored: DataFrame, score: str) -> DataFrame:
    """The inner sample of least ``score`` of each series, the first of equal ones; the ends are protected."""
    inner = scored.filter(F.col(score).isNotNull()).groupBy(*KEYS).agg(F.min(F.struct(F.col(score).alias("s"), "idx")).alias("x"))
    return inner.select(*KEYS, "x.idx", F.col("x.s").alias("score"))


def at_budget(series: DataFrame, capacity: int, overload: int) -> DataFrame:
    """Every sample once for each decimation with ``kept``, at the number of samples that a bounded buffer lets through;
    ``expected`` is that number by the law of retained counts."""
    targets = fifo(series, capacity, overload).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("target"))
    n = F.count(F.lit(1)).over(Window.partitionBy(*KEYS))
    s = series.withColumn("n", n).join(targets, KEYS)
    rules = {"stride": stride(F.col("n"), F.col("target")), "linspace": linspace(F.col("n"), F.col("target")), "keep_last": keep_last(F.col("n"), F.col("target"))}
    wide = s.select(*KEYS, "idx", "value", "n", "target", count_kept(F.col("n"), capacity, overload).alias("expected"), *[r.alias(k) for k, r in rules.items()])
    return wide.unpivot([*KEYS, "idx", "value", "n", "target", "expected"], list(rules), "method", "kept")


def gap_tail(marked: DataFrame) -> DataFrame:
    """Gaps at the index percentiles 50, 95 and 99: sorted[int(n * q)]. Gaps are counted before they are ranked."""
    order = Window.partitionBy(*KEYS, "method").orderBy("idx")
    gaps = marked.filter("kept").select(*KEYS, "method", (F.col("idx") - F.lag("idx").over(order)).alias("gap")).filter("gap is not null")
    kinds = gaps.groupBy("method", "gap").agg(F.count(F.lit(1)).alias("c"))
    by_gap = Window.partitionBy("method").orderBy("gap").rowsBetween(Window.unboundedPreceding, 0)
    ranked = kinds.select("method", "gap", F.sum("c").over(by_gap).alias("upto"), F.sum("c").over(Window.partitionBy("method")).alias("n"))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col("gap")))
    return ranked.groupBy("method").agg(F.max("n").alias("gaps"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def code_ratios(marked: DataFrame, sample_bits: int = 16) -> DataFrame:
    """Bits for places by whole index and by 8-bit gaps with a 16-bit escape, and the compression ratios of both."""
    order = Window.partitionBy(*KEYS, "method").orderBy("idx")
    gap = F.col("idx") - F.coalesce(F.lag("idx").over(order), F.lit(-1))
    cost = F.when(F.col("gap") < 255, 8).otherwise(24)
    g = marked.filter("kept").select(*KEYS, "method", "n", gap.alias("gap")).groupBy(*KEYS, "method").agg(F.count(F.lit(1)).alias("kept"), F.max("n").alias("n"), F.sum(cost).alias("gap8_bits"))
    absolute = F.col("kept") * F.ceil(F.log2(F.greatest(F.col("n"), F.lit(2)).cast("double")))
    ratio = lambda bits: sample_bits * F.col("n") / (F.col("kept") * sample_bits + bits)
    return g.select(*KEYS, "method", "kept", absolute.alias("absolute_bits"), "gap8_bits", ratio(absolute).alias("absolute_ratio"), ratio(F.col("gap8_bits")).alias("gap8_ratio"))


def random_drop(series: DataFrame, share: int = 4, seed: str = "7") -> DataFrame:
    """The n div ``share`` samples (two at least) of the smallest hashes of place and seed: random, the same each time."""
    order = Window.partitionBy(*KEYS).orderBy(F.md5(F.concat_ws(":", *KEYS, F.col("idx").cast("string"), F.lit(seed))), "idx")
    n = F.count(F.lit(1)).over(Window.partitionBy(*KEYS))
    return series.select(*KEYS, "idx", "value", F.row_number().over(order).alias("place"), n.alias("n")).filter(F.col("place") <= F.greatest(F.lit(2), F.floor(F.col("n") / share))).drop("place", "n")
