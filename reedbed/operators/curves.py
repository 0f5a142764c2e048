"""Costs measured on some series and read off for others, ratios between methods, and which names occur where."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.series import KEYS
from .rebuild import BY

#: Points of a measured curve for each doubling of the gap: with gaps below 2^63 it has at most 64 x 63 points.
STEPS = 64
SAMPLE_BITS = 16


def entropy_costs(marked: DataFrame, sample_bits: int = SAMPLE_BITS) -> DataFrame:
    """Per series and method: kept, entropy (bits a gap, the first counted from -1), entropy_ratio and bits_per_sample, when
    each kept sample costs ``sample_bits`` and the entropy of its gap. Equal gaps are counted before the sum."""
    order = Window.partitionBy(*BY).orderBy("idx")
    gaps = marked.filter("kept").select(*BY, "n", (F.col("idx") - F.coalesce(F.lag("idx").over(order), F.lit(-1))).alias("gap"))
    kinds = gaps.groupBy(*BY, "gap").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    g = kinds.groupBy(*BY).agg(F.sum("c").alias("kept"), F.max("n").alias("n"), F.sum(F.col("c") * F.log2(F.col("c").cast("double"))).alias("h"))
    entropy = F.log2(F.col("kept").cast("double")) - F.col("h") / F.col("kept")
    bits = F.col("kept") * (sample_bits + entropy)
    return g.select(*BY, "kept", entropy.alias("entropy"), (sample_bits * F.col("n") / bits).alias("entropy_ratio"), (bits / F.col("n")).alias("bits_per_sample"))


def measured_curve(costs: DataFrame, x: str, y: str, steps: int = STEPS) -> DataFrame:
    """(x, y, n) in order of x: means of the measured points in each of ``steps`` parts of a doubling of ``x``. Rows whose x is null
    or not above 0, or whose y is null, are left out."""
    part = F.round(F.log2(F.col(x).cast("double")) * steps)
    return costs.filter((F.col(x) > 0) & F.col(y).isNotNull()).groupBy(part.alias("part")).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.count(F.lit(1)).alias("n")).select("x", "y", "n")


def read_off(rows: DataFrame, curve: DataFrame, at: str, name: str, steps: int = STEPS) -> DataFrame:
    """``rows`` with ``name``: the piecewise linear curve at column ``at``, level beyond its ends, null for an empty curve or a
    null place. The curve is one row of at most 63 x ``steps`` points, whatever the number of measurements."""
    points = curve.agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("curve__"))
    both = rows.join(F.broadcast(points))
    below, above = F.filter("curve__", lambda p: p["x"] <= F.col(at)), F.filter("curve__", lambda p: p["x"] > F.col(at))
    a, b = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    inside = a["y"] + (F.col(at) - a["x"]) / (b["x"] - a["x"]) * (b["y"] - a["y"])
    return both.withColumn(name, F.when(F.col(at).isNotNull(), F.coalesce(inside, a["y"], b["y"]))).drop("curve__")


def class_ratios(gaps: DataFrame, base: str) -> DataFrame:
    """Of (method, class, n, mean_gap): each method's mean gap over that of ``base`` in the same class, and over its own in
    windows of a single extremum; null where there is none."""
    held = gaps.filter(F.col("method") == base).select("class", F.col("mean_gap").alias("base_gap"))
    single = F.max(F.when(F.col("class") == "single", F.col("mean_gap"))).over(Window.partitionBy("method"))
    d = gaps.withColumn("single_gap", single).join(held, "class", "left")
    return d.select("method", "class", "n", (F.col("mean_gap") / F.col("base_gap")).alias("to_base"), (F.col("mean_gap") / F.col("single_gap")).alias("to_single"))


def name_sets(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """(name, tables, n): in which of ``tables`` each name occurs, in order, and in how many rows. Names are few."""
    every = None
    for table, df in tables.items():
        one = df.groupBy(F.col(name)).agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit(table))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(name).agg(F.array_join(F.sort_array(F.collect_set("table")), ",").alias("tables"), F.sum("n").alias("n"))


def phases(series: DataFrame, size: int = 512, least: float = 1e-9) -> DataFrame:
    """(keys, block, n, k, freq, mag, phase): magnitude and angle of the first n / 2 bins of each block of ``size`` samples, n
    being its own number (as in ``spectrum_of_blocks``). A bin of magnitude below ``least`` has no phase (null)."""
    own = series.select(*KEYS, F.floor(F.col("idx") / size).alias("block"), (F.col("idx") % size).alias("at"), "value").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*KEYS, "block"))).filter("n > 1")
    bins = own.select("*", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 2).cast("int") - 1)).alias("k"))
    angle = F.lit(2 * math.pi) / F.col("n") * ((F.col("k") * F.col("at")) % F.col("n"))
    g = bins.groupBy(*KEYS, "block", "n", "k").agg(F.sum(F.col("value") * F.cos(angle)).alias("re"), (0 - F.sum(F.col("value") * F.sin(angle))).alias("im"))
    mag = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return g.select(*KEYS, "block", "n", "k", (F.col("k") / F.col("n")).alias("freq"), mag.alias("mag"), F.when(mag >= least, F.atan2("im", "re")).alias("phase"))
