"""What a series is like: profile, quantisation, features of windows, bands of its spectrum, cost of kept places."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.series import KEYS
from .rebuild import BY


def profile(series: DataFrame, first: int = 500) -> DataFrame:
    """Of the first samples: max / rms, share of crossings of the mean, excess kurtosis, and the kind that follows. The mean is
    added up in the order of the samples, whatever the order of rows: where a sample equals it, its last bit decides on the side."""
    own = Window.partitionBy(*KEYS).orderBy("idx")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = series.filter(F.col("idx") < first).withColumn("c", F.col("value") - F.avg("value").over(whole))
    d = d.withColumn("cross", (F.col("c") * F.lag("c").over(own) < 0).cast("double"))
    g = d.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("top"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.sum("cross").alias("cross"),
        F.avg(F.pow("c", F.lit(2.0))).alias("m2"), F.avg(F.pow("c", F.lit(4.0))).alias("m4"),
    )
    ratio, var = F.when(F.col("rms") > 1e-15, F.col("top") / F.col("rms")).otherwise(1.0), F.greatest("m2", F.lit(1e-15))
    g = g.select(*KEYS, ratio.alias("peak_ratio"), (F.coalesce("cross", F.lit(0.0)) / F.col("n")).alias("crossing_rate"), (F.col("m4") / (var * var) - 3).alias("kurtosis"))
    return g.withColumn("kind", F.when((F.col("kurtosis") > 2) | (F.col("peak_ratio") > 3), "impulsive").otherwise("oscillatory"))


def quantised(series: DataFrame, levels: int = 32767) -> DataFrame:
    """Each sample as a whole number of steps of its series' largest magnitude / ``levels``; a silent series gives 0."""
    step = F.max(F.abs("value")).over(Window.partitionBy(*KEYS)) / levels
    q = F.when(F.col("step") > 0, F.least(F.lit(levels), F.greatest(F.lit(-levels - 1), F.rint(F.col("value") / F.col("step"))))).otherwise(0)
    return series.withColumn("step", step).withColumn("q", q.cast("int"))


def quantisation_snr(series: DataFrame) -> DataFrame:
    e = F.col("value") - F.col("q") * F.col("step")
    g = quantised(series).groupBy(*KEYS).agg(F.max("step").alias("step"), F.sum(F.col("value") * F.col("value")).alias("signal"), F.sum(e * e).alias("noise"))
    return g.select(*KEYS, "step", F.when((F.col("signal") > 0) & (F.col("noise") > 0), 10 * F.log10(F.col("signal") / F.col("noise"))).alias("snr_db"))


def time_features(series: DataFrame, width: int) -> DataFrame:
    """Per full window of ``width`` samples: mean, deviation, range, rms, mean step."""
    window = F.floor(F.col("idx") / width)
    order = Window.partitionBy(*KEYS).orderBy("idx")
    step = F.when(F.col("idx") % width > 0, F.abs(F.col("value") - F.lag("value").over(order)))
    v = F.col("value")
    g = series.select(*KEYS, window.alias("window"), "value", step.alias("step")).groupBy(*KEYS, "window").agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), (F.max(v) - F.min(v)).alias("range"), F.sqrt(F.avg(v * v)).alias("rms"), F.avg("step").alias("mean_step"),
    )
    return g.filter(F.col("n") == width).drop("n")


def band_sums(spectrum: DataFrame, width: int) -> DataFrame:
    """Sums of ``width`` neighbouring magnitudes of a spectrum."""
    return spectrum.groupBy(*KEYS, F.floor(F.col("k") / width).alias("band")).agg(F.sum("mag").alias("total"))


def bin_errors(own: DataFrame, other: DataFrame) -> DataFrame:
    """Per bin of two spectra: absolute and relative error (0 where the first is not above 1e-10)."""
    both = own.select(*KEYS, "k", F.col("mag").alias("a")).join(other.select(*KEYS, "k", F.col("mag").alias("b")), [*KEYS, "k"])
    error = F.abs(F.col("a") - F.col("b"))
    return both.select(*KEYS, "k", error.alias("abs_error"), F.when(F.col("a") > 1e-10, error / F.col("a")).otherwise(0.0).alias("rel_error"))


def standardised(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, z): each dimension with mean 0 and deviation 1; a constant dimension gives 0. The table of statistics
    has one row for each dimension."""
    each = vectors.select("vec_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    stats = each.groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = F.when(F.col("s") > 0, (F.col("x") - F.col("m")) / F.col("s")).otherwise(0.0)
    return each.join(F.broadcast(stats), "dim").select("vec_id", "dim", z.alias("z"))


def gap_counts(marked: DataFrame) -> DataFrame:
    """How often each distance between kept samples occurs, by method."""
    order = Window.partitionBy(*BY).orderBy("idx")
    gaps = marked.filter("kept").select("method", (F.col("idx") - F.lag("idx").over(order)).alias("gap")).filter("gap is not null")
    return gaps.groupBy("method", "gap").agg(F.count(F.lit(1)).alias("n"))


def place_costs(marked: DataFrame, bits: int = 16) -> DataFrame:
    """Bits for kept places by a Rice code whose parameter follows from the mean distance (the first one counted from -1),
    bits by the model log2(distance) + 2, and what ``bits``-wide samples then need: ratio and bits per sample."""
    order = Window.partitionBy(*BY).orderBy("idx")
    gaps = marked.filter("kept").select(*BY, "n", (F.col("idx") - F.lag("idx", 1, -1).over(order)).alias("gap"))
    gaps = gaps.withColumn("k", F.greatest(F.lit(0.0), F.rint(F.log2(F.greatest(F.lit(1.0), F.avg("gap").over(Window.partitionBy(*BY)))))).cast("int"))
    g = gaps.groupBy(*BY).agg(F.count(F.lit(1)).alias("kept"), F.max("n").alias("n"), F.max("k").alias("k"), F.sum(F.expr("shiftright(gap, k) + 1 + k")).alias("rice"))
    each, mean = F.col("rice") / F.col("kept"), F.col("n") / F.col("kept")
    model = F.when(mean <= 1, 2.0).otherwise(F.log2(mean) + 2)
    return g.select(*BY, "kept", "k", F.col("rice").alias("rice_bits"), model.alias("model_bits"), (bits * F.col("n") / (F.col("kept") * (bits + each))).alias("ratio"), (F.col("kept") * (bits + each) / F.col("n")).alias("bits_per_sample"))


def gaussian(*parts: Column) -> Column:
    """A standard normal number that follows from ``parts`` alone: two uniform ones from a digest, by Box and Muller. The same on every run
    and in any partitioning."""
    digest = F.md5(F.concat_ws("/", *parts))
    word = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("double")
    return F.sqrt(-2 * F.ln((word(1) + 1) / (2.0**32 + 1))) * F.cos(2 * math.pi * word(9) / 2.0**32)


def noisy(series: DataFrame, width: int, share: float, seed: int = 42) -> DataFrame:
    """The series with Gaussian noise whose deviation is ``share`` of that of the sample's window of ``width`` samples (the last window
    of a segment may be shorter; a window of equal values stays as it is)."""
    sd = F.stddev_pop("value").over(Window.partitionBy(*KEYS, F.floor(F.col("idx") / width)))
    noise = gaussian(F.col("signal_id"), F.col("segment"), F.col("idx"), F.lit(seed))
    return series.select(*KEYS, "idx", (F.col("value") + share * sd * noise).alias("value"))
