"""Nearest centroids over labelled vectors, and the spectrum of a series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..sources.series import KEYS


def centroids(vectors: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, label, dim, mean, total, n): one row for each class and dimension."""
    each = vectors.select(*by, "label", F.posexplode("embedding").alias("dim", "x"))
    return each.groupBy(*by, "label", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.sum(F.col("x").cast("double")).alias("total"), F.count(F.lit(1)).alias("n"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def leave_one_out(vectors: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, vec_id, label, predicted): nearest centroid by cosine, each vector left out of its own class's mean by
    arithmetic on sums; with ``by`` (a method) among the vectors of its own value. The table of class sums has one row for each
    of those; its size is values x classes x dimensions, not rows."""
    sums = centroids(vectors, by).groupBy(*by, "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "total"))), lambda s: s["total"]).alias("sum"), F.max("n").alias("n"))
    classes = sums.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("label").alias("c"), "sum", "n"))).alias("classes"))
    own = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(*by, "vec_id", "label", own.alias("x")).join(F.broadcast(classes), list(by) or None)

    def similarity(c: Column) -> Column:
        same = F.col("label") == c["c"]
        mean = F.zip_with(c["sum"], F.col("x"), lambda s, x: F.when(same, (s - x) / F.greatest(c["n"] - 1, F.lit(1))).otherwise(s / c["n"]))
        return F.struct((-F.round(cosine(F.col("x"), mean), 12)).alias("d"), c["c"].alias("c"))

    return rows.select(*by, "vec_id", "label", F.array_min(F.transform("classes", similarity))["c"].alias("predicted"))


def spectrum(series: DataFrame, size: int = 64) -> DataFrame:
    """(keys, k, mag): magnitudes of the first size / 2 bins of the first ``size`` samples of each series that has so
    many. Samples meet only the bins of a literal array, and sums combine before the shuffle."""
    first = series.filter(F.col("idx") < size)
    bins = first.select(*KEYS, "idx", "value", F.explode(F.sequence(F.lit(0), F.lit(size // 2 - 1))).alias("k"))
    angle = F.lit(2 * math.pi / size) * ((F.col("k") * F.col("idx")) % size)
    g = bins.groupBy(*KEYS, "k").agg(F.sum(F.col("value") * F.cos(angle)).alias("re"), F.sum(F.col("value") * F.sin(angle)).alias("im"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == size)
    return g.select(*KEYS, "k", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("mag"))


def spectrum_of_blocks(series: DataFrame, size: int = 512, last: bool = False) -> DataFrame:
    """(keys, block, n, k, mag): magnitudes of the first n / 2 bins of each block of ``size`` samples, n being its own
    number of samples: the last block of a series is shorter. Block 0 alone is the form of min(N, size) samples, which the
    reference takes. A block is transformed as one array of at most ``size`` samples. With ``last`` also bin n / 2."""
    blocks = series.select(*KEYS, F.floor(F.col("idx") / size).alias("block"), (F.col("idx") % size).alias("at"), "value")
    own = blocks.groupBy(*KEYS, "block").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("known"), F.collect_list(F.struct("at", F.coalesce("value", F.lit(0.0)).alias("v"))).alias("own")).filter("n > 1")
    mags = own.select(*KEYS, "block", "n", "known", F.posexplode(_magnitudes(F.col("own.at"), F.col("own.v"), F.lit(last))).alias("k", "mag"))
    return mags.select(*KEYS, "block", "n", "k", F.when(F.col("known") > 0, F.col("mag")).alias("mag"))


@F.pandas_udf(ArrayType(DoubleType()))
def _magnitudes(at: pd.Series, value: pd.Series, last: pd.Series) -> pd.Series:
    """Of each block of n samples, placed by ``at`` modulo n, the first n / 2 magnitudes (with ``last`` one more); blocks of one length side by side."""
    sizes = at.str.len().to_numpy()
    out = np.empty(len(at), dtype=object)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        x = np.zeros((len(rows), n))
        np.add.at(x, (np.arange(len(rows))[:, None], np.stack(at.iloc[rows].to_numpy()) % n), np.stack(value.iloc[rows].to_numpy()))
        found = np.abs(np.fft.rfft(x, axis=1))
        for row, mags in zip(rows, found, strict=True):
            out[row] = mags if last.iloc[row] else mags[: n // 2]
    return pd.Series(out)


def features(series: DataFrame, width: int) -> DataFrame:
    """Per window of ``width`` samples (a shorter rest is dropped): mean, deviation, rms, kurtosis, crest."""
    v = F.col("value")
    g = series.groupBy(*KEYS, F.floor(F.col("idx") / width).alias("window")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.sqrt(F.avg(v * v)).alias("rms"), F.max(F.abs(v)).alias("top"), F.avg(v * v * v * v).alias("m4"), F.avg(v * v * v).alias("m3"), F.avg(v * v).alias("m2"),
    ).filter(F.col("n") == width)
    mu = F.col("mean")
    central4 = F.col("m4") - 4 * mu * F.col("m3") + 6 * mu * mu * F.col("m2") - 3 * mu * mu * mu * mu
    return g.select(*KEYS, "window", "mean", "sd", "rms", F.when(F.col("sd") > 1e-9, central4 / F.pow("sd", F.lit(4.0))).alias("kurtosis"), F.when(F.col("rms") > 0, F.col("top") / F.col("rms")).alias("crest"), (F.col("top")).alias("peak"))


def activity_features(series: DataFrame, width: int, rate: float, edges=((0, 5), (5, 10), (10, 20))) -> DataFrame:
    """Per full window of ``width`` samples: mean, sd, low, high, median, area (mean magnitude), crossings (changes of
    sign about the mean, per sample), rms, iqr, dominant (Hz, not bin 0), energies by band (Hz) and spectral entropy."""
    own = [*KEYS, "window"]
    rows = series.select(*KEYS, F.floor(F.col("idx") / width).alias("window"), "idx", "value")
    block = Window.partitionBy(*own)
    side = F.signum(F.round(F.col("value") - F.avg("value").over(block), 9))
    v = F.col("value")
    times = rows.withColumn("side", side).withColumn("turn", (F.col("side") != F.lag("side").over(block.orderBy("idx"))).cast("long")).groupBy(*own).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"), F.percentile(v, 0.5).alias("median"), F.avg(F.abs(v)).alias("area"),
        (F.sum("turn") / width).alias("crossings"), F.sqrt(F.avg(v * v)).alias("rms"), (F.percentile(v, 0.75) - F.percentile(v, 0.25)).alias("iqr"),
    ).filter(F.col("n") == width).drop("n")
    bins = spectrum_of_blocks(series, width, last=True).filter(F.col("n") == width).withColumnRenamed("block", "window").withColumn("e", F.col("mag") * F.col("mag"))
    share = F.col("e") / (F.sum("e").over(block) + 1e-10)
    freq = F.col("k") * (rate / width)
    waves = bins.withColumn("p", share).groupBy(*own).agg(
        (-F.max(F.when(F.col("k") > 0, F.struct(F.round("mag", 9).alias("m"), (-freq).alias("f"))))["f"]).alias("dominant"),
        *(F.sum(F.when((freq >= a) & (freq < b), F.col("e")).otherwise(0.0)).alias(f"energy_{a}_{b}") for a, b in edges), (-F.sum(F.col("p") * F.ln(F.col("p") + 1e-10))).alias("entropy"),
    )
    return times.join(waves, own)


def bin_features(series: DataFrame, width: int, bins: int = 32) -> DataFrame:
    """Per full window of ``width`` samples: its first ``bins`` magnitudes (in order, as many as there are below half the
    width) with rms, kurtosis, crest and sd."""
    mags = spectrum_of_blocks(series, width).filter((F.col("n") == width) & (F.col("k") < bins)).groupBy(*KEYS, F.col("block").alias("window")).agg(F.sort_array(F.collect_list(F.struct("k", "mag"))).alias("b"))
    stats = features(series, width).select(*KEYS, "window", "rms", "kurtosis", "crest", "sd")
    return stats.join(mags, [*KEYS, "window"]).select(*stats.columns, F.transform("b", lambda x: x["mag"]).alias("bins"))


def stratified(vectors: DataFrame, folds: int, salt: int = 64) -> DataFrame:
    """``fold`` for each row: the rows of a class are numbered within ``salt`` parts, so that no task holds a whole class,
    and dealt out in turn; folds of a class differ by at most one row for each part."""
    part = F.pmod(F.col("vec_id"), F.lit(salt))
    place = F.row_number().over(Window.partitionBy("label", part).orderBy("vec_id")) - 1 + part
    return vectors.withColumn("fold", (place % folds).cast("int"))


def cross_validated(vectors: DataFrame, folds: int) -> DataFrame:
    """(fold, n, accuracy): each fold is classified by the centroids of the others, by arithmetic on class sums; a class
    that lies in one fold alone is no candidate there. The sums have classes x folds x dimensions rows."""
    rows = stratified(vectors.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x")), folds)
    sums = rows.select("label", "fold", F.posexplode("x").alias("dim", "v")).groupBy("label", "fold", "dim").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    totals = sums.groupBy("label", "dim").agg(F.sum("s").alias("all"), F.sum("n").alias("count")).select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    rest = totals.join(sums, ["label", "fold", "dim"], "left").withColumn("left", F.col("count") - F.coalesce("n", F.lit(0))).filter("left > 0")
    means = rest.select("fold", "label", F.struct("dim", ((F.col("all") - F.coalesce("s", F.lit(0.0))) / F.col("left")).alias("m")).alias("d")).groupBy("fold", "label").agg(F.transform(F.sort_array(F.collect_list("d")), lambda d: d["m"]).alias("m"))
    held = means.groupBy("fold").agg(F.collect_list(F.struct(F.col("label").alias("c"), "m")).alias("classes"))
    near = F.array_min(F.transform("classes", lambda c: F.struct((-F.round(cosine(F.col("x"), c["m"]), 12)).alias("d"), c["c"].alias("c"))))["c"]
    return rows.join(held, "fold").withColumn("hit", (near == F.col("label")).cast("double")).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("accuracy"))
