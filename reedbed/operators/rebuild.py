"""Linear reconstruction from kept samples, and how far it is from the series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.series import KEYS

BY = [*KEYS, "method"]


def rebuilt(marked: DataFrame) -> DataFrame:
    """Each sample with ``recon``: the chord between the kept samples around it; flat before the first and after the last
    kept sample; 0 if none is kept. No join: kept neighbours come from the same windows."""
    order = Window.partitionBy(*BY).orderBy("idx")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    own = F.when(F.col("kept"), F.struct(F.col("idx").alias("i"), F.col("value").alias("v")))
    d = marked.withColumn("p", F.last(own, ignorenulls=True).over(back)).withColumn("s", F.first(own, ignorenulls=True).over(ahead))
    inside = F.when(F.col("p.i") == F.col("s.i"), F.col("p.v")).otherwise(F.col("p.v") + (F.col("idx") - F.col("p.i")) / (F.col("s.i") - F.col("p.i")) * (F.col("s.v") - F.col("p.v")))
    return d.withColumn("recon", F.coalesce(inside, F.col("p.v"), F.col("s.v"), F.lit(0.0))).drop("p", "s")


def metrics(recon: DataFrame) -> DataFrame:
    """Per series and method: n, retained, mse, snr_db (null if exact, then snr_saturated; 0 for a silent series),
    max_error, deriv_ratio, prd, ratio, degenerate (nothing was dropped)."""
    order = Window.partitionBy(*BY).orderBy("idx")
    d = recon.withColumn("e", F.col("value") - F.col("recon")).withColumn("dv", F.abs(F.col("value") - F.lag("value").over(order))).withColumn("dr", F.abs(F.col("recon") - F.lag("recon").over(order)))
    g = d.groupBy(*BY).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("long")).alias("retained"), F.avg(F.col("e") * F.col("e")).alias("mse"), F.sum(F.col("value") * F.col("value")).alias("signal"),
        F.sum(F.col("e") * F.col("e")).alias("noise"), F.max(F.abs("e")).alias("max_error"), F.avg("dv").alias("dv"), F.avg("dr").alias("dr"),
    )
    snr = F.when(F.col("signal") < 1e-15, 0.0).when(F.col("noise") >= 1e-15, 10 * F.log10(F.col("signal") / F.col("noise")))
    return g.select(
        *BY, "n", "retained", "mse", snr.alias("snr_db"), "max_error", F.when(F.col("dv") > 1e-15, F.col("dr") / F.col("dv")).alias("deriv_ratio"), (100 * F.pow(F.lit(10.0), -snr / 20)).alias("prd"),
        (F.col("n") / F.col("retained")).alias("ratio"), (F.col("n") == F.col("retained")).alias("degenerate"), ((F.col("signal") >= 1e-15) & (F.col("noise") < 1e-15)).alias("snr_saturated"),
    )


def gap_stats(marked: DataFrame) -> DataFrame:
    """Spacing of kept samples: count, mean, deviation, coefficient of variation, extremes, median, p95."""
    order = Window.partitionBy(*BY).orderBy("idx")
    gaps = marked.filter("kept").select(*BY, (F.col("idx") - F.lag("idx").over(order)).alias("gap")).filter("gap is not null")
    g = gaps.groupBy(*BY).agg(F.count(F.lit(1)).alias("gaps"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("std_gap"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), F.percentile("gap", F.lit(0.5)).alias("median_gap"), F.percentile("gap", F.lit(0.95)).alias("p95_gap"))
    return g.withColumn("cv_gap", F.col("std_gap") / F.col("mean_gap"))


def gap_bits(marked: DataFrame) -> DataFrame:
    """Bits for the places of kept samples: best Rice code of (gap - 1), order-0 entropy, absolute places."""
    order = Window.partitionBy(*BY).orderBy("idx")
    gaps = marked.filter("kept").select(*BY, "n", (F.col("idx") - F.lag("idx").over(order)).alias("gap")).filter("gap is not null")
    kinds = gaps.groupBy(*BY, "gap").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    cost = lambda k: F.sum(F.col("c") * (F.shiftright(F.col("gap") - 1, k) + 1 + k))
    g = kinds.groupBy(*BY).agg(F.sum("c").alias("gaps"), F.max("n").alias("n"), F.sum(F.col("c") * F.log2(F.col("c").cast("double"))).alias("h"), F.least(*[F.struct(cost(k).alias("bits"), F.lit(k).alias("k")) for k in range(17)]).alias("rice"))
    return g.select(*BY, "gaps", F.col("rice.bits").alias("rice_bits"), F.col("rice.k").alias("rice_k"), (F.log2(F.col("gaps").cast("double")) - F.col("h") / F.col("gaps")).alias("entropy_bits"), (F.col("gaps") * F.ceil(F.log2(F.col("n").cast("double")))).alias("absolute_bits"))
