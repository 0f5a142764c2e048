"""Comparison of methods over a table of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def describe(results: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean, sample deviation, median and the 95% interval of the mean for each group and for all rows ("ALL")."""
    g = results.filter(F.col(value).isNotNull()).rollup(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.percentile(value, F.lit(0.5)).alias("median"))
    half = 1.96 * F.col("sd") / F.sqrt("n")
    return g.select(F.coalesce(group, F.lit("ALL")).alias(group), "n", "mean", "sd", "median", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def paired(results: DataFrame, keys: list[str], method: str, value: str, one: str, other: str) -> DataFrame:
    """(keys, a, b, diff) where both methods have a value; one shuffle, no self-join."""
    pick = lambda m: F.max(F.when(F.col(method) == m, F.col(value)))
    return results.filter(F.col(method).isin(one, other)).groupBy(*keys).agg(pick(one).alias("a"), pick(other).alias("b")).filter("a is not null and b is not null").withColumn("diff", F.col("a") - F.col("b"))


def paired_summary(pairs: DataFrame, tie: float = 0.01) -> DataFrame:
    """Mean difference, its deviation, d_z with its label, pooled Cohen's d, wins, losses and ties."""
    g = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("diff").alias("mean_diff"), F.stddev_samp("diff").alias("sd_diff"), F.percentile("diff", F.lit(0.5)).alias("median_diff"),
        F.var_samp("a").alias("va"), F.var_samp("b").alias("vb"), F.sum((F.col("diff") > tie).cast("long")).alias("wins"), F.sum((F.col("diff") < -tie).cast("long")).alias("losses"), F.sum((F.abs("diff") <= tie).cast("long")).alias("ties"),
    )
    d = F.when(F.col("sd_diff") > 0, F.col("mean_diff") / F.col("sd_diff"))
    size = F.abs(d)
    label = F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").when(size.isNotNull(), "large")
    return g.select("n", "mean_a", "mean_b", "mean_diff", "sd_diff", "median_diff", d.alias("d_z"), label.alias("effect"), (F.col("mean_diff") / F.sqrt((F.col("va") + F.col("vb")) / 2)).alias("cohen_d"), "wins", "losses", "ties")


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 26.2.17 for z >= 0."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return 1 - F.exp(-z * z / 2) / 2.5066282746310002 * poly


def wilcoxon(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Signed-rank test by group: zeros are dropped, ties share their mean rank, variance corrected for ties, continuity
    0.5; fewer than 5 differences give p = 1. Equal differences are counted before ranks are made, so the ranking sees
    distinct values only."""
    sizes = pairs.filter(F.abs("diff") > 1e-15).groupBy(*keys, F.abs("diff").alias("size")).agg(F.count(F.lit(1)).alias("c"), F.sum((F.col("diff") > 0).cast("long")).alias("up"))
    order = Window.partitionBy(*keys).orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sizes.withColumn("rank", F.sum("c").over(order) - (F.col("c") - 1) / 2.0)
    g = ranked.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("c") - F.col("up"))).alias("w_minus"), F.sum(F.pow("c", F.lit(3.0)) - F.col("c")).alias("t"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("t") / 48
    z = F.when(var > 0, F.greatest(F.lit(0.0), F.abs(F.least("w_plus", "w_minus") - n * (n + 1) / 4) - 0.5) / F.sqrt(var))
    return g.select(*keys, "n", "w_plus", "w_minus", z.alias("z"), F.when((n < 5) | z.isNull(), 1.0).otherwise(F.least(F.lit(1.0), 2 * (1 - normal_cdf(z)))).alias("p"))


def holm(tests: DataFrame, name: str, p: str = "p") -> DataFrame:
    """Step-down corrected p-values; the table of tests is small (one row per comparison)."""
    order = Window.orderBy(p, name)
    m = F.count(F.lit(1)).over(Window.partitionBy())
    raw = tests.withColumn("step", F.col(p) * (m - F.row_number().over(order) + 1))
    return raw.withColumn("p_holm", F.least(F.lit(1.0), F.max("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("step")


def pareto(points: DataFrame, by: list[str], name: str, up: str, down: str) -> DataFrame:
    """Per condition ``by``, the points that no other beats in both (largest ``up``, smallest ``down``): by one ordered
    pass, not a self-join. Equal points stay together."""
    seen = Window.partitionBy(*by).orderBy(F.col(up).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # the smallest "down" among points at least as high, and of those the highest
    best = F.min(F.struct(F.col(down).alias("d"), (-F.col(up)).alias("u"))).over(seen)
    return points.withColumn("front", (best["d"] == F.col(down)) & (best["u"] == -F.col(up))).select(*by, name, up, down, "front")
