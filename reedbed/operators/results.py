"""Tables over results: breakdowns, bands, trials, two-level means, audits, and what follows from a Pareto front."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .compare import normal_cdf, pareto

#: Rows of a part that a task sorts.
ROWS_PER_PART = 250_000


def breakdown(results: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean and sample deviation for each pair of ``keys`` and for each key alone; null stands for all."""
    sets = [[F.col(k) for k in keys], *[[F.col(k)] for k in keys]]
    return results.groupingSets(sets, *map(F.col, keys)).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def pivoted(results: DataFrame, rows: str, columns: str, names: list[str], value: str) -> DataFrame:
    """Mean and median of ``value``, one row for each ``rows`` and two columns for each name."""
    own = [c for name in names for c in (F.avg(F.when(F.col(columns) == name, F.col(value))).alias(f"{name}_mean"), F.percentile(F.when(F.col(columns) == name, F.col(value)), F.lit(0.5)).alias(f"{name}_median"))]
    return results.groupBy(rows).agg(*own)


def band(x: Column, edges: list[float]) -> Column:
    """Number of the right-closed band (edges[i], edges[i + 1]] of ``x``; null outside."""
    found = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        found = F.when((x > edges[i]) & (x <= edges[i + 1]), i).otherwise(found)
    return found


def band_curve(results: DataFrame, group: str, x: str, value: str, edges: list[float]) -> DataFrame:
    """Per group and band of ``x``: the band's geometric middle, n, mean and median of ``value``."""
    mids = F.array(*[F.lit((a * b) ** 0.5) for a, b in zip(edges, edges[1:], strict=False)])
    g = results.withColumn("band", band(F.col(x), edges)).filter(F.col("band").isNotNull() & F.col(value).isNotNull())
    g = g.groupBy(group, "band").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"))
    return g.withColumn("middle", F.get(mids, F.col("band")))


def best_in_band(curve: DataFrame, group: str, least: int = 10) -> DataFrame:
    """Per band the group of greatest mean among those with at least ``least`` rows; ties go to the smaller name."""
    first = F.min(F.struct((-F.round("mean", 9)).alias("m"), F.col(group).alias("g")))
    return curve.filter(F.col("n") >= least).groupBy("band").agg(first.alias("b")).select("band", F.col("b.g").alias(group), (-F.col("b.m")).alias("mean"))


def one_sample(values: DataFrame, value: str) -> DataFrame:
    """n, mean, sample deviation, t against 0, its two-sided p by the normal curve (for many rows), 95 % interval, share above 0."""
    g = values.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.avg((F.col(value) > 0).cast("double")).alias("win_share"))
    se = F.col("sd") / F.sqrt(F.col("n").cast("double"))
    t = F.when(se > 0, F.col("mean") / se)
    return g.select("n", "mean", "sd", "win_share", t.alias("t"), (2 * (1 - normal_cdf(F.abs(t)))).alias("p"), (F.col("mean") - 1.96 * se).alias("low"), (F.col("mean") + 1.96 * se).alias("high"), F.when(F.col("sd") > 0, F.col("mean") / F.col("sd")).alias("d_z"))


def two_level(pairs: DataFrame, signal: str) -> DataFrame:
    """``one_sample`` over the mean difference of each signal, so that a signal counts once however many rows it has."""
    return one_sample(pairs.groupBy(signal).agg(F.avg("diff").alias("diff")), "diff")


def distinct_trials(results: DataFrame, config: list[str], trial: str, value: str) -> DataFrame:
    """One row where all trials of a configuration agree, all its rows where they do not. Nulls agree with nulls only. The number of
    parts follows from the rows, about ``ROWS_PER_PART`` in each, so that what a task sorts does not grow with the table."""
    parts = max(int(results.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + results.count() // ROWS_PER_PART)
    own = Window.partitionBy(*config)
    same = (F.min(value).over(own).eqNullSafe(F.max(value).over(own))) & ((F.count(value).over(own) == 0) | (F.count(value).over(own) == F.count(F.lit(1)).over(own)))
    dealt = results.repartition(parts, *config)
    return dealt.withColumn("same__", same).withColumn("row__", F.row_number().over(own.orderBy(trial))).filter("not same__ or row__ = 1").drop("same__", "row__")


def per_signal(results: DataFrame, keys: list[str], value: str) -> DataFrame:
    g = results.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"))
    return g.withColumn("range", F.col("most") - F.col("least"))


def audit(results: DataFrame, group: str, value: str, exact: str) -> DataFrame:
    """Per group, how often ``value`` is 0, below 0, null and not a number, and how many rows are exact."""
    v, count = F.col(value), lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0))).alias
    return results.groupBy(group).agg(F.count(F.lit(1)).alias("n"), count(v == 0)("zero"), count(v < 0)("negative"), count(v.isNull())("missing"), count(F.isnan(v))("not_a_number"), count(F.col(exact))("exact"))


def ranked_value(rows: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """The value at place int(share * (n - 1)) of each group's sorted values. Equal values are counted first, so a group
    is as large as its number of distinct values."""
    kinds = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    own = Window.partitionBy(*by)
    upto = F.sum("c").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = kinds.withColumn("upto", upto).withColumn("place", F.floor(share * (F.sum("c").over(own) - 1)))
    return placed.filter((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("c"))).select(*by, value)


def ideal_distance(points: DataFrame, by: list[str], up: str, down: str) -> DataFrame:
    """Distance to the best of each axis after both are scaled to 0..1 per condition; an axis without spread gives 0."""
    own = Window.partitionBy(*by)

    def short(c: str, best, worst) -> Column:
        width = F.max(c).over(own) - F.min(c).over(own)
        return F.when(width > 0, (best(c).over(own) - F.col(c)) / width).otherwise(0.0)

    a, b = short(up, F.max, F.min), short(down, F.min, F.max)
    return points.withColumn("distance", F.sqrt(a * a + b * b))


def substitution(points: DataFrame, by: list[str], name: str, up: str, down: str) -> DataFrame:
    """Along each front, from one distinct point to the next higher one: the change of ``down`` per unit of ``up``."""
    front = pareto(points, by, name, up, down).filter("front").select(*by, up, down).distinct()
    order = Window.partitionBy(*by).orderBy(up)
    rate = (F.lead(down).over(order) - F.col(down)) / (F.lead(up).over(order) - F.col(up))
    return front.withColumn("rate", rate).filter("rate is not null")


def front_share(points: DataFrame, by: list[str], name: str, up: str, down: str) -> DataFrame:
    """How often each name is on the front of its condition."""
    g = pareto(points, by, name, up, down).groupBy(name).agg(F.count(F.lit(1)).alias("conditions"), F.sum(F.col("front").cast("long")).alias("on_front"))
    return g.withColumn("share", F.col("on_front") / F.col("conditions"))
