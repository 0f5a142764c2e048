"""Which results count, and how they are labelled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sound(results: DataFrame, value: str, least: float | None = None) -> DataFrame:
    """Rows that are neither degenerate nor saturated and have a finite ``value``, of at least ``least`` (a metric that
    does not apply is stored below it)."""
    x = F.col(value)
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    kept = results.filter(~F.col("degenerate") & ~F.col("snr_saturated") & finite)
    return kept if least is None else kept.filter(x >= least)


def qualified(results: DataFrame, keys: list[str], baseline: Column) -> DataFrame:
    """Rows whose signal ``keys`` qualifies: it has a row that meets ``baseline``."""
    return results.join(results.filter(baseline).select(*keys).distinct(), keys, "left_semi")


def paired_spread(pairs: DataFrame) -> DataFrame:
    """Of (a, b, diff): standard error, extremes and 95 % interval of the difference, and Cohen's d pooled by size."""
    n, sd = F.count(F.lit(1)), F.stddev_samp("diff")
    half = 1.96 * sd / F.sqrt(n)
    pooled = F.sqrt(((F.count("a") - 1) * F.var_samp("a") + (F.count("b") - 1) * F.var_samp("b")) / (F.count("a") + F.count("b") - 2))
    d = F.when(pooled > 1e-15, (F.avg("a") - F.avg("b")) / pooled).otherwise(0.0)
    return pairs.agg(n.alias("n"), (sd / F.sqrt(n)).alias("se"), F.min("diff").alias("min_diff"), F.max("diff").alias("max_diff"), (F.avg("diff") - half).alias("low"), (F.avg("diff") + half).alias("high"), d.alias("pooled_d"))


def significance(p: Column) -> Column:
    return F.when(p < 0.001, "p<0.001").when(p < 0.01, "p<0.01").when(p < 0.05, "p<0.05").otherwise("n.s.")


def dominance(points: DataFrame, name: str, up: str, down: str) -> DataFrame:
    """Per ``name``: how many others it beats in both means (largest ``up``, smallest ``down``), and the names that beat
    it. There is one point for each method, so the pairs are few whatever the results' number."""
    mean = points.groupBy(name).agg(F.round(F.avg(up), 6).alias("u"), F.round(F.avg(down), 6).alias("d"))
    a, b = mean.select(F.col(name).alias("a"), F.col("u").alias("au"), F.col("d").alias("ad")), mean.select(F.col(name).alias("b"), F.col("u").alias("bu"), F.col("d").alias("bd"))
    beats = (F.col("bu") >= F.col("au")) & (F.col("bd") <= F.col("ad")) & ((F.col("bu") > F.col("au")) | (F.col("bd") < F.col("ad")))
    pairs = a.join(b, beats)
    over, under = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("beaten")), pairs.groupBy("a").agg(F.sort_array(F.collect_list("b")).alias("names"))
    got = mean.join(over, F.col(name) == F.col("b"), "left").join(under, F.col(name) == F.col("a"), "left")
    return got.select(name, F.coalesce("beaten", F.lit(0)).alias("dominates"), F.coalesce(F.array_join("names", ","), F.lit("")).alias("dominated_by"))


def left_band(x: Column, edges: list[float]) -> Column:
    """Number of the left-closed band [edges[i], edges[i + 1]) of ``x``; null outside."""
    found = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        found = F.when((x >= edges[i]) & (x < edges[i + 1]), i).otherwise(found)
    return found


def violations(scores: DataFrame, by: list[str], size: str, score: str, slack: float = 0.01) -> DataFrame:
    """How often ``score`` rises by more than ``slack`` as ``size`` shrinks, per ``by``."""
    before = F.lag(score).over(Window.partitionBy(*by).orderBy(F.desc(size)))
    return scores.withColumn("rise", F.col(score) - before).groupBy(*by).agg(F.count(F.lit(1)).alias("sizes"), F.coalesce(F.sum((F.col("rise") > slack).cast("long")), F.lit(0)).alias("violations"))


def stability(results: DataFrame, by: list[str], duration: str, value: str, shift: float = 2.0) -> DataFrame:
    """Each row's change of ``value`` against the shortest duration of its group, flagged beyond ``shift``."""
    first = F.first_value(value).over(Window.partitionBy(*by).orderBy(duration).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return results.withColumn("change", F.col(value) - first).withColumn("shifted", F.abs("change") > shift)


def anomalies(results: DataFrame, keys: list[str], method: str, baseline: str, value: str, margin: float) -> DataFrame:
    """Rows whose ``value`` is above that of the ``baseline`` method, on the same ``keys``, by more than ``margin``."""
    base = results.filter(F.col(method) == baseline).select(*keys, F.col(value).alias("base"))
    return results.filter(F.col(method) != baseline).join(base, keys).filter(F.col(value) > F.col("base") + margin)


def interpolated(curve: list[tuple[float, float]], x: Column) -> Column:
    """The piecewise linear curve through few measured points at ``x``; beyond its ends it stays level."""
    points = sorted(curve)
    out = F.lit(points[-1][1])
    for (a, u), (b, v) in reversed(list(zip(points, points[1:], strict=False))):
        out = F.when(x < b, u + (x - a) / (b - a) * (v - u)).otherwise(out)
    return F.when(x <= points[0][0], points[0][1]).otherwise(out)
