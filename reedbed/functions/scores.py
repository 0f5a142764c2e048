"""Importance of a sample from its neighbours, as columns. All windows share one partitioning and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.series import KEYS


def ordered() -> WindowSpec:
    return Window.partitionBy(*KEYS).orderBy("idx")


def before(name: str, n: int = 1) -> Column:
    return F.lag(name, n).over(ordered())


def after(name: str, n: int = 1) -> Column:
    return F.lead(name, n).over(ordered())


def deviation(tp, xp, t, x, ts, xs) -> Column:
    """Distance of (t, x) from the chord between its neighbours; null at an end."""
    return F.abs(x - (xp + (t - tp) / (ts - tp) * (xs - xp)))


def with_scores(series: DataFrame, window: int = 3, beta: float = 0.5, alpha: float = 0.5) -> DataFrame:
    """The series with d1, d2 (signed form), d2_abs (difference of magnitudes), energy (mean squared difference of up to
    ``window`` steps either way), ie (distance from the chord), area, span_score, lookahead, var3. Scores that need two
    neighbours are null at the ends, which are always kept."""
    v, i = F.col("value"), F.col("idx")
    diff = series.withColumn("diff", v - before("value"))
    d = diff.withColumn("d1", F.coalesce(F.abs("diff"), F.lit(0.0))).withColumn("d2", F.coalesce(F.abs(F.col("diff") - before("diff")), F.lit(0.0)))
    d = d.withColumn("d2_abs", F.when(i < 2, 0.0).otherwise(F.abs(F.col("d1") - before("d1"))))
    d = d.withColumn("energy", F.coalesce(F.avg(F.col("diff") * F.col("diff")).over(ordered().rowsBetween(-(window - 1), window)), F.lit(0.0)))
    d = d.withColumn("ie", deviation(before("idx"), before("value"), i, v, after("idx"), after("value")))
    span = after("idx") - before("idx")
    d = d.withColumn("area", 0.5 * span * F.col("ie")).withColumn("span_score", F.col("ie") * F.pow(span.cast("double"), F.lit(beta)))
    # distances that the two neighbours would have without this sample
    left = deviation(before("idx", 2), before("value", 2), before("idx"), before("value"), after("idx"), after("value"))
    right = deviation(before("idx"), before("value"), after("idx"), after("value"), after("idx", 2), after("value", 2))
    d = d.withColumn("lookahead", F.col("ie") + alpha * F.greatest(F.lit(0.0), F.col("ie") - F.least(left, right)))
    d = d.withColumn("var3", F.when(before("idx").isNotNull() & after("idx").isNotNull(), F.var_pop("value").over(ordered().rowsBetween(-1, 1))))
    return d.drop("diff")


def combined(scored: DataFrame, alpha: float = 0.1, beta: float = 0.3, gamma: float = 0.6) -> DataFrame:
    """Weighted sum, geometric and least of (d1, d2_abs, energy), and the weighted sum of their ranks."""
    parts = [(F.col("d1"), alpha), (F.col("d2_abs"), beta), (F.col("energy"), gamma)]
    linear = sum((w * c for c, w in parts[1:]), parts[0][1] * parts[0][0])
    geometric = F.pow(parts[0][0] + 1e-12, F.lit(alpha)) * F.pow(parts[1][0] + 1e-12, F.lit(beta)) * F.pow(parts[2][0] + 1e-12, F.lit(gamma))
    n = F.count(F.lit(1)).over(Window.partitionBy(*KEYS))
    rank = lambda c: (F.row_number().over(Window.partitionBy(*KEYS).orderBy(c, "idx")) - 1) / F.greatest(n - 1, F.lit(1))
    fused = alpha * rank("d1") + beta * rank("d2_abs") + gamma * rank("energy")
    return scored.select(*KEYS, "idx", linear.alias("linear"), geometric.alias("geometric"), F.least(*[c for c, _ in parts]).alias("least"), fused.alias("fused"))


def weights_at(occupancy: float, alpha: float = 0.1, beta: float = 0.3, gamma: float = 0.6, step: float = 0.15) -> tuple[float, float, float]:
    """Weights of a buffer this full: the energy gains, the first difference loses, and they sum to 1."""
    g, a = min(0.95, gamma + step * occupancy), max(0.01, alpha - step * occupancy / 2)
    total = a + beta + g
    return a / total, beta / total, g / total


def rules(scored: DataFrame, weights: tuple[float, float, float], tiny: float = 1e-12) -> DataFrame:
    """(d1, d2_abs, energy) combined by weighted sum, geometric and harmonic mean and least weighted part."""
    parts = list(zip((F.col("d1"), F.col("d2_abs"), F.col("energy")), weights, strict=True))
    linear = parts[0][1] * parts[0][0] + parts[1][1] * parts[1][0] + parts[2][1] * parts[2][0]
    geometric = F.pow(parts[0][0] + tiny, F.lit(weights[0])) * F.pow(parts[1][0] + tiny, F.lit(weights[1])) * F.pow(parts[2][0] + tiny, F.lit(weights[2]))
    below = weights[0] / (parts[0][0] + tiny) + weights[1] / (parts[1][0] + tiny) + weights[2] / (parts[2][0] + tiny)
    harmonic = F.when(below > tiny, 1 / below).otherwise(0.0)
    return scored.select(*KEYS, "idx", linear.alias("linear"), geometric.alias("geometric"), harmonic.alias("harmonic"), F.least(*[w * c for c, w in parts]).alias("least_weighted"))
