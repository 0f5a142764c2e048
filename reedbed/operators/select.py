"""Reducers that one pass decides: which samples of a series are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scores import with_scores
from ..sources.series import KEYS


def whole() -> WindowSpec:
    return Window.partitionBy(*KEYS)


def count_kept(n: Column, capacity: int, overload: int) -> Column:
    """Samples that a buffer of ``capacity`` lets through when one is taken out every ``overload`` arrivals: what is
    drained while rows arrive, and what is left at the end."""
    drained = F.floor(n / overload)
    last = F.when(drained > 0, F.greatest(drained - 1, drained * overload - capacity)).otherwise(-1)
    return F.least(n, drained + F.greatest(F.lit(0), n - F.greatest(last + 1, n - capacity)))


def fifo(series: DataFrame, capacity: int, overload: int) -> DataFrame:
    """Drop the oldest when full. Drain j emits max(j - 1, j * overload - capacity); the rest stays at the end."""
    s = series.withColumn("n", F.count(F.lit(1)).over(whole())).withColumn("drained", F.floor(F.col("n") / overload))
    # place i is emitted by the drain j with max(j - 1, j * overload - capacity) = i
    by_rank, by_age = F.col("idx") + 1, (F.col("idx") + capacity) / overload
    early = (by_rank <= F.col("drained")) & (by_rank * overload - capacity <= F.col("idx"))
    late = ((F.col("idx") + capacity) % overload == 0) & (by_age >= 1) & (by_age <= F.col("drained")) & (by_age - 1 <= F.col("idx"))
    last = F.when(F.col("drained") > 0, F.greatest(F.col("drained") - 1, F.col("drained") * overload - capacity)).otherwise(-1)
    rest = F.col("idx") >= F.greatest(last + 1, F.col("n") - capacity)
    return s.filter(early | late | rest).select(*KEYS, "idx", "value")


def stride(n: Column, budget: Column) -> Column:
    """Every (n div budget)-th sample, at most ``budget``."""
    step = F.greatest(F.lit(1), F.floor(n / budget))
    return (F.col("idx") % step == 0) & (F.floor(F.col("idx") / step) < budget)


def linspace(n: Column, budget: Column) -> Column:
    """``budget`` places from first to last, cut to whole numbers."""
    j = F.ceil(F.col("idx") * (budget - 1) / F.greatest(n - 1, F.lit(1)))
    return F.floor(j * (n - 1) / F.greatest(budget - 1, F.lit(1))) == F.col("idx")


def keep_last(n: Column, budget: Column) -> Column:
    return F.col("idx") >= n - budget


def marked(series: DataFrame, share: int = 4) -> DataFrame:
    """Every sample once per method with ``kept``: stride, linspace, keep_last, and the samples of largest distance from
    the chord (both ends kept); the budget is n div ``share``, two at least."""
    scored = with_scores(series).withColumn("n", F.count(F.lit(1)).over(whole())).withColumn("budget", F.greatest(F.lit(2), F.floor(F.col("n") / share)))
    by_score = whole().orderBy(F.when(F.col("ie").isNull(), 0).otherwise(1), F.col("ie").desc(), "idx")
    n, budget = F.col("n"), F.col("budget")
    rules = {"stride": stride(n, budget), "linspace": linspace(n, budget), "keep_last": keep_last(n, budget), "top_ie": F.row_number().over(by_score) <= budget}
    wide = scored.select(*KEYS, "idx", "value", "n", *[rule.alias(name) for name, rule in rules.items()])
    return wide.unpivot([*KEYS, "idx", "value", "n"], list(rules), "method", "kept")
