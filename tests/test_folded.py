import numpy as np
import pytest
from pyspark.sql import functions as F

from reedbed.operators import folds, signals
from reedbed.plans import folded, registry, waves
from tests.oracle import difference

QUERIES = registry.queries() | waves.queries() | folded.queries()


@pytest.mark.parametrize("name", sorted(folded.oracle_sql()))
def test_equals_sql(spark, name):
    assert not difference(spark, QUERIES[name], folded.oracle_sql()[name], "/root/testdata/sf0.001")


def test_tuned_tolerance_equals_plain_loops(spark):
    """Doubling from 1, then 60 halvings, the middle returned."""
    rng = np.random.default_rng(31)
    x = {0: np.cumsum(rng.normal(size=120)), 1: 40 * np.cumsum(rng.normal(size=60)), 2: np.array([1.0, 2.0]), 3: np.zeros(30)}
    rows = [("s", k, i, float(v), max(2, len(own) // 4)) for k, own in x.items() for i, v in enumerate(own)]
    got = {r.segment: r for r in folds.tuned(spark.createDataFrame(rows, "signal_id string, segment long, idx long, value double, target long"), folds.Door).collect()}
    for k, own in x.items():
        target, low, high = max(2, len(own) // 4), 1e-9, 1.0
        while len(folds.door_places(own, high)) > target:
            high *= 2
        for _ in range(60):
            middle = 0.5 * (low + high)
            if len(folds.door_places(own, middle)) > target:
                low = middle
            else:
                high = middle
        assert got[k].tolerance == 0.5 * (low + high) and got[k].retained == len(folds.door_places(own, got[k].tolerance))


def test_noise_repeats_and_has_its_deviation(spark):
    s = spark.range(20_000).select(F.lit("a").alias("signal_id"), F.lit(0).cast("long").alias("segment"), F.col("id").alias("idx"), (F.col("id") % 2 * 2.0).alias("value"))
    one, two = (signals.noisy(s.repartition(n), 16, 0.5).orderBy("idx").toPandas() for n in (2, 5))
    assert np.allclose(one["value"], two["value"], atol=1e-12)  # a deviation's last bits follow the order of its sum
    assert not np.allclose(one["value"], signals.noisy(s, 16, 0.5, seed=7).orderBy("idx").toPandas()["value"])
    noise = one["value"] - (one["idx"] % 2) * 2.0
    assert abs(noise.mean()) < 0.02 and abs(noise.std() - 0.5) < 0.02
