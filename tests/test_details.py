import numpy as np
import pytest
from pyspark.sql import functions as F

from reedbed.operators import curves
from reedbed.plans import details
from tests.oracle import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(details.queries()))
def test_equals_sql(spark, name):
    assert difference(spark, details.queries()[name], details.oracle_sql()[name], SF) == ""


def test_curve_is_level_beyond_its_ends(spark):
    x, y = [1.0, 2.0, 5.0, 40.0], [0.5, 2.0, 3.0, 9.0]
    curve = curves.measured_curve(spark.createDataFrame([*zip(x, y), (None, 1.0), (0.0, 7.0), (3.0, None)], "x double, y double"), "x", "y")
    at = [0.2, 1.0, 1.5, 2.0, 4.4, 39.9, 40.0, 1e6]
    rows = spark.createDataFrame([(v,) for v in [*at, None]], "at double")
    got = {r["at"]: r.bits for r in curves.read_off(rows, curve, "at", "bits").collect()}
    assert got.pop(None) is None and np.allclose([got[v] for v in at], np.interp(at, x, y))
    assert {r.bits for r in curves.read_off(rows, curve.limit(0), "at", "bits").collect()} == {None}


def test_phases_equal_numpy(spark):
    x = np.random.default_rng(2).normal(size=530)
    rows = spark.createDataFrame([("a", 0, i, float(v)) for i, v in enumerate(x)], "signal_id string, segment long, idx long, value double")
    got = {(r.block, r.k): r.phase for r in curves.phases(rows).collect()}
    for block, part in ((0, x[:512]), (1, x[512:])):
        want = np.angle(np.fft.fft(part))[: len(part) // 2]
        assert np.allclose([got[block, k] for k in range(len(want))], want, atol=1e-8)
    flat = curves.phases(rows.withColumn("value", F.lit(2.0)))
    assert {r.k for r in flat.collect() if r.phase is not None} == {0}
