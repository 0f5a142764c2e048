import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from reedbed.operators import matching
from reedbed.plans import matches
from tests.oracle import difference

SF = "/root/testdata/sf0.001"
PLACES = "signal_id string, segment long, idx long"


@pytest.mark.parametrize("name", sorted(matches.oracle_sql()))
def test_equals_sql(spark, name):
    assert difference(spark, matches.queries()[name], matches.oracle_sql()[name], SF) == ""


def slow_match(truth, found, within, nearest):
    free, pairs = set(truth), []
    for d in sorted(set(found)):
        near = [t for t in sorted(free) if abs(t - d) <= within]
        if near:
            t = min(near, key=lambda t: abs(t - d)) if nearest else near[0]
            free.remove(t)
            pairs.append((t, d))
    return pairs


@pytest.mark.parametrize("within", [0, 1, 3, 40])
@pytest.mark.parametrize("nearest", [True, False])
def test_match_equals_slow(spark, within, nearest):
    rng = np.random.default_rng(within)
    cases = [(rng.integers(-30, 60, 12).tolist(), rng.integers(-30, 60, 14).tolist()) for _ in range(10)] + [([], [3]), ([3], []), ([], [])]
    truth = spark.createDataFrame([(str(i), 0, p) for i, (t, _) in enumerate(cases) for p in t] + [("0", 0, None), (None, 0, 3)], PLACES)
    found = spark.createDataFrame([(str(i), 0, p) for i, (_, f) in enumerate(cases) for p in f] + [("0", 0, None)], PLACES)
    each = spark.createDataFrame([(str(i), 0) for i in range(len(cases))], "signal_id string, segment long")
    got = {}
    for r in matching.matched_places(truth, found, within=within, nearest=nearest).collect():
        got.setdefault(int(r.signal_id), []).append((r.t, r.d))
    scores = {int(r.signal_id): r for r in matching.match_scores(truth, found, each, within=within, nearest=nearest).collect()}
    assert len(scores) == len(cases)
    for i, (t, f) in enumerate(cases):
        pairs = slow_match(t, f, within, nearest)
        assert sorted(got.get(i, []), key=lambda p: p[1]) == pairs
        assert (scores[i].true_positives, scores[i].false_positives, scores[i].false_negatives) == (len(pairs), len(set(f)) - len(pairs), len(set(t)) - len(pairs))
        assert (scores[i].f1 is None) == (not t)


def test_long_series_end_in_seconds(spark):
    """One series of 200,000 samples with 100,000 peaks, all within the tolerance of their neighbours."""
    n = 200_000
    rows = spark.range(n).select(F.lit("a").alias("signal_id"), F.lit(0).cast("long").alias("segment"), F.col("id").alias("idx"), ((F.col("id") % 2) * 10.0 + F.col("id") / n).alias("value"))
    start = time.time()
    own = matching.peak_places(rows, reach=1, apart=2)
    moved = own.withColumn("idx", F.col("idx") + 1)
    got = matching.match_scores(own, moved, rows, within=5).first()
    assert got.true_positives == own.count() > 99_000 and got.f1 == 1.0
    assert time.time() - start < 60


def test_no_rows(spark):
    none = spark.createDataFrame([], PLACES)
    assert matching.match_scores(none, none, none).count() == 0
    assert matching.peak_places(none.withColumn("value", F.lit(1.0))).count() == 0
