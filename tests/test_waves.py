import numpy as np
import pytest

from reedbed.operators import envelope, folds, matching
from reedbed.plans import waves
from tests.oracle import difference

SF = "/root/testdata/sf0.001"


def chord(p, i, s, x):
    return abs(x[i] - (x[p] + (i - p) / (s - p) * (x[s] - x[p])))


@pytest.mark.parametrize("n,capacity", [(5, 8), (8, 8), (90, 8), (200, 3), (40, 2), (0, 4)])
def test_fill_then_evict_equals_slow(n, capacity):
    x = np.round(np.random.default_rng(n).normal(size=n), 1)
    held = []
    for i in range(n):
        held.append(i)
        if len(held) > capacity:
            held.pop(min(range(1, len(held) - 1), key=lambda k: chord(held[k - 1], held[k], held[k + 1], x)))
    assert folds.evicted_places(x, capacity) == held


@pytest.mark.parametrize("policy", list(folds.LOCAL))
@pytest.mark.parametrize("capacity,overload", [(1, 3), (2, 5), (4, 2), (8, 3), (9, 50)])
def test_kept_scores_equal_whole_ones(policy, capacity, overload):
    x = np.round(np.random.default_rng(capacity).normal(size=150), 2)
    places, out = [], []
    for i in range(len(x)):
        if len(places) == capacity:
            scores = folds.importance(policy, np.array(places, dtype=float), x[places])
            places.pop(int(scores.argmin()) if np.isfinite(scores).any() else 0)
        places.append(i)
        if (i + 1) % overload == 0:
            out.append(places.pop(0))
    assert folds.bounded_places(x, capacity, overload, policy) == out + places


def test_policies_by_hand():
    t, x = np.arange(5.0), np.array([0.0, 4.0, 4.0, 9.0, 7.0])
    assert folds.importance("any_step", t, x).tolist() == [np.inf, 4, 0, 5, 2]
    d1, d2 = np.array([0, 4, 0, 5, 2.0]), np.array([0, 0, 4, 5, 3.0])
    ew, w = folds.energy(x, 3), (0.1, 0.3, 0.6)
    for policy, want in {
        "least": np.minimum(np.minimum(w[0] * d1, w[1] * d2), w[2] * ew),
        "geometric": (d1 + 1e-12) ** w[0] * (d2 + 1e-12) ** w[1] * (ew + 1e-12) ** w[2],
        "harmonic": 1 / (w[0] / (d1 + 1e-12) + w[1] / (d2 + 1e-12) + w[2] / (ew + 1e-12)),
        "adaptive": (0.025 * d1 + 0.3 * d2 + 0.75 * ew) / 1.075,
    }.items():
        got = folds.importance(policy, t, x)
        assert np.isinf(got[[0, -1]]).all() and np.allclose(got[1:-1], want[1:-1])
    weight = folds.frequency_weight(np.array([1.0, -1, 1, -1, 1, -1, 1, -1, 1]), 1, 0.5)
    assert weight[0] == 1.5 and weight[4] == 1.5


def slow_envelope(x, rate, low, high, order):
    n = len(x)
    warp = lambda f: np.tan(np.pi * f / rate)
    out = np.zeros(n, dtype=complex)
    for k in range(n // 2 + 1):
        c = sum(x[t] * np.exp(-2j * np.pi * k * t / n) for t in range(n))
        w = warp(min(k * rate / n, 0.4999999 * rate))
        gain = 0 if k == 0 else 1 / (1 + ((w * w - warp(low) * warp(high)) / (w * (warp(high) - warp(low)))) ** (2 * order))
        twice = 1 if k == 0 or 2 * k == n else 2
        out += twice * gain * c * np.exp(2j * np.pi * k * np.arange(n) / n) / n
    return np.abs(out)


@pytest.mark.parametrize("n", [8, 9, 50])
def test_envelope_equals_direct_sums(n):
    x = np.random.default_rng(n).normal(size=n)
    assert np.allclose(envelope.envelope(x, 64, 8, 24), slow_envelope(x, 64, 8, 24, 4))


def test_envelope_finds_the_modulation(spark):
    n, rate = 2048, 2048.0
    t = np.arange(n) / rate
    x = (1 + 0.8 * np.cos(2 * np.pi * 20 * t)) * np.cos(2 * np.pi * 300 * t)
    rows = spark.createDataFrame([("a", 0, i, float(v)) for i, v in enumerate(x)] + [("b", 0, 0, 1.0), ("c", 0, 0, None)], "signal_id string, segment long, idx long, value double")
    spectrum = envelope.envelope_spectrum(rows, rate, 200, 400)
    got = envelope.peak_near(spectrum, ["signal_id", "segment"], 20.4).collect()
    assert [(r.signal_id, r.peak_freq) for r in got] == [("a", 20.0)] and abs(got[0].peak_mag - 0.8) < 0.05 and got[0].pnr_db > 20
    own = envelope.peak_near(spectrum, ["signal_id", "segment"], 20.4)
    same = envelope.diagnosis(own, own, ["signal_id", "segment"]).collect()[0]
    assert same.diagnosable and same.freq_error == 0 and same.pnr_loss == 0
    assert not envelope.diagnosis(own, own.withColumn("pnr_db", own["pnr_db"] * 0 + 5.9), ["signal_id", "segment"]).collect()[0].diagnosable
    assert envelope.envelope_spectrum(rows.limit(0), rate, 200, 400).isEmpty()


def test_band_with_bursts_is_chosen():
    rng, rate = np.random.default_rng(1), 12000.0
    x = rng.normal(size=4096) * 0.05
    for at in range(100, 4000, 500):
        x[at : at + 60] += np.sin(2 * np.pi * 3000 * np.arange(60) / rate) * np.hanning(60)
    low, high, kurtosis = envelope.best_band(x, rate)
    assert low < 3000 < high and kurtosis > 3
    assert envelope.best_band(np.zeros(64), rate) is None


def test_energy_peaks_meet_the_beats():
    rate = 360.0
    x = np.zeros(3600)
    for at in range(180, 3600, 300):
        x[at - 10 : at + 11] += np.hanning(21)
    got = envelope.energy_peaks(x, rate)
    assert len(got) == 12 and all(abs(g - a) <= 20 for g, a in zip(got, range(180, 3600, 300), strict=True))
    assert envelope.energy_peaks(np.zeros(100), rate) == []


def test_tops_by_maximum_and_first_match(spark):
    x = [0, 5, 0, 0, 0, 10, 0, 7, 0, 0, 0, 0, 6.5, 0]
    rows = spark.createDataFrame([("a", 0, i, float(v)) for i, v in enumerate(x)], "signal_id string, segment long, idx long, value double")
    assert sorted(r.idx for r in matching.peak_places(rows, reach=1, share=0.6, apart=4, of_top=True).collect()) == [5, 12]
    known, found = (spark.createDataFrame([("a", 0, i) for i in at], "signal_id string, segment long, idx long") for at in ([4, 6], [6, 8]))
    pairs = lambda nearest: sorted((r.t, r.d) for r in matching.matched_places(known, found, within=2, nearest=nearest).collect())
    assert pairs(True) == [(6, 6)] and pairs(False) == [(4, 6), (6, 8)]


@pytest.mark.parametrize("name", list(waves.oracle_sql()))
def test_waves_equal_sql(spark, name):
    assert difference(spark, waves.queries()[name], waves.oracle_sql()[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(waves.queries()) - set(waves.oracle_sql())))
def test_waves_run(spark, name):
    assert waves.queries()[name](spark, SF).count() > 0


def test_blocks_of_all_lengths_side_by_side(spark, monkeypatch):
    """Blocks are transformed by their length, not one by one, and come out as alone, wherever the batches of a task end."""
    rng = np.random.default_rng(12)
    data = {f"s{i}": rng.normal(size=n) for i, n in enumerate([7, 8, 9, 9, 33, 40, 40, 100, 257])} | {"flat": np.zeros(40)}
    rows = spark.createDataFrame([(k, 0, i, float(v)) for k, x in data.items() for i, v in enumerate(x)], "signal_id string, segment long, idx long, value double")
    calls = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(envelope, "ROWS", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        got = {(r.signal_id, r.block): (r.low, r.high, r.kurtosis) for r in envelope.bands(rows, 12800.0, size=64).collect()}
        lengths = envelope._by_block(rows.repartition(1), ["signal_id", "segment"], "value", 64, 8, "n bigint", lambda x: (calls.add(1), (np.ones(len(x), dtype=int), (np.full(len(x), x.shape[1]),)))[1]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    blocks = {(k, at // 64): x[at : at + 64] for k, x in data.items() for at in range(0, len(x), 64) if len(x[at : at + 64]) >= 8}
    want = {at: best for at, x in blocks.items() if (best := envelope.best_band(x, 12800.0))}
    assert got.keys() == want.keys() and all(np.allclose(got[at], want[at]) for at in want)
    assert sorted((r.signal_id, r.block, r.n) for r in lengths) == sorted((*at, len(x)) for at, x in blocks.items())
    assert 0 < calls.value < len(blocks)
