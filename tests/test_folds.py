import numpy as np
import pytest

from reedbed.operators import folds, select
from reedbed.sources.series import delta_code, delta_decode, read_samples

SF = "/root/testdata/sf0.001"


def chord(p, i, s, x):
    return abs(x[i] - (x[p] + (i - p) / (s - p) * (x[s] - x[p])))


def slow_bounded(x, capacity, overload):
    held, out = [], []
    for i in range(len(x)):
        if len(held) == capacity:
            best = min(range(1, len(held) - 1), key=lambda k: (chord(held[k - 1], held[k], held[k + 1], x), k)) if len(held) > 2 else 0
            held.pop(best)
        held.append(i)
        if (i + 1) % overload == 0:
            out.append(held.pop(0))
    return out + held


def slow_greedy(x, target):
    left = list(range(len(x)))
    while len(left) > max(2, target):
        k = min(range(1, len(left) - 1), key=lambda k: (chord(left[k - 1], left[k], left[k + 1], x), left[k]))
        left.pop(k)
    return left


@pytest.mark.parametrize("capacity,overload", [(4, 2), (8, 3), (5, 10)])
def test_bounded_equals_slow(capacity, overload):
    x = np.random.default_rng(capacity).normal(size=120)
    assert folds.bounded_places(x, capacity, overload, "interp") == slow_bounded(x, capacity, overload)


@pytest.mark.parametrize("policy", ["interp", "area", "span", "lookahead", "interp_composite", "first_order", "second_order", "energy", "composite", "low_variance", "fifo", "middle"])
def test_count_does_not_depend_on_policy(policy):
    x = np.round(np.random.default_rng(3).normal(size=90), 1)
    kept = folds.bounded_places(x, 8, 3, policy)
    assert len(kept) == len(set(kept)) == len(folds.bounded_places(x, 8, 3, "fifo"))


def test_span_exponents_are_interp_and_area():
    x = np.random.default_rng(5).normal(size=100)
    assert folds.bounded_places(x, 8, 4, "span", beta=0.0) == folds.bounded_places(x, 8, 4, "interp")
    assert folds.bounded_places(x, 8, 4, "span", beta=1.0) == folds.bounded_places(x, 8, 4, "area")


def test_greedy_equals_slow_and_keeps_a_spike():
    x = np.random.default_rng(7).normal(size=60)
    assert folds.greedy_places(x, 15) == slow_greedy(x, 15)
    assert 3 in folds.greedy_places(np.array([0, 0, 0, 5.0, 0, 0, 0]), 5)


def test_door_keeps_within_tolerance():
    x = np.cumsum(np.random.default_rng(9).normal(size=200))
    kept = folds.door_places(x, 0.8)
    assert np.abs(np.interp(np.arange(200), kept, x[kept]) - x).max() <= 2 * 0.8 + 1e-9
    assert len(folds.within(x, 20, folds.Door)) <= 20
    assert len(folds.lttb_places(x, 20)) == 20


def test_fifo_closed_form_equals_the_fold(spark):
    s = read_samples(spark, SF)
    a = select.fifo(s, 8, 3).select("signal_id", "segment", "idx")
    b = folds.bounded(s, 8, 3, "fifo").select("signal_id", "segment", "idx")
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_delta_round_trip(spark):
    s = folds.greedy(read_samples(spark, SF), 4)
    assert delta_decode(delta_code(s)).exceptAll(s.select("signal_id", "segment", "idx")).isEmpty()


def slow_pieces(x, tolerance):
    out = [0]
    for i in range(2, len(x)):
        at = out[-1]
        if any(chord(at, b, i, x) > tolerance for b in range(at + 1, i)):
            out.append(i - 1)
    return out if out[-1] == len(x) - 1 else [*out, len(x) - 1]


@pytest.mark.parametrize("tolerance", [0.0, 0.3, 1.1, 50.0])
def test_pieces_equal_slow(tolerance):
    x = np.cumsum(np.random.default_rng(13).normal(size=150))
    assert folds.piece_places(x, tolerance) == slow_pieces(x, tolerance)


SERIES = "signal_id string, segment long, idx long, value double"


def series_of(spark, *lengths):
    """Segments of random walks; rows come in no order."""
    rng = np.random.default_rng(17)
    rows = [(f"s{k}", k, i, float(v)) for k, n in enumerate(lengths) for i, v in enumerate(np.round(np.cumsum(rng.normal(size=n)), 2))]
    values = {k: np.array([r[3] for r in rows if r[1] == k]) for k in range(len(lengths))}
    return spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], SERIES).repartition(3), values


def by_segment(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.segment, []).append(r.idx)
    return {k: sorted(v) for k, v in out.items()}


def test_a_segment_of_any_length_is_one_fold(spark):
    """10,000 samples, many times what a batch of Arrow holds here: nothing starts anew."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        s, x = series_of(spark, 10_000, 3, 1, 700)
        for policy in ("interp", "fifo"):
            assert by_segment(folds.bounded(s, 8, 3, policy)) == {k: sorted(folds.bounded_places(v, 8, 3, policy)) for k, v in x.items()}
        assert by_segment(folds.bounded(s, 8, 3, "fifo")) == by_segment(select.fifo(s, 8, 3))
        assert by_segment(folds.bounded(s, 8, 20_000, "fifo"))[0] == list(range(9_992, 10_000))
        assert by_segment(folds.at_tolerance(s, folds.Door, 1.5)) == {k: folds.door_places(v, 1.5) for k, v in x.items()}
        assert by_segment(folds.at_tolerance(s, folds.Pieces, 1.5)) == {k: folds.piece_places(v, 1.5) for k, v in x.items()}
        assert by_segment(folds.lttb(s, 4)) == {k: slow_triangles(v, max(2, len(v) // 4)) for k, v in x.items()}
        assert by_segment(folds.evicted(s, 8)) == {k: folds.evicted_places(v, 8) for k, v in x.items()}
        swept = folds.swept(s, [{"capacity": 8, "overload": 3, "policy": "interp"}, {"capacity": 4, "overload": 2, "policy": "area"}])
        assert by_segment(swept.filter("config = 1")) == {k: sorted(folds.bounded_places(v, 4, 2, "area")) for k, v in x.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert folds.bounded(s.limit(0), 8, 3).count() == folds.lttb(s.limit(0), 4).count() == folds.swinging_door(s.limit(0), 4).count() == 0


@pytest.mark.parametrize("kind", [folds.Door, folds.Pieces])
def test_tolerances_do_not_depend_on_the_block(spark, monkeypatch, kind):
    """Halved over in memory and by reading again: the same steps, so the same survivors."""
    s, x = series_of(spark, 400, 30)
    want = {k: folds.within(v, len(v) // 4, kind, 9) for k, v in x.items()}
    rows = folds.with_share(s, 4)
    assert by_segment(folds.tolerance_to(rows, kind, 9)) == want
    monkeypatch.setattr(folds, "BLOCK", 50)
    assert by_segment(folds.tolerance_to(rows, kind, 9)) == want
    assert len(want[0]) <= 100


def slow_triangles(x, target):
    """Buckets by the definition, on whole arrays."""
    n = len(x)
    if target >= n:
        return list(range(n))
    if target < 3:
        return sorted({0, n - 1})
    size, at, out = (n - 2) / (target - 2), 0, [0]
    for b in range(target - 2):
        own, after = range(int(b * size) + 1, int((b + 1) * size) + 1), range(int((b + 1) * size) + 1, min(int((b + 2) * size) + 1, n))
        tm, xm = (np.mean(after), x[list(after)].mean()) if len(after) else (n - 1, x[n - 1])
        at = max(own, key=lambda i: (abs((at - tm) * (x[i] - x[at]) - (at - i) * (xm - x[at])) * 0.5, -i))
        out.append(at)
    return [*out, n - 1]


@pytest.mark.parametrize("n,target", [(100, 20), (101, 33), (50, 50), (50, 3), (50, 2), (7, 5), (1, 2), (2, 2), (0, 2), (999, 250)])
def test_triangles_equal_slow(n, target):
    x = np.random.default_rng(n).normal(size=n)
    assert folds.lttb_places(x, target) == slow_triangles(x, target)


def slow_door(x, tolerance):
    """Store i - 1 when no line from the last stored sample passes within the tolerance of all samples since."""
    out, at = [0], 0
    for i in range(1, len(x)):
        slopes = [((x[j] - tolerance - x[at]) / (j - at), (x[j] + tolerance - x[at]) / (j - at)) for j in range(at + 1, i + 1)]
        if max(a for a, _ in slopes) > min(b for _, b in slopes) and i - 1 > at:
            at = i - 1
            out.append(at)
    return out if out[-1] == len(x) - 1 else [*out, len(x) - 1]


@pytest.mark.parametrize("tolerance", [0.0, 0.2, 0.9, 40.0])
def test_door_equals_slow(tolerance):
    x = np.cumsum(np.random.default_rng(21).normal(size=180))
    assert folds.door_places(x, tolerance) == slow_door(x, tolerance)


def slow_greedy_area(x, target):
    left = list(range(len(x)))
    while len(left) > max(2, target):
        left.pop(min(range(1, len(left) - 1), key=lambda k: (0.5 * (left[k + 1] - left[k - 1]) * chord(left[k - 1], left[k], left[k + 1], x), left[k])))
    return left


def test_greedy_area_equals_slow():
    x = np.round(np.random.default_rng(23).normal(size=70), 2)
    assert folds.greedy_places(x, 17, area=True) == slow_greedy_area(x, 17)


def test_offline_methods_keep_the_online_count(spark):
    """Greedy removal and the triangles: exactly the count of the online run of the same segment (anti-join empty); door and
    segments: never more, and one tolerance step below would be more."""
    s, x = series_of(spark, 300, 12, 8, 90)
    got = folds.at_online_budget(s, 8, 3)
    counts = got.groupBy("method", "segment").count()
    online = counts.filter("method = 'online'").selectExpr("segment", "count as want")
    exact = counts.filter("method in ('greedy_interp', 'greedy_area', 'lttb')").join(online, "segment")
    assert exact.count() == 12 and exact.filter("count <> want").isEmpty()
    assert counts.filter("method in ('door', 'pieces')").join(online, "segment").filter("count > want").isEmpty()
    want = {k: len(folds.bounded_places(v, 8, 3, "interp")) for k, v in x.items()}
    assert by_segment(got.filter("method = 'greedy_interp'")) == {k: slow_greedy(v, want[k]) for k, v in x.items()}


def slow_parts(t, x, i, window=3):
    """d1, d2 and energy of buffered sample i by their definitions."""
    d1 = lambda k: abs(x[k] - x[k - 1]) if k else 0.0
    steps = [(x[k] - x[k - 1]) ** 2 for k in range(max(1, i - window + 1), min(len(x) - 1, i + window) + 1)]
    return d1(i), abs(d1(i) - d1(i - 1)) if i > 1 else 0.0, sum(steps) / len(steps) if steps else 0.0


def slow_score(policy, t, x, i):
    w, n = (0.1, 0.3, 0.6), len(x)
    if policy == "any_step":
        return abs(x[i] - x[i - 1]) if i else np.inf
    if i in (0, n - 1):
        return np.inf
    error = lambda p, k, s: abs(x[k] - (x[p] + (t[k] - t[p]) / (t[s] - t[p]) * (x[s] - x[p])))
    ie, span = error(i - 1, i, i + 1), t[i + 1] - t[i - 1]
    d1, d2, ew = slow_parts(t, x, i)
    if policy == "lookahead":
        after = ([error(i - 2, i - 1, i + 1)] if i > 1 else []) + ([error(i - 1, i + 1, i + 2)] if i + 2 < n else [])
        return ie + 0.5 * max(0.0, ie - min(after)) if after else ie
    if policy == "low_variance":
        return float(np.var(x[i - 1 : i + 2]))
    if policy == "interp_frequency":
        own = x[max(i - 3, 0) : i + 4]
        around = [v - np.mean(own) for v in x[max(i - 3, 0) : max(i - 3, 0) + 8]]
        return ie * (1 + 0.6 * sum(a * b < 0 for a, b in zip(around, around[1:], strict=False)) / (len(around) - 1))
    return {
        "interp": ie, "area": 0.5 * span * ie, "span": ie * span**0.5, "interp_composite": ie * (1 + 0.6 * ew), "first_order": d1, "second_order": d2, "energy": ew,
        "composite": 0.1 * d1 + 0.3 * d2 + 0.6 * ew, "adaptive": (0.025 * d1 + 0.3 * d2 + 0.75 * ew) / 1.075, "least": min(0.1 * d1, 0.3 * d2, 0.6 * ew),
        "geometric": (d1 + 1e-12) ** w[0] * (d2 + 1e-12) ** w[1] * (ew + 1e-12) ** w[2], "harmonic": 1 / (w[0] / (d1 + 1e-12) + w[1] / (d2 + 1e-12) + w[2] / (ew + 1e-12)),
    }[policy]


@pytest.mark.parametrize("policy", ["any_step", "lookahead", "low_variance", "interp_frequency", "interp_composite", "first_order", "second_order", "energy", "composite", "adaptive", "least", "geometric", "harmonic"])
def test_policies_equal_slow(policy):
    """Each sample's score by its definition, on buffers with gaps, and the survivors that follow from it."""
    rng = np.random.default_rng(29)
    for n in (4, 5, 8, 13):
        t, x = np.sort(rng.choice(60, n, replace=False)).astype(float), rng.normal(size=n)
        want = [slow_score(policy, t, x, i) for i in range(n)]
        assert np.allclose(folds.importance(policy, t, x), want), (policy, n)
    x, held, out = rng.normal(size=80), [], []
    for i in range(80):
        if len(held) == 8:
            held.pop(int(np.argmin([slow_score(policy, np.array(held, dtype=float), x[held], k) for k in range(8)])))
        held.append(i)
        if i % 3 == 2:
            out.append(held.pop(0))
    assert folds.bounded_places(x, 8, 3, policy) == out + held
