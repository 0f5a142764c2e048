import numpy as np
import pytest

from reedbed.operators import folds
from reedbed.plans import waves
from tests.test_folds import slow_parts


def snr(x, places):
    if not (x * x).sum() >= 1e-15:
        return 0.0
    noise = ((x - np.interp(np.arange(len(x)), places, x[places])) ** 2).sum()
    return 10 * np.log10((x * x).sum() / noise) if noise >= 1e-15 else None


def scored(x, *args, **options):
    fold = folds.Scored(folds.Buffer(*args, **options))
    for i, v in enumerate(x.tolist()):
        fold.push(i, v)
    return fold.rest()[0]


@pytest.mark.parametrize("n,capacity,overload", [(1, 4, 3), (5, 8, 3), (200, 4, 2), (300, 8, 50), (90, 2, 7), (60, 3, 1)])
def test_scores_equal_rebuilt_series(n, capacity, overload):
    x = np.round(np.random.default_rng(n).normal(size=n), 2)
    places = folds.bounded_places(x, capacity, overload, "interp")
    count, got = scored(x, capacity, overload, "interp")
    want = snr(x, places)
    assert count == len(places) and (got == want if want is None else abs(got - want) < 1e-9)


def test_silent_series_scores_nothing():
    assert scored(np.zeros(30), 4, 3, "interp") == (folds.bounded_places(np.zeros(30), 4, 3, "interp").__len__(), 0.0)


def test_simplex():
    grid = folds.simplex()
    assert len(grid) == 63 and np.allclose([sum(w) for w in grid], 1) and min(w[0] for w in grid) > 0.04 and (0.1, 0.3, 0.6) in [tuple(np.round(w, 9)) for w in grid]


def slow_ranks(x, held, weights):
    """Place in ``held`` of the least sum of ranks among the inner samples; all are inner in a buffer of up to three."""
    t = np.array(held, dtype=float)
    inner = range(1, len(held) - 1) if len(held) > 3 else range(len(held))
    parts = {i: slow_parts(t, x[held], i) for i in inner}
    total = dict.fromkeys(inner, 0.0)
    for m, w in enumerate(weights):
        for r, i in enumerate(sorted(inner, key=lambda i: (parts[i][m], i))):
            total[i] += w * (r / max(len(parts) - 1, 1))
    return min(inner, key=lambda i: (total[i], i))


@pytest.mark.parametrize("capacity,overload", [(2, 3), (3, 2), (5, 4), (9, 3), (16, 50)])
def test_ranks_equal_slow(capacity, overload):
    x = np.round(np.random.default_rng(capacity).normal(size=160), 2)
    held, out = [], []
    for i in range(len(x)):
        if len(held) == capacity:
            held.pop(slow_ranks(x, held, (0.1, 0.3, 0.6)))
        held.append(i)
        if (i + 1) % overload == 0:
            out.append(held.pop(0))
    assert folds.bounded_places(x, capacity, overload, "ranks") == out + held


@pytest.mark.parametrize("policy", ["composite", "adaptive", "first_order", "second_order", "energy"])
@pytest.mark.parametrize("capacity", [1, 2, 3, 4, 9, 30])
def test_loops_choose_as_whole_scores(policy, capacity, monkeypatch):
    x = np.round(np.random.default_rng(capacity).normal(size=200), 1)
    plain = folds.bounded_places(x, capacity, 4, policy)
    monkeypatch.setattr(folds, "SMALL", 0)
    assert plain == folds.bounded_places(x, capacity, 4, policy)


def test_best_weights_equal_loops(spark):
    rng, grid = np.random.default_rng(12), folds.simplex(4, 3)
    x = {k: np.round(np.cumsum(rng.normal(size=n)), 2) for k, n in enumerate((70, 90, 4, 60))}
    kinds = {0: "a", 1: "a", 2: "a", 3: "b"}
    rows = spark.createDataFrame([("s", k, i, float(v)) for k, own in x.items() for i, v in enumerate(own)], "signal_id string, segment long, idx long, value double")
    kind = spark.createDataFrame([("s", k, v) for k, v in kinds.items()], "signal_id string, segment long, kind string")
    got = {r.kind: r for r in folds.weights_by_kind(rows, kind, 6, 3, grid).collect()}
    assert set(got) == {"a", "b"}
    for name in got:
        best = None
        for w in grid:
            own = [v for v in (snr(x[k], folds.bounded_places(x[k], 6, 3, "composite", weights=w)) for k in x if kinds[k] == name) if v is not None]
            if best is None or np.mean(own) > best[0] + 1e-9:
                best = (np.mean(own), w, len(own))
        assert abs(got[name].mean_snr_db - best[0]) < 1e-6 and np.allclose((got[name].alpha, got[name].beta, got[name].gamma), best[1]) and got[name].trials == best[2]


@pytest.mark.parametrize("lengths", [(90,), (70, 90, 4, 60, 1, 2, 9, 8, 90)])
def test_folds_side_by_side_equal_single_ones(lengths):
    rng = np.random.default_rng(len(lengths))
    order = sorted(lengths, reverse=True)
    x = [np.round(np.cumsum(rng.normal(size=n)), 2) for n in order]
    dealt = rng.permutation(len(x))
    starts, at = np.zeros(len(x), dtype=int), 0
    for k in dealt:
        starts[k], at = at, at + order[k]
    values, places, n = np.concatenate([x[k] for k in dealt]), np.concatenate([np.arange(order[k]) for k in dealt]), np.array(order)
    of = lambda found, k: sorted(zip(found[1][found[0] == k].tolist(), found[2][found[0] == k].tolist(), strict=True))
    for policy in (*waves.POLICIES, "ranks"):
        for capacity, overload in ((8, 3), (1, 3), (2, 5), (9, 50)):
            found = folds.buffered(places, values, starts, n, capacity, overload, policy)
            assert all(of(found, k) == [(i, x[k][i]) for i in sorted(folds.bounded_places(x[k], capacity, overload, policy))] for k in range(len(x)))
    _, retained, scores = folds.scored(places, values, starts, n, folds.buffered(places, values, starts, n, 6, 3))
    for k in range(len(x)):
        (want, value), own = list(folds.kept(folds.Scored(folds.Buffer(6, 3, "interp")), enumerate(x[k].tolist())))[0], scores[k].as_py()
        assert retained[k] == want and (own is value is None or abs(own - value) < 1e-9)
    for kind in (folds.Door, folds.Pieces):
        found = folds.halved(places, values, starts, n, kind, np.maximum(2, n // 4), 50)
        assert all(of(found, k) == [(i, x[k][i]) for i in folds.within(x[k], max(2, len(x[k]) // 4), kind)] for k in range(len(x)))


def test_long_segments_and_odd_numbers_are_folded_alone(spark, monkeypatch):
    """A segment beyond ``WIDE`` or with a number that is not finite goes the other way, each by one way alone."""
    monkeypatch.setattr(folds, "WIDE", 50)
    monkeypatch.setattr(folds, "ROWS", 64)
    rng = np.random.default_rng(3)
    x = {k: np.round(np.cumsum(rng.normal(size=n)), 2) for k, n in enumerate((70, 50, 51, 8, 40, 30))}
    x[4][7], x[5][3] = np.inf, np.nan
    rows = spark.createDataFrame([("s", k, i, float(v)) for k, own in x.items() for i, v in enumerate(own)], "signal_id string, segment long, idx long, value double")
    got = {(k, c): [] for k in x for c in range(2)}
    for r in folds.swept(rows, [{"capacity": 8, "overload": 3, "policy": p} for p in ("fifo", "area")]).collect():
        got[r.segment, r.config].append(r.idx)
    assert all(sorted(got[k, c]) == sorted(folds.bounded_places(x[k], 8, 3, p)) for k in x for c, p in enumerate(("fifo", "area")))
