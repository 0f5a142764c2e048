"""Reducers whose choices depend on all earlier ones: a fold over each (signal_id, segment).

Spark deals the series out by segment and sorts it, and a task reads its segments as one stream of Arrow batches: a fold takes a
sample at a time and holds its own state alone, so a segment may have any number of rows. ``bounded`` keeps ``capacity``
samples, drops the one of least importance when full, and lets the oldest out every ``overload`` arrivals. ``Door`` and
``Pieces`` hold two samples and two slopes, ``Triangles`` two buckets.

A tolerance that meets a budget is found by halving. A segment of at most ``BLOCK`` samples is halved over in the task that holds
it; a longer one is read again for every ``DEPTH`` halvings, with a fold for each tolerance that they can reach. Both take the
same steps, so results do not depend on ``BLOCK``. Greedy removal looks at a whole segment and holds it.

Many short segments are folded side by side, each step one on arrays over segments: a Python step for each sample and fold costs
more than its work.
"""

from __future__ import annotations

import heapq
import math
from array import array
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import discard, written
from ..functions.scores import weights_at
from ..sources.series import KEYS

#: Keeps powers and quotients of scores defined at 0.
TINY = 1e-12
#: Most samples of a segment that are halved over in memory, and halvings of a longer one in one reading.
BLOCK, HALVINGS, DEPTH = 1 << 20, 50, 2
#: Policies whose score of a sample depends on its two neighbours alone, as functions of (chord error, span, beta).
LOCAL = {"interp": lambda e, s, b: e, "area": lambda e, s, b: 0.5 * s * e, "span": lambda e, s, b: e * max(s, 1) ** b}
#: Weights of first difference, second difference and energy in policies of one of them.
SINGLE = {"first_order": (1, 0, 0), "second_order": (0, 1, 0), "energy": (0, 0, 1)}
#: Buffers up to this size are scored by plain loops, as numpy's cost of a call is more than theirs.
SMALL = 64
#: Segments of at most ``WIDE`` samples, all below ``HUGE``, are folded side by side, about ``ROWS`` samples at a time.
WIDE, ROWS, HUGE = 512, 1 << 17, 1e75
SCHEMA = "signal_id string, segment long, idx long, value double"


def chord_error(t: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distance of each inner sample from the chord between its neighbours; infinite at the ends. Along the last axis, as all scores."""
    out = np.full(x.shape, np.inf)
    if x.shape[-1] > 2:
        out[..., 1:-1] = chord(t, x, slice(1, -1), slice(None, -2), slice(2, None))
    return out


def chord(t: np.ndarray, x: np.ndarray, i, p, s) -> np.ndarray:
    """Distance of the samples ``i`` from the chords between ``p`` and ``s``."""
    return np.abs(x[..., i] - (x[..., p] + (t[..., i] - t[..., p]) / (t[..., s] - t[..., p]) * (x[..., s] - x[..., p])))


def importance(policy: str, t: np.ndarray, x: np.ndarray, beta: float = 0.5, alpha: float = 0.5, window: int = 3, weights=(0.1, 0.3, 0.6)) -> np.ndarray:
    """Score of each buffered sample; infinite where it may not go. Buffers of one size may be rows of a matrix."""
    n = x.shape[-1]
    span = np.zeros(x.shape)
    span[..., 1:-1] = t[..., 2:] - t[..., :-2]
    if policy in ("interp", "area", "span", "lookahead", "interp_composite", "interp_frequency"):
        ie = chord_error(t, x)
        if policy == "interp_frequency":
            return np.where(np.isinf(ie), np.inf, ie * frequency_weight(x, window, weights[2]))
        if policy == "area":
            return np.where(np.isinf(ie), np.inf, 0.5 * span * np.where(np.isinf(ie), 0, ie))
        if policy == "span":
            return np.where(np.isinf(ie), np.inf, np.where(np.isinf(ie), 0, ie) * np.power(np.maximum(span, 1), beta))
        if policy == "lookahead":
            out = ie.copy()
            for i in range(1, n - 1):
                # errors of the two neighbours once the sample is gone
                after = [chord(t, x, at, p, s) for at, p, s in ((i - 1, i - 2, i + 1), (i + 1, i - 1, i + 2)) if p >= 0 and s < n]
                if after:
                    low = np.minimum.reduce(after)
                    out[..., i] = np.where(np.isfinite(low), ie[..., i] + alpha * np.maximum(0.0, ie[..., i] - low), ie[..., i])
            return out
        if policy == "interp_composite":
            return ie * (1 + weights[2] * energy(x, window))
        return ie
    d1 = np.abs(np.diff(x, prepend=x[..., :1]))
    d2 = np.abs(np.diff(d1, prepend=d1[..., :1]))
    d2[..., :2] = 0
    if policy == "low_variance":
        out = np.full(x.shape, np.inf)
        three = np.stack([x[..., :-2], x[..., 1:-1], x[..., 2:]])
        out[..., 1:-1] = three.var(0)
        return out
    if policy == "any_step":  # nothing but the oldest sample is safe
        d1[..., 0] = np.inf
        return d1
    if policy == "ranks":
        return fused_ranks((d1, d2, energy(x, window)), weights)
    if policy == "adaptive":  # the buffer is full whenever a score is asked for
        weights = weights_at(1.0, *weights)
    ew = energy(x, window)
    with np.errstate(divide="ignore"):
        if policy == "geometric":
            out = np.prod([(p + TINY) ** w for p, w in zip((d1, d2, ew), weights, strict=True)], axis=0)
        elif policy == "harmonic":
            out = 1 / sum(w / (p + TINY) for p, w in zip((d1, d2, ew), weights, strict=True))
        elif policy == "least":
            out = np.min([w * p for p, w in zip((d1, d2, ew), weights, strict=True)], axis=0)
        else:
            parts = SINGLE.get(policy, weights)
            out = parts[0] * d1 + parts[1] * d2 + parts[2] * ew
    if n > 3:
        out[..., [0, -1]] = np.inf
    return out


def linear_weights(policy: str, weights) -> tuple[float, float, float] | None:
    """Weights of a policy that adds up the three metrics; None for others."""
    if policy == "adaptive":
        return weights_at(1.0, *weights)
    return SINGLE.get(policy, weights if policy == "composite" else None)


def least_linear(x: list[float], weights, window: int) -> int | None:
    """Place of the least weighted sum of the metrics (as in ``importance``, whose steps it takes in the same order), the first of
    equal ones; None where a score is not finite."""
    n, (a, b, g) = len(x), weights
    d1, upto, total = [0.0], [0.0], 0.0
    for p, q in zip(x, x[1:], strict=False):
        step = q - p
        d1.append(abs(step))
        total += step * step
        upto.append(total)
    found, least = None, math.inf
    for i in range(1, n - 1) if n > 3 else range(n):
        low, high = max(i - window, 0), min(i + window, n - 1)
        energy = (upto[high] - upto[low]) / (high - low) if high > low else 0.0
        score = a * d1[i] + b * (abs(d1[i] - d1[i - 1]) if i > 1 else 0.0) + g * energy
        if not math.isfinite(score):
            return None
        if score < least:
            found, least = i, score
    return found


def fused_ranks(metrics, weights) -> np.ndarray:
    """Weighted sum of each inner sample's ranks by three metrics, scaled to 0..1; equal metrics are ranked by place. The ends are
    safe where there are more than three samples."""
    n = metrics[0].shape[-1]
    own = slice(1, n - 1) if n > 3 else slice(0, n)
    out = np.full(metrics[0].shape, np.inf)
    total = np.zeros(out[..., own].shape)
    count = total.shape[-1]
    for metric, weight in zip(metrics, weights, strict=True):
        ranks = np.empty(total.shape)
        np.put_along_axis(ranks, np.argsort(metric[..., own], axis=-1, kind="stable"), np.broadcast_to(np.arange(count) / max(count - 1, 1), total.shape), -1)
        total = total + weight * ranks
    out[..., own] = total
    return out


def frequency_weight(x: np.ndarray, window: int, gamma: float) -> np.ndarray:
    """1 + gamma * the rate of sign changes about the local mean, in the 2 * window + 1 steps from ``window`` before."""
    n = x.shape[-1]
    total, i = np.concatenate((np.zeros_like(x[..., :1]), np.cumsum(x, -1)), -1), np.arange(n)
    low, high = np.maximum(i - window, 0), np.minimum(i + window, n - 1)
    mean = (total[..., high + 1] - total[..., low]) / (high - low + 1)
    rate = np.zeros(x.shape)
    for at in range(n):
        own = x[..., low[at] : min(low[at] + 2 * window + 1, n - 1) + 1] - mean[..., at : at + 1]
        if own.shape[-1] > 1:
            rate[..., at] = (own[..., :-1] * own[..., 1:] < 0).mean(-1)
    return 1 + gamma * rate


def energy(x: np.ndarray, window: int) -> np.ndarray:
    squares = np.concatenate((np.zeros_like(x[..., :1]), np.cumsum(np.diff(x) ** 2, -1)), -1)
    i = np.arange(x.shape[-1])
    low, high = np.maximum(i - window, 0), np.minimum(i + window, x.shape[-1] - 1)
    return np.where(high > low, (squares[..., high] - squares[..., low]) / np.maximum(high - low, 1), 0.0)


class Buffer:
    """At most ``capacity`` samples; when full, the one of least importance goes before a new one comes. Its fields are
    all of its state, so that a stream can keep them between batches."""

    def __init__(self, capacity: int, overload: int, policy: str, places=(), values=(), arrived: int = 0, **options):
        self.capacity, self.overload, self.policy, self.options = capacity, overload, policy, options
        self.places, self.values, self.arrived = list(places), list(values), arrived
        self.local, self.beta = LOCAL.get(policy), options.get("beta", 0.5)
        self.linear = linear_weights(policy, options.get("weights", (0.1, 0.3, 0.6))) if capacity <= SMALL else None
        #: Scores of a local policy; each change renews those beside it.
        self.scores = [np.inf] * len(self.places) if self.local else []
        if self.local:
            self._score(range(len(self.places)))

    def _score(self, at) -> None:
        t, x = self.places, self.values
        for i in at:
            if 0 < i < len(t) - 1:
                p, span = x[i - 1], t[i + 1] - t[i - 1]
                self.scores[i] = self.local(abs(x[i] - (p + (t[i] - t[i - 1]) / span * (x[i + 1] - p))), span, self.beta)
            elif 0 <= i < len(t):
                self.scores[i] = np.inf

    def victim(self) -> int:
        if self.policy == "fifo":
            return 0
        if self.policy == "middle":
            return len(self.places) // 2
        if self.local:
            return self.scores.index(min(self.scores))
        if self.linear and (at := least_linear(self.values, self.linear, self.options.get("window", 3))) is not None:
            return at
        scores = importance(self.policy, np.array(self.places, dtype=np.float64), np.array(self.values, dtype=np.float64), **self.options)
        return int(scores.argmin()) if np.isfinite(scores).any() else 0

    def _remove(self, at: int) -> tuple[int, float]:
        if self.local:
            del self.scores[at]
        out = self.places.pop(at), self.values.pop(at)
        if self.local:
            self._score((at - 1, at))
        return out

    def push(self, place: int, value: float) -> tuple[int, float] | None:
        """Takes a sample; returns the oldest one when it is its turn to leave."""
        if len(self.places) == self.capacity:
            self._remove(self.victim())
        self.places.append(place)
        self.values.append(value)
        if self.local:
            self.scores.append(np.inf)
            self._score((len(self.places) - 2,))
        self.arrived += 1
        return self._remove(0) if self.arrived % self.overload == 0 else None

    def rest(self) -> list[tuple[int, float]]:
        return list(zip(self.places, self.values, strict=True))


class Scored:
    """How well a buffer's survivors rebuild the series, without the survivors: ``rest`` gives their number and the SNR in
    decibels (null if exact, 0 for a silent series). It holds the samples since the survivor that left last, at most as many as
    arrive while one stays in the buffer: capacity x overload, and the gap before it."""

    def __init__(self, buffer: Buffer):
        self.buffer, self.since, self.last = buffer, [], None
        self.signal = self.noise = 0.0
        self.retained = 0

    def push(self, place: int, value: float) -> None:
        self.since.append((place, value))
        self.signal += value * value
        if (left := self.buffer.push(place, value)) is not None:
            self._reach(*left)

    def _reach(self, place: int, value: float) -> None:
        """Errors up to the survivor ``place``; before the first one the series is flat."""
        at = 0
        p, v = self.last or (place, value)
        while at < len(self.since) and self.since[at][0] <= place:
            i, x = self.since[at]
            self.noise += (x - (value if i == place or p == place else v + (i - p) / (place - p) * (value - v))) ** 2
            at += 1
        del self.since[:at]
        self.last, self.retained = (place, value), self.retained + 1

    def rest(self) -> list[tuple[int, float | None]]:
        for left in self.buffer.rest():
            self._reach(*left)
        self.noise += sum((x - self.last[1]) ** 2 for _, x in self.since)
        if self.signal < 1e-15:
            return [(self.retained, 0.0)]
        return [(self.retained, 10 * math.log10(self.signal / self.noise) if self.noise >= 1e-15 else None)]


class Filled:
    """Fill, then evict: a sample is taken before the one to go is chosen, none leaves before the end."""

    def __init__(self, capacity: int, policy: str = "interp", **options):
        self.buffer, self.room = Buffer(math.inf, math.inf, policy, **options), max(capacity, 2)

    def push(self, place: int, value: float) -> None:
        self.buffer.push(place, value)
        if len(self.buffer.places) > self.room:
            self.buffer._remove(self.buffer.victim())

    def rest(self) -> list[tuple[int, float]]:
        return self.buffer.rest()


class Door:
    """Swinging door: store the sample before the one at which the door from the last stored sample closes. Both ends stay. The
    fields are all of its state."""

    def __init__(self, tolerance: float, at: tuple[int, float] | None = None, last: tuple[int, float] | None = None, low: float = -math.inf, high: float = math.inf):
        self.tolerance, self.at, self.last, self.low, self.high = tolerance, at, last, low, high

    def _narrow(self, place: int, value: float) -> None:
        run, (_, base) = place - self.at[0], self.at
        self.low, self.high = max(self.low, (value - self.tolerance - base) / run), min(self.high, (value + self.tolerance - base) / run)

    def push(self, place: int, value: float) -> tuple[int, float] | None:
        """Takes a sample; returns one that is stored."""
        out, last = None, self.last
        self.last = (place, value)
        if self.at is None:
            self.at = out = self.last
            return out
        self._narrow(place, value)
        if self.low > self.high and last[0] > self.at[0]:
            self.at = out = last
            self.low, self.high = -math.inf, math.inf
            self._narrow(place, value)
        return out

    def rest(self) -> list[tuple[int, float]]:
        return [] if self.at == self.last else [self.last]


class Pieces(Door):
    """Greedy segments: store the sample before the one whose chord from the last stored sample leaves a sample between
    them farther than ``tolerance``. ``low`` and ``high`` are the slopes that pass all samples between."""

    def push(self, place: int, value: float) -> tuple[int, float] | None:
        out, last = None, self.last
        self.last = (place, value)
        if self.at is None:
            self.at = out = self.last
            return out
        if last[0] > self.at[0]:
            self._narrow(*last)
        if not self.low <= (value - self.at[1]) / (place - self.at[0]) <= self.high:
            self.at = out = last
            self.low, self.high = -math.inf, math.inf
        return out


class Triangles:
    """Largest-triangle-three-buckets of ``n`` samples down to ``target``: a bucket's sample is chosen when the next bucket is
    full. It holds two buckets."""

    def __init__(self, n: int, target: int):
        self.n, self.target, self.bucket, self.count, self.held, self.at = n, target, 0, 0, [], None
        self.size = (n - 2) / (target - 2) if 2 < target < n else 0.0

    def push(self, place: int, value: float) -> tuple[int, float] | None:
        nth, self.count = self.count, self.count + 1
        if self.target >= self.n or nth in (0, self.n - 1) and self.target < 3:
            return place, value
        if self.target < 3:
            return None
        if not nth:
            self.at = (place, value)
            return self.at
        self.held.append((place, value))
        b = self.bucket
        low, high, far = (int((b + i) * self.size) + 1 for i in range(3))
        if b == self.target - 2 or self.count < min(far, self.n):
            return None
        cut = high - low
        t, x = np.array([h[0] for h in self.held], dtype=np.float64), np.array([h[1] for h in self.held])
        tm, xm = (t[cut:].mean(), x[cut:].mean()) if len(t) > cut else (place, value)
        areas = np.abs((self.at[0] - tm) * (x[:cut] - self.at[1]) - (self.at[0] - t[:cut]) * (xm - self.at[1])) * 0.5
        self.at = self.held[int(areas.argmax())]
        self.held, self.bucket = self.held[cut:], b + 1
        return self.at

    def rest(self) -> list[tuple[int, float]]:
        return self.held[-1:] if self.size else []


class Within:
    """All samples of a segment, kept by ``kind`` at the least tolerance that halving finds for ``target``."""

    def __init__(self, kind: type[Door], target: int, halvings: int = HALVINGS):
        self.kind, self.target, self.halvings, self.places, self.values = kind, target, halvings, array("q"), array("d")

    def push(self, place: int, value: float) -> None:
        self.places.append(place)
        self.values.append(value)

    def rest(self) -> list[tuple[int, float]]:
        rows = list(zip(self.places, self.values, strict=True))
        low, high = 0.0, bracket(min(self.values), max(self.values)) if rows else 0.0
        for _ in range(self.halvings):
            middle = (low + high) / 2
            low, high = (low, middle) if sum(1 for _ in kept(self.kind(middle), rows)) <= self.target else (middle, high)
        return list(kept(self.kind(high), rows))


class Greedy:
    """All samples of a segment, thinned at its end by ``greedy_places``."""

    def __init__(self, target: int, area: bool):
        self.target, self.area, self.places, self.values = target, area, array("q"), array("d")

    def push(self, place: int, value: float) -> None:
        self.places.append(place)
        self.values.append(value)

    def rest(self) -> list[tuple[int, float]]:
        return [(self.places[i], self.values[i]) for i in greedy_places(np.array(self.values), self.target, self.area)]


class Tuned(Within):
    """A tolerance for ``target`` by doubling an upper end from 1, then halving: the middle of the last bracket. Its rest is one pair, how
    many samples ``kind`` keeps at that tolerance and the tolerance. It holds the segment's samples."""

    def rest(self) -> list[tuple[int, float]]:
        rows = list(zip(self.places, self.values, strict=True))
        count = lambda tolerance: sum(1 for _ in kept(self.kind(tolerance), rows))
        low, high = 1e-9, 1.0
        while count(high) > self.target and high <= 1e9:
            high *= 2
        for _ in range(self.halvings):
            middle = 0.5 * (low + high)
            low, high = (middle, high) if count(middle) > self.target else (low, middle)
        middle = 0.5 * (low + high)
        return [(count(middle), middle)] if rows else []


def bracket(least: float, most: float) -> float:
    return float(most - least) + 1e-9


class Halved:
    """Some halvings of a bracket of tolerances in one reading: a fold for each tolerance that they can reach. Its rest is the
    new bracket, as two samples: 0 the lower end, 1 the upper one."""

    def __init__(self, kind: type[Door], target: int, low: float, high: float, depth: int):
        self.target, self.low, self.high, self.depth = target, low, high, depth
        self.folds: dict[float, list] = {}
        self._reach(kind, low, high, depth)

    def _reach(self, kind, low, high, depth) -> None:
        middle = (low + high) / 2
        if depth:
            self.folds[middle] = [kind(middle), 0]
            self._reach(kind, low, middle, depth - 1)
            self._reach(kind, middle, high, depth - 1)

    def push(self, place: int, value: float) -> None:
        for own in self.folds.values():
            own[1] += own[0].push(place, value) is not None

    def rest(self) -> list[tuple[int, float]]:
        low, high = self.low, self.high
        for _ in range(self.depth):
            middle = (low + high) / 2
            fold, count = self.folds[middle]
            low, high = (low, middle) if count + len(fold.rest()) <= self.target else (middle, high)
        return [(0, low), (1, high)]


def kept(fold, rows):
    """Samples that ``fold`` lets out of the samples ``rows``."""
    for place, value in rows:
        if (out := fold.push(place, value)) is not None:
            yield out
    yield from fold.rest()


def bounded_places(x: np.ndarray, capacity: int, overload: int, policy: str, **options) -> list[int]:
    """Places that leave the buffer alive: drained ones in order, then what is left."""
    buffer = Buffer(capacity, overload, policy, **options)
    out = [left[0] for i, v in enumerate(x.tolist()) if (left := buffer.push(i, v)) is not None]
    return out + buffer.places


def evicted_places(x: np.ndarray, capacity: int, policy: str = "interp", **options) -> list[int]:
    """Fill, then evict: a sample is taken before the one to go is chosen, none leaves alive, ``capacity`` remain."""
    return [i for i, _ in kept(Filled(capacity, policy, **options), enumerate(x.tolist()))]


def greedy_places(x: np.ndarray, target: int, area: bool = False) -> list[int]:
    """Remove the sample nearest to its chord (or of least area) until ``target`` are left; ends stay, ties go to the
    older sample."""
    n, x = len(x), x.tolist()
    before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n

    def score(i: int) -> float:
        p, s = before[i], after[i]
        e = abs(x[i] - (x[p] + (i - p) / (s - p) * (x[s] - x[p])))
        return 0.5 * (s - p) * e if area else e

    heap = [(score(i), i) for i in range(1, n - 1)]
    heapq.heapify(heap)
    left = n
    while left > max(2, target) and heap:
        own, i = heapq.heappop(heap)
        if not alive[i] or own != score(i):
            continue
        alive[i], left = False, left - 1
        p, s = before[i], after[i]
        after[p], before[s] = s, p
        for j in (p, s):
            if 0 < j < n - 1:
                heapq.heappush(heap, (score(j), j))
    return [i for i in range(n) if alive[i]]


def lttb_places(x: np.ndarray, target: int) -> list[int]:
    """All samples if ``target`` is not below their number, both ends if it is under 3."""
    return [i for i, _ in kept(Triangles(len(x), target), enumerate(x.tolist()))]


def door_places(x: np.ndarray, tolerance: float) -> list[int]:
    return [i for i, _ in kept(Door(tolerance), enumerate(x.tolist()))]


def piece_places(x: np.ndarray, tolerance: float) -> list[int]:
    return [i for i, _ in kept(Pieces(tolerance), enumerate(x.tolist()))]


def within(x: np.ndarray, target: int, kind: type[Door], halvings: int = HALVINGS) -> list[int]:
    """The run of ``kind`` of least tolerance, by bisection, that keeps at most ``target`` samples."""
    return [i for i, _ in kept(Within(kind, target, halvings), enumerate(x.tolist()))]


def in_sequence(series: DataFrame, *more: str) -> DataFrame:
    """The series with its length ``n`` and place ``nth``, each segment whole and sorted in one partition. The windows ask for
    just that partitioning and order, so a series that is dealt out by segment is not shuffled again."""
    order = Window.partitionBy(*KEYS).orderBy("idx")
    n = F.count(F.lit(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return series.select(*KEYS, "idx", "value", *more, n.alias("n"), F.row_number().over(order).alias("nth"))


def streamed(rows: DataFrame, make, *more: str) -> DataFrame:
    """Survivors of each segment of ``rows`` (from ``in_sequence``) under the folds that ``make(row)`` gives for its first row, a
    tuple of n and the columns ``more``. Their number in the list is ``config``. Memory is the folds' state and some batches."""

    def run(batches):
        names = ("signal_id", "segment", "idx", "value")
        now, folds, out = (), [], []

        def end():
            for i, fold in enumerate(folds):
                out.extend((*now, *left, i) for left in fold.rest())

        def let_out():
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(made, [*names, "config"])

        for batch in batches:
            rest = list(zip(*(batch.column(c).to_pylist() for c in ("n", *more)), strict=True))
            for at, (signal, segment, place, value) in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                if (signal, segment) != now:
                    end()
                    now, folds = (signal, segment), make(rest[at])
                for i, fold in enumerate(folds):
                    if (left := fold.push(place, value)) is not None:
                        out.append((signal, segment, *left, i))
            if len(out) > 8192:
                yield let_out()
        end()
        yield let_out()

    return rows.select(*KEYS, "idx", "value", "n", "nth", *more).mapInArrow(run, f"{SCHEMA}, config int")


def side_by_side(rows: DataFrame, run, *more: str) -> DataFrame:
    """Like ``streamed``, for segments of at most ``WIDE`` samples: ``run(places, values, starts, lengths, more)`` takes about ``ROWS``
    samples of whole segments, the longest segment first, and gives (segment's number, place, value, config) as arrays."""
    least = ROWS

    def results(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held).combine_chunks()
        firsts = np.flatnonzero(table["nth"].to_numpy() == 1)
        firsts = firsts[np.argsort(-table["n"].to_numpy()[firsts], kind="stable")]
        lengths = table["n"].to_numpy()[firsts]
        for segment, place, value, config in run(table["idx"].to_numpy(), table["value"].to_numpy(), firsts, lengths, [table[c].to_numpy()[firsts] for c in more]):
            at = pa.array(firsts[segment])
            for cut in range(0, len(at), 1 << 16):
                own = slice(cut, cut + (1 << 16))
                value_ = value[own] if isinstance(value, pa.Array) else pa.array(value[own], pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [*(table[c].take(at[own]).combine_chunks() for c in KEYS), pa.array(place[own], pa.int64()), value_, pa.array(np.full(len(at[own]), config), pa.int32())],
                    [*KEYS, "idx", "value", "config"],
                )

    def stream(batches):
        held, count = [], 0
        for batch in batches:
            firsts = np.flatnonzero(batch.column("nth").to_numpy() == 1)
            if len(firsts) and count + firsts[-1] >= least:
                held.append(batch.slice(0, int(firsts[-1])))
                yield from results(held)
                batch, held, count = batch.slice(int(firsts[-1])), [], 0
            held.append(batch)
            count += batch.num_rows
        if count:
            yield from results(held)

    return rows.select(*KEYS, "idx", "value", "n", "nth", *more).mapInArrow(stream, f"{SCHEMA}, config int")


def by_width(rows: DataFrame, run, make, *more: str) -> DataFrame:
    """``side_by_side`` for short segments of numbers below ``HUGE``, ``streamed`` for others."""
    own = Window.partitionBy(*KEYS).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    plain = (F.max(F.abs("value")).over(own) < HUGE) & (F.col("n") <= WIDE)  # nan is greater than any number
    marked = rows.withColumn("plain", plain)
    return side_by_side(marked.filter("plain"), run, *more).unionByName(streamed(marked.filter("not plain"), make, *more))


def buffered(places: np.ndarray, values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, capacity: int, overload: int, policy: str = "interp", **options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Survivors (segment's number, place, value) of a ``Buffer`` for each segment, the longest first. All take a sample at a time:
    after as many arrivals all buffers hold as many, so a step is one on a matrix."""
    t, x, held, out = np.zeros((len(starts), capacity)), np.zeros((len(starts), capacity)), 0, []

    def leave(rows: slice, columns: slice) -> None:
        own = t[rows, columns]
        out.append((np.repeat(np.arange(len(starts))[rows], own.shape[1]), own.astype(np.int64).ravel(), x[rows, columns].flatten()))

    def remove(alive: int, at: np.ndarray) -> None:
        stay = np.arange(held - 1) + (np.arange(held - 1) >= at[:, None])
        for a in (t, x):
            a[:alive, : held - 1] = np.take_along_axis(a[:alive, :held], stay, 1)

    for i in range(int(lengths.max(initial=0))):
        alive = int(np.searchsorted(-lengths, -i, side="left"))  # those with more than i samples
        if held == capacity:
            if policy in ("fifo", "middle"):
                at = np.full(alive, 0 if policy == "fifo" else held // 2)
            else:
                scores = importance(policy, t[:alive, :held], x[:alive, :held], **options)
                at = np.where(np.isfinite(scores).any(1), scores.argmin(1), 0)
            remove(alive, at)
            held -= 1
        t[:alive, held], x[:alive, held] = places[starts[:alive] + i], values[starts[:alive] + i]
        held += 1
        if (i + 1) % overload == 0:
            leave(slice(0, alive), slice(0, 1))
            remove(alive, np.zeros(alive, dtype=int))
            held -= 1
        ended = slice(int(np.searchsorted(-lengths, -(i + 1), side="left")), alive)
        leave(ended, slice(0, held))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def scored(places, values, starts, lengths, kept) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """What ``Scored`` gives of each segment, from its survivors: (segment's number, their number, SNR)."""
    segment, place, value = kept
    order = np.lexsort((place, segment))
    segment, place, value = segment[order], place[order], value[order]
    nth = np.repeat(np.arange(len(starts)), lengths)
    offset = np.arange(len(nth)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    i, x = places[np.repeat(starts, lengths) + offset], values[np.repeat(starts, lengths) + offset]
    # survivors before (or at) and after each sample, as places in one sequence of all segments
    low = int(places.min())
    step = int(places.max()) - low + 1
    s = np.searchsorted(segment * step + (place - low), nth * step + (i - low), side="left")
    firsts = np.searchsorted(segment, np.arange(len(starts)), side="left")[nth]
    ends = np.searchsorted(segment, np.arange(len(starts)), side="right")[nth]
    after, before = np.minimum(s, ends - 1), np.maximum(np.minimum(s, ends) - 1, firsts)
    inside = (s > firsts) & (s < ends) & (place[after] != i)
    p, v, q, w = place[before], value[before], place[after], value[after]
    recon = np.where(inside, v + (i - p) / np.where(inside, q - p, 1) * (w - v), w)
    at = np.cumsum(lengths) - lengths
    signal, noise = np.add.reduceat(x * x, at), np.add.reduceat((x - recon) ** 2, at)
    snr = np.where(signal < 1e-15, 0.0, 10 * np.log10(np.maximum(signal, 1e-300) / np.maximum(noise, 1e-300)))
    return np.arange(len(starts)), np.bincount(segment, minlength=len(starts)), pa.array(snr, pa.float64(), mask=(signal >= 1e-15) & (noise < 1e-15))


def halved(places, values, starts, lengths, kind: type[Door], target: np.ndarray, halvings: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``Within`` keeps of each segment, the longest first, a sample of all segments at a time."""
    longest = int(lengths.max(initial=0))
    inside = np.arange(longest) < lengths[:, None]
    at = np.minimum(starts[:, None] + np.arange(longest), len(values) - 1)
    t, x = places[at].T.copy(), values[at].T.copy()  # a row for each place in the segments
    alive = [int(np.searchsorted(-lengths, -i, side="left")) for i in range(longest)]

    def stored(tolerance: np.ndarray) -> np.ndarray:
        """Whether each sample is kept."""
        out = np.zeros((longest, len(starts)), dtype=bool)
        out[0] = True
        from_t, from_x = t[0].copy(), x[0].copy()
        low, high = np.full(len(starts), -np.inf), np.full(len(starts), np.inf)
        for i in range(1, longest):
            own = slice(0, alive[i])
            a, b, lo, hi, tol, last, last_x, now, value = from_t[own], from_x[own], low[own], high[own], tolerance[own], t[i - 1, own], x[i - 1, own], t[i, own], x[i, own]
            moved = last > a
            if kind is Pieces:
                run = np.where(moved, last - a, 1)
                lo[:], hi[:] = np.where(moved, np.maximum(lo, (last_x - tol - b) / run), lo), np.where(moved, np.minimum(hi, (last_x + tol - b) / run), hi)
                slope = (value - b) / (now - a)
                closed = ~((lo <= slope) & (slope <= hi))
                lo[closed], hi[closed] = -np.inf, np.inf
            else:
                run = now - a
                lo[:], hi[:] = np.maximum(lo, (value - tol - b) / run), np.minimum(hi, (value + tol - b) / run)
                closed = (lo > hi) & moved
                run = now[closed] - last[closed]
                lo[closed], hi[closed] = (value[closed] - tol[closed] - last_x[closed]) / run, (value[closed] + tol[closed] - last_x[closed]) / run
            out[i - 1, own] |= closed
            a[closed], b[closed] = last[closed], last_x[closed]
        out[lengths - 1, np.arange(len(starts))] = True
        return out

    low = np.zeros(len(starts))
    high = (np.where(inside, x.T, -np.inf).max(1) - np.where(inside, x.T, np.inf).min(1)) + 1e-9
    for _ in range(halvings):
        middle = (low + high) / 2
        fits = stored(middle).sum(0) <= target
        low, high = np.where(fits, low, middle), np.where(fits, middle, high)
    segment, place = np.nonzero(stored(high).T)
    return segment, t[place, segment], x[place, segment]


def alone(series: DataFrame, make, *more: str) -> DataFrame:
    """Survivors under one fold for each segment."""
    return streamed(in_sequence(series, *more), lambda row: [make(*row)], *more).drop("config")


def bounded(series: DataFrame, capacity: int, overload: int, policy: str = "interp", **options) -> DataFrame:
    return alone(series, lambda n: Buffer(capacity, overload, policy, **options))


def evicted(series: DataFrame, capacity: int, policy: str = "interp", **options) -> DataFrame:
    return alone(series, lambda n: Filled(capacity, policy, **options))


def at_tolerance(series: DataFrame, kind: type[Door], tolerance: float) -> DataFrame:
    """Survivors of ``Door`` or ``Pieces`` at a given tolerance."""
    return alone(series, lambda n: kind(tolerance))


def with_share(series: DataFrame, share: int) -> DataFrame:
    """The series with a ``target`` of its length div ``share``, 2 at least."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*KEYS).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return series.select(*KEYS, "idx", "value", F.greatest(F.lit(2), F.floor(n / share)).alias("target"))


def with_target(series: DataFrame, survivors: DataFrame) -> DataFrame:
    """The series with the number of its ``survivors`` as ``target``; series without survivors are left out."""
    counts = survivors.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("target"))
    return series.join(counts, KEYS).select(*KEYS, "idx", "value", "target")


def greedy_to(rows: DataFrame, area: bool = False) -> DataFrame:
    """Greedy removal down to ``target``. A task holds a whole segment, as each choice is over all that is left."""

    return alone(rows, lambda n, target: Greedy(target, area), "target")


def lttb_to(rows: DataFrame) -> DataFrame:
    return alone(rows, Triangles, "target")


def tolerance_to(rows: DataFrame, kind: type[Door], halvings: int = HALVINGS) -> DataFrame:
    """Survivors of ``kind`` at the least tolerance, by bisection, that keeps at most ``target`` samples."""
    longest = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    sequence = in_sequence(rows, "target")
    run = lambda places, values, starts, lengths, more: [(*halved(places, values, starts, lengths, kind, more[0], halvings), 0)]
    short = by_width(sequence.filter(F.col("n") <= BLOCK), run, lambda row: [Within(kind, row[1], halvings)], "target").drop("config")
    if longest <= BLOCK:
        return short
    long = written(rows.join(rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK), KEYS).drop("n"))
    ends = written(long.groupBy(*KEYS).agg(F.lit(0.0).alias("low"), (F.max("value") - F.min("value") + F.lit(1e-9)).alias("high")))
    for done in range(0, halvings, DEPTH):
        depth = min(DEPTH, halvings - done)
        found = alone(long.join(ends, KEYS), lambda n, target, low, high, depth=depth: Halved(kind, target, low, high, depth), "target", "low", "high")
        new = written(found.groupBy(*KEYS).agg(F.min_by("value", "idx").alias("low"), F.max_by("value", "idx").alias("high")))
        discard(ends)
        ends = new
    return short.unionByName(alone(long.join(ends, KEYS), lambda n, high: kind(high), "high"))


def tuned(rows: DataFrame, kind: type[Door], halvings: int = 60) -> DataFrame:
    """(keys, tolerance, retained): unlike ``tolerance_to``, which returns the upper end of its bracket, the middle, at which a segment may
    keep more than ``target``."""
    return alone(rows, lambda n, target: Tuned(kind, target, halvings), "target").select(*KEYS, F.col("value").alias("tolerance"), F.col("idx").alias("retained"))


def greedy(series: DataFrame, share: int, area: bool = False) -> DataFrame:
    return greedy_to(with_share(series, share), area)


def lttb(series: DataFrame, share: int) -> DataFrame:
    return lttb_to(with_share(series, share))


def swinging_door(series: DataFrame, share: int) -> DataFrame:
    return tolerance_to(with_share(series, share), Door)


def piecewise(series: DataFrame, share: int) -> DataFrame:
    return tolerance_to(with_share(series, share), Pieces)


def at_online_budget(series: DataFrame, capacity: int, overload: int, policy: str = "interp") -> DataFrame:
    """(method, keys, idx, value): survivors of the online buffer and of each offline method that is given the online count
    of the same segment as its budget. Greedy removal and the triangles keep exactly that many; door and segments the most that
    a tolerance allows."""
    online = written(bounded(series, capacity, overload, policy))
    rows = with_target(series, online)
    methods = {"online": online, "greedy_interp": greedy_to(rows), "greedy_area": greedy_to(rows, area=True), "lttb": lttb_to(rows), "door": tolerance_to(rows, Door), "pieces": tolerance_to(rows, Pieces)}
    return reduce(DataFrame.unionByName, [own.select(F.lit(name).alias("method"), *KEYS, "idx", "value") for name, own in methods.items()])


def swept(series: DataFrame, configs: list[dict]) -> DataFrame:
    """Survivors of ``bounded`` under each of ``configs`` (its keyword arguments), with ``config``, the place in the list.
    One shuffle for the whole sweep: a segment meets all configurations in the task that reads it."""
    run = lambda places, values, starts, lengths, _: ((*buffered(places, values, starts, lengths, **c), i) for i, c in enumerate(configs))
    return by_width(in_sequence(series), run, lambda row: [Buffer(**c) for c in configs])


def simplex(parts: int = 10, most: int = 8, least: tuple[float, float, float] = (0.05, 0.0, 0.05)) -> list[tuple[float, float, float]]:
    """Weights in steps of 1 / ``parts`` that add up to 1, the first of at most ``most`` steps; each is raised to its least and all
    are scaled again."""
    out = []
    for a in range(most + 1):
        for b in range(parts - a + 1):
            own = [max(low, w / parts) for low, w in zip(least, (a, b, parts - a - b), strict=True)]
            out.append(tuple(w / sum(own) for w in own))
    return out


def weights_by_kind(series: DataFrame, kinds: DataFrame, capacity: int, overload: int, grid: list[tuple[float, float, float]], policy: str = "composite") -> DataFrame:
    """(kind, alpha, beta, gamma, trials, mean_snr_db): the weights of ``grid`` with the greatest mean SNR over the segments of
    each kind; ``kinds`` has (keys, kind). Exact results are in neither the mean nor its count; of equal means the earlier weights
    win; kinds without a result are left out. One reading of the series serves the whole grid, and no survivor leaves its task."""
    def run(places, values, starts, lengths, _):
        for i, w in enumerate(grid):
            yield *scored(places, values, starts, lengths, buffered(places, values, starts, lengths, capacity, overload, policy, weights=w)), i

    scores = by_width(in_sequence(series), run, lambda row: [Scored(Buffer(capacity, overload, policy, weights=w)) for w in grid])
    means = scores.join(kinds.select(*KEYS, "kind"), KEYS).filter("value is not null").groupBy("kind", "config").agg(F.avg("value").alias("snr"), F.count(F.lit(1)).alias("trials"))
    best = means.groupBy("kind").agg(F.max(F.struct(F.round("snr", 9).alias("snr"), (-F.col("config")).alias("c"), "trials")).alias("b"))
    table = F.array(*[F.array(*map(F.lit, w)) for w in grid])
    w = F.element_at(table, 1 - F.col("b.c"))
    return best.select("kind", *[w[i].alias(name) for i, name in enumerate(("alpha", "beta", "gamma"))], F.col("b.trials").alias("trials"), F.col("b.snr").alias("mean_snr_db"))
