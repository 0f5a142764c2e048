"""Periodic runs of words by internal pattern matching (Kociumaka et al., 2015).

The texts of a batch are one sequence of word numbers in which no two texts share a number. Ranks of its blocks of 1, 2,
4, ... words come from prefix doubling; only blocks that occur again in their text go on to the next length. The last ranks
give a suffix array, and the places of a block are an interval of it. For each length L, blocks at multiples of L / 2
ask a wavelet tree over the suffix array for their occurrences at distances from 3L/2 - 1 to 3L - 2, in two windows of at
most L places: how many there are, the first, the second and the last. Two occurrences are candidates for a period. Three
or more are an arithmetic progression, whose difference is the period of the block itself; then the ends of the two
stretches with that period around the block and around the progression give the candidates, and where the stretches
meet, each member of the progression is one. Candidates are extended as far as they hold by comparing ranks of blocks, and
the smallest period of each stretch is kept.

A run of smallest period q and ``least`` >= 12 words or more holds a block of L words at a multiple of L / 2 whose copy q words
later lies in the run too, where 3L/2 - 1 <= q <= 3L - 2 (for L = 4 also smaller q), so no run is missed.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import added, table

#: Fewest words of a run, and the shortest blocks that are looked up. A run of 12 words needs blocks of 4.
LEAST, BLOCK = 12, 4
#: Words of the texts that are searched together (a longer text is searched alone).
TOGETHER = 1 << 18


def words_of(text: str | None) -> list[bytes]:
    """Words between blanks, tabs and line ends."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class Places:
    """A wavelet tree over a sequence of numbers below ``2 ** bits``: how many in an interval are small, and which is k-th."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            zero = (values >> bit & 1) == 0
            before = np.concatenate(([0], np.cumsum(zero))).astype(np.int32)
            self.levels.append((bit, before, int(before[-1])))
            values = np.concatenate((values[zero], values[~zero]))

    def below(self, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Numbers below ``limit`` in the intervals [low, high)."""
        count = np.zeros(len(low), dtype=np.int64)
        for bit, before, zeros in self.levels:
            a, b = before[low], before[high]
            one = (limit >> bit & 1) == 1
            count += np.where(one, b - a, 0)
            low, high = np.where(one, zeros + low - a, a), np.where(one, zeros + high - b, b)
        return count

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest number, from 0, of the intervals."""
        out, k = np.zeros(len(low), dtype=np.int64), k.copy()
        for bit, before, zeros in self.levels:
            a, b = before[low], before[high]
            one = k >= b - a
            out += one.astype(np.int64) << bit
            k -= np.where(one, b - a, 0)
            low, high = np.where(one, zeros + low - a, a), np.where(one, zeros + high - b, b)
        return out


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key the number of smaller ones, and how many are equal to it."""
    order = np.argsort(keys, kind="stable")
    own = keys[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(own)), dtype=bool), own[1:] != own[:-1])))
    size = np.diff(np.concatenate((new, [len(own)])))
    rank, many = np.empty(len(keys), dtype=np.int64), np.empty(len(keys), dtype=np.int64)
    rank[order], many[order] = np.repeat(new, size), np.repeat(size, size)
    return rank, many


class Blocks:
    """Ranks of the blocks of 1, 2, 4, ... words of a sequence. Equal blocks have equal ranks; a block that occurs once has a
    negative rank of its own. Longer blocks than any that occurs twice have no level."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.n, alone = n, -1 - np.arange(n + 1)
        level = alone.copy()
        many = np.bincount(words)[words] if n else words
        level[:n] = np.where(many > 1, words, alone[:n])
        self.levels = [level]
        at, length = np.flatnonzero(many > 1), 1
        base = np.zeros(0, dtype=np.int64)
        while len(at):
            after = np.minimum(at + length, n)
            low = level[after]
            fit = low >= 0
            at, after = at[fit], after[fit]
            if not len(at):
                break
            # order by the first half, then by the second one
            first, second = level[at], level[after]
            rank, many = ranked(first * (n + 1) + second)
            stay = many > 1
            nxt = alone.copy()
            length *= 2
            if length == BLOCK:
                base = at[stay]
            nxt[at[stay]] = rank[stay]
            level, at = nxt, at[stay]
            if not len(at):
                break
            self.levels.append(level)
        self._sort(base)

    def _sort(self, places: np.ndarray) -> None:
        """The suffix array of the places whose blocks of ``BLOCK`` words occur again, and the interval of each such block by
        length: the ranks of all lengths, shortest first, order the suffixes."""
        used = self.levels[BLOCK.bit_length() - 1 :]
        keys = [level[places] for level in used]
        order = np.lexsort([places, *keys[::-1]]) if len(places) else places
        self.suffixes = places[order]
        self.intervals = []
        changed = np.zeros(len(places), dtype=bool)
        for key in keys:
            own = key[order]
            if len(own):
                changed = changed.copy()
                changed[0] = True
                changed[1:] |= own[1:] != own[:-1]
            new = np.flatnonzero(changed)
            size = np.diff(np.concatenate((new, [len(own)])))
            start, end = np.full(self.n + 1, 0, dtype=np.int64), np.full(self.n + 1, 0, dtype=np.int64)
            start[self.suffixes], end[self.suffixes] = np.repeat(new, size), np.repeat(new + size, size)
            self.intervals.append((start, end))

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from ``a`` and from ``b`` on (a < b): less than twice the longest block that occurs again."""
        out, a, b = np.zeros(len(a), dtype=np.int64), a.copy(), b.copy()
        for k in reversed(range(len(self.levels))):
            same = self.levels[k][np.minimum(a, self.n)] == self.levels[k][np.minimum(b, self.n)]
            step = np.where(same & (self.levels[k][np.minimum(b, self.n)] >= 0), 1 << k, 0)
            a, b, out = a + step, b + step, out + step
        return out

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree before ``a`` and before ``b`` (a < b)."""
        out, a, b = np.zeros(len(a), dtype=np.int64), a.copy(), b.copy()
        for k in reversed(range(len(self.levels))):
            x, y = a - (1 << k), b - (1 << k)
            level = self.levels[k]
            same = (x >= 0) & (level[np.maximum(x, 0)] == level[np.maximum(y, 0)]) & (level[np.maximum(y, 0)] >= 0)
            step = np.where(same, 1 << k, 0)
            a, b, out = a - step, b - step, out + step
        return out


def stretch(blocks: Blocks, a: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretch of period ``d`` around the words from ``a`` to ``a + d``."""
    return a - blocks.back(a, a + d), a + d + blocks.ahead(a, a + d)


def periods(blocks: Blocks) -> np.ndarray:
    """Candidates (place, period) in two rows."""
    places = blocks.suffixes
    if not len(places):
        return np.zeros((2, 0), dtype=np.int64)
    tree = Places(places, int(blocks.n).bit_length())
    found = []
    for k, (start, end) in enumerate(blocks.intervals):
        length = BLOCK << k
        at = np.sort(places[places % (length // 2) == 0])
        at = at[end[at] - start[at] > 1]
        if not len(at):
            continue
        nearest, farthest = (1 if k == 0 else 3 * length // 2 - 1), 3 * length - 2
        edges = [*range(nearest, farthest + 1, length), farthest + 1]
        counts = [tree.below(start[at], end[at], np.minimum(at + edge, blocks.n)) for edge in edges]
        for before, until in zip(counts, counts[1:], strict=False):
            x, y, many = start[at], end[at], until - before
            some = many > 0
            own, x, y, before, many = at[some], x[some], y[some], before[some], many[some]
            if not len(own):
                continue
            first = tree.kth(x, y, before)
            found.append((own, first - own))
            two = many > 1
            own, x, y, before, many, first = own[two], x[two], y[two], before[two], many[two], first[two]
            if not len(own):
                continue
            second = tree.kth(x, y, before + 1)
            pair = many == 2
            found.append((own[pair], second[pair] - own[pair]))
            own, first, step, many = own[~pair], first[~pair], (second - first)[~pair], many[~pair]
            if len(own):
                found += progressions(blocks, own, first, step, many)
    a = np.concatenate([p for p, _ in found]) if found else np.zeros(0, dtype=np.int64)
    d = np.concatenate([p for _, p in found]) if found else np.zeros(0, dtype=np.int64)
    fit = d > 0
    return np.stack((a[fit], d[fit]))


def progressions(blocks: Blocks, own: np.ndarray, first: np.ndarray, step: np.ndarray, many: np.ndarray):
    """Candidates of blocks at ``own`` that occur at first, first + step, ... (``many`` times)."""
    s, e = stretch(blocks, own, step)
    t, f = stretch(blocks, first, step)
    last = first + (many - 1) * step - own
    out = [(own, step)]
    for d in (t - s, f - e):
        fit = (d >= first - own) & (d <= last)
        out.append((own[fit], d[fit]))
    # the two stretches overlap by less than one step: every member that both can hold is a period
    meet = (e >= t) & (e - t < step) & (t > s)
    limit = np.minimum(np.minimum(e - s, f - t), (f - s) // 2)
    held = np.where(meet, np.clip((np.minimum(limit, last) - (first - own)) // step + 1, 0, many), 0)
    row = np.repeat(np.arange(len(own)), held)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held)
    out.append((own[row], (first - own)[row] + nth * step[row]))
    return out


def runs_of(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The runs (start, length, period in rows) of a sequence of numbers from 0, by start, then period: stretches of smallest
    period q with at least max(``least``, 2q) words that are as long as that period holds. ``least`` is 12 or more."""
    blocks = Blocks(words)
    a, d = np.unique(periods(blocks), axis=1)
    start, end = stretch(blocks, a, d)
    length = end - start
    fit = length >= np.maximum(least, 2 * d)
    start, length, d = start[fit], length[fit], d[fit]
    order = np.lexsort((d, length, start))
    start, length, d = start[order], length[order], d[order]
    new = np.concatenate((np.ones(min(1, len(start)), dtype=bool), (start[1:] != start[:-1]) | (length[1:] != length[:-1])))
    start, length, d = start[new], length[new], d[new]
    order = np.lexsort((d, start))
    return np.stack((start[order], length[order], d[order]))


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in a run after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, runs[0] + runs[2], 1)
    np.add.at(edge, runs[0] + runs[1], -1)
    return np.cumsum(edge[:n]) > 0


def numbered(texts: list[list[bytes]], tails: list[tuple[int, int] | None]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Word numbers of the texts in one sequence, no number in two texts; where each text starts; and the places of the words of
    texts with a ``tail`` (start, period): from there on the words repeat."""
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    words = np.empty(starts[-1], dtype=np.int64)
    held, top = [], 0
    for i, (own, tail) in enumerate(zip(texts, tails, strict=True)):
        seen = {w: j for j, w in enumerate(dict.fromkeys(own))}
        ids = np.fromiter(map(seen.__getitem__, own), dtype=np.int64, count=len(own))
        place = None
        if tail is not None and len(own):
            place = np.arange(len(own))
            place[tail[0] :] = tail[0] + (place[tail[0] :] - tail[0]) % tail[1]
            ids = ids[place]
        held.append(place)
        words[starts[i] : starts[i + 1]] = ids + top
        top += len(seen)
    return words, starts, held


def tail_of(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The tail that the query plants in the text of a document: (start, period)."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    start = g % n
    return start, 1 + (n - start) // (3 + g % 8)


RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def searched(texts: list[list[bytes]], tails=None):
    """For each text its runs and the words that stay, as (runs, words)."""
    words, starts, held = numbered(texts, tails or [None] * len(texts))
    runs = runs_of(words)
    cut = np.searchsorted(runs[0], starts)
    for i, own in enumerate(texts):
        mine = runs[:, cut[i] : cut[i + 1]] - np.array([[starts[i]], [0], [0]])
        if held[i] is not None:
            own = [own[j] for j in held[i].tolist()]
        if mine.shape[1]:
            own = [own[j] for j in np.flatnonzero(~dropped(len(own), mine)).tolist()]
        yield mine, own


def in_batches(texts: list[list[bytes]], size: int = TOGETHER):
    """Ranges of texts of about ``size`` words together."""
    first, words = 0, 0
    for i, t in enumerate(texts):
        if words and words + len(t) > size:
            yield first, i
            first, words = i, 0
        words += len(t)
    if first < len(texts):
        yield first, len(texts)


def greatest(runs: np.ndarray) -> tuple:
    """Start, length, period and thousandths of the exponent of the longest run (ties: smallest start, then period)."""
    if not runs.shape[1]:
        return None, None, None, None
    at = int(np.lexsort((runs[2], runs[0], -runs[1]))[0])
    start, length, period = (int(x) for x in runs[:, at])
    return start, length, period, 1000 * length // period


def periodic_runs(docs: DataFrame, text: str = "text", out: str = "periodic") -> DataFrame:
    """``docs`` with a struct ``out``: n_runs; start, length, period and exponent_milli of the longest run (null without one); all
    runs; and the text without the words that repeat a run's first period.

    Words are what lies between blanks, tabs and line ends. A null or empty text has no run and an empty collapsed text;
    a text of any length is searched whole. Repeated rows and other columns pass as they are; a column named ``out`` is refused.
    """
    @F.pandas_udf(RESULT)
    def search(texts: pd.Series) -> pd.DataFrame:
        rows, own = [], [words_of(t) for t in texts]
        for a, b in in_batches(own):
            for runs, kept in searched(own[a:b]):
                rows.append((runs.shape[1], *greatest(runs), [{"start": s, "length": n, "period": p} for s, n, p in runs.T.tolist()], b" ".join(kept).decode("utf-8", "surrogatepass")))
        frame = pd.DataFrame(rows, columns=["n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"])
        return frame.astype({c: "Int64" for c in ("n_runs", "start", "length", "period", "exponent_milli")})

    return added(docs, out, search(docs[text]))


def digests(docs: DataFrame) -> DataFrame:
    """The query's rows: each document's text with the tail that its identifier plants, its runs as digests."""
    arrow = pa.schema([(n, pa.string() if n.endswith("256") else pa.int64()) for n in (c.split()[0] for c in DIGEST.split(", "))])

    def search(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = batch.slice(at, 256)
                ids, texts = own.column("doc_id").to_pylist(), [words_of(t) for t in own.column("text").to_pylist()]
                rows = []
                for a, b in in_batches(texts):
                    tails = [tail_of(i, len(t)) for i, t in zip(ids[a:b], texts[a:b], strict=True)]
                    for i, (runs, kept) in zip(ids[a:b], searched(texts[a:b], tails), strict=True):
                        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs.T.tolist())
                        rows.append((i, runs.shape[1], *greatest(runs), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, DIGEST)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
