"""Whole texts scored through their words.

The scorers of this package are sums over a text's words, so each worker keeps a table from word to
value, computes the values of new words in batches with numpy, and sums rows of that table per text.
The table is a cache only: it is emptied when it has grown past ``limit`` words, which changes no result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Sequence

import numpy as np

LETTERS = re.compile(r"[^\W\d_]+")
WORDS = re.compile(r"\w+")
#: Words summed at once, and new words whose values are computed at once.
RUN, FILL = 1 << 18, 1 << 13


_HELD: dict[object, object] = {}


def held(key: object, make: Callable[[], object]):
    """A worker's cache under ``key``. A worker holds one cache at a time: workers live on from stage to stage, and the
    caches of different models would add up."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


class WordTable(dict):
    def __init__(self, compute: Callable[[list[str]], np.ndarray], limit: int = 250_000):
        super().__init__()
        self.compute, self.limit = compute, limit
        self.pending: list[str] = []
        self.rows: np.ndarray | None = None
        self.filled = 0

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.pending.append(word)
        return row

    def sums(self, texts: Iterable[Sequence[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: the sum of its words' rows, and how many words it has. Texts are summed in runs of about ``RUN``
        words, and the table is emptied between runs, so the memory does not grow with the batch."""
        found, counts, index, own = [], [], array("i"), []
        for words in texts:
            index.extend(map(self.__getitem__, words))
            own.append(len(words))
            if len(index) >= RUN:
                found.append(self._sum(index, own))
                counts += own
                index, own = array("i"), []
        found.append(self._sum(index, own))
        width = max(f.shape[1] for f in found)
        return np.concatenate([np.pad(f, ((0, 0), (0, width - f.shape[1]))) for f in found]), np.array(counts + own, dtype=np.int64)

    def _sum(self, index: array, counts: list[int]) -> np.ndarray:
        for at in range(0, len(self.pending), FILL):
            self._fill(self.pending[at : at + FILL])
        self.pending = []
        out = segment_sums(self.rows, np.frombuffer(index, dtype=np.int32), np.array(counts, dtype=np.int64))
        if len(self) > self.limit:
            self.clear()
            self.filled = 0
        return out

    def _fill(self, words: list[str]) -> None:
        new = np.asarray(self.compute(words), dtype=np.float64).reshape(len(words), -1)
        need = self.filled + len(new)
        if self.rows is None or need > len(self.rows):
            grown = np.zeros((max(1024, 3 * need // 2), new.shape[1]))
            if self.rows is not None:
                grown[: self.filled] = self.rows[: self.filled]
            self.rows = grown
        self.rows[self.filled : need] = new
        self.filled = need


def segment_sums(rows: np.ndarray | None, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if rows is None:
        return np.zeros((len(counts), 1))
    out = np.zeros((len(counts), rows.shape[1]))
    starts = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.zeros(0, dtype=np.int64)
    full = counts > 0
    if full.any():
        for column in range(rows.shape[1]):
            out[full, column] = np.add.reduceat(rows[index, column], starts[full])
    return out
