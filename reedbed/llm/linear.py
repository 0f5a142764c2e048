"""Linear models over hashed features, fitted by iterative parameter averaging.

Each round, every partition starts from the current parameters, runs some epochs of Adagrad over its rows
and returns the parameters that it moved; Spark sums the moves, weighted by row count. What reaches the driver per
round is at most one number for each parameter, whatever the input and its partitions. (McDonald et al., 2010.)
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: loss(scores, targets, extras) -> d loss / d score per row, d loss / d extras
Loss = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def epochs_over(rows, weights, extras, loss: Loss, epochs: int, rate: float, l1: float, batch: int = 64):
    """``rows``: (indices, values, target) each; returns new weights and extras."""
    weights, extras = weights.astype(np.float64), extras.astype(np.float64)
    squares, extra_squares = np.full(len(weights), 1e-8), np.full(len(extras), 1e-8)
    batches = []
    for at in range(0, len(rows), batch):
        some = rows[at : at + batch]
        index = np.concatenate([r[0] for r in some]) if some else np.zeros(0, dtype=np.int64)
        value = np.concatenate([r[1] for r in some])
        row = np.repeat(np.arange(len(some)), [len(r[0]) for r in some])
        own, inverse = np.unique(index, return_inverse=True)
        batches.append((own, inverse, value, row, np.array([r[2] for r in some])))
    for _ in range(epochs):
        for own, inverse, value, row, target in batches:
            score = np.bincount(row, weights=weights[own][inverse] * value, minlength=len(target))
            slope, extra_slope = loss(score, target, extras)
            gradient = np.bincount(inverse, weights=slope[row] * value, minlength=len(own)) / len(target)
            squares[own] += gradient**2
            step = rate / np.sqrt(squares[own])
            moved = weights[own] - step * gradient
            weights[own] = np.sign(moved) * np.maximum(0, np.abs(moved) - step * l1)
            extra_squares += extra_slope**2
            extras = extras - rate * extra_slope / np.sqrt(extra_squares)
    return weights, extras


def fit(rows: DataFrame, dim: int, extras: np.ndarray, loss: Loss, rounds: int = 3, epochs: int = 6, rate: float = 0.3, l1: float = 0.0):
    """``rows``: idx array<int>, val array<float>, target double, already in a bounded number of partitions
    and cut from its lineage. Returns the averaged weights and extras (as given, where there are no rows)."""
    context = rows.sparkSession.sparkContext
    weights, extras = np.zeros(dim), np.asarray(extras, dtype=np.float64)
    for _ in range(rounds):
        weights = weights.astype(np.float32).astype(np.float64)
        current = context.broadcast((weights.astype(np.float32), extras))

        def part(batches):
            own = []
            for b in batches:
                index, value, target = b.column("idx"), b.column("val"), b.column("target").to_numpy(zero_copy_only=False)
                own += [(index[i].values.to_numpy().astype(np.int64), value[i].values.to_numpy(), target[i]) for i in range(b.num_rows)]
            if own:
                w, e = epochs_over(own, *current.value, loss, epochs, rate, l1)
                step = w - current.value[0]
                moved = np.flatnonzero(step)
                # rows below 0: the number of rows, then the extras' steps
                index = np.concatenate((moved, -1 - np.arange(1 + len(e))))
                value = np.concatenate((step[moved], [1.0], e - current.value[1])) * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(value)], ["i", "step"])

        found = rows.select("idx", "val", "target").mapInArrow(part, "i long, step double").groupBy("i").agg(F.sum("step").alias("step")).toArrow()
        current.destroy()
        index, step = found.column("i").to_numpy(), found.column("step").to_numpy()
        if not len(index):
            break
        step = step / step[index == -1][0]
        weights[index[index >= 0]] += step[index >= 0]
        extras = extras.copy()
        extras[-2 - index[index < -1]] += step[index < -1]
    return weights, extras
