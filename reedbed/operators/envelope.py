"""Envelopes of band-passed series: spectrum, peak near a frequency, diagnosis after reduction, blind choice of a band.

A transform runs in numpy on blocks of ``size`` samples of a series, so memory has a bound whatever the length of the series; a
task reads its blocks as one stream and transforms those of equal length side by side, as a call for each would cost more than
its work. A block shorter than ``least`` samples gives no row. The band-pass is the squared magnitude of a
digital Butterworth filter (bilinear, pre-warped), the gain of a forward and backward pass without its edge padding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.series import KEYS

#: Hz; the widest band is the best one only if no other has as much kurtosis.
CENTRES = range(500, 5501, 250)
WIDTHS = (500, 1000, 1500, 2000, 3000)
#: Samples that a task transforms at a time, or one block.
ROWS = 1 << 17


def band_gain(n: int, rate: float, low: float, high: float, order: int) -> np.ndarray:
    """Gain of each bin of a real transform of ``n`` samples."""
    low, high = np.tan(np.pi * low / rate), np.tan(np.pi * min(high, 0.495 * rate) / rate)
    w = np.tan(np.pi * np.minimum(np.arange(n // 2 + 1) / n, 0.4999999))
    out = np.zeros(len(w))
    out[1:] = 1 / (1 + ((w[1:] ** 2 - low * high) / ((high - low) * w[1:])) ** (2 * order))
    return out


def band_passed(x: np.ndarray, rate: float, low: float, high: float, order: int) -> np.ndarray:
    return np.fft.irfft(np.fft.rfft(x) * band_gain(len(x), rate, low, high, order), len(x))


def envelope(x: np.ndarray, rate: float, low: float, high: float, order: int = 4) -> np.ndarray:
    """Magnitude of the analytic signal of the band, along the last axis."""
    return _enveloped(np.fft.rfft(x), x.shape[-1], band_gain(x.shape[-1], rate, low, high, order))


def _enveloped(bins: np.ndarray, n: int, gain: np.ndarray) -> np.ndarray:
    half = np.zeros((*bins.shape[:-1], n), dtype=complex)
    half[..., : n // 2 + 1] = bins * gain
    half[..., 1 : (n + 1) // 2] *= 2
    return np.abs(np.fft.ifft(half))


def envelope_bins(x: np.ndarray, rate: float, low: float, high: float) -> np.ndarray:
    e, w = envelope(x, rate, low, high), np.hanning(x.shape[-1])
    return np.abs(np.fft.rfft((e - e.mean(-1, keepdims=True)) * w)) * (2 / w.sum())


def best_bands(x: np.ndarray, rate: float, centres=CENTRES, widths=WIDTHS) -> np.ndarray:
    """For each row (low, high, kurtosis) of the band whose envelope has the largest excess kurtosis; the first of equal ones, nan
    for a flat row."""
    out, n = np.full((len(x), 3), np.nan), x.shape[-1]
    bins = np.fft.rfft(x)
    for width in widths:
        for centre in centres:
            low, high = centre - width / 2, centre + width / 2
            if low < 100 or high > 0.495 * rate:
                continue
            e = _enveloped(bins, n, band_gain(n, rate, low, high, 4))
            e = e - e.mean(-1, keepdims=True)
            second = (e * e).mean(-1)
            varied = second > 1e-18
            kurtosis = (e**4).mean(-1) / np.where(varied, second, 1) ** 2 - 3
            better = varied & ~(kurtosis <= out[:, 2])
            out[better] = np.stack([np.full(len(x), low), np.full(len(x), high), kurtosis], axis=1)[better]
    return out


def best_band(x: np.ndarray, rate: float, centres=CENTRES, widths=WIDTHS) -> tuple[float, float, float] | None:
    """``best_bands`` of one series; None if it is flat."""
    best = best_bands(x[None, :], rate, centres, widths)[0]
    return None if np.isnan(best[0]) else tuple(best.tolist())


def energy_peaks(x: np.ndarray, rate: float, low: float = 5.0, high: float = 15.0, width: float = 0.12, apart: float = 0.2, share: float = 0.3) -> list[int]:
    """Peaks of the moving mean of the squared band (``width`` seconds): strict local tops (of a plateau its middle) of at
    least ``share`` of the mean; of those nearer than ``apart`` seconds the taller, of equal ones the later."""
    span = max(1, int(width * rate))
    y = np.convolve(band_passed(x, rate, low, high, 2) ** 2, np.ones(span) / span, mode="same")
    edges = np.flatnonzero(np.diff(y)) + 1  # where a run of equal values starts
    starts, ends = np.concatenate(([0], edges)), np.concatenate((edges - 1, [len(y) - 1]))
    top = [(int(a) + int(b)) // 2 for a, b in zip(starts[1:-1], ends[1:-1], strict=True) if y[a] > y[a - 1] and y[b] > y[b + 1]]
    top = [i for i in top if y[i] >= share * y.mean()]
    taken: list[int] = []
    for i in sorted(top, key=lambda i: (y[i], i), reverse=True):
        if all(abs(i - j) >= int(apart * rate) for j in taken):
            taken.append(i)
    return sorted(taken)


def _by_block(series: DataFrame, by: list[str], value: str, size: int, least: int, schema: str, transform) -> DataFrame:
    """``transform(values)`` gives, for blocks of one length as rows of a matrix, the number of each row's results and the columns of
    ``schema``, row after row."""
    types, most = dict(series.dtypes), ROWS
    names = [*by, "block"]
    rows = series.select(*by, F.floor(F.col("idx") / size).alias("block"), "idx", F.col(value).alias("v")).filter("v is not null")
    order = Window.partitionBy(*names).orderBy("idx")
    n = F.count(F.lit(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.select(*names, "v", n.alias("n"), F.row_number().over(order).alias("nth")).filter(F.col("n") >= least)

    def results(held: list[pa.RecordBatch]):
        """Of the whole blocks held."""
        table = pa.Table.from_batches(held).combine_chunks()
        v, lengths = table["v"].to_numpy(), table["n"].to_numpy()
        starts = np.flatnonzero(table["nth"].to_numpy() == 1)
        for length in np.unique(lengths[starts]).tolist():
            own = starts[lengths[starts] == length]
            counts, columns = transform(v[own[:, None] + np.arange(length)])
            at = pa.array(np.repeat(own, counts))
            out = [*(table[c].take(at).combine_chunks() for c in names), *map(pa.array, columns)]
            yield pa.RecordBatch.from_arrays(out, [*names, *(c.split()[0] for c in schema.split(", "))])

    def run(batches):
        held, count = [], 0
        for batch in batches:
            firsts = np.flatnonzero(batch.column("nth").to_numpy() == 1)
            if len(firsts) and count + firsts[-1] >= most:
                held.append(batch.slice(0, int(firsts[-1])))
                yield from results(held)
                batch, held, count = batch.slice(int(firsts[-1])), [], 0
            held.append(batch)
            count += batch.num_rows
        if count:
            yield from results(held)

    return rows.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in by), "block bigint", schema]))


def envelope_spectrum(series: DataFrame, rate: float, low: float, high: float, by: list[str] = KEYS, value: str = "value", size: int = 4096, least: int = 8) -> DataFrame:
    """(by, block, k, freq, mag): bins of the envelope's spectrum, Hann-windowed, without its mean."""

    def bins(x: np.ndarray) -> tuple:
        mag = envelope_bins(x, rate, low, high)
        k = np.tile(np.arange(mag.shape[1]), len(x))
        return np.full(len(x), mag.shape[1]), (k, k * (rate / x.shape[1]), mag.ravel())

    return _by_block(series, by, value, size, least, "k bigint, freq double, mag double", bins)


def bands(series: DataFrame, rate: float, by: list[str] = KEYS, value: str = "value", size: int = 4096, least: int = 8, centres=CENTRES, widths=WIDTHS) -> DataFrame:
    """(by, block, low, high, kurtosis): the band chosen without knowledge of a fault; none for a flat block."""

    def choose(x: np.ndarray) -> tuple:
        best = best_bands(x, rate, centres, widths)
        found = ~np.isnan(best[:, 0])
        return found.astype(int), tuple(best[found].T.copy())

    return _by_block(series, by, value, size, least, "low double, high double, kurtosis double", choose)


def peaks_by_energy(series: DataFrame, rate: float, by: list[str] = KEYS, value: str = "value", size: int = 65536, least: int = 8) -> DataFrame:
    """(by, block, place): ``energy_peaks`` of each block; places count from the start of the series."""

    def peaks(x: np.ndarray) -> tuple:
        found = [energy_peaks(own, rate) for own in x]
        return np.array([len(f) for f in found]), (np.array([i for f in found for i in f], dtype=np.int64),)

    found = _by_block(series, by, value, size, least, "place bigint", peaks)
    return found.withColumn("place", F.col("block") * size + F.col("place"))


def peak_near(spectrum: DataFrame, by: list[str], f0: Column | float, share: float = 0.05) -> DataFrame:
    """(by, peak_freq, peak_mag, floor, pnr_db): largest bin within ``share`` of ``f0`` (the lower of equal ones) and its
    ratio to the median of the bins of 0.5 to 1.5 ``f0`` outside. Null without such bins or with a floor of 0."""
    f0 = f0 if isinstance(f0, Column) else F.lit(float(f0))
    near = F.col("freq").between(f0 * (1 - share), f0 * (1 + share))
    around = F.col("freq").between(f0 * 0.5, f0 * 1.5) & ~near
    g = spectrum.groupBy(*by).agg(
        F.max(F.when(near, F.struct(F.col("mag").alias("m"), (-F.col("freq")).alias("f")))).alias("top"), F.percentile(F.when(around, F.col("mag")), 0.5).alias("floor"),
    )
    return g.select(*by, (-F.col("top.f")).alias("peak_freq"), F.col("top.m").alias("peak_mag"), "floor", F.when((F.col("floor") > 0) & (F.col("top.m") > 0), 20 * F.log10(F.col("top.m") / F.col("floor"))).alias("pnr_db"))


def diagnosis(known: DataFrame, rebuilt: DataFrame, by: list[str], freq_ok: float = 1.0, pnr_ok: float = 6.0) -> DataFrame:
    """``rebuilt``'s rows of ``peak_near`` against those of the series itself: freq_error, amp_error_pct, pnr_loss and
    whether the peak is still found (``diagnosable``; false without a peak)."""
    own = known.select(*by, F.col("peak_freq").alias("f__"), F.col("peak_mag").alias("a__"), F.col("pnr_db").alias("p__"))
    far = F.abs(F.col("peak_freq") - F.col("f__"))
    sound = F.coalesce((far <= freq_ok) & (F.col("pnr_db") >= pnr_ok), F.lit(False))
    error = F.when(F.col("a__") > 0, 100 * F.abs(F.col("peak_mag") - F.col("a__")) / F.col("a__"))
    return rebuilt.join(own, by).select(*rebuilt.columns, far.alias("freq_error"), error.alias("amp_error_pct"), (F.col("p__") - F.col("pnr_db")).alias("pnr_loss"), sound.alias("diagnosable")).drop("floor")
