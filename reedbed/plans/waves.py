"""Queries on envelopes, peaks, windows of features, folds of a class and eviction policies, with SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, envelope, folds, rebuild, signals
from ..sources.series import KEYS, read_samples
from .registry import _S, _marked, rounded

#: Samples a second that the queries take the events to have, the band to demodulate and the tone looked for, in Hz.
RATE, BAND, TONE = 64.0, (8.0, 24.0), 8.0
WIDTH = 16
FOLDS = 5
POLICIES = (
    "interp", "area", "span", "lookahead", "interp_composite", "interp_frequency", "first_order", "second_order", "energy", "composite", "geometric", "harmonic",
    "least", "adaptive", "any_step", "low_variance", "fifo", "middle",
)


def _weights(spark, d):
    """Best weights of the composite score for impulsive and for oscillatory series."""
    series = read_samples(spark, d)
    return rounded(folds.weights_by_kind(series, signals.profile(series), 8, 3, folds.simplex()))


def _policies(spark, d):
    """Survivors under every policy, in one pass over the series."""
    kept = folds.swept(read_samples(spark, d), [{"capacity": 8, "overload": 3, "policy": p} for p in POLICIES])
    return kept.select(*KEYS, "idx", "value", F.element_at(F.array(*map(F.lit, POLICIES)), F.col("config") + 1).alias("policy"))


def _diagnosis(spark, d):
    """Peak of the envelope's spectrum near the tone, before and after each reduction."""
    tone = lambda df, by, value: envelope.peak_near(envelope.envelope_spectrum(df, RATE, *BAND, by, value), [*by, "block"], TONE, 0.2)
    own = tone(read_samples(spark, d), KEYS, "value")
    return rounded(envelope.diagnosis(own, tone(rebuild.rebuilt(_marked(spark, d)), rebuild.BY, "recon"), [*KEYS, "block"]))


def _tone(spark, d):
    bins = classify.spectrum_of_blocks(read_samples(spark, d)).withColumn("freq", F.col("k") * RATE / F.col("n"))
    return rounded(envelope.peak_near(bins.withColumn("mag", F.round("mag", 9)), [*KEYS, "block"], TONE, 0.2))


def _bins(spark, d):
    got = classify.bin_features(read_samples(spark, d), WIDTH)
    return rounded(got.withColumn("bins", F.transform("bins", lambda x: F.round(x, 6))))


def queries() -> dict:
    s = read_samples
    return {
        "activity_features": lambda k, d: rounded(classify.activity_features(s(k, d), WIDTH, 50.0)),
        "band_choice": lambda k, d: rounded(envelope.bands(s(k, d), RATE * 200, least=16)),
        "bin_features": _bins,
        "cross_validation": lambda k, d: rounded(classify.cross_validated(k.read.parquet(f"{d}/embeddings.parquet"), FOLDS)),
        "weight_search": _weights,
        "bounded_ranks": lambda k, d: folds.bounded(s(k, d), 8, 3, "ranks"),
        "energy_peaks": lambda k, d: envelope.peaks_by_energy(s(k, d), RATE),
        "envelope_diagnosis": _diagnosis,
        "envelope_spectrum": lambda k, d: rounded(envelope.envelope_spectrum(s(k, d), RATE, *BAND)),
        "fill_then_evict": lambda k, d: folds.evicted(s(k, d), 8),
        "policy_survivors": _policies,
        "tone_peak": _tone,
    }


_WINDOW = f"""w AS (SELECT signal_id, segment, idx // {WIDTH} AS "window", idx % {WIDTH} AS place, value FROM s QUALIFY count(*) OVER (PARTITION BY signal_id, segment, idx // {WIDTH}) = {WIDTH})"""
_BINS = f"""b AS (SELECT signal_id, segment, "window", k, sqrt(pow(sum(value * cos(2 * pi() / {WIDTH} * ((k * place) % {WIDTH}))), 2) + pow(sum(value * sin(2 * pi() / {WIDTH} * ((k * place) % {WIDTH}))), 2)) AS mag
 FROM w, range({WIDTH // 2 + 1}) r(k) GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    return {
        "activity_features": f"""WITH {_S}, {_WINDOW}, {_BINS},
 sd AS (SELECT *, sign(round(value - avg(value) OVER (PARTITION BY signal_id, segment, "window"), 9)) AS side FROM w),
 tn AS (SELECT *, side <> lag(side) OVER (PARTITION BY signal_id, segment, "window" ORDER BY place) AS turn FROM sd),
 t AS (SELECT signal_id, segment, "window", round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, min(value) AS low, max(value) AS high, round(quantile_cont(value, 0.5), 6) AS median,
  round(avg(abs(value)), 6) AS area, round(sum(turn::INT) / {WIDTH}, 6) AS crossings, round(sqrt(avg(value * value)), 6) AS rms, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM tn GROUP BY ALL),
 e AS (SELECT *, mag * mag AS e, k * 50.0 / {WIDTH} AS f FROM b),
 p AS (SELECT *, e / (sum(e) OVER (PARTITION BY signal_id, segment, "window") + 1e-10) AS p FROM e),
 v AS (SELECT signal_id, segment, "window", -(max(CASE WHEN k > 0 THEN {{'m': round(mag, 9), 'f': -f::DOUBLE}} END).f) AS dominant, round(sum(CASE WHEN f < 5 THEN e ELSE 0 END), 6) AS energy_0_5,
  round(sum(CASE WHEN f >= 5 AND f < 10 THEN e ELSE 0 END), 6) AS energy_5_10, round(sum(CASE WHEN f >= 10 AND f < 20 THEN e ELSE 0 END), 6) AS energy_10_20, round(-sum(p * ln(p + 1e-10)), 6) AS entropy FROM p GROUP BY ALL)
 SELECT * FROM t JOIN v USING (signal_id, segment, "window")""",
        "bin_features": f"""WITH {_S}, {_WINDOW}, {_BINS},
 g AS (SELECT signal_id, segment, "window", sqrt(avg(value * value)) AS rms, stddev_pop(value) AS sd, max(abs(value)) AS top, avg(value) AS mu, avg(pow(value, 2)) AS m2, avg(pow(value, 3)) AS m3, avg(pow(value, 4)) AS m4 FROM w GROUP BY ALL),
 l AS (SELECT signal_id, segment, "window", list(round(mag, 6) ORDER BY k) AS bins FROM b WHERE k < {WIDTH // 2} GROUP BY ALL)
 SELECT signal_id, segment, "window", round(rms, 6) AS rms, round(CASE WHEN sd > 1e-9 THEN (m4 - 4 * mu * m3 + 6 * mu * mu * m2 - 3 * pow(mu, 4)) / pow(sd, 4) END, 6) AS kurtosis,
  round(CASE WHEN rms > 0 THEN top / rms END, 6) AS crest, round(sd, 6) AS sd, bins FROM g JOIN l USING (signal_id, segment, "window")""",
        "cross_validation": f"""WITH r AS (SELECT vec_id, label, embedding, ((row_number() OVER (PARTITION BY label, vec_id % 64 ORDER BY vec_id) - 1 + vec_id % 64) % {FOLDS})::INT AS fold FROM embeddings),
 x AS (SELECT vec_id, label, fold, d, embedding[d]::DOUBLE AS x FROM r, range(1, 65) t(d)),
 s AS (SELECT label, fold, d, sum(x) AS s, count(*) AS n FROM x GROUP BY ALL),
 m AS (SELECT j AS fold, label AS c, d, sum(s) FILTER (fold <> j) / sum(n) FILTER (fold <> j) AS m FROM s, range({FOLDS}) t(j) GROUP BY ALL HAVING sum(n) FILTER (fold <> j) > 0),
 q AS (SELECT vec_id, label, fold, c, -round(coalesce(sum(x * m) / nullif(sqrt(sum(x * x)) * sqrt(sum(m * m)), 0), 0), 12) AS far FROM x JOIN m USING (fold, d) GROUP BY ALL),
 b AS (SELECT vec_id, label, fold, c FROM q QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY far, c) = 1)
 SELECT fold, count(*) AS n, round(avg((c = label)::INT), 6) AS accuracy FROM b GROUP BY fold""",
        "tone_peak": f"""WITH {_S}, z AS (SELECT signal_id, segment, idx // 512 AS block, idx % 512 AS place, value, count(*) OVER (PARTITION BY signal_id, segment, idx // 512) AS n FROM s),
 b AS (SELECT signal_id, segment, block, k * {RATE} / n AS freq, round(sqrt(pow(sum(value * cos(2 * pi() / n * ((k * place) % n))), 2) + pow(sum(value * sin(2 * pi() / n * ((k * place) % n))), 2)), 9) AS mag
  FROM z, range(256) r(k) WHERE k < n // 2 GROUP BY signal_id, segment, block, n, k),
 h AS (SELECT *, freq::DOUBLE BETWEEN {TONE} * (1 - 0.2::DOUBLE) AND {TONE} * (1 + 0.2::DOUBLE) AS near, freq BETWEEN {TONE} * 0.5 AND {TONE} * 1.5 AS around FROM b),
 g AS (SELECT signal_id, segment, block, max(CASE WHEN near THEN {{'m': mag, 'f': -freq::DOUBLE}} END) AS top, quantile_cont(CASE WHEN around AND NOT near THEN mag END, 0.5) AS floor FROM h GROUP BY ALL)
 SELECT signal_id, segment, block, round(-(top.f), 6) AS peak_freq, round(top.m, 6) AS peak_mag, round(floor, 6) AS floor, round(CASE WHEN floor > 0 AND top.m > 0 THEN 20 * log10(top.m / floor) END, 6) AS pnr_db FROM g""",
    }
