"""Queries that report on results and signals, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, folds, rebuild, results, signals
from ..sources.series import KEYS, read_samples
from ..streaming import bounded
from .registry import _BASE, _GAPS, _M, _N, _S, _SPEC, _marked, _metrics, _pairs, rounded

NAMES = ["stride", "linspace", "keep_last", "top_ie"]
EDGES = [1.0, 3.0, 4.0, 5.0, 10.0]


def _points(spark, d):
    return _metrics(spark, d).select(*KEYS, "method", F.round("ratio", 6).alias("ratio"), F.round("mse", 6).alias("mse"))


def _curve(spark, d):
    return results.band_curve(_metrics(spark, d), "method", "ratio", "snr_db", EDGES)


def _gaps(spark, d):
    order = rebuild.Window.partitionBy(*rebuild.BY).orderBy("idx")
    return _marked(spark, d).filter("kept").select(*rebuild.BY, (F.col("idx") - F.lag("idx").over(order)).alias("gap"))


def _trials(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_linenumber", "l_orderkey", "l_returnflag")
    return results.distinct_trials(lines, ["l_suppkey", "l_linenumber"], "l_orderkey", "l_returnflag")


def _bin_errors(spark, d):
    r = rebuild.rebuilt(_marked(spark, d)).filter("method = 'top_ie'")
    own, other = (classify.spectrum(r.select(*KEYS, "idx", F.col(c).alias("value")), 32) for c in ("value", "recon"))
    return signals.bin_errors(own, other)


def _two_spectra(spark, d):
    """Spectra of blocks of the series (a) and of its reconstruction by top_ie (b), bin by bin."""
    r = rebuild.rebuilt(_marked(spark, d)).filter("method = 'top_ie'")
    own, other = (classify.spectrum_of_blocks(r.select(*KEYS, "idx", F.col(c).alias("value"))).withColumnRenamed("mag", n) for c, n in (("value", "a"), ("recon", "b")))
    return own.join(other, [*KEYS, "block", "n", "k"])


def _correlation_of_blocks(spark, d):
    g = _two_spectra(spark, d).groupBy(*KEYS, "block", "n").agg(F.corr("a", "b").alias("r"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"))
    return g.select(*KEYS, "block", "n", F.when((F.col("sa") > 1e-12) & (F.col("sb") > 1e-12), F.round("r", 6)).alias("spectral_corr"))


def _errors_of_blocks(spark, d):
    error = F.abs(F.col("a") - F.col("b"))
    return _two_spectra(spark, d).select(*KEYS, "block", "n", "k", error.alias("abs_error"), F.when(F.col("a") > 1e-10, error / F.col("a")).otherwise(0.0).alias("rel_error"))


def _sums_of_blocks(spark, d):
    whole = classify.spectrum_of_blocks(read_samples(spark, d))
    return whole.groupBy(*KEYS, "block", "n", F.floor(F.col("k") / 4).alias("band")).agg(F.sum("mag").alias("total"))


#: Each as the whole signal (blocks of 512 samples and the shorter rest) and as its first min(N, 512) samples.
_BLOCKS = {"spectrum": lambda k, d: classify.spectrum_of_blocks(read_samples(k, d)), "spectral_correlation": _correlation_of_blocks, "bin_errors": _errors_of_blocks, "band_sums": _sums_of_blocks}


def _blocks(name, first):
    return lambda k, d: rounded(_BLOCKS[name](k, d).filter("block = 0").drop("block") if first else _BLOCKS[name](k, d))


def _sweep(spark, d):
    """Mean SNR of the span policy by exponent and capacity, and the best exponent for each capacity."""
    series = read_samples(spark, d)
    configs = [{"capacity": c, "overload": 3, "policy": "span", "beta": b} for c in (8, 16) for b in (0.0, 0.5, 1.0)]
    kept = folds.swept(series, configs)
    named = series.crossJoin(F.broadcast(spark.createDataFrame([(i, c["capacity"], c["beta"]) for i, c in enumerate(configs)], "config int, capacity int, beta double")))
    marked = named.join(kept.select(*KEYS, "idx", "config", F.lit(True).alias("hit")), [*KEYS, "idx", "config"], "left").withColumn("kept", F.coalesce("hit", F.lit(False)))
    m = rebuild.metrics(rebuild.rebuilt(marked.withColumn("method", F.col("config").cast("string"))))
    g = m.filter("snr_db is not null").groupBy("method").agg(F.avg("snr_db").alias("snr"))
    table = spark.createDataFrame([(str(i), c["capacity"], c["beta"]) for i, c in enumerate(configs)], "method string, capacity int, beta double")
    best = g.join(F.broadcast(table), "method").groupBy("capacity").agg(F.max(F.struct("snr", "beta")).alias("b"))
    return best.select("capacity", F.col("b.beta").alias("beta"), F.round("b.snr", 6).alias("mean_snr_db"))


def queries() -> dict:
    s = read_samples
    return {
        "breakdown": lambda k, d: rounded(results.breakdown(_metrics(k, d), ["method", "segment"], "mse")),
        "method_pivot": lambda k, d: rounded(results.pivoted(_metrics(k, d), "segment", "method", NAMES, "mse")),
        "band_curve": lambda k, d: rounded(_curve(k, d)),
        "best_in_band": lambda k, d: rounded(results.best_in_band(_curve(k, d), "method")),
        "two_level_mean": lambda k, d: rounded(results.two_level(_pairs(k, d), "signal_id")),
        "distinct_trials": _trials,
        "per_signal": lambda k, d: rounded(results.per_signal(_metrics(k, d), ["signal_id", "method"], "mse")),
        "audit": lambda k, d: results.audit(_metrics(k, d), "method", "snr_db", "degenerate"),
        "gap_p95": lambda k, d: results.ranked_value(_gaps(k, d), rebuild.BY, "gap", 0.95),
        "ideal_distance": lambda k, d: rounded(results.ideal_distance(_points(k, d), KEYS, "ratio", "mse")),
        "substitution_rate": lambda k, d: rounded(results.substitution(_points(k, d), KEYS, "method", "ratio", "mse")),
        "front_share": lambda k, d: rounded(results.front_share(_points(k, d), KEYS, "method", "ratio", "mse")),
        "place_costs": lambda k, d: rounded(signals.place_costs(_marked(k, d))),
        "quantisation": lambda k, d: rounded(signals.quantisation_snr(s(k, d))),
        "signal_profile": lambda k, d: rounded(signals.profile(s(k, d))),
        "time_features": lambda k, d: rounded(signals.time_features(s(k, d), 16)),
        "band_sums": lambda k, d: rounded(signals.band_sums(classify.spectrum(s(k, d), 32), 4)),
        "bin_errors": lambda k, d: rounded(_bin_errors(k, d)),
        "standardised": lambda k, d: rounded(signals.standardised(k.read.parquet(f"{d}/embeddings.parquet"))),
        "gap_counts": lambda k, d: signals.gap_counts(_marked(k, d)),
        "piecewise_linear": lambda k, d: folds.piecewise(s(k, d), 4),
        "span_sweep": _sweep,
        "stream_bounded_interp": lambda k, d: bounded.replayed(s(k, d), 8, 3),
    } | {f"{name}_{form}": _blocks(name, form == "512") for name in _BLOCKS for form in ("whole", "512")}


_P = "p AS (SELECT signal_id, segment, method, round(ratio, 6) AS ratio, round(mse, 6) AS mse FROM mt)"
_F = "f AS (SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.signal_id = a.signal_id AND b.segment = a.segment AND b.ratio >= a.ratio AND b.mse <= a.mse AND (b.ratio > a.ratio OR b.mse < a.mse)))"
_B = """bd AS (SELECT method, snr_db, CASE WHEN ratio > 1 AND ratio <= 3 THEN 0 WHEN ratio > 3 AND ratio <= 4 THEN 1 WHEN ratio > 4 AND ratio <= 5 THEN 2 WHEN ratio > 5 AND ratio <= 10 THEN 3 END AS band FROM mt WHERE snr_db IS NOT NULL),
 cv AS (SELECT method, band, count(*) AS n, avg(snr_db) AS mean, quantile_cont(snr_db, 0.5) AS median FROM bd WHERE band IS NOT NULL GROUP BY ALL)"""
_DFT = """(WITH z AS (SELECT signal_id, segment, idx // 512 AS block, idx % 512 AS place, {v} AS v, count(*) OVER (PARTITION BY signal_id, segment, idx // 512) AS n FROM {t})
 SELECT signal_id, segment, block, n, k::INT AS k, sqrt(pow(sum(v * cos(2 * pi() / n * ((k * place) % n))), 2) + pow(sum(v * sin(2 * pi() / n * ((k * place) % n))), 2)) AS mag FROM z, range(256) r(k) WHERE k < n // 2 GROUP BY ALL)"""
_BYM = "PARTITION BY signal_id, segment, method"


def _blocks_sql() -> dict[str, str]:
    own, two = _DFT.format(v="value", t="s"), f"{_BASE}, top AS (SELECT * FROM rc WHERE method = 'top_ie'), fa AS {_DFT.format(v='value', t='top')}, fb AS {_DFT.format(v='recon', t='top')}"
    join = "FROM fa JOIN fb USING (signal_id, segment, block, n, k)"
    whole = {
        "spectrum": f"WITH {_S}, f AS {own} SELECT signal_id, segment, block, n, k, round(mag, 6) AS mag FROM f",
        "spectral_correlation": f"{two} SELECT signal_id, segment, block, n, CASE WHEN stddev_pop(fa.mag) > 1e-12 AND stddev_pop(fb.mag) > 1e-12 THEN round(corr(fa.mag, fb.mag), 6) END AS spectral_corr {join} GROUP BY ALL",
        "bin_errors": f"{two} SELECT signal_id, segment, block, n, k, round(abs(fa.mag - fb.mag), 6) AS abs_error, round(CASE WHEN fa.mag > 1e-10 THEN abs(fa.mag - fb.mag) / fa.mag ELSE 0 END, 6) AS rel_error {join}",
        "band_sums": f"WITH {_S}, f AS {own} SELECT signal_id, segment, block, n, k // 4 AS band, round(sum(mag), 6) AS total FROM f GROUP BY ALL",
    }
    return {f"{k}_whole": v for k, v in whole.items()} | {f"{k}_512": f"SELECT * EXCLUDE (block) FROM ({v}) WHERE block = 0" for k, v in whole.items()}


def oracle_sql() -> dict[str, str]:
    pivot = ", ".join(f"round(avg(mse) FILTER (method = '{m}'), 6) AS {m}_mean, round(quantile_cont(mse, 0.5) FILTER (method = '{m}'), 6) AS {m}_median" for m in NAMES)
    return {
        "breakdown": f"{_BASE} SELECT method, segment, count(mse) AS n, round(avg(mse), 6) AS mean, round(stddev_samp(mse), 6) AS sd FROM mt GROUP BY GROUPING SETS ((method, segment), (method), (segment))",
        "method_pivot": f"{_BASE} SELECT segment, {pivot} FROM mt GROUP BY segment",
        "band_curve": f"{_BASE}, {_B} SELECT method, band, n, round(mean, 6) AS mean, round(median, 6) AS median, round(sqrt(CASE band WHEN 0 THEN 3 WHEN 1 THEN 12 WHEN 2 THEN 20 ELSE 50 END), 6) AS middle FROM cv",
        "best_in_band": f"{_BASE}, {_B} SELECT band, method, round(mean, 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY round(mean, 9) DESC, method) AS r FROM cv WHERE n >= 10) WHERE r = 1",
        "two_level_mean": f"""{_BASE}, d AS (SELECT signal_id, avg(a.mse - b.mse) AS diff FROM mt a JOIN mt b USING (signal_id, segment) WHERE a.method = 'top_ie' AND b.method = 'stride' GROUP BY signal_id),
 g AS (SELECT count(*) AS n, avg(diff) AS mean, stddev_samp(diff) AS sd, avg((diff > 0)::INT) AS win_share FROM d), t AS (SELECT *, sd / sqrt(n) AS se FROM g), z AS (SELECT *, CASE WHEN se > 0 THEN mean / se END AS t FROM t), u AS (SELECT *, 1 / (1 + 0.2316419 * abs(t)) AS k FROM z)
 SELECT n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(win_share, 6) AS win_share, round(t, 6) AS t, round(2 * (exp(-t * t / 2) / 2.5066282746310002 * (k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429)))))), 6) AS p,
 round(mean - 1.96 * se, 6) AS low, round(mean + 1.96 * se, 6) AS high, round(CASE WHEN sd > 0 THEN mean / sd END, 6) AS d_z FROM u""",
        "distinct_trials": """SELECT l_suppkey, l_linenumber, l_orderkey, l_returnflag FROM (SELECT *, min(l_returnflag) OVER w = max(l_returnflag) OVER w AS same, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey) AS r
 FROM lineitem WINDOW w AS (PARTITION BY l_suppkey, l_linenumber)) WHERE NOT same OR r = 1""",
        "per_signal": f"{_BASE} SELECT signal_id, method, count(mse) AS n, round(avg(mse), 6) AS mean, round(stddev_pop(mse), 6) AS sd, round(min(mse), 6) AS least, round(max(mse), 6) AS most, round(max(mse) - min(mse), 6) AS \"range\" FROM mt GROUP BY ALL",
        "audit": f"""{_BASE} SELECT method, count(*) AS n, count(*) FILTER (snr_db = 0) AS zero, count(*) FILTER (snr_db < 0) AS negative, count(*) FILTER (snr_db IS NULL) AS missing, count(*) FILTER (isnan(snr_db)) AS not_a_number,
 count(*) FILTER (n = retained) AS exact FROM mt GROUP BY method""",
        "gap_p95": f"WITH {_S}, {_N}, {_M}, {_GAPS}, r AS (SELECT signal_id, segment, method, gap, row_number() OVER ({_BYM} ORDER BY gap) - 1 AS r, count(*) OVER ({_BYM}) AS c FROM g) SELECT signal_id, segment, method, gap FROM r WHERE r = floor(0.95::DOUBLE * (c - 1))",
        "ideal_distance": f"""{_BASE}, {_P}, x AS (SELECT *, max(ratio) OVER w AS rx, min(ratio) OVER w AS rn, max(mse) OVER w AS ex, min(mse) OVER w AS en FROM p WINDOW w AS (PARTITION BY signal_id, segment))
 SELECT signal_id, segment, method, ratio, mse, round(sqrt(pow(CASE WHEN rx > rn THEN (rx - ratio) / (rx - rn) ELSE 0 END, 2) + pow(CASE WHEN ex > en THEN (mse - en) / (ex - en) ELSE 0 END, 2)), 6) AS distance FROM x""",
        "substitution_rate": f"""{_BASE}, {_P}, {_F}, q AS (SELECT DISTINCT signal_id, segment, ratio, mse FROM f), r AS (SELECT *, (lead(mse) OVER w - mse) / (lead(ratio) OVER w - ratio) AS rate FROM q WINDOW w AS (PARTITION BY signal_id, segment ORDER BY ratio))
 SELECT signal_id, segment, ratio, mse, round(rate, 6) AS rate FROM r WHERE rate IS NOT NULL""",
        "front_share": f"{_BASE}, {_P}, {_F}, c AS (SELECT method, count(*) AS conditions FROM p GROUP BY 1), o AS (SELECT method, count(*) AS n FROM f GROUP BY 1) SELECT method, conditions, coalesce(n, 0) AS on_front, round(coalesce(n, 0) / conditions, 6) AS share FROM c LEFT JOIN o USING (method)",
        "place_costs": f"""WITH {_S}, {_N}, {_M}, pg AS (SELECT signal_id, segment, method, n, idx - lag(idx, 1, -1) OVER ({_BYM} ORDER BY idx) AS gap FROM mk WHERE kept),
 pk AS (SELECT *, greatest(0, round_even(log2(greatest(1, avg(gap) OVER ({_BYM}))), 0))::INT AS k FROM pg), c AS (SELECT signal_id, segment, method, count(*) AS kept, max(n) AS n, max(k) AS k, sum((gap >> k) + 1 + k)::BIGINT AS rice_bits FROM pk GROUP BY ALL)
 SELECT signal_id, segment, method, kept, k, rice_bits, round(CASE WHEN n / kept <= 1 THEN 2 ELSE log2(n / kept) + 2 END, 6) AS model_bits, round(16 * n / (kept * (16 + rice_bits / kept)), 6) AS ratio, round(kept * (16 + rice_bits / kept) / n, 6) AS bits_per_sample FROM c""",
        "quantisation": f"""WITH {_S}, x AS (SELECT *, max(abs(value)) OVER (PARTITION BY signal_id, segment) / 32767 AS step FROM s), q AS (SELECT *, CASE WHEN step > 0 THEN least(32767, greatest(-32768, round_even(value / step, 0))) ELSE 0 END AS q FROM x),
 g AS (SELECT signal_id, segment, max(step) AS step, sum(value * value) AS sig, sum((value - q * step) * (value - q * step)) AS noise FROM q GROUP BY ALL) SELECT signal_id, segment, round(step, 6) AS step, round(CASE WHEN sig > 0 AND noise > 0 THEN 10 * log10(sig / noise) END, 6) AS snr_db FROM g""",
        "signal_profile": f"""WITH {_S}, c AS (SELECT signal_id, segment, idx, value, value - avg(value) OVER (PARTITION BY signal_id, segment) AS c FROM s WHERE idx < 500), x AS (SELECT *, (c * lag(c) OVER (PARTITION BY signal_id, segment ORDER BY idx) < 0)::INT AS hit FROM c),
 g AS (SELECT signal_id, segment, count(*) AS n, max(value) AS top, sqrt(avg(value * value)) AS rms, coalesce(sum(hit), 0) AS hits, greatest(avg(c * c), 1e-15) AS m2, avg(c * c * c * c) AS m4 FROM x GROUP BY ALL),
 h AS (SELECT signal_id, segment, CASE WHEN rms > 1e-15 THEN top / rms ELSE 1 END AS peak_ratio, hits / n AS crossing_rate, m4 / (m2 * m2) - 3 AS kurtosis FROM g)
 SELECT signal_id, segment, round(peak_ratio, 6) AS peak_ratio, round(crossing_rate, 6) AS crossing_rate, round(kurtosis, 6) AS kurtosis, CASE WHEN kurtosis > 2 OR peak_ratio > 3 THEN 'impulsive' ELSE 'oscillatory' END AS kind FROM h""",
        "time_features": f"""WITH {_S}, x AS (SELECT *, CASE WHEN idx % 16 > 0 THEN abs(value - lag(value) OVER (PARTITION BY signal_id, segment ORDER BY idx)) END AS step FROM s)
 SELECT signal_id, segment, idx // 16 AS "window", round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(max(value) - min(value), 6) AS "range", round(sqrt(avg(value * value)), 6) AS rms, round(avg(step), 6) AS mean_step FROM x GROUP BY ALL HAVING count(*) = 16""",
        "band_sums": f"WITH {_S}, f AS ({_SPEC.format(v='value', t='s', more='')}) SELECT signal_id, segment, k // 4 AS band, round(sum(mag), 6) AS total FROM f GROUP BY ALL",
        "bin_errors": f"""{_BASE}, fa AS ({_SPEC.format(v='value', t='rc', more="AND method = 'top_ie'")}), fb AS ({_SPEC.format(v='recon', t='rc', more="AND method = 'top_ie'")})
 SELECT signal_id, segment, k::INT AS k, round(abs(fa.mag - fb.mag), 6) AS abs_error, round(CASE WHEN fa.mag > 1e-10 THEN abs(fa.mag - fb.mag) / fa.mag ELSE 0 END, 6) AS rel_error FROM fa JOIN fb USING (signal_id, segment, k)""",
        "standardised": """WITH x AS (SELECT vec_id, d::INT - 1 AS dim, embedding[d]::DOUBLE AS x FROM embeddings, range(1, 65) t(d)), g AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY dim)
 SELECT vec_id, dim, round(CASE WHEN s > 0 THEN (x - m) / s ELSE 0 END, 6) AS z FROM x JOIN g USING (dim)""",
        "gap_counts": f"WITH {_S}, {_N}, {_M}, {_GAPS} SELECT method, gap, count(*) AS n FROM g GROUP BY ALL",
    } | _blocks_sql()
