"""Phases, correlation by piece, measured and entropy costs, ratios of methods, names and decoded places, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import with_scores
from ..operators import classify, curves, places, rebuild
from ..sources.series import KEYS, delta_code, delta_decode, long_enough, read_samples
from .registry import _BASE, _GAPS, _M, _N, _S, _marked, _metrics, rounded
from .studies import _X

#: Samples of a piece, least of a piece that counts, least of a series, and the weight of energy.
PIECE, LEAST, LONG, GAMMA = 16, 8, 40, 0.6


def _pieces(spark, d):
    """Correlation of the spectra of each piece of a series and of its reconstruction by top_ie."""
    r = rebuild.rebuilt(_marked(spark, d)).filter("method = 'top_ie'")
    own, other = (classify.spectrum_of_blocks(r.select(*KEYS, "idx", F.col(c).alias("value")), PIECE).withColumnRenamed("mag", n) for c, n in (("value", "a"), ("recon", "b")))
    g = own.join(other, [*KEYS, "block", "n", "k"]).filter(F.col("n") >= LEAST).groupBy(*KEYS, "block", "n").agg(F.corr("a", "b").alias("r"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"))
    return rounded(g.select(*KEYS, "block", "n", F.when((F.col("sa") > 1e-9) & (F.col("sb") > 1e-9), F.col("r")).alias("spectral_corr")))


def _measured(spark, d):
    """Bits for a place, measured by Rice codes on top_ie, read off at the mean spacing of the other methods, and the ratio they give."""
    marked = _marked(spark, d)
    costs = rebuild.gap_bits(marked).join(rebuild.gap_stats(marked).select(*rebuild.BY, "mean_gap"), rebuild.BY).filter("method = 'top_ie'").withColumn("bits", F.col("rice_bits") / F.col("gaps"))
    curve = curves.measured_curve(costs, "mean_gap", "bits")
    rows = _metrics(spark, d).filter("method <> 'top_ie'").select(*rebuild.BY, "n", "retained", "ratio")
    bits = F.col("retained") * (curves.SAMPLE_BITS + F.col("bits"))
    return rounded(curves.read_off(rows, curve, "ratio", "bits").withColumn("code_ratio", curves.SAMPLE_BITS * F.col("n") / bits))


def _ratios(spark, d):
    gaps = places.gap_by_class(_marked(spark, d), places.extremum_count(read_samples(spark, d)))
    return rounded(curves.class_ratios(gaps, "stride"))


def _names(spark, d):
    m = _metrics(spark, d)
    return curves.name_sets({"all": m, "exact": m.filter("degenerate or snr_saturated"), "negative": m.filter("snr_db < 0"), "silent": m.filter("snr_db is null and not snr_saturated"), "single": m.filter("retained = 1")}, "method")


def _composite(spark, d):
    scored = with_scores(read_samples(spark, d))
    return rounded(scored.filter("ie is not null").select(*KEYS, "idx", (F.col("ie") * (1 + GAMMA * F.col("energy"))).alias("score")), 3)


def queries() -> dict:
    s = read_samples
    return {
        "spectrum_phase": lambda k, d: rounded(curves.phases(s(k, d))),
        "piece_correlation": _pieces,
        "entropy_costs": lambda k, d: rounded(curves.entropy_costs(_marked(k, d))),
        "measured_bits": _measured,
        "gap_ratios": _ratios,
        "name_sets": _names,
        "interp_composite_score": _composite,
        "delta_decode": lambda k, d: delta_decode(delta_code(_marked(k, d).filter("kept and method = 'top_ie'"))),
        "long_series": lambda k, d: long_enough(s(k, d), LONG),
    }


_CLASSES = f"""{_BASE}, {_X}, gp AS (SELECT signal_id, segment, method, idx, idx - lag(idx) OVER (PARTITION BY signal_id, segment, method ORDER BY idx) AS gap FROM mk WHERE kept),
 c AS (SELECT method, CASE WHEN extrema > 1 THEN 'several' ELSE 'single' END AS class, count(*) AS n, avg(gap) AS m FROM gp JOIN ex USING (signal_id, segment, idx) WHERE gap IS NOT NULL GROUP BY ALL)"""


def _piece_dft(value: str) -> str:
    return f"""(SELECT signal_id, segment, block, n, k, sqrt(pow(sum(v * cos(2 * pi() / n * ((k * place) % n))), 2) + pow(sum(v * sin(2 * pi() / n * ((k * place) % n))), 2)) AS mag
  FROM (SELECT signal_id, segment, idx // {PIECE} AS block, idx % {PIECE} AS place, {value} AS v, count(*) OVER (PARTITION BY signal_id, segment, idx // {PIECE}) AS n FROM rc WHERE method = 'top_ie'), range({PIECE // 2}) r(k) WHERE k < n // 2 GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    sets = {"all": "TRUE", "exact": "n = retained OR (sig >= 1e-15 AND noise < 1e-15)", "negative": "snr_db < 0", "silent": "snr_db IS NULL AND NOT (sig >= 1e-15 AND noise < 1e-15)", "single": "retained = 1"}
    return {
        "spectrum_phase": f"""WITH {_S}, z AS (SELECT signal_id, segment, idx // 512 AS block, idx % 512 AS place, value AS v, count(*) OVER (PARTITION BY signal_id, segment, idx // 512) AS n FROM s),
 f AS (SELECT signal_id, segment, block, n, k::INT AS k, sum(v * cos(2 * pi() / n * ((k * place) % n))) AS re, 0 - sum(v * sin(2 * pi() / n * ((k * place) % n))) AS im FROM z, range(256) r(k) WHERE k < n // 2 GROUP BY ALL)
 SELECT signal_id, segment, block, n, k, round(k / n, 6) AS freq, round(sqrt(re * re + im * im), 6) AS mag, round(CASE WHEN sqrt(re * re + im * im) >= 1e-9 THEN atan2(im, re) END, 6) AS phase FROM f""",
        "piece_correlation": f"""{_BASE}, fa AS {_piece_dft("value")}, fb AS {_piece_dft("recon")}
 SELECT signal_id, segment, block, n, round(CASE WHEN stddev_pop(fa.mag) > 1e-9 AND stddev_pop(fb.mag) > 1e-9 THEN corr(fa.mag, fb.mag) END, 6) AS spectral_corr FROM fa JOIN fb USING (signal_id, segment, block, n, k) WHERE n >= {LEAST} GROUP BY ALL""",
        "entropy_costs": f"""WITH {_S}, {_N}, {_M}, pg AS (SELECT signal_id, segment, method, n, idx - lag(idx, 1, -1) OVER (PARTITION BY signal_id, segment, method ORDER BY idx) AS gap FROM mk WHERE kept),
 kd AS (SELECT signal_id, segment, method, gap, count(*) AS c, max(n) AS n FROM pg GROUP BY ALL), t AS (SELECT signal_id, segment, method, sum(c)::BIGINT AS kept, max(n) AS n, sum(c * log2(c)) AS h FROM kd GROUP BY ALL),
 en AS (SELECT *, log2(kept) - h / kept AS entropy FROM t)
 SELECT signal_id, segment, method, kept, round(entropy, 6) AS entropy, round(16 * n / (kept * (16 + entropy)), 6) AS entropy_ratio, round(kept * (16 + entropy) / n, 6) AS bits_per_sample FROM en""",
        "measured_bits": f"""{_BASE}, {_GAPS}, kd AS (SELECT signal_id, segment, avg(gap) AS x, least({", ".join(f"sum(((gap - 1) >> {k}) + 1 + {k})" for k in range(17))}) / count(*) AS y FROM g WHERE method = 'top_ie' GROUP BY ALL),
 cv AS (SELECT avg(x) AS x, avg(y) AS y FROM kd GROUP BY round(log2(x) * {curves.STEPS})), rw AS (SELECT signal_id, segment, method, n, retained, ratio FROM mt WHERE method <> 'top_ie'),
 di AS (SELECT DISTINCT ratio FROM rw), lo AS (SELECT ratio, arg_max(x, x) AS ax, arg_max(y, x) AS ay FROM di JOIN cv ON x <= ratio GROUP BY 1), hi AS (SELECT ratio, arg_min(x, x) AS bx, arg_min(y, x) AS by_ FROM di JOIN cv ON x > ratio GROUP BY 1),
 bt AS (SELECT ratio, coalesce(ay + (ratio - ax) / (bx - ax) * (by_ - ay), ay, by_) AS bits FROM di LEFT JOIN lo USING (ratio) LEFT JOIN hi USING (ratio))
 SELECT signal_id, segment, method, n, retained, round(ratio, 6) AS ratio, round(bits, 6) AS bits, round(16 * n / (retained * (16 + bits)), 6) AS code_ratio FROM rw JOIN bt USING (ratio)""",
        "gap_ratios": f"""{_CLASSES} SELECT a.method, a.class, a.n, round(a.m / b.m, 6) AS to_base, round(a.m / o.m, 6) AS to_single FROM c a LEFT JOIN c b ON b.method = 'stride' AND b.class = a.class LEFT JOIN c o ON o.method = a.method AND o.class = 'single'""",
        "name_sets": f"""{_BASE}, u AS ({" UNION ALL ".join(f"SELECT method, '{t}' AS t FROM mt WHERE {w}" for t, w in sets.items())}) SELECT method, string_agg(DISTINCT t, ',' ORDER BY t) AS tables, count(*) AS n FROM u GROUP BY method""",
        "interp_composite_score": f"WITH {_S}, {_N} SELECT signal_id, segment, idx, round(ie * (1 + {GAMMA} * energy), 3) AS score FROM sc WHERE ie IS NOT NULL",
        "delta_decode": f"WITH {_S}, {_N}, {_M} SELECT signal_id, segment, idx FROM mk WHERE kept AND method = 'top_ie'",
        "long_series": f"WITH {_S} SELECT * FROM s QUALIFY count(*) OVER (PARTITION BY signal_id, segment) >= {LONG}",
    }
