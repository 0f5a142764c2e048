"""Queries over the given tables, each with the same result in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import combined, with_scores
from ..operators import classify, compare, folds, rebuild, select
from ..sources.series import KEYS, delta_code, read_samples


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean fidelity of the one-pass reducers at the same budget."""
    m = rebuild.metrics(rebuild.rebuilt(select.marked(read_samples(spark, sf_dir))))
    g = m.groupBy("method").agg(F.count(F.lit(1)).alias("series"), F.avg("snr_db").alias("mean_snr_db"), F.avg("mse").alias("mean_mse"), F.max("max_error").alias("max_error"), F.sum("retained").alias("retained"))
    return rounded(g)


def _marked(spark, d):
    return select.marked(read_samples(spark, d))


def _metrics(spark, d):
    return rebuild.metrics(rebuild.rebuilt(_marked(spark, d)))


def _pairs(spark, d):
    return compare.paired(_metrics(spark, d), KEYS, "method", "mse", "top_ie", "stride")


def _wilcoxon(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    pairs = compare.paired(lines.groupBy("l_suppkey", "l_linenumber", "l_returnflag").agg(F.avg(F.col("l_extendedprice").cast("double")).alias("x")).withColumn("x", F.round("x", 2)), ["l_suppkey", "l_linenumber"], "l_returnflag", "x", "A", "R")
    return compare.holm(compare.wilcoxon(pairs.withColumn("diff", F.round("diff", 2)), ["l_linenumber"]), "l_linenumber")


def _pareto(spark, d):
    m = _metrics(spark, d).select(*KEYS, "method", F.round("ratio", 6).alias("ratio"), F.round("mse", 6).alias("mse"))
    return compare.pareto(m, KEYS, "method", "ratio", "mse")


def _spectral(spark, d):
    r = rebuild.rebuilt(_marked(spark, d)).filter("method = 'top_ie'")
    own = classify.spectrum(r.select(*KEYS, "idx", "value"), 32).withColumnRenamed("mag", "a")
    other = classify.spectrum(r.select(*KEYS, "idx", F.col("recon").alias("value")), 32).withColumnRenamed("mag", "b")
    g = own.join(other, [*KEYS, "k"]).groupBy(*KEYS).agg(F.corr("a", "b").alias("r"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"))
    return g.select(*KEYS, F.when((F.col("sa") > 1e-12) & (F.col("sb") > 1e-12), F.round("r", 6)).alias("spectral_corr"))


def _accuracy(spark, d):
    g = classify.leave_one_out(spark.read.parquet(f"{d}/embeddings.parquet"))
    hit = (F.col("predicted") == F.col("label")).cast("long")
    return rounded(g.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits")).withColumn("accuracy", F.col("hits") / F.col("n")))


def queries() -> dict:
    s = read_samples
    return {
        "flagship": flagship,
        "samples_index": s,
        "static_scores": lambda k, d: rounded(with_scores(s(k, d))),
        "combined_scores": lambda k, d: rounded(combined(with_scores(s(k, d))).drop("geometric")),
        "marked_reducers": lambda k, d: _marked(k, d).filter("kept").select(*KEYS, "method", "idx", "value"),
        "fifo_reducer": lambda k, d: select.fifo(s(k, d), 8, 3),
        "delta_code": lambda k, d: delta_code(_marked(k, d).filter("kept and method = 'top_ie'")).select(*KEYS, "retained", F.array_join("deltas", " ").alias("deltas")),
        "reconstruction_metrics": lambda k, d: rounded(_metrics(k, d)),
        "gap_stats": lambda k, d: rounded(rebuild.gap_stats(_marked(k, d))),
        "gap_bits": lambda k, d: rounded(rebuild.gap_bits(_marked(k, d))),
        "window_features": lambda k, d: rounded(classify.features(s(k, d), 16).withColumn("kurtosis", F.round("kurtosis", 4))),
        "spectrum": lambda k, d: rounded(classify.spectrum(s(k, d), 32)),
        "spectral_correlation": _spectral,
        "describe_methods": lambda k, d: rounded(compare.describe(_metrics(k, d), "method", "mse")),
        "paired_summary": lambda k, d: rounded(compare.paired_summary(_pairs(k, d))),
        "wilcoxon_holm": lambda k, d: rounded(_wilcoxon(k, d)),
        "pareto_front": _pareto,
        "centroids": lambda k, d: rounded(classify.centroids(k.read.parquet(f"{d}/embeddings.parquet")).drop("total")),
        "leave_one_out": _accuracy,
        "bounded_interp": lambda k, d: folds.bounded(s(k, d), 8, 3, "interp"),
        "bounded_area": lambda k, d: folds.bounded(s(k, d), 8, 3, "area"),
        "bounded_span": lambda k, d: folds.bounded(s(k, d), 8, 3, "span"),
        "bounded_lookahead": lambda k, d: folds.bounded(s(k, d), 8, 3, "lookahead"),
        "bounded_composite": lambda k, d: folds.bounded(s(k, d), 8, 3, "composite"),
        "greedy_interp": lambda k, d: folds.greedy(s(k, d), 4),
        "greedy_area": lambda k, d: folds.greedy(s(k, d), 4, area=True),
        "lttb": lambda k, d: folds.lttb(s(k, d), 4),
        "swinging_door": lambda k, d: folds.swinging_door(s(k, d), 4),
    }


_S = """s AS (SELECT user_id::VARCHAR AS signal_id, (date_diff('day', DATE '1970-01-01', ts::DATE) // 30)::BIGINT AS segment,
 row_number() OVER (PARTITION BY user_id, date_diff('day', DATE '1970-01-01', ts::DATE) // 30 ORDER BY ts, event_id) - 1 AS idx, value FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL)"""
_W = "WINDOW w AS (PARTITION BY signal_id, segment ORDER BY idx)"
_N = f"""nb AS (SELECT *, lag(idx) OVER w AS tp, lag(value) OVER w AS xp, lead(idx) OVER w AS tn, lead(value) OVER w AS xn, lag(idx, 2) OVER w AS tpp, lag(value, 2) OVER w AS xpp, lead(idx, 2) OVER w AS tnn, lead(value, 2) OVER w AS xnn FROM s {_W}),
e AS (SELECT *, abs(value - (xp + (idx - tp) / (tn - tp) * (xn - xp))) AS ie, coalesce(abs(value - xp), 0) AS d1, coalesce(abs((value - xp) - (xp - xpp)), 0) AS d2,
 CASE WHEN idx < 2 THEN 0 ELSE abs(abs(value - xp) - abs(xp - xpp)) END AS d2_abs,
 abs(xp - (xpp + (tp - tpp) / (tn - tpp) * (xn - xpp))) AS el, abs(xn - (xp + (tn - tp) / (tnn - tp) * (xnn - xp))) AS er FROM nb),
sc AS (SELECT *, coalesce(avg((value - xp) * (value - xp)) OVER (PARTITION BY signal_id, segment ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING), 0) AS energy,
 CASE WHEN tp IS NOT NULL AND tn IS NOT NULL THEN var_pop(value) OVER (PARTITION BY signal_id, segment ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END AS var3,
 ie + 0.5 * greatest(0, ie - least(el, er)) AS lookahead FROM e)"""
_M = """b AS (SELECT *, count(*) OVER (PARTITION BY signal_id, segment) AS n FROM sc), bb AS (SELECT *, greatest(2, n // 4) AS budget FROM b),
wide AS (SELECT *, row_number() OVER (PARTITION BY signal_id, segment ORDER BY CASE WHEN ie IS NULL THEN 0 ELSE 1 END, ie DESC NULLS LAST, idx) AS rk FROM bb),
mk AS (SELECT signal_id, segment, idx, value, n, 'stride' AS method, idx % greatest(1, n // budget) = 0 AND idx // greatest(1, n // budget) < budget AS kept FROM wide
 UNION ALL SELECT signal_id, segment, idx, value, n, 'linspace', floor(ceil(idx * (budget - 1) / greatest(n - 1, 1)) * (n - 1) / greatest(budget - 1, 1)) = idx FROM wide
 UNION ALL SELECT signal_id, segment, idx, value, n, 'keep_last', idx >= n - budget FROM wide UNION ALL SELECT signal_id, segment, idx, value, n, 'top_ie', rk <= budget FROM wide)"""
_R = """pr AS (SELECT *, max(CASE WHEN kept THEN idx END) OVER (PARTITION BY signal_id, segment, method ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pi,
 min(CASE WHEN kept THEN idx END) OVER (PARTITION BY signal_id, segment, method ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS si FROM mk),
rc AS (SELECT a.*, CASE WHEN pi = si THEN p.value WHEN pi IS NULL THEN q.value WHEN si IS NULL THEN p.value ELSE p.value + (a.idx - pi) / (si - pi) * (q.value - p.value) END AS recon
 FROM pr a LEFT JOIN s p ON p.signal_id = a.signal_id AND p.segment = a.segment AND p.idx = pi LEFT JOIN s q ON q.signal_id = a.signal_id AND q.segment = a.segment AND q.idx = si),
df AS (SELECT *, value - recon AS e, abs(value - lag(value) OVER w) AS dv, abs(recon - lag(recon) OVER w) AS dr FROM rc WINDOW w AS (PARTITION BY signal_id, segment, method ORDER BY idx)),
ag AS (SELECT signal_id, segment, method, count(*) AS n, sum(kept::INT)::BIGINT AS retained, avg(e * e) AS mse, sum(value * value) AS sig, sum(e * e) AS noise, max(abs(e)) AS max_error, avg(dv) AS dv, avg(dr) AS dr FROM df GROUP BY ALL),
mt AS (SELECT *, CASE WHEN sig < 1e-15 THEN 0 WHEN noise >= 1e-15 THEN 10 * log10(sig / noise) END AS snr_db, n / retained AS ratio FROM ag)"""
_BASE = f"WITH {_S}, {_N}, {_M}, {_R}"
_GAPS = "gp AS (SELECT signal_id, segment, method, n, idx - lag(idx) OVER (PARTITION BY signal_id, segment, method ORDER BY idx) AS gap FROM mk WHERE kept), g AS (SELECT * FROM gp WHERE gap IS NOT NULL)"
_SPEC = "SELECT signal_id, segment, k, sqrt(pow(sum({v} * cos(2 * pi() / 32 * ((k * idx) % 32))), 2) + pow(sum({v} * sin(2 * pi() / 32 * ((k * idx) % 32))), 2)) AS mag FROM {t}, range(16) r(k) WHERE idx < 32 {more} GROUP BY ALL HAVING count(*) = 32"


def oracle_sql() -> dict[str, str]:
    rice = ", ".join(f"{{'bits': sum(c * (((gap - 1) >> {k}) + 1 + {k})), 'k': {k}}}" for k in range(17))
    return {
        "flagship": f"{_BASE} SELECT method, count(*) AS series, round(avg(snr_db), 6) AS mean_snr_db, round(avg(mse), 6) AS mean_mse, round(max(max_error), 6) AS max_error, sum(retained)::BIGINT AS retained FROM mt GROUP BY 1",
        "samples_index": f"WITH {_S} SELECT * FROM s",
        "static_scores": f"""WITH {_S}, {_N} SELECT signal_id, segment, idx, round(value, 6) AS value, round(d1, 6) AS d1, round(d2, 6) AS d2, round(d2_abs, 6) AS d2_abs, round(energy, 6) AS energy, round(ie, 6) AS ie,
 round(0.5 * (tn - tp) * ie, 6) AS area, round(ie * pow(tn - tp, 0.5), 6) AS span_score, round(CASE WHEN ie IS NOT NULL THEN lookahead END, 6) AS lookahead, round(var3, 6) AS var3 FROM sc""",
        "combined_scores": f"""WITH {_S}, {_N}, rk AS (SELECT *, row_number() OVER (PARTITION BY signal_id, segment ORDER BY d1, idx) - 1 AS r1, row_number() OVER (PARTITION BY signal_id, segment ORDER BY d2_abs, idx) - 1 AS r2,
 row_number() OVER (PARTITION BY signal_id, segment ORDER BY energy, idx) - 1 AS r3, greatest(count(*) OVER (PARTITION BY signal_id, segment) - 1, 1) AS m FROM sc)
 SELECT signal_id, segment, idx, round(0.1 * d1 + 0.3 * d2_abs + 0.6 * energy, 6) AS linear, round(least(d1, d2_abs, energy), 6) AS "least", round(0.1 * (r1 / m) + 0.3 * (r2 / m) + 0.6 * (r3 / m), 6) AS fused FROM rk""",
        "marked_reducers": f"WITH {_S}, {_N}, {_M} SELECT signal_id, segment, method, idx, value FROM mk WHERE kept",
        "fifo_reducer": f"""WITH {_S}, c AS (SELECT signal_id, segment, count(*) AS n FROM s GROUP BY ALL), j AS (SELECT signal_id, segment, greatest(j - 1, j * 3 - 8) AS idx FROM c, range(1, 100000) t(j) WHERE j <= n // 3),
 l AS (SELECT c.*, coalesce(max(idx), -1) AS last FROM c LEFT JOIN j USING (signal_id, segment) GROUP BY ALL),
 kept AS (SELECT * FROM j UNION SELECT s.signal_id, s.segment, s.idx FROM s JOIN l USING (signal_id, segment) WHERE s.idx >= greatest(last + 1, n - 8)) SELECT s.* FROM s JOIN kept USING (signal_id, segment, idx)""",
        "delta_code": f"""WITH {_S}, {_N}, {_M}, k AS (SELECT signal_id, segment, idx, idx - coalesce(lag(idx) OVER (PARTITION BY signal_id, segment ORDER BY idx), 0) AS step FROM mk WHERE kept AND method = 'top_ie')
 SELECT signal_id, segment, count(*) AS retained, string_agg(step::BIGINT::VARCHAR, ' ' ORDER BY idx) AS deltas FROM k GROUP BY ALL""",
        "reconstruction_metrics": f"""{_BASE} SELECT signal_id, segment, method, n, retained, round(mse, 6) AS mse, round(snr_db, 6) AS snr_db, round(max_error, 6) AS max_error, round(CASE WHEN dv > 1e-15 THEN dr / dv END, 6) AS deriv_ratio,
 round(100 * pow(10, -snr_db / 20), 6) AS prd, round(ratio, 6) AS ratio, n = retained AS degenerate, sig >= 1e-15 AND noise < 1e-15 AS snr_saturated FROM mt""",
        "gap_stats": f"""WITH {_S}, {_N}, {_M}, {_GAPS} SELECT signal_id, segment, method, count(*) AS gaps, round(avg(gap), 6) AS mean_gap, round(stddev_pop(gap), 6) AS std_gap, min(gap) AS min_gap, max(gap) AS max_gap,
 round(quantile_cont(gap, 0.5), 6)::DOUBLE AS median_gap, round(quantile_cont(gap, 0.95), 6)::DOUBLE AS p95_gap, round(stddev_pop(gap) / avg(gap), 6) AS cv_gap FROM g GROUP BY ALL""",
        "gap_bits": f"""WITH {_S}, {_N}, {_M}, {_GAPS}, kd AS (SELECT signal_id, segment, method, gap, count(*) AS c, max(n) AS n FROM g GROUP BY ALL),
 t AS (SELECT signal_id, segment, method, sum(c)::BIGINT AS gaps, max(n) AS n, sum(c * log2(c)) AS h, list_min([{rice}]) AS rice FROM kd GROUP BY ALL)
 SELECT signal_id, segment, method, gaps, rice.bits::BIGINT AS rice_bits, rice.k AS rice_k, round(log2(gaps) - h / gaps, 6) AS entropy_bits, (gaps * ceil(log2(n)))::BIGINT AS absolute_bits FROM t""",
        "window_features": f"""WITH {_S}, a AS (SELECT signal_id, segment, idx // 16 AS "window", count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd, sqrt(avg(value * value)) AS rms, max(abs(value)) AS top, avg(value * value * value * value) AS m4, avg(value * value * value) AS m3,
 avg(value * value) AS m2 FROM s GROUP BY ALL HAVING count(*) = 16) SELECT signal_id, segment, "window", round(mean, 6) AS mean, round(sd, 6) AS sd, round(rms, 6) AS rms,
 round(CASE WHEN sd > 1e-9 THEN (m4 - 4 * mean * m3 + 6 * mean * mean * m2 - 3 * mean * mean * mean * mean) / pow(sd, 4) END, 4) AS kurtosis, round(CASE WHEN rms > 0 THEN top / rms END, 6) AS crest, round(top, 6) AS peak FROM a""",
        "spectrum": f"WITH {_S}, f AS ({_SPEC.format(v='value', t='s', more='')}) SELECT signal_id, segment, k::INT AS k, round(mag, 6) AS mag FROM f",
        "spectral_correlation": f"""{_BASE}, fa AS ({_SPEC.format(v='value', t='rc', more="AND method = 'top_ie'")}), fb AS ({_SPEC.format(v='recon', t='rc', more="AND method = 'top_ie'")})
 SELECT signal_id, segment, CASE WHEN stddev_pop(fa.mag) > 1e-12 AND stddev_pop(fb.mag) > 1e-12 THEN round(corr(fa.mag, fb.mag), 6) END AS spectral_corr FROM fa JOIN fb USING (signal_id, segment, k) GROUP BY ALL""",
        "describe_methods": f"""{_BASE}, d AS (SELECT coalesce(method, 'ALL') AS method, count(*) AS n, avg(mse) AS mean, stddev_samp(mse) AS sd, quantile_cont(mse, 0.5) AS median FROM mt WHERE mse IS NOT NULL GROUP BY ROLLUP (method))
 SELECT method, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(median, 6) AS median, round(mean - 1.96 * sd / sqrt(n), 6) AS low, round(mean + 1.96 * sd / sqrt(n), 6) AS high FROM d""",
        "paired_summary": f"""{_BASE}, p AS (SELECT a.mse AS a, b.mse AS b, a.mse - b.mse AS diff FROM mt a JOIN mt b USING (signal_id, segment) WHERE a.method = 'top_ie' AND b.method = 'stride'),
 g AS (SELECT count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, avg(diff) AS mean_diff, stddev_samp(diff) AS sd_diff, quantile_cont(diff, 0.5) AS median_diff, var_samp(a) AS va, var_samp(b) AS vb, sum((diff > 0.01)::INT)::BIGINT AS wins, sum((diff < -0.01)::INT)::BIGINT AS losses,
 sum((abs(diff) <= 0.01)::INT)::BIGINT AS ties FROM p), h AS (SELECT *, CASE WHEN sd_diff > 0 THEN mean_diff / sd_diff END AS d FROM g)
 SELECT n, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean_diff, 6) AS mean_diff, round(sd_diff, 6) AS sd_diff, round(median_diff, 6) AS median_diff, round(d, 6) AS d_z,
 CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' WHEN d IS NOT NULL THEN 'large' END AS effect, round(mean_diff / sqrt((va + vb) / 2), 6) AS cohen_d, wins, losses, ties FROM h""",
        "wilcoxon_holm": """WITH x AS (SELECT l_suppkey, l_linenumber, l_returnflag, round(avg(l_extendedprice::DOUBLE), 2) AS x FROM lineitem GROUP BY ALL),
 p AS (SELECT a.l_linenumber, round(a.x - b.x, 2) AS diff FROM x a JOIN x b USING (l_suppkey, l_linenumber) WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'R'),
 r AS (SELECT l_linenumber, diff, rank() OVER w + (count(*) OVER (PARTITION BY l_linenumber, abs(diff)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY l_linenumber, abs(diff)) AS c FROM p WHERE abs(diff) > 1e-15 WINDOW w AS (PARTITION BY l_linenumber ORDER BY abs(diff))),
 g AS (SELECT l_linenumber, count(*) AS n, sum(CASE WHEN diff > 0 THEN rk ELSE 0 END)::DOUBLE AS w_plus, sum(CASE WHEN diff < 0 THEN rk ELSE 0 END)::DOUBLE AS w_minus, sum((c * c - 1.0))::DOUBLE AS t FROM r GROUP BY 1),
 z AS (SELECT *, greatest(0, abs(least(w_plus, w_minus) - n * (n + 1.0) / 4) - 0.5) / sqrt(n * (n + 1.0) * (2 * n + 1) / 24 - t / 48) AS z FROM g),
 u AS (SELECT *, 1 / (1 + 0.2316419 * z) AS k FROM z),
 q AS (SELECT *, CASE WHEN n < 5 OR z IS NULL THEN 1 ELSE least(1, 2 * (exp(-z * z / 2) / 2.5066282746310002 * (k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))))) END AS p FROM u)
 SELECT l_linenumber, n, round(w_plus, 6) AS w_plus, round(w_minus, 6) AS w_minus, round(z, 6) AS z, round(p, 6) AS p,
 round(least(1, max(p * (count(*) OVER () - rn + 1)) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS p_holm FROM (SELECT *, row_number() OVER (ORDER BY p, l_linenumber) AS rn, count(*) OVER () AS m FROM q)""".replace("count(*) OVER () - rn", "m - rn"),
        "pareto_front": f"""{_BASE}, p AS (SELECT signal_id, segment, method, round(ratio, 6) AS ratio, round(mse, 6) AS mse FROM mt)
 SELECT a.*, NOT EXISTS (SELECT 1 FROM p b WHERE b.signal_id = a.signal_id AND b.segment = a.segment AND b.ratio >= a.ratio AND b.mse <= a.mse AND (b.ratio > a.ratio OR b.mse < a.mse)) AS front FROM p a""",
        "centroids": "SELECT label, d::INT - 1 AS dim, round(avg(embedding[d]::DOUBLE), 6) AS mean, count(*) AS n FROM embeddings, range(1, 65) t(d) GROUP BY ALL",
        "leave_one_out": """WITH c AS (SELECT label AS c, d, sum(embedding[d]::DOUBLE) AS s, count(*) AS n FROM embeddings, range(1, 65) t(d) GROUP BY ALL),
 m AS (SELECT vec_id, label, c, e.embedding[d]::DOUBLE AS x, CASE WHEN c = label THEN (s - e.embedding[d]::DOUBLE) / greatest(n - 1, 1) ELSE s / n END AS y FROM embeddings e, c),
 k AS (SELECT vec_id, label, c, round(CASE WHEN sum(x * x) > 0 AND sum(y * y) > 0 THEN sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) ELSE 0 END, 12) AS sim FROM m GROUP BY ALL),
 b AS (SELECT vec_id, label, c, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, c) AS r FROM k)
 SELECT label, count(*) AS n, sum((c = label)::INT)::BIGINT AS hits, round(sum((c = label)::INT) / count(*), 6) AS accuracy FROM b WHERE r = 1 GROUP BY label""",
    }
