"""Queries on files, filters, budgets, places and labels, each with its SQL beside it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import ensure_checkpoint_dir
from ..functions.scores import rules, weights_at, with_scores
from ..operators import classify, compare, places, rebuild, screens, select
from ..sources import files
from ..sources.series import KEYS, read_samples
from . import registry
from .registry import _S, _SPEC, _marked, _metrics, rounded

_BASE = registry._BASE.removeprefix("WITH ")

DURATIONS = (8, 16, 32)
EDGES = [0.0, 2.0, 3.0, 4.0, 8.0]
#: Measured bits for a place by mean gap, for the interpolation query.
BITS = [(1.0, 1.0), (2.0, 2.0), (4.0, 3.2), (8.0, 4.4)]


def _folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


def _text_signals(spark, d):
    """Series written as text, one value a line, and the first 64 samples of each read back."""
    folder = _folder(spark)
    files.write_signals(read_samples(spark, d), folder)
    return files.read_signals(spark, folder, 64)


def _annotations(spark, d):
    """Places of events of one kind, below 64."""
    events = spark.read.parquet(f"{d}/events.parquet")
    marks = read_samples(spark, d, value="event_id").select(*KEYS, "idx", F.col("value").cast("long").alias("event_id"))
    kinds = events.select("event_id", "event_type", F.col("value").alias("v")).filter("v is not null").select("event_id", "event_type")
    return marks.join(kinds, "event_id").filter("idx < 64").select(*KEYS, "idx", "event_type")


def _catalogue(spark, d):
    customers = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("signal_id"))
    return files.catalogue(customers, read_samples(spark, d), 24)


def _manifest(spark, d):
    """Names of recordings made from the parts table."""
    part = spark.read.parquet(f"{d}/part.parquet")
    kind = F.element_at(F.array(F.lit("IR007"), F.lit("B014"), F.lit("OR021"), F.lit("Normal")), (F.col("p_partkey") % 4 + 1).cast("int"))
    stem = F.concat(F.col("p_partkey").cast("string"), F.lit("_"), kind, F.when(F.col("p_size") % 5 < 4, F.concat(F.lit("_"), (F.col("p_size") % 5).cast("string"))).otherwise(""))
    got = files.described(part.select(stem.alias("stem")))
    return rounded(got.select("stem", "name", "condition", "diameter", "load", "rpm", *files.DEFECTS))


def _windows(spark, d):
    vectors = spark.read.parquet(f"{d}/embeddings.parquet")
    lines = vectors.select("vec_id", F.array_join(F.transform(F.slice("embedding", 1, (60 + F.col("vec_id") % 8).cast("int")), lambda x: x.cast("double").cast("string")), " ").alias("line"))
    w = files.fixed_windows(lines, 64)
    return rounded(w.select("vec_id", F.element_at("window", 1).alias("first"), F.element_at("window", -1).alias("last"), F.aggregate("window", F.lit(0.0), lambda a, x: a + x).alias("total")))


def _results_file(spark, d):
    """Metrics written as CSV with inf for a saturated ratio and read back."""
    folder = _folder(spark)
    m = _metrics(spark, d).select(*KEYS, "method", F.col("n"), F.coalesce(F.round("snr_db", 6).cast("string"), F.lit("inf")).alias("snr_db"), F.round("mse", 6).alias("mse"))
    files.write_results(m, folder)
    got = files.read_results(spark, folder, ["signal_id", "method"])
    return got.select("signal_id", F.col("segment").cast("long").alias("segment"), "method", F.col("n").cast("long").alias("n"), "snr_db", "mse")


def _qualified(spark, d):
    m = _metrics(spark, d)
    base = (F.col("method") == "linspace") & (F.round("snr_db", 6) >= 2)
    return rounded(screens.qualified(screens.sound(m, "snr_db", 0.0), KEYS, base).select(*KEYS, "method", "snr_db"))


def _matched(spark, d):
    marked = places.at_budget(read_samples(spark, d), 8, 3)
    g = marked.groupBy(*KEYS, "method").agg(F.max("target").alias("target"), F.max("expected").alias("expected"), F.sum(F.col("kept").cast("long")).alias("kept"))
    return g.select(*KEYS, "method", "target", (F.col("target") == F.col("expected")).alias("lawful"), "kept")


def _durations(spark, d):
    series = read_samples(spark, d)
    every = None
    for n in DURATIONS:
        one = rebuild.metrics(rebuild.rebuilt(select.marked(series.filter(F.col("idx") < n)))).filter("snr_db is not null").groupBy("method").agg(F.round(F.avg("snr_db"), 6).alias("snr_db")).withColumn("duration", F.lit(n).cast("long"))
        every = one if every is None else every.unionByName(one)
    return rounded(screens.stability(every, ["method"], "duration", "snr_db", 0.2))


def _dominance(spark, d):
    return screens.dominance(_metrics(spark, d).filter("snr_db is not null").withColumn("cost", F.col("retained").cast("double")), "method", "snr_db", "cost")


def _p_values(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_suppkey", "l_linenumber", "l_returnflag").agg(F.round(F.avg(F.col("l_extendedprice").cast("double")), 2).alias("x"))
    pairs = compare.paired(lines, ["l_suppkey", "l_linenumber"], "l_returnflag", "x", "A", "R").withColumn("diff", F.round("diff", 2))
    p = F.when(F.col("n") < 10, None).otherwise(F.round("p", 6))
    return rounded(compare.wilcoxon(pairs, ["l_linenumber"]).select("l_linenumber", "n", p.alias("p"), F.when(p.isNull(), "n.s.").otherwise(screens.significance(F.col("p"))).alias("label")))


def _violations(spark, d):
    m = _metrics(spark, d).filter("snr_db is not null").select("signal_id", "method", F.col("retained").alias("size"), F.col("segment"), F.round("snr_db", 6).alias("snr_db"))
    g = m.groupBy("method", "size").agg(F.round(F.avg("snr_db"), 6).alias("score"))
    return screens.violations(g, ["method"], "size", "score")


def _distances(spark, d):
    """Euclidean distance of each vector from the mean vector of its label."""
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.posexplode("embedding").alias("dim", "x"))
    means = vectors.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    both = vectors.join(means, ["label", "dim"])
    return rounded(both.groupBy("vec_id", "label").agg(F.sqrt(F.sum(F.pow(F.col("x").cast("double") - F.col("m"), F.lit(2.0)))).alias("distance")))


def _tones(spark, d):
    """Errors of the bins 2, 4 and 8 alone."""
    r = rebuild.rebuilt(_marked(spark, d)).filter("method = 'top_ie'")
    tones = F.col("k").isin(2, 4, 8)
    own = classify.spectrum(r.select(*KEYS, "idx", "value"), 32).filter(tones)
    other = classify.spectrum(r.select(*KEYS, "idx", F.col("recon").alias("value")), 32).filter(tones).withColumnRenamed("mag", "b")
    return rounded(own.join(other, [*KEYS, "k"]).select(*KEYS, "k", F.abs(F.col("mag") - F.col("b")).alias("error")))


def queries() -> dict:
    s = read_samples
    return {
        "text_signals": _text_signals,
        "annotations": _annotations,
        "catalogue": _catalogue,
        "recording_manifest": _manifest,
        "fixed_windows": _windows,
        "concatenated": lambda k, d: files.concatenated(s(k, d), 40),
        "results_file": _results_file,
        "combined_rules": lambda k, d: rounded(rules(with_scores(s(k, d)), (0.1, 0.3, 0.6))),
        "adaptive_rules": lambda k, d: rounded(rules(with_scores(s(k, d)), weights_at(1.0))),
        "frequency_weight": lambda k, d: rounded(places.frequency_weight(s(k, d))),
        "spectral_score": lambda k, d: rounded(places.frequency_weight(with_scores(s(k, d)).select(*KEYS, "idx", "value", "ie")).select(*KEYS, "idx", (F.col("ie") * F.col("weight")).alias("score"))),
        "victim": lambda k, d: rounded(places.victim(with_scores(s(k, d)).withColumn("ie", F.round("ie", 9)), "ie")),
        "sound_results": lambda k, d: rounded(screens.sound(_metrics(k, d), "snr_db", 0.0).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg("snr_db").alias("mean"))),
        "qualified_signals": _qualified,
        "matched_budget": _matched,
        "random_drop": lambda k, d: places.random_drop(s(k, d)),
        "duration_stability": _durations,
        "gap_tail": lambda k, d: places.gap_tail(_marked(k, d)),
        "near_position": lambda k, d: rounded(places.near_position(_marked(k, d))),
        "extremum_count": lambda k, d: places.extremum_count(s(k, d)).select(*KEYS, "idx", F.col("extrema").cast("long").alias("extrema")),
        "gap_by_class": lambda k, d: rounded(places.gap_by_class(_marked(k, d), places.extremum_count(s(k, d)))),
        "code_ratios": lambda k, d: rounded(places.code_ratios(_marked(k, d))),
        "bits_by_gap": lambda k, d: rounded(rebuild.gap_stats(_marked(k, d)).select(*KEYS, "method", screens.interpolated(BITS, F.col("mean_gap")).alias("bits"))),
        "paired_spread": lambda k, d: rounded(screens.paired_spread(compare.paired(_metrics(k, d), KEYS, "method", "mse", "top_ie", "stride"))),
        "dominance": _dominance,
        "p_value_labels": _p_values,
        "left_bands": lambda k, d: rounded(_metrics(k, d).withColumn("band", screens.left_band(F.col("ratio"), EDGES)).groupBy("method", "band").agg(F.count(F.lit(1)).alias("n"), F.percentile("mse", F.lit(0.95)).alias("p95_mse"))),
        "monotone": _violations,
        "anomalies": lambda k, d: rounded(screens.anomalies(_metrics(k, d).select(*KEYS, "method", F.round("mse", 6).alias("mse")), KEYS, "method", "top_ie", "mse", 0.5)),
        "euclidean": _distances,
        "tone_errors": _tones,
    }


def _rules_sql(w: tuple[float, float, float]) -> str:
    a, b, g = w
    return f"""{_BASE.split(", b AS")[0]}
 SELECT signal_id, segment, idx,
  round({a} * d1 + {b} * d2_abs + {g} * energy, 6) AS linear,
  round(pow(d1 + 1e-12, {a}) * pow(d2_abs + 1e-12, {b}) * pow(energy + 1e-12, {g}), 6) AS geometric,
  round(1 / ({a} / (d1 + 1e-12) + {b} / (d2_abs + 1e-12) + {g} / (energy + 1e-12)), 6) AS harmonic,
  round(least({a} * d1, {b} * d2_abs, {g} * energy), 6) AS least_weighted
 FROM sc"""


_W = """fw AS (SELECT *, avg(value) OVER (PARTITION BY signal_id, segment ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS m,
 (list(value) OVER (PARTITION BY signal_id, segment ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 9 FOLLOWING))[1:10] AS l FROM {t}),
wt AS (SELECT *, CASE WHEN len(l) > 1 THEN 1 + len(list_filter(range(1, len(l)), lambda j: (l[j] - m) * (l[j + 1] - m) < 0)) / (len(l) - 1) ELSE 1 END AS weight FROM fw)"""

_X = """sg AS (SELECT *, sign(value - lag(value) OVER (PARTITION BY signal_id, segment ORDER BY idx)) AS st FROM s),
sl AS (SELECT *, list(st) FILTER (WHERE st <> 0) OVER (PARTITION BY signal_id, segment ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS l FROM sg),
ex AS (SELECT signal_id, segment, idx, coalesce(len(list_filter(range(1, len(l)), lambda j: l[j] <> l[j + 1])), 0)::BIGINT AS extrema FROM sl)"""

_GAPS = "gp AS (SELECT signal_id, segment, method, n, idx, idx - lag(idx) OVER (PARTITION BY signal_id, segment, method ORDER BY idx) AS gap FROM mk WHERE kept)"
_SOUND = "so AS (SELECT * FROM mt WHERE n <> retained AND snr_db IS NOT NULL AND NOT (sig >= 1e-15 AND noise < 1e-15))"


def _duration_sql() -> str:
    parts = []
    for n in DURATIONS:
        parts.append(f"SELECT {n}::BIGINT AS duration, x.* FROM (WITH {_BASE.replace('FROM s WINDOW w', f'FROM s WHERE idx < {n} WINDOW w', 1)} SELECT method, round(avg(snr_db), 6) AS snr_db FROM mt WHERE snr_db IS NOT NULL GROUP BY method) x")
    return f"""WITH e AS ({" UNION ALL ".join(parts)}),
 f AS (SELECT *, snr_db - first_value(snr_db) OVER (PARTITION BY method ORDER BY duration) AS change FROM e)
 SELECT method, duration, snr_db, round(change, 6) AS change, abs(change) > 0.2 AS shifted FROM f"""


def oracle_sql() -> dict[str, str]:
    gap = "CASE WHEN x <= 1 THEN 1.0 WHEN x < 2 THEN 1 + (x - 1) WHEN x < 4 THEN 2 + (x - 2) / 2 * 1.2 WHEN x < 8 THEN 3.2 + (x - 4) / 4 * 1.2 ELSE 4.4 END"
    return {
        "text_signals": f"WITH {_S} SELECT signal_id, segment, idx, value FROM s WHERE idx < 64",
        "annotations": """WITH a AS (SELECT user_id::VARCHAR AS signal_id, (date_diff('day', DATE '1970-01-01', ts::DATE) // 30)::BIGINT AS segment, event_id, event_type, value,
  row_number() OVER (PARTITION BY user_id, date_diff('day', DATE '1970-01-01', ts::DATE) // 30 ORDER BY ts, event_id) - 1 AS idx
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)
 SELECT signal_id, segment, idx, event_type FROM a WHERE value IS NOT NULL AND idx < 64""",
        "catalogue": f"""WITH {_S}, c AS (SELECT signal_id, count(*) AS samples FROM s GROUP BY 1)
 SELECT DISTINCT c_custkey::VARCHAR AS signal_id, coalesce(samples, 0) AS samples, coalesce(samples, 0) >= 24 AS used
 FROM customer LEFT JOIN c ON c.signal_id = c_custkey::VARCHAR""",
        "recording_manifest": """WITH p AS (SELECT p_partkey, p_partkey % 4 AS k, p_size % 5 AS l FROM part),
 q AS (SELECT p_partkey, CASE k WHEN 0 THEN 'IR007' WHEN 1 THEN 'B014' WHEN 2 THEN 'OR021' ELSE 'Normal' END || CASE WHEN l < 4 THEN '_' || l ELSE '' END AS name,
  CASE k WHEN 0 THEN 'inner_race' WHEN 1 THEN 'ball' WHEN 2 THEN 'outer_race' ELSE 'normal' END AS condition,
  CASE k WHEN 0 THEN 0.007 WHEN 1 THEN 0.014 WHEN 2 THEN 0.021 ELSE 0 END::DOUBLE AS diameter, CASE WHEN l < 4 THEN l ELSE -1 END::INT AS load,
  CASE l WHEN 0 THEN 1797 WHEN 1 THEN 1772 WHEN 2 THEN 1750 WHEN 3 THEN 1730 END AS rpm FROM p)
 SELECT p_partkey || '_' || name AS stem, name, condition, diameter, load, rpm,
  round(rpm / 60 * 5.4152::DOUBLE, 6) AS bpfi, round(rpm / 60 * 3.5848::DOUBLE, 6) AS bpfo, round(rpm / 60 * 2.3568::DOUBLE, 6) AS bsf, round(rpm / 60 * 0.3983::DOUBLE, 6) AS ftf FROM q""",
        "fixed_windows": """SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS "first", round(embedding[64]::DOUBLE, 6) AS "last", round(list_sum([x::DOUBLE FOR x IN embedding]), 6) AS total
 FROM embeddings WHERE vec_id % 8 >= 4""",
        "concatenated": f"""WITH {_S}, c AS (SELECT signal_id, row_number() OVER (PARTITION BY signal_id ORDER BY segment, idx) - 1 AS idx, value FROM s)
 SELECT * FROM c WHERE idx < 40""",
        "results_file": f"WITH {_BASE} SELECT signal_id, segment, method, n, round(snr_db, 6) AS snr_db, round(mse, 6) AS mse FROM mt",
        "combined_rules": "WITH " + _rules_sql((0.1, 0.3, 0.6)),
        "adaptive_rules": "WITH " + _rules_sql(weights_at(1.0)),
        "frequency_weight": f"WITH {_S}, {_W.format(t='s')} SELECT signal_id, segment, idx, value, round(weight, 6) AS weight FROM wt",
        "spectral_score": f"WITH {_BASE.split(', b AS')[0]}, {_W.format(t='sc')} SELECT signal_id, segment, idx, round(ie * weight, 6) AS score FROM wt",
        "victim": f"""WITH {_BASE.split(", b AS")[0]}, v AS (SELECT signal_id, segment, idx, round(ie, 9) AS score,
  row_number() OVER (PARTITION BY signal_id, segment ORDER BY round(ie, 9), idx) AS r FROM sc WHERE ie IS NOT NULL)
 SELECT signal_id, segment, idx, round(score, 6) AS score FROM v WHERE r = 1""",
        "sound_results": f"WITH {_BASE}, {_SOUND} SELECT method, count(*) AS n, round(avg(snr_db), 6) AS mean FROM so WHERE snr_db >= 0 GROUP BY method",
        "qualified_signals": f"""WITH {_BASE}, {_SOUND}, ok AS (SELECT * FROM so WHERE snr_db >= 0)
 SELECT signal_id, segment, method, round(snr_db, 6) AS snr_db FROM ok
 WHERE (signal_id, segment) IN (SELECT (signal_id, segment) FROM ok WHERE method = 'linspace' AND round(snr_db, 6) >= 2)""",
        "matched_budget": f"""WITH {_S}, c AS (SELECT signal_id, segment, count(*) AS n FROM s GROUP BY ALL), d AS (SELECT *, n // 3 AS j FROM c),
 l AS (SELECT *, CASE WHEN j > 0 THEN greatest(j - 1, j * 3 - 8) ELSE -1 END AS last FROM d),
 t AS (SELECT *, least(n, j + greatest(0, n - greatest(last + 1, n - 8)))::BIGINT AS target FROM l), a AS (SELECT * FROM s JOIN t USING (signal_id, segment)),
 m AS (SELECT *, 'stride' AS method, idx % greatest(1, n // target) = 0 AND idx // greatest(1, n // target) < target AS kept FROM a
  UNION ALL SELECT *, 'linspace', floor(ceil(idx * (target - 1) / greatest(n - 1, 1)) * (n - 1) / greatest(target - 1, 1)) = idx FROM a
  UNION ALL SELECT *, 'keep_last', idx >= n - target FROM a)
 SELECT signal_id, segment, method, target, true AS lawful, sum(kept::INT)::BIGINT AS kept FROM m GROUP BY ALL""",
        "random_drop": f"""WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY signal_id, segment ORDER BY md5(signal_id || ':' || segment || ':' || idx || ':7'), idx) AS p,
  count(*) OVER (PARTITION BY signal_id, segment) AS n FROM s)
 SELECT signal_id, segment, idx, value FROM r WHERE p <= greatest(2, n // 4)""",
        "duration_stability": _duration_sql(),
        "gap_tail": f"""WITH {_BASE}, {_GAPS}, r AS (SELECT method, gap, row_number() OVER (PARTITION BY method ORDER BY gap) - 1 AS i, count(*) OVER (PARTITION BY method) AS n FROM gp WHERE gap IS NOT NULL)
 SELECT method, max(n) AS gaps, max(CASE WHEN i = floor(n * 0.5::DOUBLE) THEN gap END) AS p50, max(CASE WHEN i = floor(n * 0.95::DOUBLE) THEN gap END) AS p95,
  max(CASE WHEN i = floor(n * 0.99::DOUBLE) THEN gap END) AS p99 FROM r GROUP BY method""",
        "near_position": f"""WITH {_BASE} SELECT signal_id, segment, method, sum(kept::INT)::BIGINT AS kept, round(sum(kept::INT) / max(n), 6) AS share,
  sum((kept AND abs(idx - n // 2) <= 20)::INT)::BIGINT AS near FROM mk GROUP BY ALL""",
        "extremum_count": f"WITH {_S}, {_X} SELECT * FROM ex",
        "gap_by_class": f"""WITH {_BASE}, {_X}, {_GAPS} SELECT method, CASE WHEN extrema > 1 THEN 'several' ELSE 'single' END AS class, count(*) AS n,
  round(avg(gap), 6) AS mean_gap, round(stddev_pop(gap), 6) AS std_gap FROM gp JOIN ex USING (signal_id, segment, idx) WHERE gap IS NOT NULL GROUP BY ALL""",
        "code_ratios": f"""WITH {_BASE}, {_GAPS}, g AS (SELECT signal_id, segment, method, count(*) AS kept, max(n) AS n, sum(CASE WHEN coalesce(gap, idx + 1) < 255 THEN 8 ELSE 24 END)::BIGINT AS gap8_bits FROM gp GROUP BY ALL),
 h AS (SELECT *, (kept * ceil(log2(greatest(n, 2))))::BIGINT AS absolute_bits FROM g)
 SELECT signal_id, segment, method, kept, absolute_bits, gap8_bits, round(16 * n / (kept * 16 + absolute_bits), 6) AS absolute_ratio, round(16 * n / (kept * 16 + gap8_bits), 6) AS gap8_ratio FROM h""",
        "bits_by_gap": f"""WITH {_BASE}, {_GAPS}, g AS (SELECT signal_id, segment, method, avg(gap) AS x FROM gp WHERE gap IS NOT NULL GROUP BY ALL)
 SELECT signal_id, segment, method, round({gap}, 6)::DOUBLE AS bits FROM g""",
        "paired_spread": f"""WITH {_BASE}, p AS (SELECT a.mse AS a, b.mse AS b, a.mse - b.mse AS diff FROM mt a JOIN mt b USING (signal_id, segment) WHERE a.method = 'top_ie' AND b.method = 'stride')
 SELECT count(*) AS n, round(stddev_samp(diff) / sqrt(count(*)), 6) AS se, round(min(diff), 6) AS min_diff, round(max(diff), 6) AS max_diff,
  round(avg(diff) - 1.96 * stddev_samp(diff) / sqrt(count(*)), 6) AS low, round(avg(diff) + 1.96 * stddev_samp(diff) / sqrt(count(*)), 6) AS high,
  round((avg(a) - avg(b)) / sqrt(((count(a) - 1) * var_samp(a) + (count(b) - 1) * var_samp(b)) / (count(a) + count(b) - 2)), 6) AS pooled_d FROM p""",
        "dominance": f"""WITH {_BASE}, p AS (SELECT method, round(avg(snr_db), 6) AS u, round(avg(retained::DOUBLE), 6) AS d FROM mt WHERE snr_db IS NOT NULL GROUP BY method),
 bt AS (SELECT x.method AS worse, y.method AS better FROM p x JOIN p y ON y.u >= x.u AND y.d <= x.d AND (y.u > x.u OR y.d < x.d))
 SELECT method, (SELECT count(*) FROM bt WHERE better = method) AS dominates, coalesce((SELECT string_agg(better, ',' ORDER BY better) FROM bt WHERE worse = method), '') AS dominated_by FROM p""",
        "left_bands": f"""WITH {_BASE}, bd AS (SELECT *, CASE WHEN ratio >= 0 AND ratio < 2 THEN 0 WHEN ratio >= 2 AND ratio < 3 THEN 1 WHEN ratio >= 3 AND ratio < 4 THEN 2 WHEN ratio >= 4 AND ratio < 8 THEN 3 END::INT AS band FROM mt)
 SELECT method, band, count(*) AS n, round(quantile_cont(mse, 0.95), 6) AS p95_mse FROM bd GROUP BY ALL""",
        "monotone": f"""WITH {_BASE}, g AS (SELECT method, retained AS size, round(avg(round(snr_db, 6)), 6) AS score FROM mt WHERE snr_db IS NOT NULL GROUP BY ALL),
 r AS (SELECT method, score - lag(score) OVER (PARTITION BY method ORDER BY size DESC) AS rise FROM g)
 SELECT method, count(*) AS sizes, coalesce(sum((rise > 0.01)::INT), 0)::BIGINT AS violations FROM r GROUP BY method""",
        "anomalies": f"""WITH {_BASE}, m AS (SELECT signal_id, segment, method, round(mse, 6) AS mse FROM mt)
 SELECT a.*, b.mse AS base FROM m a JOIN m b USING (signal_id, segment) WHERE b.method = 'top_ie' AND a.method <> 'top_ie' AND a.mse > b.mse + 0.5""",
        "p_value_labels": f"""WITH w AS ({registry.oracle_sql()["wilcoxon_holm"]}), p AS (SELECT l_linenumber, n, CASE WHEN n >= 10 THEN p END AS p FROM w)
 SELECT l_linenumber, n, p, CASE WHEN p < 0.001 THEN 'p<0.001' WHEN p < 0.01 THEN 'p<0.01' WHEN p < 0.05 THEN 'p<0.05' ELSE 'n.s.' END AS label FROM p""",
        "tone_errors": f"""WITH {_BASE}, fa AS ({_SPEC.format(v="value", t="rc", more="AND method = 'top_ie'")}), fb AS ({_SPEC.format(v="recon", t="rc", more="AND method = 'top_ie'")})
 SELECT signal_id, segment, k::INT AS k, round(abs(fa.mag - fb.mag), 6) AS error FROM fa JOIN fb USING (signal_id, segment, k) WHERE k IN (2, 4, 8)""",
        "euclidean": """WITH v AS (SELECT vec_id, label, d, embedding[d]::DOUBLE AS x FROM embeddings, range(1, 65) t(d)), m AS (SELECT label, d, avg(x) AS m FROM v GROUP BY ALL)
 SELECT vec_id, label, round(sqrt(sum((x - m) * (x - m))), 6) AS distance FROM v JOIN m USING (label, d) GROUP BY ALL""",
    }
