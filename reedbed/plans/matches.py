"""Peaks after a reduction against those before, and labelled windows after a reduction, with SQL that walks each series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify, learners, matching, rebuild, select
from ..sources.series import KEYS, read_samples
from .registry import _BASE, _M, _N, _R, _marked, rounded

#: The two detectors, each with its tolerance and rule of match.
MIDDLE = {"reach": 2, "share": 0.5, "apart": 5, "of_top": False}
TOP = {"reach": 1, "share": 0.6, "apart": 4, "of_top": True}
WITHIN = 2
#: Samples a second of the shift in milliseconds.
RATE = 360.0
#: Samples of a labelled window.
WIDTH = 64


def _scores(spark, d, detector: dict, nearest: bool):
    """Peaks of the rebuilt series against those of the series itself, by method; a series without a peak counts as accurate."""
    again = rebuild.rebuilt(_marked(spark, d))
    truth = matching.peak_places(read_samples(spark, d), **detector)
    found = matching.peak_places(again, rebuild.BY, "recon", **detector)
    scores = matching.match_scores(truth, found, again, KEYS, ["method"], WITHIN, nearest)
    return rounded(scores.withColumn("shift_ms", F.col("mean_shift") * (1000 / RATE)).withColumn("accuracy", F.coalesce("f1", F.lit(1.0))))


def _places(spark, d, detector: dict):
    return rounded(matching.peak_places(read_samples(spark, d), **detector))


def _vectors(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").filter("label is not null")


def _reduced(spark, d):
    """Each labelled vector as a window of samples, reduced by each method and rebuilt."""
    return rebuild.rebuilt(select.marked(learners.as_series(_vectors(spark, d))))


def _kernel_folds(spark, d):
    """Accuracy, by fold, of one machine a class with a radial kernel."""
    return rounded(learners.fold_accuracy(learners.learned(_vectors(spark, d))))


def _bins(series: DataFrame) -> DataFrame:
    """A window's first 32 magnitudes, rms, kurtosis, crest and deviation as its ``embedding``; null kurtosis or crest is 0."""
    f = classify.bin_features(series, WIDTH)
    rest = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in ("rms", "kurtosis", "crest", "sd")])
    return f.select("signal_id", F.concat("bins", rest).alias("embedding"))


def _window_accuracy(spark, d):
    """Mean and deviation of the folds' accuracies on spectral features of windows as they are and as rebuilt after two reductions."""
    vectors, again = _vectors(spark, d), _reduced(spark, d)
    labels = vectors.select(F.col("vec_id").cast("string").alias("signal_id"), "vec_id", "label")
    series = {"none": learners.as_series(vectors)} | {m: again.filter(F.col("method") == m).select(*KEYS, "idx", F.col("recon").alias("value")) for m in ("top_ie", "keep_last")}
    found = [learners.fold_accuracy(learners.learned(_bins(s).join(labels, "signal_id"), kind="logistic")).withColumn("method", F.lit(m)) for m, s in series.items()]
    g = reduce(DataFrame.unionByName, found).groupBy("method").agg(F.count(F.lit(1)).alias("folds"), F.sum("n").alias("n"), F.avg("accuracy").alias("accuracy"), F.stddev_pop("accuracy").alias("sd"))
    return rounded(g)


def _window_report(spark, d):
    """By method, for all labels (null) and for each: accuracy of nearest centroids on rebuilt windows, mean finite SNR and mean
    correlation of the spectra before and after (of windows where both vary)."""
    again = _reduced(spark, d)
    hits = classify.leave_one_out(learners.as_vectors(again, _vectors(spark, d), "recon", "method"), ("method",))
    named = again.withColumn("signal_id", F.concat_ws("/", "signal_id", "method"))
    own, other = (classify.spectrum_of_blocks(named.select(*KEYS, "idx", F.col(c).alias("value"))).withColumnRenamed("mag", n) for c, n in (("value", "a"), ("recon", "b")))
    waves = own.join(other, [*KEYS, "block", "n", "k"]).groupBy("signal_id").agg(F.corr("a", "b").alias("r"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"))
    corr = waves.select(F.split("signal_id", "/")[0].cast("long").alias("vec_id"), F.split("signal_id", "/")[1].alias("method"), F.when((F.col("sa") > 1e-12) & (F.col("sb") > 1e-12), F.col("r")).alias("r"))
    snr = rebuild.metrics(again).select(F.col("signal_id").cast("long").alias("vec_id"), "method", "snr_db")
    rows = hits.join(snr, ["vec_id", "method"]).join(corr, ["vec_id", "method"], "left").withColumn("hit", (F.col("predicted") == F.col("label")).cast("long"))
    return rounded(rows.groupingSets([["method"], ["method", "label"]], "method", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), F.avg("hit").alias("accuracy"), F.avg("snr_db").alias("mean_snr_db"), F.avg("r").alias("mean_corr")))


def queries() -> dict:
    return {
        "kernel_folds": _kernel_folds,
        "window_accuracy": _window_accuracy,
        "window_report": _window_report,
        "peak_places": lambda k, d: _places(k, d, MIDDLE),
        "top_peak_places": lambda k, d: _places(k, d, TOP),
        "peak_scores": lambda k, d: _scores(k, d, MIDDLE, True),
        "top_peak_scores": lambda k, d: _scores(k, d, TOP, False),
    }


def _peaks_sql(name: str, table: str, by: str, value: str, detector: dict) -> str:
    """Tables {name}: the peaks of each series of ``table``, by a recursive walk over its candidates."""
    r, low = detector["reach"], "0.6 * top" if detector["of_top"] else "bottom + 0.5 * (top - bottom)"
    return f"""{name}_c AS (SELECT {by}, idx, x, row_number() OVER (PARTITION BY {by} ORDER BY idx) AS r FROM (SELECT {by}, idx, {value} AS x, max({value}) OVER a AS top, min({value}) OVER a AS bottom,
  lag({value}, {r}) OVER o IS NOT NULL AND lead({value}, {r}) OVER o IS NOT NULL AS inner_, max({value}) OVER (o ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS around
  FROM {table} WINDOW a AS (PARTITION BY {by}), o AS (PARTITION BY {by} ORDER BY idx)) WHERE inner_ AND x > {low} AND x >= around),
 {name}_f AS (SELECT {by}, r, idx AS li, x AS lx, NULL::BIGINT AS out_i, NULL::DOUBLE AS out_x FROM {name}_c WHERE r = 1 UNION ALL
  SELECT {", ".join("f." + c.strip() for c in by.split(","))}, c.r, CASE WHEN c.idx - li >= {detector["apart"]} OR c.x > lx THEN c.idx ELSE li END, CASE WHEN c.idx - li >= {detector["apart"]} OR c.x > lx THEN c.x ELSE lx END,
  CASE WHEN c.idx - li >= {detector["apart"]} THEN li END, CASE WHEN c.idx - li >= {detector["apart"]} THEN lx END
  FROM {name}_f f JOIN {name}_c c ON {" AND ".join(f"f.{x.strip()} = c.{x.strip()}" for x in by.split(","))} AND c.r = f.r + 1),
 {name} AS (SELECT {by}, out_i AS idx, out_x AS height FROM {name}_f WHERE out_i IS NOT NULL UNION ALL
  SELECT {by}, li, lx FROM {name}_f QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY r DESC) = 1)"""


def _match_sql(detector: dict, nearest: bool) -> str:
    far = "abs(t - p.d)" if nearest else "0"
    return f"""{_BASE.replace("WITH ", "WITH RECURSIVE ", 1)}, {_peaks_sql("tp", "s", "signal_id, segment", "value", detector)}, {_peaks_sql("fp", "rc", "signal_id, segment, method", "recon", detector)},
 kn AS (SELECT signal_id, segment, list(idx ORDER BY idx) AS known FROM tp GROUP BY ALL),
 sr AS (SELECT DISTINCT signal_id, segment, method, coalesce(known, []::BIGINT[]) AS known FROM mk LEFT JOIN kn USING (signal_id, segment)),
 p AS (SELECT signal_id, segment, method, idx AS d, row_number() OVER (PARTITION BY signal_id, segment, method ORDER BY idx) AS r FROM fp),
 m AS (SELECT *, 0::BIGINT AS r, []::BIGINT[] AS taken, 0::BIGINT AS shift FROM sr UNION ALL
  SELECT signal_id, segment, method, known, r, CASE WHEN best IS NULL THEN taken ELSE list_append(taken, best.t) END, shift + coalesce(abs(best.t - d), 0)
  FROM (SELECT m.signal_id, m.segment, m.method, known, p.r, p.d, taken, shift, list_min([{{'far': {far}, 't': t}} for t in known if abs(t - p.d) <= {WITHIN} and not list_contains(taken, t)]) AS best
   FROM m JOIN p ON p.signal_id = m.signal_id AND p.segment = m.segment AND p.method = m.method AND p.r = m.r + 1)),
 l AS (SELECT *, len(taken) AS hits, len(known) AS all_, r AS seen FROM m QUALIFY row_number() OVER (PARTITION BY signal_id, segment, method ORDER BY r DESC) = 1)
 SELECT signal_id, segment, method, hits AS true_positives, seen - hits AS false_positives, all_ - hits AS false_negatives, round(CASE WHEN all_ > 0 THEN CASE WHEN seen > 0 THEN hits / seen ELSE 0 END END, 6) AS precision,
  round(CASE WHEN all_ > 0 THEN hits / all_ END, 6) AS recall, round(CASE WHEN all_ > 0 THEN 2 * hits / (all_ + seen) END, 6) AS f1, round(CASE WHEN hits > 0 THEN shift / hits END, 6) AS mean_shift,
  round(CASE WHEN hits > 0 THEN shift / hits * 1000 / {RATE} END, 6) AS shift_ms, round(CASE WHEN all_ > 0 THEN 2 * hits / (all_ + seen) ELSE 1 END, 6) AS accuracy FROM l"""


_V = "s AS (SELECT vec_id::VARCHAR AS signal_id, 0::BIGINT AS segment, d - 1 AS idx, embedding[d]::DOUBLE AS value FROM embeddings, range(1, 65) t(d) WHERE label IS NOT NULL)"
_REPORT = f"""WITH {_V}, {_N}, {_M}, {_R}, lb AS (SELECT vec_id::VARCHAR AS signal_id, label FROM embeddings),
 x AS (SELECT signal_id, method, label, idx AS d, recon AS x FROM rc JOIN lb USING (signal_id)), c AS (SELECT method, label AS c, d, sum(x) AS s, count(*) AS n FROM x GROUP BY ALL),
 y AS (SELECT signal_id, x.method, label, c, x, CASE WHEN c = label THEN (s - x) / greatest(n - 1, 1) ELSE s / n END AS y FROM x JOIN c ON c.method = x.method AND c.d = x.d),
 k AS (SELECT signal_id, method, label, c, round(CASE WHEN sum(x * x) > 0 AND sum(y * y) > 0 THEN sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) ELSE 0 END, 12) AS sim FROM y GROUP BY ALL),
 h AS (SELECT signal_id, method, label, (c = label)::INT AS hit FROM k QUALIFY row_number() OVER (PARTITION BY signal_id, method ORDER BY sim DESC, c) = 1),
 w AS (SELECT signal_id, method, k, sqrt(pow(sum(value * cos(2 * pi() / 64 * ((k * idx) % 64))), 2) + pow(sum(value * sin(2 * pi() / 64 * ((k * idx) % 64))), 2)) AS a,
  sqrt(pow(sum(recon * cos(2 * pi() / 64 * ((k * idx) % 64))), 2) + pow(sum(recon * sin(2 * pi() / 64 * ((k * idx) % 64))), 2)) AS b FROM rc, range(32) r(k) GROUP BY ALL),
 q AS (SELECT signal_id, method, CASE WHEN stddev_pop(a) > 1e-12 AND stddev_pop(b) > 1e-12 THEN corr(a, b) END AS r FROM w GROUP BY ALL)
 SELECT method, label, count(*) AS n, sum(hit)::BIGINT AS hits, round(avg(hit), 6) AS accuracy, round(avg(CASE WHEN NOT (sig >= 1e-15 AND noise < 1e-15) THEN snr_db END), 6) AS mean_snr_db, round(avg(r), 6) AS mean_corr
 FROM h JOIN mt USING (signal_id, method) LEFT JOIN q USING (signal_id, method) GROUP BY GROUPING SETS ((method), (method, label))"""


def oracle_sql() -> dict[str, str]:
    walk = lambda detector: f"{_BASE.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_peaks_sql('tp', 's', 'signal_id, segment', 'value', detector)} SELECT signal_id, segment, idx, round(height, 6) AS height FROM tp"
    return {"window_report": _REPORT, "peak_places": walk(MIDDLE), "top_peak_places": walk(TOP), "peak_scores": _match_sql(MIDDLE, True), "top_peak_scores": _match_sql(TOP, False)}
