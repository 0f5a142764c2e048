"""Queries on folds, with SQL that walks each segment sample by sample (a recursive table) where a fold has few fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds, signals
from ..sources.series import KEYS, read_samples
from .registry import _S, rounded

#: Buffer, arrivals for each one let out, tolerance and share of the queries.
CAPACITY, OVERLOAD, TOLERANCE, SHARE = 8, 3, 25.0, 4
#: Window, share of its deviation and seed of the noise.
WIDTH, NOISE, SEED = 16, 0.5, 42
EXACT = ("online", "greedy_interp", "greedy_area", "lttb")


def _budget(spark, d):
    """What each offline method keeps of the count that the online buffer kept of the same segment."""
    got = folds.at_online_budget(read_samples(spark, d), CAPACITY, OVERLOAD).groupBy("method", *KEYS).agg(F.count(F.lit(1)).alias("retained"))
    target = got.filter("method = 'online'").select(*KEYS, F.col("retained").alias("target"))
    fits = F.when(F.col("method").isin(*EXACT), F.col("retained") == F.col("target")).otherwise(F.col("retained") <= F.col("target"))
    return got.join(target, KEYS).select("method", *KEYS, "target", fits.alias("fits"))


def queries() -> dict:
    s = read_samples
    return {
        "door_tolerance": lambda k, d: folds.at_tolerance(s(k, d), folds.Door, TOLERANCE),
        "pieces_tolerance": lambda k, d: folds.at_tolerance(s(k, d), folds.Pieces, TOLERANCE),
        "noisy_series": lambda k, d: rounded(signals.noisy(s(k, d), WIDTH, NOISE, SEED)),
        "online_budget": _budget,
        "tuned_door": lambda k, d: folds.tuned(folds.with_share(s(k, d), SHARE), folds.Door),
    }


def _walk(start: str, step: str, at: str) -> str:
    """A recursive table f over the samples of each segment: ``start`` and ``step`` give its columns, ``at`` the new ones from f and the
    next sample x."""
    return f"""WITH RECURSIVE {_S}, f AS (SELECT signal_id, segment, {start} FROM s WHERE idx = 0 UNION ALL
 SELECT signal_id, segment, {step} FROM (SELECT f.*, x.idx AS i, x.value AS v, {at} FROM f JOIN s x ON x.signal_id = f.signal_id AND x.segment = f.segment AND x.idx = f.idx + 1))"""


_STORED = """ SELECT s.* FROM s JOIN (SELECT signal_id, segment, stored AS idx FROM f WHERE stored IS NOT NULL UNION SELECT signal_id, segment, max(idx) FROM f GROUP BY ALL) k USING (signal_id, segment, idx)"""
_NONE = "'-inf'::DOUBLE AS low, 'inf'::DOUBLE AS high"
_DOOR = _walk(
    f"idx, value AS last, idx AS ai, value AS av, {_NONE}, idx AS stored",
    f"""i, v, CASE WHEN shut THEN idx ELSE ai END, CASE WHEN shut THEN last ELSE av END, CASE WHEN shut THEN (v - {TOLERANCE} - last) / (i - idx) ELSE lower END,
 CASE WHEN shut THEN (v + {TOLERANCE} - last) / (i - idx) ELSE upper END, CASE WHEN shut THEN idx END""",
    f"greatest(low, (x.value - {TOLERANCE} - av) / (x.idx - ai)) AS lower, least(high, (x.value + {TOLERANCE} - av) / (x.idx - ai)) AS upper, lower > upper AND f.idx > ai AS shut",
)
_PIECES = _walk(
    f"idx, value AS last, idx AS ai, value AS av, {_NONE}, idx AS stored",
    "i, v, CASE WHEN shut THEN idx ELSE ai END, CASE WHEN shut THEN last ELSE av END, CASE WHEN shut THEN '-inf'::DOUBLE ELSE lower END, CASE WHEN shut THEN 'inf'::DOUBLE ELSE upper END, CASE WHEN shut THEN idx END",
    f"""CASE WHEN f.idx > ai THEN greatest(low, (last - {TOLERANCE} - av) / (f.idx - ai)) ELSE low END AS lower, CASE WHEN f.idx > ai THEN least(high, (last + {TOLERANCE} - av) / (f.idx - ai)) ELSE high END AS upper,
 NOT ((x.value - av) / (x.idx - ai) BETWEEN lower AND upper) AS shut""",
)


def _errors(score: str) -> str:
    """Scores of the inner samples of the lists t (places) and w (values): ``score`` of the chord error e and the span d."""
    e = "abs(w[k] - (w[k - 1] + (t[k] - t[k - 1]) / (t[k + 1] - t[k - 1]) * (w[k + 1] - w[k - 1])))"
    return f"[{score.format(e=e, d='(t[k + 1] - t[k - 1])')} for k in range(2, len(t))]"


def _buffer(score: str) -> str:
    """The bounded buffer: when full the inner sample of least score goes, then the new one comes, then the oldest may leave."""
    step = f"""signal_id, segment, i, CASE WHEN leaves THEN t2[2:] ELSE t2 END AS t, CASE WHEN leaves THEN w2[2:] ELSE w2 END AS w, CASE WHEN leaves THEN t2[1] END AS stored
 FROM (SELECT *, list_append(CASE WHEN full_ THEN t[:gone] || t[gone + 2:] ELSE t END, i) AS t2, list_append(CASE WHEN full_ THEN w[:gone] || w[gone + 2:] ELSE w END, v) AS w2, (i + 1) % {OVERLOAD} = 0 AS leaves
 FROM (SELECT *, list_position(scores, list_min(scores)) AS gone FROM (SELECT f.*, x.idx AS i, x.value AS v, len(t) = {CAPACITY} AS full_, {_errors(score)} AS scores
 FROM f JOIN s x ON x.signal_id = f.signal_id AND x.segment = f.segment AND x.idx = f.idx + 1)))"""
    return f"""WITH RECURSIVE {_S}, f AS (SELECT DISTINCT signal_id, segment, -1::BIGINT AS idx, []::BIGINT[] AS t, []::DOUBLE[] AS w, NULL::BIGINT AS stored FROM s UNION ALL SELECT {step}),
 o AS (SELECT signal_id, segment, stored AS idx FROM f WHERE stored IS NOT NULL UNION ALL SELECT signal_id, segment, unnest(t) FROM f QUALIFY row_number() OVER (PARTITION BY signal_id, segment ORDER BY idx DESC) = 1)
 SELECT s.* FROM s JOIN o USING (signal_id, segment, idx)"""


def _filled(score: str) -> str:
    """Fill, then evict: the new sample comes first."""
    return f"""WITH RECURSIVE {_S}, f AS (SELECT DISTINCT signal_id, segment, -1::BIGINT AS idx, []::BIGINT[] AS t, []::DOUBLE[] AS w FROM s UNION ALL
 SELECT signal_id, segment, i, CASE WHEN over_ THEN t[:gone] || t[gone + 2:] ELSE t END, CASE WHEN over_ THEN w[:gone] || w[gone + 2:] ELSE w END
 FROM (SELECT *, len(t) > {CAPACITY} AS over_, list_position(scores, list_min(scores)) AS gone FROM (SELECT *, {_errors(score)} AS scores FROM (SELECT f.signal_id, f.segment, x.idx AS i, list_append(t, x.idx) AS t, list_append(w, x.value) AS w
 FROM f JOIN s x ON x.signal_id = f.signal_id AND x.segment = f.segment AND x.idx = f.idx + 1)))),
 o AS (SELECT signal_id, segment, unnest(t) AS idx FROM f QUALIFY row_number() OVER (PARTITION BY signal_id, segment ORDER BY idx DESC) = 1)
 SELECT s.* FROM s JOIN o USING (signal_id, segment, idx)"""


_LTTB = f"""WITH RECURSIVE {_S}, l AS (SELECT signal_id, segment, count(*) AS n, greatest(2, count(*) // {SHARE}) AS m, list(value ORDER BY idx) AS w FROM s GROUP BY ALL),
 g AS (SELECT *, (n - 2) / (m - 2) AS size FROM l WHERE m > 2 AND m < n),
 f AS (SELECT signal_id, segment, 0::BIGINT AS b, 0::BIGINT AS place FROM g UNION ALL
 SELECT signal_id, segment, b + 1, lo + list_position(areas, list_max(areas)) - 1 FROM (SELECT *, [abs((place - tm) * (w[i + 1] - w[place + 1]) - (place - i) * (xm - w[place + 1])) * 0.5 for i in range(lo, hi)] AS areas
 FROM (SELECT *, CASE WHEN far > hi THEN list_avg(range(hi, far)) ELSE n - 1 END AS tm, CASE WHEN far > hi THEN list_sum(w[hi + 1:far]) / (far - hi) ELSE w[n] END AS xm
 FROM (SELECT f.*, g.n, g.w, floor(b * size)::BIGINT + 1 AS lo, floor((b + 1) * size)::BIGINT + 1 AS hi, least(floor((b + 2) * size)::BIGINT + 1, n) AS far FROM f JOIN g USING (signal_id, segment) WHERE b < m - 2)))),
 k AS (SELECT signal_id, segment, place AS idx FROM f UNION SELECT signal_id, segment, unnest([0, n - 1]) FROM l UNION SELECT signal_id, segment, unnest(range(n)) FROM l WHERE m >= n)
 SELECT s.* FROM s JOIN k USING (signal_id, segment, idx)"""


def oracle_sql() -> dict[str, str]:
    return {
        "door_tolerance": _DOOR + _STORED,
        "pieces_tolerance": _PIECES + _STORED,
        "lttb": _LTTB,
        "bounded_interp": _buffer("{e}"),
        "bounded_area": _buffer("0.5 * {d} * {e}"),
        "bounded_span": _buffer("{e} * pow({d}, 0.5)"),
        "fill_then_evict": _filled("{e}"),
        "noisy_series": f"""WITH {_S}, d AS (SELECT *, stddev_pop(value) OVER (PARTITION BY signal_id, segment, idx // {WIDTH}) AS sd, md5(concat_ws('/', signal_id, segment, idx, {SEED})) AS h FROM s)
 SELECT signal_id, segment, idx, round(value + {NOISE} * sd * sqrt(-2 * ln((('0x' || h[1:8])::BIGINT + 1.0::DOUBLE) / (pow(2, 32) + 1))) * cos(2 * pi() * ('0x' || h[9:16])::BIGINT / pow(2, 32)), 6) AS value FROM d""",
        "online_budget": f"""WITH {_S}, c AS (SELECT signal_id, segment, count(*) AS n, count(*) // {OVERLOAD} AS j FROM s GROUP BY ALL),
 l AS (SELECT *, CASE WHEN j > 0 THEN greatest(j - 1, j * {OVERLOAD} - {CAPACITY}) ELSE -1 END AS last FROM c)
 SELECT method, signal_id, segment, least(n, j + greatest(0, n - greatest(last + 1, n - {CAPACITY})))::BIGINT AS target, TRUE AS fits
 FROM l, (VALUES {", ".join(f"('{m}')" for m in (*EXACT, "door", "pieces"))}) t(method)""",
    }
