import time

import numpy as np
import pandas as pd

from reedbed.operators import classify, folds, matching, results, signals
from reedbed.plans import matches, reports
from reedbed.sources import files
from reedbed.sources.series import KEYS, read_samples
from reedbed.streaming import bounded

SF = "/root/testdata/sf0.001"


def slow_peaks(x, share, apart):
    out, level = [], min(x) + share * (max(x) - min(x))
    for i in range(2, len(x) - 2):
        if x[i] > level and x[i] == max(x[i - 2 : i + 3]):
            if out and i - out[-1] < apart:
                if x[i] > x[out[-1]]:
                    out[-1] = i
            else:
                out.append(i)
    return out


def test_peaks_equal_slow(spark):
    rng = np.random.default_rng(4)
    data = {f"s{i}": np.round(rng.normal(size=n), 1) for i, n in enumerate([3, 5, 60, 200])} | {"flat": np.zeros(20)}
    rows = spark.createDataFrame([(k, 0, i, float(v)) for k, x in data.items() for i, v in enumerate(x)], "signal_id string, segment long, idx long, value double")
    got = {k: [] for k in data}
    for r in matching.peak_places(rows, apart=7).orderBy("idx").collect():
        got[r.signal_id].append(r.idx)
    assert got == {k: slow_peaks(x.tolist(), 0.5, 7) for k, x in data.items()}


def test_ranked_value_counts_ties(spark):
    values = [3, 1, 1, 2, 9, 9, None]
    rows = spark.createDataFrame([("a", v) for v in values], "k string, v int")
    for share in (0.0, 0.5, 0.95, 1.0):
        own = sorted(v for v in values if v is not None)
        assert [r.v for r in results.ranked_value(rows, ["k"], "v", share).collect()] == [own[int(share * (len(own) - 1))]]


def test_trials_with_nulls(spark):
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("b", 1, 5.0), ("b", 2, 6.0), ("c", 1, None), ("c", 2, None), ("d", 1, None), ("d", 2, 1.0)], "c string, t int, v double")
    got = sorted((r.c, r.t) for r in results.distinct_trials(rows, ["c"], "t", "v").collect())
    assert got == [("a", 1), ("b", 1), ("b", 2), ("c", 1), ("d", 1), ("d", 2)]


def test_pieces_stay_within_tolerance():
    x = np.cumsum(np.random.default_rng(6).normal(size=150))
    kept = folds.piece_places(x, 0.7)
    assert np.abs(np.interp(np.arange(150), kept, x[kept]) - x).max() <= 0.7 + 1e-9
    assert len(folds.within(x, 15, folds.Pieces)) <= 15
    assert folds.piece_places(np.zeros(2), 1.0) == [0, 1] and folds.piece_places(np.zeros(0), 1.0) == []


def test_sweep_equals_single_runs(spark):
    s = read_samples(spark, SF)
    configs = [{"capacity": 8, "overload": 3, "policy": "span", "beta": 0.0}, {"capacity": 6, "overload": 2, "policy": "fifo"}]
    got = folds.swept(s, configs)
    for i, c in enumerate(configs):
        a, b = got.filter(f"config = {i}").drop("config"), folds.bounded(s, **c)
        assert a.count() == b.count() and a.exceptAll(b).isEmpty()
    assert {r.capacity for r in reports.queries()["span_sweep"](spark, SF).collect()} == {8, 16}


def test_stream_equals_batch_over_many_batches(spark, tmp_path):
    rng = np.random.default_rng(8)
    data = {"a": rng.normal(size=90), "b": rng.normal(size=31)}
    (tmp_path / "in").mkdir()
    for part in range(3):
        rows = [(k, i, v) for k, x in data.items() for i, v in enumerate(x) if i * 3 // len(x) == part] + ([(k, None, None) for k in data] if part == 2 else [])
        pd.DataFrame(rows, columns=["signal_id", "idx", "value"]).astype({"idx": "Int64"}).sample(frac=1, random_state=part).to_parquet(tmp_path / "in" / f"{part}.parquet")
        time.sleep(0.05)
    stream = spark.readStream.schema(bounded.OUT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = bounded.reduced(stream, 8, 3).writeStream.format("memory").queryName("survivors").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination()
    got = sorted((r.signal_id, r.idx) for r in spark.table("survivors").collect())
    assert got == sorted((k, i) for k, x in data.items() for i in folds.bounded_places(x, 8, 3, "interp"))


def test_replay_equals_batch(spark):
    s = read_samples(spark, SF)
    a, b = bounded.replayed(s, 8, 3).select(*KEYS, "idx", "value"), folds.bounded(s, 8, 3).select(*KEYS, "idx", "value")
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_peak_scores_are_whole(spark):
    got = matches.queries()["peak_scores"](spark, SF).toPandas()
    assert set(got["method"]) == set(reports.NAMES) and got["f1"].dropna().between(0, 1).all()


def test_spectrum_reads_every_sample(spark):
    rows = [("long", 0, i, float((i * 7) % 11)) for i in range(1034)] + [("short", 0, i, float(i)) for i in range(5)]
    got = classify.spectrum_of_blocks(spark.createDataFrame(rows, "signal_id string, segment long, idx long, value double")).collect()
    for name, block, n in (("long", 0, 512), ("long", 1, 512), ("long", 2, 10), ("short", 0, 5)):
        values = [v for s, _, i, v in rows if s == name and i // 512 == block]
        mags = [r.mag for r in sorted((r for r in got if (r.signal_id, r.block) == (name, block)), key=lambda r: r.k)]
        assert len(values) == n and np.allclose(mags, np.abs(np.fft.fft(values))[: n // 2], atol=1e-6)


def test_crossings_do_not_depend_on_the_order_of_rows(spark):
    """0.1 is the mean of each series, but sums in some orders miss it by a rounding error."""
    x = [0.0, 0.1, 0.2, 0.3, 0.1, 0.1, 0.0, 0.1, 0.2, -0.1]
    orders = [np.random.default_rng(i).permutation(len(x)) for i in range(40)]
    rows = [(f"s{nth}", 0, int(i), x[i]) for nth, order in enumerate(orders) for i in order]
    got = signals.profile(spark.createDataFrame(rows, "signal_id string, segment long, idx long, value double")).collect()
    assert {r.crossing_rate for r in got} == {0.1}


def test_crossings_are_those_of_a_sum_in_the_order_of_the_samples(spark):
    """The mean of each series is one of its samples; added up in order, it may miss that by a rounding error, and then the sample has a side, as in the SQL."""
    x = [[0.0, 0.1, 0.2, 0.3, 0.1, 0.1, 0.0, 0.1, 0.2, -0.1], *([round(v / 10, 1) for v in np.random.default_rng(i).integers(0, 8, 7).tolist()] for i in range(400))]
    rows = [(f"s{nth}", 0, i, v) for nth, own in enumerate(x) for i, v in enumerate(own)]
    rows = [rows[i] for i in np.random.default_rng(1).permutation(len(rows))]
    got = {r.signal_id: r.crossing_rate for r in signals.profile(spark.createDataFrame(rows, "signal_id string, segment long, idx long, value double")).collect()}
    for nth, own in enumerate(x):
        total = 0.0
        for v in own:
            total += v
        c = [v - total / len(own) for v in own]
        assert got[f"s{nth}"] == sum(a * b < 0 for a, b in zip(c, c[1:])) / len(own)  # noqa: B905


def test_parts_of_trials_follow_from_the_rows(spark, monkeypatch):
    monkeypatch.setattr(results, "ROWS_PER_PART", 100, raising=False)
    rows = spark.range(1000).selectExpr("id % 50 AS c", "id AS t", "if(id % 50 < 25, 1, id) AS v")
    got = results.distinct_trials(rows, ["c"], "t", "v")
    assert got.rdd.getNumPartitions() == 11 and got.count() == 25 + 500


def test_files_of_signals_do_not_grow_with_their_number(spark, tmp_path):
    rows = spark.range(2000).selectExpr("concat('s', id % 500) AS signal_id", "0L AS segment", "id div 500 AS idx", "id / 4 AS value")
    files.write_signals(rows, str(tmp_path / "s"))
    assert len(list((tmp_path / "s").rglob("*.txt"))) <= 4
    key = lambda r: (r.signal_id, r.segment, r.idx, r.value)
    assert sorted(map(key, files.read_signals(spark, str(tmp_path / "s")).collect())) == sorted(map(key, rows.collect()))


def test_spectrum_takes_no_row_for_each_sample_and_bin(spark):
    """Samples meet their bins inside a task; a sample without a value adds nothing, and places count modulo the block's number of rows."""
    values = {"a": {i: None if i == 3 else float(i % 5) for i in range(12)}, "b": {i: float(i) for i in range(0, 10, 2)}}
    rows = spark.createDataFrame([(name, 0, i, v) for name, own in values.items() for i, v in own.items()], "signal_id string, segment long, idx long, value double")
    got = classify.spectrum_of_blocks(rows, 16)
    assert "explode(sequence" not in got._jdf.queryExecution().optimizedPlan().toString()
    mags = {(r.signal_id, r.n, r.k): r.mag for r in got.collect()}
    true = {(name, len(own), k): abs(sum((v or 0.0) * np.exp(-2j * np.pi * k * i / len(own)) for i, v in own.items())) for name, own in values.items() for k in range(len(own) // 2)}
    assert mags.keys() == true.keys() and all(abs(mags[x] - true[x]) < 1e-9 for x in true)
