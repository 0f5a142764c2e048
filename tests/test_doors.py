"""Doors as a stream: many batches, a late end, a restart, idle keys, and equality with the batch form."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from reedbed.operators import folds
from reedbed.streaming import doors

SCHEMA = "signal_id string, idx long, value double, ts timestamp"
START = datetime.datetime(2024, 1, 1)


def rows_of(signal, x, first=0, at=0):
    return [(signal, first + i, float(v), START + datetime.timedelta(seconds=at + first + i)) for i, v in enumerate(x)]


class Run:
    """One query over files that come one by one; each call of ``step`` is a run of its own from the checkpoint."""

    def __init__(self, spark, folder, kind, tolerance, **options):
        self.spark, self.folder, self.kind, self.tolerance, self.options, self.n = spark, str(folder), kind, tolerance, options, 0

    def step(self, *batches):
        for rows in batches:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        out = doors.compressed(stream, self.kind, self.tolerance, **self.options)
        out.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start().awaitTermination()
        got = self.spark.read.schema(doors.OUT).parquet(f"{self.folder}/out").collect()
        return {s: sorted(r.idx for r in got if r.signal_id == s) for s in {r.signal_id for r in got}}


@pytest.fixture
def stored(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", doors.STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("kind", [folds.Door, folds.Pieces])
def test_stream_equals_batch(stored, tmp_path, kind):
    """Three batches, a stop and a start between, repeated rows, an end in the last one."""
    rng = np.random.default_rng(41)
    x = {"a": np.cumsum(rng.normal(size=90)), "b": np.cumsum(rng.normal(size=40)), "c": np.array([1.0])}
    run = Run(stored, tmp_path, kind, 1.2)
    run.step(rows_of("a", x["a"][:30]) + rows_of("b", x["b"][:1]), rows_of("b", x["b"][1:25], 1)[::-1])
    end = [(s, None, None, START + datetime.timedelta(seconds=95)) for s in x]
    got = run.step(rows_of("a", x["a"][20:90], 20) + rows_of("b", x["b"][25:], 25) + rows_of("c", x["c"]), end)
    series = stored.createDataFrame([(s, 0, i, float(v)) for s, own in x.items() for i, v in enumerate(own)], "signal_id string, segment long, idx long, value double")
    want = folds.at_tolerance(series, kind, 1.2).groupBy("signal_id").agg(F.sort_array(F.collect_list("idx")).alias("idx")).collect()
    assert got == {r.signal_id: r.idx for r in want}


def test_idle_keys_end(stored, tmp_path):
    """A signal that falls silent is let out once the watermark is past its last row by ``idle``; later rows begin it anew."""
    run = Run(stored, tmp_path, folds.Door, 0.5, idle=datetime.timedelta(seconds=60), late="1 second")
    line = np.arange(10.0)
    got = run.step(rows_of("quiet", line), rows_of("busy", line, at=30))
    assert got["quiet"] == [0]
    got = run.step(rows_of("busy", np.arange(5.0), 10, 200), rows_of("busy", np.arange(5.0), 15, 300))
    assert got["quiet"] == [0, 9]
    got = run.step(rows_of("quiet", line[:3], 50, 400))
    assert got["quiet"] == [0, 9, 50]
