"""The bounded-buffer reducer as keyed state: at most ``capacity`` samples per signal live between batches.

Rows of a signal come in order of ``idx`` from batch to batch; within a batch they are sorted here. A row with a null
``idx`` ends its signal: what the buffer still holds is let out, and the state is removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..checkpoints import ensure_checkpoint_dir
from ..operators.folds import Buffer

OUT = "signal_id string, idx long, value double"
STATE = "idx array<long>, value array<double>, arrived long"


def reduced(stream: DataFrame, capacity: int, overload: int, policy: str = "interp", **options) -> DataFrame:
    """``stream``: signal_id, idx, value. The samples that leave the buffer alive, as the batch reducer chooses them."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        places, values, arrived = state.get if state.exists else ([], [], 0)
        buffer = Buffer(capacity, overload, policy, list(places), list(values), arrived, **options)
        rows = pd.concat(list(parts), ignore_index=True)
        new = rows.dropna(subset=["idx"]).sort_values("idx")
        out = [left for i, x in zip(new["idx"].astype("int64"), new["value"], strict=True) if (left := buffer.push(i, x)) is not None]
        if len(new) < len(rows):
            out += buffer.rest()
            if state.exists:
                state.remove()
        else:
            state.update((buffer.places, buffer.values, buffer.arrived))
        yield pd.DataFrame({"signal_id": [key[0]] * len(out), "idx": [i for i, _ in out], "value": [x for _, x in out]}).astype({"idx": "int64", "value": "float64"})

    return stream.select("signal_id", "idx", "value").groupBy("signal_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def replayed(series: DataFrame, capacity: int, overload: int, policy: str = "interp", **options) -> DataFrame:
    """A finished table of series sent through the stream: each segment is a signal with its end. Input, state and output
    lie in the shared folder."""
    spark = series.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    rows = series.select(F.concat_ws("/", "signal_id", "segment").alias("signal_id"), "idx", "value")
    ends = rows.select("signal_id").distinct().select("signal_id", F.lit(None).cast("long").alias("idx"), F.lit(None).cast("double").alias("value"))
    rows.unionByName(ends).write.parquet(f"{folder}/in")
    stream = reduced(spark.readStream.schema(OUT).parquet(f"{folder}/in"), capacity, overload, policy, **options)
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    name = F.split("signal_id", "/(?=[^/]*$)")
    return spark.read.schema(OUT).parquet(f"{folder}/out").select(name[0].alias("signal_id"), name[1].cast("long").alias("segment"), "idx", "value")
