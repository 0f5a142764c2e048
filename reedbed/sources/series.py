"""Tables as ordered series: (signal_id, segment, idx, value).

A segment is a fixed span of days of one signal, so that no signal is one unbounded group: every window and fold of this
package works within (signal_id, segment).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ["signal_id", "segment"]
SEGMENT_DAYS = 30


def samples(events: DataFrame, signal: str = "user_id", ts: str = "ts", tie: str = "event_id", value: str = "value", days: int = SEGMENT_DAYS) -> DataFrame:
    """Number the rows of each (signal, segment) by time; rows without signal, time or value are left out."""
    rows = events.select(
        events[signal].cast("string").alias("signal_id"), F.floor(F.datediff(F.to_date(events[ts]), F.lit("1970-01-01").cast("date")) / days).cast("long").alias("segment"),
        events[ts].alias("ts"), events[tie].alias("tie"), events[value].cast("double").alias("value"),
    ).filter("signal_id is not null and ts is not null and value is not null")
    order = Window.partitionBy(*KEYS).orderBy("ts", "tie")
    return rows.select(*KEYS, (F.row_number().over(order) - 1).cast("long").alias("idx"), "value")


def read_samples(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return samples(spark.read.parquet(f"{sf_dir}/events.parquet"), **options)


def long_enough(series: DataFrame, least: int) -> DataFrame:
    """Only segments with at least ``least`` samples."""
    return series.withColumn("n__", F.count(F.lit(1)).over(Window.partitionBy(*KEYS))).filter(F.col("n__") >= least).drop("n__")


def delta_code(survivors: DataFrame) -> DataFrame:
    """Kept places as differences, the first one absolute: (signal_id, segment, retained, deltas)."""
    order = Window.partitionBy(*KEYS).orderBy("idx")
    steps = survivors.select(*KEYS, "idx", (F.col("idx") - F.coalesce(F.lag("idx").over(order), F.lit(0))).alias("step"))
    return steps.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("retained"), F.transform(F.sort_array(F.collect_list(F.struct("idx", "step"))), lambda x: x["step"]).alias("deltas"))


def delta_decode(coded: DataFrame) -> DataFrame:
    each = coded.select(*KEYS, F.posexplode("deltas").alias("place", "step"))
    order = Window.partitionBy(*KEYS).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return each.select(*KEYS, F.sum("step").over(order).alias("idx"))
