"""Reading the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def added(df: DataFrame, name: str, column: Column) -> DataFrame:
    """``df`` with one more column. A column of that name (in any case) would be lost, so it is refused."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {name}: name another output column")
    return df.withColumn(name, column)
