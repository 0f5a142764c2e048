"""Which rows a model is fitted on: bounded, chosen by identifier, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 4
HELD = 2


def part(doc_id: Column) -> Column:
    """crc32 of the identifier as text, modulo 4; a null identifier counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % PARTS


def held_out(doc_id: Column) -> Column:
    return part(doc_id) == HELD


def thinned(df: DataFrame, key: str, bound: int, count: int | None = None, seed: int = 17) -> DataFrame:
    """About ``bound`` rows at most, taken by a hash of ``key`` (all rows if there are fewer)."""
    total = df.count() if count is None else count
    if total <= bound:
        return df
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * bound / total))
