"""Packing by minimum bin slack.

Texts longer than a window are cut at multiples of it; what remains is packed whole. The multiset of lengths (at most
``capacity`` distinct ones, whatever the number of texts) is planned on the driver: the largest length left opens a
window, and a subset-sum over a bitset picks the multiset of other lengths that leaves the least slack, with counts
traced back through the stored bitsets. A filling is used as often as its lengths last, so the plan's size depends on
the capacity alone. Spark then numbers the pieces of each length and each piece finds its place in the plan.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import cut_lineage
from .tables import table
from .tokens import encoder, some, vocabulary_path

CAPACITY = 4096
END_ID = 2


def fill(room: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """The multiset of ``lengths`` (descending, ``counts`` of each) with the largest sum that is not above ``room``."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        if length > room:
            continue
        left, take = min(counts[length], room // length), 1
        while left:
            n = min(take, left)
            grown = (reach | reach << (n * length)) & mask
            if grown != reach:
                steps.append((length, n, reach))
                reach = grown
            left, take = left - n, 2 * take
        if reach >> room:
            break
    target, used = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> target & 1:
            used[length] = used.get(length, 0) + n
            target -= n * length
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: pieces}) for each filling; every piece of ``counts`` is in exactly one window."""
    left, out = {k: n for k, n in counts.items() if n > 0}, []
    order = sorted(left, reverse=True)
    while left:
        order = [x for x in order if x in left]
        first = order[0]
        left[first] -= 1
        used = fill(capacity - first, [x for x in order if left[x]], left)
        left[first] += 1
        used[first] = used.get(first, 0) + 1
        times = min(left[x] // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((times, used))
    return out


def places(fillings: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For each length and filling: the first number of its pieces, pieces per window, first window, offset there."""
    taken: dict[int, int] = {}
    rows, window = [], 0
    for times, used in fillings:
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            rows.append((length, taken.get(length, 0), n, window, offset))
            taken[length] = taken.get(length, 0) + n * times
            offset += n * length
        window += times
    found = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {"key": found[:, 0] << 44 | found[:, 1], "start": found[:, 1], "per": found[:, 2], "window": found[:, 3], "offset": found[:, 4]}


def pack(pieces: DataFrame, length: str = "length", order: tuple[str, ...] = (), capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (lengths from 1 to ``capacity``) with sequence_id and offset, without gaps from 0 in each sequence.

    ``pieces`` must be cut from its lineage, so that a row stays in its partition. Pieces of one length are numbered
    partition by partition: no task sees more of a frequent length than one partition's rows.
    """
    columns = pieces.columns
    row = pieces.select(F.struct(*[pieces[c] for c in columns]).alias("row"), pieces[length].cast("long").alias("len"), F.spark_partition_id().alias("part"))
    counts = row.groupBy("len", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("len", "part", (F.sum("n").over(Window.partitionBy("len").orderBy("part")) - F.col("n")).alias("base"))
    totals = {r["len"]: r.n for r in row.groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect()}
    fillings = plan(totals, capacity)
    shared = pieces.sparkSession.sparkContext.broadcast(places(fillings))
    numbered = row.select("row", "len", "part", (F.row_number().over(Window.partitionBy("len", "part").orderBy(*[F.col("row")[c] for c in order or columns])) - 1).alias("own"))
    ranked = numbered.join(before, ["len", "part"]).select("row", "len", (F.col("base") + F.col("own")).alias("rank"))

    def place(batches):
        p = shared.value
        for b in batches:
            lengths, ranks = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("len", "rank"))
            at = np.searchsorted(p["key"], lengths << 44 | ranks, side="right") - 1
            own = ranks - p["start"][at]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(p["window"][at] + own // p["per"][at]), pa.array(p["offset"][at] + own % p["per"][at] * lengths)], ["row", "sequence_id", "offset"])

    kept = [c for c in columns if c not in ("sequence_id", "offset")]
    schema = "row struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in pieces.schema) + ">, sequence_id long, offset long"
    out = ranked.mapInArrow(place, schema)
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "sequence_id", "offset")


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids, as little-endian 32-bit numbers) of each piece of each row.

    Every row gives at least one piece, as its ids end in ``END_ID``; a null text counts as empty. Rows that repeat, or
    share an identifier or have none, are separate texts with pieces of their own.
    """
    where = path or vocabulary_path()

    def cut(batches):
        for b in batches:
            for names, texts in zip(some(b.column("i").to_pylist(), 256), some(b.column("t").to_pylist(), 256), strict=True):
                rows = []
                for name, data in zip(names, encoder(where).encode(texts), strict=True):
                    data += END_ID.to_bytes(4, "little")
                    for at in range(0, len(data), 4 * capacity):
                        own = data[at : at + 4 * capacity]
                        rows.append((name, at // 4, len(own) // 4, zlib.crc32(own), len(data) // 4, own if with_ids else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 5 + (pa.binary(),), strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    made = docs.select(docs[doc_id].cast("long").alias("i"), docs[text].alias("t")).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    return made if with_ids else made.drop("ids")


def packed(docs: DataFrame, **options) -> DataFrame:
    return pack(cut_lineage(pieces(docs, **options)), order=("doc_id", "start"), capacity=options.get("capacity", CAPACITY))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"))
