"""Exact de-duplication by content sort.

Rows are ordered by (start of the normalised text, its digest, longest original first, smallest identifier).
Splitters sampled from that order deal the rows to ranges, Spark sorts each range externally, and neighbours are
compared in full. Texts cross the network once. The order ends in the identifier, so that splitters fall inside a
large group of copies too and spread it over many ranges; such groups are known from the splitters, and their size
and survivor come from one aggregation with map-side combine. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The characters that normalisation deletes (0x20 and 0x09 to 0x0D).
SPACES = " \t\n\x0b\x0c\r"
#: Ranges for each shuffle partition, and rows of a range (there are more ranges if there are more rows).
RANGES_PER_PARTITION = 4
ROWS_PER_RANGE = 1_000_000
SAMPLES_PER_RANGE = 24
#: Characters of a text, and of text and digest, at the front of a key.
HEAD = 48
GROUP = HEAD + 64


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def sort_key(text: Column, doc_id: Column) -> Column:
    """Fixed widths: start of the text, SHA-256, original length downwards, identifier (null last)."""
    return F.concat(
        F.rpad(F.substring(normalised(text), 1, HEAD), HEAD, "\x00"),
        F.sha2(normalised(text).cast("binary"), 256),
        F.lpad((F.lit(2**31) - F.length(F.coalesce(text, F.lit("")))).cast("string"), 10, "0"),
        F.coalesce(F.lpad((doc_id.cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0"), F.lit("~")),
    )


def splitters(rows: DataFrame, ranges: int, total: int) -> tuple[list[str], list[str]]:
    """At most ``ranges - 1`` sampled keys of (t, i) at even places, and the groups that hold two or more of them.

    A splitter that is alone in its group is moved to the group's start, so only those groups are ever divided.
    The sample's size follows ``ranges``; rows are sampled before their keys are computed, in one job.
    """
    if ranges < 2 or not total:
        return [], []
    sampled = rows.sample(False, min(1.0, ranges * SAMPLES_PER_RANGE / total), seed=11)
    sample = sorted(r[0] for r in sampled.select(sort_key(F.col("t"), F.col("i")).alias("k")).collect())
    cuts = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    groups = [c[:GROUP] for c in cuts]
    large = sorted({g for g, h in zip(groups, groups[1:], strict=False) if g == h})
    return sorted({c if c[:GROUP] in set(large) else c[:GROUP] for c in cuts}), large


def range_of(key: Column, cuts: list[str], width: int = 64) -> Column:
    """How many splitters are not above the key: first among every ``width``-th, then within one block."""
    below = lambda some: F.size(F.filter(some, lambda c: c <= key))
    if len(cuts) <= width:
        return below(F.lit(cuts)) if cuts else F.lit(0)
    blocks = [cuts[at : at + width] for at in range(0, len(cuts), width)]
    block = F.greatest(below(F.lit([b[0] for b in blocks])), F.lit(1))
    return (block - 1) * width + below(F.element_at(F.lit(blocks), block))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", ranges: int | None = None) -> DataFrame:
    """All rows and columns of ``docs`` and a struct ``exact`` of

    keep_id (identifier of the row that stays), group_size, kept, text_sha256 (of the normalised text, hex).

    Equal: identical after deleting the characters of ``SPACES``. Of equal texts the row with the most code points
    stays, then the one with the smallest identifier; null identifiers come last, and of rows that tie in all of this
    (repeated rows) exactly one stays. A null text counts as empty. Empty input gives an empty result. ``exact``
    replaces a column of that name; all other columns pass as they are, whatever their names.
    """
    total = docs.count()
    if ranges is None:
        ranges = max(RANGES_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // ROWS_PER_RANGE)
    own = [c for c in docs.columns if c != "exact"]
    rows = docs.select(F.struct(*[docs[c] for c in own]).alias("row"), docs[text].alias("t"), docs[doc_id].cast("long").alias("i"))
    keyed = rows.select("row", "i", sort_key(F.col("t"), F.col("i")).alias("k"))
    cuts, large = splitters(rows.select("t", "i"), ranges, total)

    dealt = keyed.select("row", "i", "k", range_of(F.col("k"), cuts).alias("at"))
    order = Window.partitionBy("at").orderBy("k")
    seen = dealt.select("*", F.lag(F.col("row")[text]).over(order).alias("before"), F.row_number().over(order).alias("place"))
    starts = (F.col("place") == 1) | (normalised(F.col("before")) != normalised(F.col("row")[text]))
    runs = seen.select("row", "i", "k", "at", "place", F.sum(starts.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    run = Window.partitionBy("at", "run")
    sized = runs.select("row", "k", "place", F.min(F.struct("k", "place", "i")).over(run).alias("first"), F.count(F.lit(1)).over(run).alias("n"))

    first, n, kept = F.col("first.i"), F.col("n"), F.col("place") == F.col("first.place")
    if large:
        # one row for each group that splitters divide: fewer than half the ranges
        group = F.substring("k", 1, GROUP)
        whole = keyed.filter(group.isin(large)).groupBy(group.alias("g")).agg(F.min(F.struct("k", "i")).alias("best"), F.count(F.lit(1)).alias("total"))
        sized = sized.join(F.broadcast(whole), group == F.col("g"), "left")
        first, n = F.when(F.col("g").isNull(), first).otherwise(F.col("best.i")), F.coalesce("total", n)
        kept = kept & (F.col("g").isNull() | (F.col("k") == F.col("best.k")))
    return sized.select(*[F.col("row")[c].alias(c) for c in own], F.struct(first.alias("keep_id"), n.alias("group_size"), kept.alias("kept"), F.substring("k", HEAD + 1, 64).alias("text_sha256")).alias("exact"))


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "exact.keep_id", "exact.group_size", "exact.kept", "exact.text_sha256")


OP10_SQL = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept, count(*) OVER (PARTITION BY norm) AS group_size
      FROM n WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id))
SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM r
"""
