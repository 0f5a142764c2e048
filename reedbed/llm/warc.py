"""WARC fixity by Merkle trees.

Records are numbered slots. A slot's leaf is the digest of its record; a node is the digest of up to ``FANOUT``
children, in order, each with the range of bytes that it takes from the start of the node. So a root vouches for every
record and for the place of every record among the others. Two replicas are compared at their roots, and
only children of nodes that differ are looked at on the way down to the corrupt records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import written
from .tables import table

FANOUT = 16
RECORDS_PER_FILE = 1000


def record(number: Column, url: Column, body: Column) -> Column:
    """A response record of WARC 1.1 as text; a null body or address counts as empty."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(number.cast("string"), F.lit("none")), F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, number: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(slot, record): the pages as records. A null number has slot -1, beside a real -1; their identifiers differ."""
    return pages.select(F.coalesce(pages[number].cast("long"), F.lit(-1)).alias("slot"), record(pages[number], pages[url], pages[body]).alias("record"))


def leaves(replica: DataFrame) -> DataFrame:
    """(slot, digest, length, copies, record_sha256) for each slot of (slot, record).

    Records that share a slot give one leaf: their digests are summed piecewise, so their order does not matter and a
    slot with very many records is combined before the shuffle. record_sha256 is the smallest of theirs.
    """
    hashed = replica.select("slot", F.sha2(F.col("record").cast("binary"), 256).alias("h"), F.octet_length("record").cast("long").alias("length"))
    piece = lambda at: F.sum(F.conv(F.substring("h", at, 13), 16, 10).cast("decimal(20,0)"))
    sums = hashed.groupBy("slot").agg(F.count(F.lit(1)).alias("copies"), F.sum("length").alias("length"), F.min("h").alias("record_sha256"), *[piece(1 + 13 * i).alias(f"s{i}") for i in range(5)])
    return sums.select("slot", F.sha2(F.concat_ws(",", "copies", *[f"s{i}" for i in range(5)]), 256).alias("digest"), "length", "copies", "record_sha256")


def parents(nodes: DataFrame) -> DataFrame:
    """(side, node, digest, length) one level up; a node has at most ``FANOUT`` children. The digest is that of each child's
    number, range of offsets [start, end) within the node and digest."""
    children = F.sort_array(F.collect_list(F.struct("node", "digest", "length")))
    grouped = nodes.groupBy("side", F.floor(F.col("node") / FANOUT).alias("node")).agg(children.alias("children"), F.sum("length").alias("length"))
    end = lambda at: F.aggregate(F.slice("children", F.lit(1), at), F.lit(0).cast("long"), lambda total, c: total + c["length"])
    ranges = F.transform("children", lambda c, i: F.struct(c["node"].alias("node"), end(i).alias("start"), end(i + 1).alias("end"), c["digest"].alias("digest")))
    return grouped.select("side", "node", F.sha2(F.to_json(ranges), 256).alias("digest"), "length")


def differing(level: DataFrame, under: DataFrame | None) -> DataFrame:
    """Nodes whose digests differ between the sides, among the children of ``under`` (all nodes if None)."""
    if under is not None:
        wanted = under.select(F.col("node").alias("parent"))
        level = level.join(wanted, F.floor(F.col("node") / FANOUT) == F.col("parent"), "left_semi")
    seen = level.groupBy("node").agg(F.max(F.when(F.col("side") == 0, F.col("digest"))).alias("own"), F.max(F.when(F.col("side") == 1, F.col("digest"))).alias("other"))
    return seen.filter(~F.col("own").eqNullSafe(F.col("other")))


def audit(primary: DataFrame, replica: DataFrame, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """One row per slot of either side of (slot, record): slot, file, offset, length, copies, record_sha256, status.

    status: ok, corrupt (both have the slot, contents differ), missing (not in the replica) or extra (only there).
    Offsets are those of the primary file, in which ``per_file`` slots follow each other; extra slots have none.
    Two empty sides give no rows.
    """
    both = written(leaves(primary).withColumn("side", F.lit(0)).union(leaves(replica).withColumn("side", F.lit(1))).withColumnRenamed("slot", "node"))
    far = both.agg(F.max(F.abs("node"))).first()[0] or 0
    levels = [both.select("side", "node", "digest", "length")]
    while FANOUT ** (len(levels) - 1) <= far:
        levels.append(written(parents(levels[-1])))
    found = None
    for level in reversed(levels):
        found = written(differing(level, found))
    status = found.select(F.col("node").alias("bad"), F.when(F.col("own").isNull(), "extra").when(F.col("other").isNull(), "missing").otherwise("corrupt").alias("state"))
    own = both.filter("side = 0").withColumn("file", F.floor(F.col("node") / per_file))
    order = Window.partitionBy("file").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.select("node", "file", F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"), "length", "copies", "record_sha256")
    extra = both.filter("side = 1").join(own.select(F.col("node").alias("o")), F.col("node") == F.col("o"), "left_anti")
    every = placed.unionByName(extra.select("node", F.floor(F.col("node") / per_file).alias("file"), F.lit(None).cast("long").alias("offset"), "length", "copies", "record_sha256"))
    return every.join(status, F.col("node") == F.col("bad"), "left").select(F.col("node").alias("slot"), "file", "offset", "length", "copies", "record_sha256", F.coalesce("state", F.lit("ok")).alias("status"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with damage that the identifier alone decides: changed, cut, lost and added pages."""
    lot = F.crc32(pages["page_id"].cast("string"))
    html = F.when(lot % 101 == 3, F.overlay("html", F.lit("#"), 2, 1)).when(lot % 103 == 5, F.expr("left(html, length(html) - 1)")).otherwise(F.col("html"))
    kept = pages.select("page_id", "url", html.alias("html"), lot.alias("lot"))
    return kept.filter("lot % 107 <> 7 or lot is null").drop("lot").unionByName(pages.filter(lot % 109 == 9).select((-2 - F.col("page_id")).alias("page_id"), "url", "html"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(records(pages), records(damaged(pages))).select(F.col("slot").alias("page_id"), "file", "offset", "length", "copies", "record_sha256", "status")


_RECORD = r"""'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
 || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10)"""
#: DuckDB has no crc32: the damage is found by comparing the replica's rule on the identifier's text bit by bit.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(page_id::VARCHAR, '')]), lambda c, b:
 list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda s, z: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END))"""
OP5_SQL = f"""
WITH p AS (SELECT page_id, {_RECORD} AS rec, xor({_CRC}, 4294967295) AS lot FROM (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages)),
own AS (SELECT page_id, page_id // 1000 AS file, coalesce(sum(strlen(rec)) OVER (PARTITION BY page_id // 1000 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
 strlen(rec) AS length, 1::BIGINT AS copies, sha256(rec) AS record_sha256,
 CASE WHEN lot % 107 = 7 THEN 'missing' WHEN lot % 101 = 3 OR lot % 103 = 5 THEN 'corrupt' ELSE 'ok' END AS status FROM p),
q AS (SELECT -2 - pages.page_id AS page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages JOIN p USING (page_id) WHERE lot % 109 = 9),
more AS (SELECT page_id, {_RECORD} AS rec FROM q)
SELECT * FROM own UNION ALL
SELECT page_id, floor(page_id / 1000.0)::BIGINT, NULL, strlen(rec), 1, sha256(rec), 'extra' FROM more
"""
