"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import discard, written

#: Rows of a file of a round's table: few links take few tasks.
ROWS_PER_PART = 50_000


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, label) for every node of a link; the label is the smallest node of its component.

    Smallest labels spread over links and then over labels (pointer jumping), so rounds grow with the logarithm of
    the longest chain. Every round is a written table, removed when the next one stands; nothing but one number returns to the driver.
    """
    pairs = links.select(F.col(left).alias("u"), F.col(right).alias("v"))
    both = written(pairs.union(pairs.select("v", "u")).filter("u <> v").distinct())
    parts = 1 + both.count() // ROWS_PER_PART
    start = written(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")).coalesce(parts))
    labels = start
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels["node"] == near["u"], "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("higher"))
        jumped = written(spread.join(up, spread["label"] == up["up"], "left").select("node", "old", F.least("label", "higher").alias("label")).coalesce(parts))
        changed = jumped.filter("label <> old").limit(1).count()
        discard(start)
        start, labels = jumped, jumped.select("node", "label")
        if not changed:
            discard(both)
            return labels
