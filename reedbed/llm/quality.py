"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k | text) = logistic(threshold_k - s(text)), where s is linear in hashed features of the text and the same
for all thresholds, and the thresholds are ordered. The expected grade and the tail probability P(grade >= k) serve
selection. A text's features are the means over its chunks (between white space) of: the chunk's letters, hashed;
the signs before and after them; its case; and repetition of a chunk just before. s is therefore a mean of values of chunks, kept per worker in a table.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut_lineage
from . import linear
from .sampling import held_out, thinned
from .tables import added, table
from .words import WordTable, held

DIM = 1 << 18
#: Rated rows that the model is fitted on, at most (about: taken by hash), and the partitions they lie in.
TRAIN_ROWS = 16_000
TRAIN_PARTS = 8
#: Mean features are small; this scale suits the step of the fit.
SCALE = 10.0
#: A text is kept if P(grade >= KEEP_GRADE) is at least KEEP_PROBABILITY.
KEEP_GRADE, KEEP_PROBABILITY = 1, 0.5
#: Stands for a repetition; no chunk holds a null character alone.
AGAIN = "\x00"
_CHUNK = re.compile(r"^([^\w]*)(.*?)([^\w]*)$", re.S)


def features(chunk: str) -> list[int]:
    """Hashed features of one chunk: its lower-cased core, signs before, signs after, case."""
    before, core, after = _CHUNK.match(chunk).groups()
    case = "u" if core.isupper() and len(core) > 1 else "t" if core[:1].isupper() else "l"
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) & (DIM - 1) for f in (f"w {core.lower()}", f"b {before}", f"a {after}", f"c {case}")]


def chunks_of(text: str | None) -> list[str]:
    """The text's chunks, and the chunk ``AGAIN`` once for each that repeats one of the three before it."""
    chunks = text.split() if isinstance(text, str) else []
    return chunks + [AGAIN] * sum(sum(map(eq, chunks[lag:], chunks)) for lag in (1, 2, 3))


def vector(text: str | None) -> tuple[list[int], list[float]]:
    sums: dict[int, float] = {}
    chunks = chunks_of(text)
    for chunk in chunks:
        for f in features(chunk):
            sums[f] = sums.get(f, 0.0) + SCALE / len(chunks)
    return list(sums), list(sums.values())


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def of_chunks(self, chunks: list[str]) -> np.ndarray:
        index = np.array([features(c) for c in chunks])
        return SCALE * self.weights[index].sum(1)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... in columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))


def ordered(free: np.ndarray) -> np.ndarray:
    """Thresholds from free parameters: the first, then logarithms of the gaps."""
    return np.cumsum(np.concatenate((free[:1], np.exp(np.clip(free[1:], -6, 6)))))


def cumulative_loss(scores: np.ndarray, grades: np.ndarray, free: np.ndarray):
    """Gradient of the negative log-likelihood of the grades, by score and by free threshold parameter."""
    cuts = ordered(free)
    grades = grades.astype(np.int64)
    edge = np.concatenate(([-np.inf], cuts, [np.inf]))
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    low, high = sigmoid(edge[grades] - scores), sigmoid(edge[grades + 1] - scores)
    slope = 1 - low - high  # d -log(high - low) / d score
    width = np.maximum(high - low, 1e-9)
    by_cut = np.zeros(len(cuts))
    for k in range(len(cuts)):
        top, bottom = grades == k, grades == k + 1
        by_cut[k] = (-(high * (1 - high) / width)[top].sum() + (low * (1 - low) / width)[bottom].sum()) / max(1, len(scores))
    chain = np.concatenate(([1.0], np.exp(np.clip(free[1:], -6, 6))))
    return slope, np.cumsum(by_cut[::-1])[::-1] * chain


def train(rated: DataFrame, grades: int, text: str = "text", grade: str = "grade", doc_id: str = "doc_id", bound: int = TRAIN_ROWS) -> Ordinal:
    """``rated``: texts with a grade from 0 to ``grades - 1``; rows without a grade are left out. Fitted on about
    ``bound`` rows at most. Without rows all weights are 0."""
    rows = rated.select(rated[doc_id].alias("doc_id"), rated[text].alias("text"), rated[grade].cast("double").alias("target")).filter("target is not null")
    picked = thinned(rows, "doc_id", bound)

    def featurise(batches):
        for b in batches:
            idx, val = zip(*map(vector, b.column("text").to_pylist()), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32())), b.column("target")], ["doc_id", "idx", "val", "target"])

    made = picked.repartition(TRAIN_PARTS, F.xxhash64("doc_id", "text")).sortWithinPartitions("doc_id").mapInArrow(featurise, "doc_id long, idx array<int>, val array<float>, target double")
    weights, free = linear.fit(cut_lineage(made), DIM, np.concatenate(([-1.0], np.zeros(grades - 2))), cumulative_loss, rounds=3, epochs=8, rate=0.3, l1=1e-5)
    return Ordinal(weights, ordered(free))


def predictor(spark: SparkSession, model: Ordinal, keep_grade: int = KEEP_GRADE, keep_probability: float = KEEP_PROBABILITY):
    """A column function: text -> struct(expected_grade, tail_probability, keep)."""
    shared = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    number = shared._jbroadcast.id()

    @F.pandas_udf("expected_grade double, tail_probability double, keep boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        own = Ordinal(*shared.value)
        sums, counts = held(("quality", number), lambda: WordTable(own.of_chunks)).sums(map(chunks_of, texts))
        tails = own.tails(sums[:, 0] / np.maximum(counts, 1))
        return pd.DataFrame({"expected_grade": tails.sum(1), "tail_probability": tails[:, keep_grade - 1], "keep": tails[:, keep_grade - 1] >= keep_probability})

    return predict


def grade(docs: DataFrame, model: Ordinal, text: str = "text", out: str = "quality", **rule) -> DataFrame:
    """``docs`` with a struct ``out``: expected_grade, tail_probability, keep. A null or empty text has score 0, so its
    probabilities follow from the thresholds alone. Repeated rows and other columns pass as they are; a column named ``out`` is
    refused."""
    return added(docs, out, predictor(docs.sparkSession, model, **rule)(docs[text]))


#: Grades of the labels table: 0 poor, 1 sound but toxic, 2 sound and clean.
GRADES = 3


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows that are not held out, with their grade; labels without a quality give none. Of several grades of a
    document the smallest counts."""
    grades = F.when(labels["quality"] == 0, 0).when(labels["quality"] == 1, F.when(labels["toxic"] == 1, 1).otherwise(2))
    own = labels.select(labels["doc_id"].alias("l_id"), grades.alias("grade")).filter("grade is not null").groupBy("l_id").agg(F.min("grade").alias("grade"))
    texts = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).filter(~held_out(F.col("doc_id")))
    return texts.join(own, texts["doc_id"] == own["l_id"]).select("doc_id", "text", "grade")


def bounded(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """The labels are thinned before the join, so only about ``bound`` texts are joined at all."""
    named = labels.filter(~held_out(labels["doc_id"]))
    return rated(docs, thinned(named, "doc_id", bound))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(bounded(docs, table(spark, sf_dir, "labels")), GRADES)
    got = grade(docs, model)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "quality.expected_grade", "quality.tail_probability", "quality.keep")
