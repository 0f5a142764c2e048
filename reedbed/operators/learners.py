"""Learners on labelled vectors, judged fold by fold, and labelled windows after a reduction.

A fold is fitted by Spark ML on the rows of the other folds, so training data never lie in one task; the driver loops over
methods, not rows, and has the folds of one fitted side by side. The vectors are written first: three statistics and the folds read them. The kernel machine is a linear one on random Fourier features: with ``scale`` = 1 / (dimensions x
variance), features cos(w.x + b) for normal w of variance 2 x scale have the radial kernel exp(-scale |x - y|^2) as their
mean product (Rahimi and Recht, 2007).
"""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import discard, written
from .classify import stratified

SEED = 42
#: Random features of the kernel and the weight of a training error against the margin.
FEATURES, COST = 256, 10.0


def learner(kind: str, rows: int, seed: int = SEED) -> Estimator:
    """``forest``; ``logistic``; ``margins``, one linear support vector machine for each class against the rest."""
    weight = 1 / (COST * max(rows, 1))
    if kind == "forest":
        return RandomForestClassifier(numTrees=20, maxDepth=8, seed=seed)
    if kind == "logistic":
        return LogisticRegression(maxIter=30, regParam=weight)
    return OneVsRest(classifier=LinearSVC(maxIter=20, regParam=weight), parallelism=4)


def scaled(rows: DataFrame) -> DataFrame:
    """``features`` of ``x`` with mean 0 and deviation 1 in each dimension; one that does not vary is 0."""
    vectors = rows.withColumn("raw", array_to_vector("x"))
    return StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(vectors).transform(vectors).drop("raw", "x")


def radial(rows: DataFrame, width: int, features: int = FEATURES, seed: int = SEED) -> DataFrame:
    """``features`` of scaled vectors of ``width`` dimensions replaced by random Fourier features of the radial kernel."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, np.sqrt(2 / width), (width, features)), rng.uniform(0, 2 * np.pi, features)

    @F.pandas_udf("array<double>")
    def waves(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.sqrt(2 / features) * np.cos(np.stack(x.to_numpy()) @ w + b)) if len(x) else [])

    return rows.withColumn("features", array_to_vector(waves(vector_to_array("features"))))


def learned(vectors: DataFrame, folds: int = 5, kind: str = "margins", kernel: bool = True) -> DataFrame:
    """(vec_id, label, fold, predicted) of ``vectors`` (vec_id, label, embedding): each row is classified by a learner fitted on
    the other folds. Rows with a null label, an empty or null vector, or a null or infinite number in it, are left out; vectors have one
    length. Scaling is by all rows, as the folds' labels have no part in it. With fewer than two labels all rows get the one
    there is; a fold without rows gives none."""
    usable = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) != float("inf")))
    clean = written(vectors.filter(usable).select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x")))
    seen = clean.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width"), F.count_distinct("label").alias("labels")).first()
    dealt = stratified(clean, folds)
    if seen.labels < 2:
        return dealt.select("vec_id", "label", "fold", F.col("label").alias("predicted"))
    index = StringIndexer(inputCol="label", outputCol="target", stringOrderType="alphabetAsc").fit(dealt)
    ready = scaled(index.transform(dealt)).withColumnRenamed("label", "own").withColumnRenamed("target", "label")
    if kernel:
        ready = radial(ready, seen.width)
    table = written(ready.withColumn("features", vector_to_array("features")))
    ready = table.withColumn("features", array_to_vector("features"))
    names = F.array(*[F.lit(x) for x in index.labels])

    def judged(fold: int) -> DataFrame:
        model = learner(kind, seen.n).fit(ready.filter(F.col("fold") != fold))
        return model.transform(ready.filter(F.col("fold") == fold)).select("vec_id", F.col("own").alias("label"), "fold", F.element_at(names, (F.col("prediction") + 1).cast("int")).cast(vectors.schema["label"].dataType).alias("predicted"))

    with ThreadPool(folds) as pool:
        found = pool.map(inheritable_thread_target(vectors.sparkSession)(judged), range(folds))
    out = written(reduce(DataFrame.unionByName, found))
    discard(table, clean)
    return out


def fold_accuracy(found: DataFrame, *more: str) -> DataFrame:
    """(more, fold, n, hits, accuracy)."""
    g = found.groupBy(*more, "fold").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("predicted") == F.col("label")).cast("long")).alias("hits"))
    return g.withColumn("accuracy", F.col("hits") / F.col("n"))


def as_series(vectors: DataFrame) -> DataFrame:
    """Each labelled vector as a series of its own (signal_id, segment 0)."""
    each = vectors.filter("label is not null").select(F.col("vec_id").cast("string").alias("signal_id"), F.lit(0).cast("long").alias("segment"), F.posexplode("embedding").alias("idx", "value"))
    return each.select("signal_id", "segment", F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value"))


def as_vectors(series: DataFrame, labels: DataFrame, value: str, *more: str) -> DataFrame:
    """The series back as (more, vec_id, label, embedding)."""
    g = series.groupBy(*more, "signal_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", F.col(value).alias("v")))), lambda p: p["v"]).alias("embedding"))
    return g.join(labels.select(F.col("vec_id").cast("string").alias("signal_id"), "vec_id", "label"), "signal_id").select(*more, "vec_id", "label", "embedding")
