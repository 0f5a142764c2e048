import numpy as np

from reedbed.operators import learners
from reedbed.plans import matches

VECTORS = "vec_id long, label string, embedding array<double>"


def rings(spark):
    """Two classes that no line parts: a disc and the ring around it."""
    rng = np.random.default_rng(8)
    turn, far = rng.uniform(0, 2 * np.pi, 300), np.where(np.arange(300) % 2 == 0, 0.5, 2.0) + rng.normal(0, 0.1, 300)
    rows = [(i, "ring" if i % 2 else "disc", [float(far[i] * np.cos(turn[i])), float(far[i] * np.sin(turn[i]))]) for i in range(300)]
    return spark.createDataFrame([*rows, (900, None, [0.0, 0.0]), (901, "disc", None), (902, "disc", []), (903, "ring", [float("nan"), 0.0]), (904, "ring", [None, 1.0])], VECTORS)


def test_kernel_parts_what_a_line_cannot(spark):
    data, got = rings(spark), {}
    for kind, kernel in (("margins", True), ("logistic", True), ("logistic", False), ("forest", False)):
        found = learners.learned(data, 3, kind, kernel)
        assert found.count() == 300 and found.select("vec_id").distinct().count() == 300
        rows = learners.fold_accuracy(found).collect()
        assert sum(r.n for r in rows) == 300 and {r.fold for r in rows} == {0, 1, 2}
        got[kind, kernel] = sum(r.hits for r in rows) / 300
    assert min(got["margins", True], got["logistic", True], got["forest", False]) > 0.97 and got["logistic", False] < 0.75


def test_random_features_meet_the_kernel(spark):
    x = np.random.default_rng(3).normal(size=(12, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<double>")
    ready = rows.withColumn("features", learners.array_to_vector("x"))
    z = np.array([r.features.toArray() for r in learners.radial(ready, 4, features=4096).orderBy("vec_id").collect()])
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 4)
    assert np.abs(z @ z.T - want).max() < 0.08


def test_one_label_and_no_rows(spark):
    one = spark.createDataFrame([(1, "a", [1.0]), (2, "a", [2.0])], VECTORS)
    assert {r.predicted for r in learners.learned(one).collect()} == {"a"}
    assert learners.learned(one.limit(0)).count() == 0


def test_vectors_return_from_series(spark):
    rows = spark.createDataFrame([(7, "a", [1.0, 2.0, 3.0]), (8, "b", [0.0, 5.0, 1.0])], VECTORS)
    back = learners.as_vectors(learners.as_series(rows), rows, "value")
    assert sorted(back.select("vec_id", "label", "embedding").collect()) == sorted(rows.collect())


def test_folds_of_the_table(spark):
    rows = matches.queries()["kernel_folds"](spark, "/root/testdata/sf0.001").collect()
    assert sum(r.n for r in rows) == 500 and all(0 <= r.accuracy <= 1 for r in rows)


def test_vectors_are_made_once(spark):
    """Statistics and folds read what was written; they do not make the vectors again."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = [(i, i % 2, [float(i % 2), float(i % 5)]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found = learners.learned(vectors.mapInArrow(count, vectors.schema), kind="logistic", kernel=False)
    assert found.count() == 40 and made.value == 40
