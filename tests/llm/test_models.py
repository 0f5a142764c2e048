import itertools

import numpy as np
import pytest

import corpus_pipeline
from reedbed.llm import near_dedup, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, uid int"


def test_posterior_equals_sum_over_labels():
    rng = np.random.default_rng(3)
    voters = 5
    parents = [4, 0, 0, 1, -1]
    model = toxicity.LabelModel(0.3, parents, rng.uniform(0.05, 0.95, (voters, 2, 2)))
    votes = np.array(list(itertools.product((0, 1), repeat=voters)))
    total = 0.0
    for v, q in zip(votes, model.posterior(votes), strict=True):
        joint = []
        for y, prior in ((0, 0.7), (1, 0.3)):
            p = prior
            for j, up in enumerate(parents):
                rate = model.rates[j, y, v[up] if up >= 0 else 0]
                p *= rate if v[j] else 1 - rate
            joint.append(p)
        assert q == pytest.approx(joint[1] / sum(joint))
        total += sum(joint)
    assert total == pytest.approx(1)


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(4)
    y = rng.random(20_000) < 0.2
    rates = np.array([[0.02, 0.6], [0.05, 0.7], [0.1, 0.5], [0.3, 0.3], [0.01, 0.9]])
    votes = (rng.random((len(y), 5)) < np.where(y[:, None], rates[:, 1], rates[:, 0])).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.fit_label_model(patterns, counts)
    assert model.prior == pytest.approx(0.2, abs=0.03)
    for j in range(5):
        for label in (0, 1):
            found = sum(c * (model.posterior(p[None])[0] if label else 1 - model.posterior(p[None])[0]) * p[j] for p, c in zip(patterns, counts, strict=True))
            whole = sum(c * (model.posterior(p[None])[0] if label else 1 - model.posterior(p[None])[0]) for p, c in zip(patterns, counts, strict=True))
            assert found / whole == pytest.approx(rates[j, label], abs=0.06)


def test_pattern_votes():
    votes = dict(zip(toxicity.PATTERN_VOTERS, toxicity.pattern_votes("you are sooo du*mb you know you know know"), strict=True))
    assert votes == {"signs": True, "shouting": False, "exclamation": False, "second person": True, "masked": True, "stretched": True, "doubled": True}
    assert not any(toxicity.pattern_votes(None))


def test_ordinal_gradient_equals_differences():
    rng = np.random.default_rng(5)
    scores, grades, free = rng.normal(size=40), rng.integers(0, 4, 40), np.array([-0.7, 0.2, -0.4])

    def loss(s, f):
        edge = np.concatenate(([-np.inf], quality.ordered(f), [np.inf]))
        g = lambda x: 1 / (1 + np.exp(-x))
        return -np.log(g(edge[grades + 1] - s) - g(edge[grades] - s))

    slope, by_free = quality.cumulative_loss(scores, grades, free)
    e = 1e-6
    assert slope == pytest.approx((loss(scores + e, free) - loss(scores - e, free)) / (2 * e), abs=1e-6)
    for k in range(len(free)):
        d = np.eye(len(free))[k] * e
        assert by_free[k] == pytest.approx((loss(scores, free + d) - loss(scores, free - d)).mean() / (2 * e), abs=1e-6)
    tails = quality.Ordinal(np.zeros(1), quality.ordered(free)).tails(scores)
    assert (np.diff(tails, axis=1) <= 0).all() and ((tails >= 0) & (tails <= 1)).all()


def test_labels_that_differ(spark):
    docs = spark.createDataFrame([(1, "a"), (4, "b"), (5, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, 1, 1), (4, 1, 0), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.labelled_rows(docs, labels).collect()}
    assert got == {k: v for k, v in {1: 1, 4: 1}.items() if k in got} and got
    grades = {r.doc_id: r.grade for r in quality.rated(docs, labels).collect()}
    assert grades == {k: v for k, v in {1: 0, 4: 1}.items() if k in grades} and grades


def planted(length, low, high, pairs, seed):
    rng, rows = np.random.default_rng(seed), []
    word = lambda: f"w{rng.integers(30_000)}"
    for i in range(pairs):
        a = [word() for _ in range(int(rng.integers(*length)))]
        b = list(a)
        most = int((1 - rng.uniform(low, high)) * len(a))
        for at in rng.choice(len(a), most, replace=False):
            b[at] = word()
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    return rows


LENGTHS, BANDS = ((5, 20), (20, 60), (60, 300), (1000, 1200)), ((0.8, 0.85), (0.85, 0.9), (0.9, 1.0))


def test_recall_by_similarity_and_length(spark):
    """Of planted pairs in each band of similarity and length, at least 0.95 are found."""
    rows, of = [], {}
    for n, (length, band) in enumerate(itertools.product(LENGTHS, BANDS)):
        for i, t in planted(length, *band, 60, n):
            of[n * 1000 + i] = (length, band)
            rows.append((n * 1000 + i, t))
    label = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {}
    for i in range(0, len(rows), 2):
        a, b = rows[i][0], rows[i + 1][0]
        found.setdefault(of[a], []).append(label[a] == label[b])
    assert min(sum(x) / len(x) for x in found.values()) >= 0.95, {k: sum(x) / len(x) for k, x in found.items()}


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, tmp_path, stage):
    odd = [(1, "Hello there, this is a text.", "en", "s", 1), (1, "Hello there, this is a text.", "en", "s", 1), (None, None, None, None, None), (2, "", "en", "s", 2), (3, "word " * 5000, None, None, 3)]
    spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    run = dict(corpus_pipeline.STAGES)[stage]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, DOCS)
        got = run(spark, docs, str(tmp_path))
        assert got.count() <= (len(rows) if stage != "packing" else 99)
        if stage != "packing":
            assert got.columns == docs.columns


def test_exact_stage_keeps_a_column_of_the_operators_name(spark):
    """A user's column named exact is not lost, nor one named like those within."""
    docs = spark.createDataFrame([(1, "a b", "mine", 1), (2, "ab", "other", 2), (3, "c", None, 3)], "doc_id long, text string, exact string, keep_id int")
    got = corpus_pipeline.exact(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text, r.exact, r.keep_id) for r in got if r.doc_id != 3) == [(1, "a b", "mine", 1)]
    assert got[0].__fields__ == docs.columns and len(got) == 2
