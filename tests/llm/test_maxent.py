"""Language-model scores: base by plain counts, a proper distribution, gradients by differences, cases of rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from reedbed.llm import maxent as m

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(3)


def plain_tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\f\r":
            words += [now] if now else []
            now = ""
        else:
            now += c
    return [*words, None]


@pytest.fixture(scope="module")
def result(spark):
    return {r["doc_id"]: r for r in m.op11(spark, SF).collect()}


def test_base_equals_plain_counts(spark, result):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(result) == len(docs)
    counts, held = Counter(), {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in docs}
    for r in docs:
        if not held[r.doc_id]:
            counts.update(plain_tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    for r in docs:
        own, tokens = result[r.doc_id], plain_tokens(r.text)
        assert (own.held_out, own.n_tokens, own.n_known, own.train_tokens) == (held[r.doc_id], len(tokens), sum(t in counts for t in tokens), n)
        assert own.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens), rel=1e-9)


def test_beats_the_unigram_on_held_out_texts(result):
    own = [r for r in result.values() if r.held_out]
    assert len(own) > 10 and sum(r.score for r in own) > sum(r.base_score for r in own)


def small_model():
    words = m.Vocabulary(None, 3 * m.WORDS + 500, m.WORDS + 100, [], RNG.integers(1, 9, m.WORDS))
    model = m.Model.of(words)
    model.class_rows[:] = RNG.normal(0, 0.5, model.class_rows.shape)
    model.word_rows[:] = RNG.normal(0, 0.5, model.word_rows.shape)
    return model


def test_probabilities_sum_to_one():
    """For one context, over all words of the model and the class of the others."""
    model = small_model()
    codes = np.arange(m.WORDS + 1)
    _, contexts = m.windows(np.array([5, 60_000, 7]), np.array([3]))
    own = np.repeat(contexts[:, 2:3], len(codes), axis=1)
    assert np.exp(model.log_probabilities(codes, own)).sum() == pytest.approx(1, abs=1e-4)


def test_probability_equals_plain_sums():
    """One token at a time, by loops over features."""
    model = small_model()
    codes = np.array([9, 1000, 61_000, 9, 130], dtype=np.int64)
    targets, contexts = m.windows(codes, np.array([5]))
    got = model.log_probabilities(targets, contexts)
    for i, target in enumerate(codes.tolist()):
        c = min(target // m.SIZE, m.CLASSES - 1)
        x = model.class_bias.astype(float) + sum(model.class_rows[m.class_rows(contexts)[f, i]].astype(float) for f in range(m.FEATURES))
        want = x[c] - math.log(np.exp(x).sum())
        if target < m.WORDS:
            rows = m.word_rows(contexts, np.full(5, c))[:, i]
            y = model.word_bias[c].astype(float) + sum(model.word_rows[r].astype(float) for r in rows)
            want += y[target % m.SIZE] - math.log(np.exp(y).sum())
        assert got[i] == pytest.approx(want, abs=1e-4)


def test_contexts_stay_within_a_text():
    codes = np.array([1, 2, 3, 4, 5])
    _, joint = m.windows(codes, np.array([2, 5]))
    _, alone = m.windows(codes[2:], np.array([3]))
    assert (joint[:, 2:] == alone).all()
    assert (joint[:, 0] == alone[:, 0]).all()  # both are starts


def test_steps_follow_the_gradient():
    """The first step of a row is minus its summed gradient, scaled; the gradient equals differences of the loss."""
    model = small_model()
    targets, contexts = m.windows(np.array([9, 200, 9, 9]), np.array([4]))
    rows = m.class_rows(contexts)
    own = np.minimum(targets // m.SIZE, m.CLASSES - 1)
    slope = m._slope(model.logits(model.class_bias, model.class_rows, rows).astype(np.float64), own)
    row = int(rows[0, 1])
    want = sum(slope[i] for f in range(m.FEATURES) for i in range(4) if rows[f, i] == row)
    for column in (0, 3, m.CLASSES - 1):
        loss = []
        for d in (1e-2, -1e-2):
            model.class_rows[row, column] += d
            x = model.logits(model.class_bias, model.class_rows, rows).astype(np.float64)
            loss.append(-(x[np.arange(4), own] - np.log(np.exp(x).sum(1))).sum())
            model.class_rows[row, column] -= d
        assert (loss[0] - loss[1]) / 2e-2 == pytest.approx(want[column], abs=2e-3)
    steps = m.Steps(model.class_rows)
    steps.take(rows, slope.astype(np.float32))
    assert np.allclose(steps.weights[row] - model.class_rows[row], -m.RATE / np.sqrt(1 + (want**2).sum()) * want, atol=1e-4)


def test_defined_cases(spark):
    """Null, empty and long texts, repeated rows, a null identifier, long tokens, clashing columns; no rows; no training rows."""
    schema = "doc_id long, text string, uid int, score string"
    long = "w" * 5000
    rows = [(1, None, 1, "a"), (1, "", 2, None), (3, "A a " * 4000, 3, "b"), (3, "A a " * 4000, 3, "b"), (None, f"{long} b {long[:-1]}x", 4, "c"), (4, long, 5, "c")]
    got = m.scores(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6 and all(math.isfinite(r.score) and r.score < 0 for r in got)
    held = {i: zlib.crc32(str(i or "").encode()) % 7 == 2 for i in (1, 3, 4)}
    empty = [r for r in got if r.doc_id == 1]
    assert [r.n_tokens for r in empty] == [1, 1] and empty[0].score == empty[1].score
    twice = [r for r in got if r.doc_id == 3]
    assert twice[0] == twice[1] and twice[0].n_tokens == 8001
    own = next(r for r in got if r.doc_id == 4)
    assert own.n_tokens == 2 and (held[4] or own.n_known == 2)
    assert m.scores(spark.createDataFrame([], schema)).count() == 0
    from pyspark.sql import functions as F

    none = m.scores(spark.createDataFrame(rows, schema), held=F.lit(True)).collect()
    assert {(r.train_tokens, r.base_score, r.n_known) for r in none} == {(0, 0.0, 0)} and all(abs(r.score) < 1e-3 for r in none)


def test_every_token_has_its_whole_probability(spark):
    """Without features the score is the base score, so no token's part is left out: words of the model, other frequent ones, tokens longer than the model holds, and unknown
    ones. With a trained model the probabilities of all known tokens and of the unknown one sum to 1."""
    long = "y" * 200
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10**6 + i, f"{long} a {long}z{i} b unheardof{i}") for i in range(20)], "doc_id long, text string"))
    given = docs.withColumn("held_out", m.held_out(docs["doc_id"]))
    words = m.vocabulary(given.filter("not held_out"))
    rows = m.encoded(given, words)
    learned = rows.filter("not held_out")
    plain = m.scored(rows, words, m.trained(learned, words, rounds=())).collect()
    assert words.types > m.WORDS and any(r.n_known < r.n_tokens for r in plain) and rows.filter("n_tail > 0 and n_rare > 0").count()
    assert all(r.score == pytest.approx(r.base_score, rel=1e-4) for r in plain)
    model = m.trained(learned, words)
    _, contexts = m.windows(np.array([5, 60_000, 7]), np.array([3]))
    codes = np.arange(m.WORDS + 1)
    shares = np.exp(model.log_probabilities(codes, np.repeat(contexts[:, 2:3], len(codes), axis=1)))
    counts = {bytes(r.token): r.c for r in words.counts.collect()}
    others = [c for t, c in counts.items() if t not in set(words.frequent[: m.WORDS])]
    assert len(others) == words.types - m.WORDS
    assert shares[:-1].sum() + shares[-1] * sum((c + 1) / words.rest for c in [*others, 0]) == pytest.approx(1, abs=1e-4)
