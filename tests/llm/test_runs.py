"""Periodic runs: against all starts and periods, and the defined cases of rows."""

import hashlib

import numpy as np
import pytest

from reedbed.llm import runs

SF = "/root/testdata/sf0.001"


def slow(words, least=runs.LEAST):
    """Every maximal stretch of each period, the smallest period of each stretch."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((i, n, q) for (i, n), q in found.items())


def fast(words):
    return [tuple(x) for x in runs.runs_of(np.asarray(words, dtype=np.int64)).T.tolist()]


def ordered(found):
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_random_words(letters):
    rng = np.random.default_rng(letters)
    for _ in range(400):
        words = rng.integers(0, letters, rng.integers(0, 130)).tolist()
        assert fast(words) == ordered(slow(words)), words


def test_planted_and_nested_periods():
    """Powers of words that are periodic themselves, with faults and borders that meet."""
    rng = np.random.default_rng(11)
    for _ in range(600):
        words = []
        for _ in range(rng.integers(1, 5)):
            base = rng.integers(0, 3, rng.integers(1, 8)).tolist()
            inner = (base * int(rng.integers(1, 6)))[: int(rng.integers(1, 30))]
            words += (inner * int(rng.integers(1, 6)))[: int(rng.integers(1, 120))]
            if rng.integers(2):
                words.append(int(rng.integers(0, 4)))
        assert fast(words) == ordered(slow(words)), words


def test_words_of_fibonacci_and_of_one_defect():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert fast(b) == ordered(slow(b))
    for half in (7, 12, 30, 61):
        words = ([0, 1] * half)[: half + half % 2 + 1] + ([0, 1] * half)[: half]
        assert fast(words) == ordered(slow(words))


def test_texts_of_a_batch_are_apart():
    texts = [["a", "b"] * 8, ["a", "b"] * 8, [], ["c"] * 5]
    texts = [[w.encode() for w in t] for t in texts]
    got = [(r.T.tolist(), b" ".join(k)) for r, k in runs.searched(texts)]
    assert got == [([[0, 16, 2]], b"a b")] * 2 + [([], b""), ([], b"c c c c c")]
    assert list(runs.in_batches(texts, 10)) == [(0, 1), (1, 2), (2, 4)]


def test_long_text_of_one_period(spark):
    """100,000 words of period 3 with one fault; memory and time stay in proportion."""
    words = ["x", "y", "z"] * 33_334
    words[50_000] = "fault"
    got = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string").transform(runs.periodic_runs).select("periodic.*").first()
    assert [tuple(r) for r in got["runs"]] == [(0, 50_000, 3), (50_001, 50_001, 3)]
    assert got["length"] == 50_001 and len(got["collapsed"].split()) == 7


def test_query_equals_slow(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in runs.op12(spark, SF).collect()}
    assert len(got) == len(docs)
    some = 0
    for doc_id, text in docs:
        words = (text or "").encode().split()
        tail = runs.tail_of(doc_id, len(words))
        if tail:
            a, p = tail
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if len(words) > 3000:
            continue
        numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
        found = ordered(slow([numbers[w] for w in words]))
        gone = {j for s, n, q in found for j in range(s + q, s + n)}
        own = got[doc_id]
        assert own["n_runs"] == len(found)
        assert own["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert own["collapsed_sha256"] == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        assert (own["start"], own["length"], own["period"]) == (best or (None, None, None))
        assert own["exponent_milli"] == (best and 1000 * best[1] // best[2])
        some += len(found)
    assert some > 20


def test_defined_cases(spark):
    schema = "doc_id long, text string, start long, runs string"
    rows = [(None, None, 1, "x"), (1, "", 2, None), (1, "", 2, None), (2, " \t\n", 3, "y"), (3, "a " * 12, 4, "z")]
    got = runs.periodic_runs(spark.createDataFrame(rows, schema)).collect()
    assert [(r["doc_id"], r["start"], r["periodic"]["n_runs"], r["periodic"]["collapsed"]) for r in got] == [(None, 1, 0, ""), (1, 2, 0, ""), (1, 2, 0, ""), (2, 3, 0, ""), (3, 4, 1, "a")]
    assert runs.digests(spark.createDataFrame([], schema)).count() == 0
    assert [r["n_runs"] for r in runs.digests(spark.createDataFrame(rows, schema)).collect()] == [0, 0, 0, 0, 1]
    with pytest.raises(ValueError):
        runs.periodic_runs(spark.createDataFrame(rows, schema), out="RUNS")
