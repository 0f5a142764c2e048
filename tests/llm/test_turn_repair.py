"""Conversation repair: against all edits, across parts, and the defined cases of rows."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reedbed.llm import turn_repair as r

PATTERN = re.compile(r"(s?(ua)+)?")


def slow(rows):
    """(cost, audit, repaired lines) of the best edits by trying all with at most two inserts in one place."""
    seen, each = set(), []
    for role, text in rows:
        fault = "blank" if not r.FILLED.search(text) else "duplicate" if (role, text) in seen else "" if text.rstrip()[-1] in ".!?" else "truncated"
        seen.add((role, text))
        extra = 3 * (fault == "truncated")
        own = [(4, "D", [])]
        if fault in ("", "truncated"):
            own += [(extra, "K", [(role, text)]), (3 + extra, "R", [("user", text)]), (3 + extra, "R", [("assistant", text)])]
        each.append(own)
    inserts = [(0, "", [])] + [(3 * n, "I" * n, [(x, "") for x in names]) for n in (1, 2) for names in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    steps = [x for own in each for x in (inserts, own)] + [inserts]
    for way in itertools.product(*steps):
        turns = [t for _, _, line in way for t in line]
        if PATTERN.fullmatch("".join(role[:1] or "?" for role, _ in turns)):
            found = sum(c for c, _, _ in way), "".join(a for _, a, _ in way), "\n".join(f"{a}:{b}" for a, b in turns)
            if best is None or found[:2] < best[:2]:
                best = found
    return best


def fast(rows):
    seen, own = set(), []
    for role, text in rows:
        own.append((role, text, 1, (role, text) not in seen))
        seen.add((role, text))
    audit, cost, turns = r.Part(own).repaired(np.array(r.END), 0, True)
    return cost, audit, "\n".join(f"{a}:{b}" for a, b in turns)


def test_cheapest_edits_equal_all_edits():
    rng = np.random.default_rng(5)
    roles, texts = ["user", "assistant", "system", "tool", ""], ["Yes.", "and then", " \t", "No!", "x"]
    for n in (0, 1, 2, 3):
        for _ in range(6 if n == 3 else 30):
            rows = [(roles[rng.choice(5, p=[0.35, 0.3, 0.15, 0.1, 0.1])], texts[rng.integers(5)]) for _ in range(n)]
            assert fast(rows) == slow(rows), rows


def test_powers_equal_single_rows():
    rng = np.random.default_rng(6)
    symbols = [r.GONE] + [(a, b) for a in ("u", "a", "s", "t") for b in (False, True)]
    for _ in range(200):
        symbol, n, after = symbols[rng.integers(len(symbols))], int(rng.integers(0, 60)), rng.integers(0, 9, 4)
        want = after
        for _ in range(n):
            want = np.array(r.row(symbol, tuple(int(x) for x in want))[0])
        assert r.advanced(symbol, n, after).tolist() == want.tolist()


def test_runs_equal_rows_one_by_one():
    """A long run takes the same edits as its rows each for itself."""
    rng = np.random.default_rng(7)
    symbols = [r.GONE, ("u", False), ("a", False), ("u", True), ("t", False), ("s", False)]
    for _ in range(40):
        runs = [(symbols[rng.integers(6)], int(rng.integers(1, 9))) for _ in range(6)]
        singles = [(s, 1) for s, n in runs for _ in range(n)]
        assert r.unrolled(r.collapsed(runs), np.array(r.END), 0) == r.unrolled(singles, np.array(r.END), 0)


def table_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string")


def test_parts_of_a_conversation_are_repaired_as_one(spark):
    """A conversation that holds most rows lies in several parts; the result is that of one part."""
    rng = np.random.default_rng(8)
    roles, texts = ["user", "assistant", "system"], ["Yes.", "and then", " "]
    rows = [(7, i, roles[rng.integers(3)], f"{i} {texts[rng.integers(3)]}" if rng.integers(4) else texts[rng.integers(3)], "x") for i in range(1500)]
    rows += [(8, i, "user", "Hi.", "x") for i in range(20)] + [(9, 0, "assistant", "So.", "x")]
    df = table_of(spark, rows)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = r.repaired(df)
        assert pieces.filter("conv = 7").count() > 2
        got = {x["conv"]: x for x in r.summed(pieces).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    for conv, own in itertools.groupby(rows, key=lambda x: x[0]):
        cost, audit, text = fast([(x[2], x[3]) for x in own])
        assert (got[conv]["cost"], got[conv]["audit"], got[conv]["repaired_sha256"]) == (cost, audit, hashlib.sha256(text.encode()).hexdigest())
    assert (got[8]["illegal"], got[8]["duplicate"], got[8]["audit"], got[8]["cost"]) == (19, 19, "K" + "D" * 19 + "I", 4 * 19 + 3)


def test_defined_cases(spark):
    """Nulls in any column, repeated rows, no filled text, roles of no known initial, other columns."""
    rows = [
        (None, None, None, None, "a"), (None, 0, "user", "Hm.", "a"),  # a null role and text are one space: blank
        (1, 3, "user", "Same.", "a"), (1, 3, "user", "Same.", "b"),  # copies: the second is a duplicate
        (2, 0, "", "Text.", "a"),
        (3, 2, "user", "One.", "a"), (3, 6, "assistant", "Two", "a"), (3, None, "system", "Be kind.", "a"),
    ]
    got = {x["conv"]: x for x in r.summed(r.repaired(table_of(spark, rows))).collect()}
    assert (got[None]["blank"], got[None]["audit"], got[None]["cost"]) == (1, "DKI", 7)
    assert (got[1]["duplicate"], got[1]["illegal"], got[1]["audit"]) == (1, 1, "KDI")
    assert (got[2]["audit"], got[2]["cost"]) == ("D", 4)
    assert (got[3]["truncated"], got[3]["audit"], got[3]["cost"]) == (1, "KKK", 3)
    gaps = {x["conv"]: x["gaps"] for x in r.gaps_of(table_of(spark, rows).select(F.col("conv_id").alias("conv"), "turn")).collect()}
    assert gaps == {None: 0, 1: 0, 2: 0, 3: 3}
    assert r.summed(r.repaired(table_of(spark, []))).count() == 0


@pytest.mark.parametrize("drop", [True, False])
def test_query_returns_conversations_without_rows(spark, tmp_path, drop):
    """A conversation all of whose rows are dropped: zeros, no audit, the hash of nothing."""
    import zlib

    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "Hello.", "x")] if drop else []
    table_of(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = [x.asDict() for x in r.op13(spark, str(tmp_path)).collect()]
    none = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    assert got == ([{"conv_id": lost, **none}] if drop else [])
