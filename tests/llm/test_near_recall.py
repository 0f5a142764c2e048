"""Recall of near-duplicates that share passages with many other texts, nested texts, and the number of searches."""

import numpy as np

from reedbed.llm import near_dedup as nd

PAIRS = 100


def with_passages(rng, passages, own, changed, pairs=PAIRS):
    """Pairs of texts of the common ``passages`` and ``own`` words, ``changed`` of which differ within a pair."""
    word = lambda: f"v{rng.integers(40_000)}"
    common = [[word() for _ in range(n)] for n in passages]
    rows = []
    for i in range(pairs):
        a = [word() for _ in range(own)]
        b = list(a)
        for at in rng.choice(own, changed, replace=False):
            b[at] = word()
        cut = sorted(rng.integers(0, own + 1, len(common)))
        for k, words in enumerate((a, b)):
            out, last = [], 0
            for c, p in zip(cut, common, strict=True):
                out += words[last:c] + p
                last = c
            rows.append((2 * i + k, " ".join(out + words[last:])))
    return rows


CELLS = ((60,), 40, 18), ((70,), 30, 20), ((75,), 25, 18), ((75,), 25, 20), ((79,), 21, 19), ((40, 35), 25, 19)


def test_recall_behind_a_common_passage(spark):
    """Similarity 0.80 to 0.82: what is left to tell pairs apart are a few own words. Each cell has its own passages."""
    rows = []
    for n, cell in enumerate(CELLS):
        rows += [(1000 * n + i, t.replace("v", f"{'abcdefgh'[n]}")) for i, t in with_passages(np.random.default_rng(n), *cell)]
    label = {r.doc_id: r.class_id for r in nd.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {cell: np.mean([label[1000 * n + i] == label[1000 * n + i + 1] for i in range(0, 2 * PAIRS, 2)]) for n, cell in enumerate(CELLS)}
    assert min(found.values()) >= 0.9, found
    for n in range(len(CELLS)):  # texts that only share the passage stay apart
        assert len({c for i, c in label.items() if i // 1000 == n}) >= PAIRS // 2


def test_nested_texts_end_in_few_searches(spark, monkeypatch):
    """One word repeated 4000 * 0.96 ** i times: each is similar to the next ones, so all are one class."""
    counted = []
    monkeypatch.setattr(nd, "tried", lambda *a, f=nd.tried: counted.append(1) or f(*a))
    rows = [(i, " ".join(["yes"] * int(4000 * 0.96**i))) for i in range(40)]
    label = {r.doc_id: r.class_id for r in nd.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(label.values()) == {0} and len(counted) <= 2 + nd.searches(40)


def test_similar_texts_share_a_key():
    """For any first text: texts within the similarity have a key in common, whatever their words."""
    rng = np.random.default_rng(9)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        first, a = rng.integers(0, 30, n).astype(np.uint32), rng.integers(0, 30, n).astype(np.uint32)
        b = a.copy()
        for _ in range(n):
            c, at = b.copy(), int(rng.integers(0, len(b)))
            kind = rng.integers(3)
            c = np.delete(c, at) if kind == 0 else np.insert(c, at, rng.integers(0, 30)) if kind == 1 else np.where(np.arange(len(c)) == at, rng.integers(0, 30), c).astype(np.uint32)
            if not len(c) or nd.distances([(a, c.astype(np.uint32))])[0] is None:
                break
            b = c.astype(np.uint32)
        sizes = lambda x: (x % 7 + 1).astype(np.int64)
        assert set(nd.split_keys(3, first, a, sizes(a)).tolist()) & set(nd.split_keys(3, first, b, sizes(b)).tolist())


def test_no_link_is_left_out(spark):
    """Pairs of similarity 0.8 with a change in every fifth word, and as many behind a passage that all of a family have: each pair is found."""
    rng, rows = np.random.default_rng(3), []
    word = lambda: f"z{rng.integers(40_000)}"
    for i in range(300):
        a = [word() for _ in range(50)]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(word() if n % 5 == 2 else w for n, w in enumerate(a)))]
    rows += [(1000 + i, text.replace("v", "p")) for i, text in with_passages(rng, (75,), 25, 20)]
    label = {r.doc_id: r.class_id for r in nd.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i, _ in rows if i % 2 == 0 and label[i] != label[i + 1]] == []


def test_a_frequent_key_makes_no_family(spark, monkeypatch):
    """Texts that share one frequent pair of words, of which they need not share more than the others leave: none is compared with all others."""
    monkeypatch.setattr(nd, "LARGE", 8)
    kept = []
    monkeypatch.setattr(nd, "within_families", lambda family, *a, f=nd.within_families: kept.append(family.filter("family is not null").count()) or f(family, *a))
    rng, rows = np.random.default_rng(4), []
    word = lambda: f"y{rng.integers(40_000)}"
    for i in range(100):
        a = ["same", "pair"] + [word() for _ in range(118)]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(word() if n % 5 == 2 else w for n, w in enumerate(a)))]
    label = {r.doc_id: r.class_id for r in nd.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label[2 * i] == label[2 * i + 1] == 2 * i for i in range(100)) and kept == [0]


def test_keys_survive_packing_and_small_limits_lose_no_pair(spark, monkeypatch):
    """Against brute force with every limit so small that parts, frequent keys, families and keys of the counted texts all occur."""
    rng = np.random.default_rng(5)
    n = 3000
    key, text, at = rng.integers(0, 2**63, n).astype(np.uint64), np.sort(rng.integers(0, 90, n)), rng.integers(0, 200_000, n)
    uid, label, size = rng.integers(0, 2**40, 90), rng.integers(0, 2**40, 90), rng.integers(1, 500_000, 90)
    back = nd.unpacked(nd.packed(key, text, at, at[::-1], uid, label, size))
    assert all(np.array_equal(x, y) for x, y in zip(back, (key >> np.uint64(16), uid[text], label[text], size[text], at, at[::-1]), strict=True))
    texts = []
    for i in range(240):
        a = list(texts[int(rng.integers(len(texts)))]) if i % 3 else [f"x{w}" for w in rng.zipf(1.3, int(rng.integers(5, 130))) % 400]
        for _ in range(int(0.23 * len(a) * rng.random()) if i % 3 else 0):
            a[int(rng.integers(len(a)))] = f"x{rng.zipf(1.3) % 400}"
        texts.append(a)
    own = [nd.hashes(" ".join(a).encode()) for a in texts]
    least = list(range(240))
    pairs = [(i, j) for i in range(240) for j in range(i)]
    near = [p for p, d in zip(pairs, nd.distances([(own[i], own[j]) for i, j in pairs]), strict=True) if d is not None]
    for _ in range(240):
        for i, j in near:
            least[i] = least[j] = min(least[i], least[j])
    docs = spark.createDataFrame([(i, " ".join(a)) for i, a in enumerate(texts)], "doc_id long, text string")
    for large in (2, 12):
        monkeypatch.setattr(nd, "LARGE", large)
        monkeypatch.setattr(nd, "BLOCK", 8)
        monkeypatch.setattr(nd, "FIRST", 0)
        label = {r.doc_id: r.class_id for r in nd.near_classes(docs).collect()}
        assert [label[i] for i in range(240)] == least


def rows_of(spark, monkeypatch, texts):
    """The rows of keys by kind: of pairs, of texts with frequent keys, and of keys of one name; and the classes."""
    found = []
    monkeypatch.setattr(nd, "families", lambda rows, *a, f=nd.families: found.extend(rows.filter(x).count() for x in ("n > 0", "n < 0", "n = 0")) or f(rows, *a))
    label = {r.doc_id: r.class_id for r in nd.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    return found, [label[i] for i in range(len(texts))]


def test_a_text_of_frequent_keys_has_one_row(spark, monkeypatch):
    """Pairs behind one passage: a text has one row for all keys of the passage, not one for each, and all pairs are found."""
    monkeypatch.setattr(nd, "LARGE", 8)
    monkeypatch.setattr(nd, "FIRST", 0)
    texts = [t for _, t in with_passages(np.random.default_rng(6), (70,), 30, 20)]
    (_, frequent, _), label = rows_of(spark, monkeypatch, texts)
    assert frequent == len(texts) and label[::2] == label[1::2]


def test_unlike_texts_of_few_words_seldom_meet(spark, monkeypatch):
    """Texts of a vocabulary of 150 words have many pairs of words in common by accident, and hardly any three."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in rng.integers(150, size=60)) for _ in range(600)]
    (met, _, _), label = rows_of(spark, monkeypatch, texts)
    assert met < 600 and label == list(range(600))


def test_widths_on_both_sides_of_the_border(spark):
    """A text of less than ``LONG`` words and a similar longer one meet by keys of as many words, and both are long enough for them."""
    for size in range(2, 200):
        for k in nd.widths(size, nd.SIMILARITY):
            reach = np.arange(size, int(size / nd.SIMILARITY + 1e-9) + 1)
            if k == nd.WIDE:
                assert size >= nd.LONG and nd.common(reach, k, nd.SIMILARITY).min() >= 1 + size // nd.MORE
        for other in range(nd.least_size(np.array([size]), nd.SIMILARITY)[0], size + 1):
            assert int(nd.width(np.array([other]), nd.SIMILARITY)[0]) in set(nd.widths(size, nd.SIMILARITY)) & set(nd.widths(other, nd.SIMILARITY))


def test_all_texts_are_counted(spark, monkeypatch):
    """The cells hold all k-mers of all texts, and a k-mer of more than ``LARGE`` of each ``SHARE`` texts is named."""
    monkeypatch.setattr(nd, "COUNTED", 10, raising=False)
    monkeypatch.setattr(nd, "SHARE", 10, raising=False)
    monkeypatch.setattr(nd, "LARGE", 2)
    rng = np.random.default_rng(8)
    words = [np.concatenate((rng.integers(0, 2**32, 40), [1, 2, 3])).astype(np.uint32) for _ in range(200)]
    names = [" ".join(f"k{w}" for w in own).encode() for own in words]
    df = spark.createDataFrame([(i, bytearray(nd.zlib.compress(w, 1))) for i, w in enumerate(names)], "uid long, words binary")
    levels, hot = nd.counted(df, len(names), nd.SIMILARITY)
    tokens, n = np.unique(np.concatenate([nd.kmers(nd.hashes(w), k) for w in names for k in nd.widths(43, nd.SIMILARITY)]), return_counts=True)
    total = np.bincount((tokens >> np.uint64(64 - nd.CELLS)).astype(np.int64), n, 1 << nd.CELLS)
    assert np.array_equal(np.argsort(total[total > 0], kind="stable"), np.argsort(levels[total > 0], kind="stable")) and not levels[total == 0].any()
    assert np.array_equal(hot, tokens[n == 200])


def test_edits_change_few_cells_of_a_mark():
    rng = np.random.default_rng(10)
    for _ in range(500):
        a = rng.integers(0, 2**32, int(rng.integers(0, nd.MARKED))).astype(np.uint32)
        b, edits = a.copy(), int(rng.integers(0, 12))
        for _ in range(edits):
            at, kind = int(rng.integers(0, len(b) + 1)), rng.integers(3) if len(b) else 1
            b = np.insert(b, at, rng.integers(0, 2**32)) if kind == 1 else np.delete(b, min(at, len(b) - 1)) if kind == 0 else np.where(np.arange(len(b)) == at, rng.integers(0, 2**32), b).astype(np.uint32)
        assert np.bitwise_count(nd.mark(a) ^ nd.mark(b)).sum() <= 2 * edits - abs(len(a) - len(b))


def test_texts_that_share_a_passage_alone_seldom_meet(spark, monkeypatch):
    """Texts of 40 words, 22 of them a common passage: each two share half of their runs of three words and are no copies. Copies among them are found."""
    rng = np.random.default_rng(11)
    passage = [f"p{i}" for i in range(22)]
    texts = [" ".join(passage[:11] + [f"q{x}" for x in rng.integers(100_000, size=18)] + passage[11:]) for _ in range(200)]
    texts += [t.replace("p3", "other") for t in texts[::20]]
    (met, _, _), label = rows_of(spark, monkeypatch, texts)
    assert met < 2000 and label == [*range(200), *range(0, 200, 20)]
