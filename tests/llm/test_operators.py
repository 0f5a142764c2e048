import collections
import hashlib
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from reedbed.llm import chat, exact_dedup, jpeg, langid, media, near_dedup, packing, pieces, quality, registry, tokens, toxicity, warc
from reedbed.llm.sampling import part
from reedbed.llm.tables import table
from tests.oracle import difference

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, exact int, language int, row string, uid int"
ODD = [
    (1, "a b", "en", 1, 1, "x", 1), (1, "a b", "en", 1, 1, "x", 1), (None, "a  b", None, 2, 2, None, 2), (None, None, None, None, None, None, None), (2, "", "en", 3, 3, "y", 3),
    (3, "ab", "en", 4, 4, "z", 4), (4, "é ñ 🙂 ▁ 12 don't <|endoftext|>", "fr", 5, 5, "z", 5), (5, "word " * 6000, "en", 6, 6, "z", 6),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    assert not difference(spark, registry.queries()[name], registry.oracle_sql()[name], SF)


@pytest.mark.parametrize("ranges", [1, 7, 200])
def test_exact_odd_rows(odd, none, ranges):
    got = exact_dedup.exact_dedup(odd, ranges=ranges).collect()
    assert len(got) == len(ODD) and [r["uid"] for r in got if r["doc_id"] == 3] == [4]
    group = [r for r in got if r["exact"]["group_size"] == 4]
    assert len(group) == 4 and sum(r["exact"]["kept"] for r in group) == 1
    assert all(r["exact"]["keep_id"] is None for r in group)  # "a  b" has the most code points
    assert exact_dedup.exact_dedup(none).count() == 0


def test_large_groups_are_divided(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'same text' else concat('text ', id) end as text")
    got = exact_dedup.exact_dedup(docs, ranges=16).where("text = 'same text'").selectExpr("exact.*").distinct().collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(0, 1334)}
    assert exact_dedup.exact_dedup(docs, ranges=16).where("exact.kept").count() == 4000 - 1333


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment_equals_full():
    rng = np.random.default_rng(1)
    pairs = []
    for _ in range(120):
        a = rng.integers(0, 40, rng.integers(1, 70)).astype(np.uint32)
        b = list(a)
        for _ in range(rng.integers(0, 14)):
            if b and rng.random() < 0.5:
                b.pop(rng.integers(len(b)))
            else:
                b.insert(rng.integers(len(b) + 1), rng.integers(0, 40))
        pairs.append((a, np.array(b, dtype=np.uint32)))
    for (a, b), d in zip(pairs, near_dedup.distances(pairs), strict=True):
        true = edits(a, b)
        assert d == (true if 1 - true / max(len(a), len(b)) >= 0.8 - 1e-12 else None)


def test_near_classes_equal_brute_force(spark):
    docs = {r.doc_id: near_dedup.word_hashes(r.text) for r in table(spark, SF, "documents").collect()}
    ids, label = sorted(docs), {i: i for i in docs}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]]
    for (a, b), d in zip(pairs, near_dedup.distances([(docs[a], docs[b]) for a, b in pairs]), strict=True):
        if d is not None:
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    got = near_dedup.op6(spark, SF).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: root(i) for i in ids}
    assert sum(r.kept for r in got) == len({root(i) for i in ids})


def planted(kind, pairs, seed):
    """Texts of (doc_id, text): rows 2 i and 2 i + 1 are a pair of word edit similarity 0.8 or a little more."""
    rng, rows = np.random.default_rng(seed), []
    word = lambda: f"w{rng.integers(20_000)}"
    passage = [word() for _ in range(60)]
    for i in range(pairs):
        if kind == "scattered":
            a = [word() for _ in range(int(rng.integers(60, 200)))]
            open_, changes = np.arange(len(a)), len(a) // 5
        elif kind == "short":
            a = [word() for _ in range(int(rng.integers(5, 25)))]
            open_, changes = np.arange(len(a)), len(a) // 5
        else:
            a = passage + [word() for _ in range(40)]
            open_, changes = np.arange(60, 100), 15
        b = list(a)
        for at in rng.choice(open_, changes, replace=False):
            b[at] = word()
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    return rows


@pytest.mark.parametrize("kind", ["scattered", "short", "passage"])
def test_near_recall_of_planted_pairs(spark, kind):
    rows = planted(kind, 150, 3)
    words = [near_dedup.word_hashes(t) for _, t in rows]
    true = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if near_dedup.distances([(words[i], words[j])])[0] is not None}
    assert true >= {(2 * i, 2 * i + 1) for i in range(150)}
    label = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(label[i] == label[j] for i, j in true) >= 0.98 * len(true)


def test_near_odd_rows(odd, none):
    got = near_dedup.near_classes(odd).collect()
    assert len(got) == len(ODD) and sum(r.kept for r in got) == len({r.class_id for r in got})
    assert near_dedup.near_classes(none).count() == 0


def test_packing_is_exact(spark, odd, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    got = packing.packed(odd).toPandas()
    for _, s in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (s["offset"] == np.r_[0, np.cumsum(s["length"])[:-1]]).all() and s["length"].sum() <= 4096
    want = sorted(zlib.crc32(np.array((tokenizer.encode(t or "", add_special_tokens=False).ids + [2])[:4096], dtype="<u4").tobytes()) for _, t, *_ in ODD)
    assert sorted(got[got["start"] == 0]["ids_crc32"]) == want
    assert packing.packed(none).count() == 0


def test_plan_fills_windows():
    rng = np.random.default_rng(2)
    counts = {int(k): int(n) for k, n in zip(*np.unique(rng.integers(1, 4097, 3000), return_counts=True), strict=True)}
    fillings = packing.plan(counts)
    used: dict[int, int] = {}
    for times, f in fillings:
        assert sum(k * n for k, n in f.items()) <= 4096
        for k, n in f.items():
            used[k] = used.get(k, 0) + n * times
    assert used == counts
    # lengths spread evenly over the window are the hard case: few pieces fit together
    assert sum(t for t, _ in fillings) <= 1.01 * sum(k * n for k, n in counts.items()) / 4096


def test_jpeg_round_trip(spark, odd):
    rng = np.random.default_rng(0)
    payloads = [bytes(64), bytes([128] * 640), rng.bytes(64 * 13), rng.integers(120, 137, 64 * 50).astype(np.uint8).tobytes(), rng.choice([127, 128, 129, 200, 0, 255], 64 * 77, p=[0.02, 0.9, 0.02, 0.02, 0.02, 0.02]).astype(np.uint8).tobytes()]
    for p, (image, found, rgb) in zip(payloads, jpeg.read(jpeg.write(payloads)), strict=True):
        assert jpeg.payload(image, found) == p and rgb.shape == (image.height, image.width, 3)
    flat = jpeg.read(jpeg.write([bytes([128] * 384)]))[0][2]
    assert (flat == 128).all()
    assert media.tensor_column(media.media_column(odd)).count() == len(ODD)


def test_jpeg_digests(spark):
    texts = {r.doc_id: r.text.encode() for r in table(spark, SF, "documents").collect()}
    for r in media.op3(spark, SF).collect():
        data = media.padded(texts[r.doc_id])
        assert (r.payload_sha256, r.tail_crc32, r.n_bytes) == (hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(texts[r.doc_id]))


def test_segmentation_equals_all_paths(odd, none):
    lattice = pieces.lattice(tokens.vocabulary_path("piece_bpe_32k.model"))

    def scores(text):
        total = [0]
        for chunk in pieces.CHUNK.findall(" " + text):
            edges = lattice.edges(chunk)
            ways = [[0]]
            for end in range(1, len(edges)):
                ways.append([w + s for start, s, _ in edges[end] for w in ways[start]])
            total = [a + b for a in total for b in ways[-1]]
        return sorted(total, reverse=True)

    for text in ["the cat", "hello", "ab  c", "é ñ", "a▁b x", "🙂 ok", "aa aa aa"]:
        got = lattice.segment([text], 5)[0]
        assert [s for s, _ in got] == scores(text)[:5] and all(lattice.decode(i) == text for _, i in got)
    back = pieces.decoded(pieces.segmented(odd)).collect()
    assert sorted({t for r in back for t in r.texts}) == sorted({t or "" for _, t, *_ in ODD})
    assert pieces.segmented(odd).count() == len(ODD) and pieces.segmented(none).count() == 0


def test_fast_path_equals_slow_path():
    lattice = pieces.lattice(tokens.vocabulary_path("piece_bpe_32k.model"))
    rng = np.random.default_rng(4)
    by_length = {}
    for _ in range(400):
        s = "".join(rng.choice(list("etaoinshrd"), int(rng.integers(1, 40))))
        by_length.setdefault(len(s), []).append(s)
    for own in by_length.values():
        for s, (score, regret, ids) in zip(own, lattice.best_of_many(own), strict=True):
            slow = lattice.best(s)
            assert (score, regret) == slow[:2] and lattice.spelling(ids) == lattice.spelling(slow[2]) == s.encode()


def test_long_text_without_spaces():
    lattice = pieces.lattice(tokens.vocabulary_path("piece_bpe_32k.model"))
    rng = np.random.default_rng(5)
    text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 100_000))
    start = time.time()
    got = lattice.segment([text], 3)[0]
    assert time.time() - start < 30 and len(got) == 3 and all(lattice.decode(i) == text for _, i in got)
    # the parts' joined lists are those of one search over the whole chunk
    short = " " + text[:300]
    assert [s for s, _ in lattice.segment([short[1:]], 4)[0]] == [s for s, _ in lattice.n_best(short, 4)]


def test_language(spark, odd, none):
    got = langid.op9(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97 and got["score"].between(0, 1).all() and got["accepted"].mean() > 0.98
    model = langid.train(odd)
    rows = langid.identify(odd, model, out="found").collect()
    assert len(rows) == len(ODD) and all(r["found"]["lang"] == "und" for r in rows if not r["text"])
    assert sorted(str(tuple(r)[:-1]) for r in rows) == sorted(map(str, ODD))
    with pytest.raises(ValueError):
        langid.identify(odd, model)
    assert langid.identify(none, langid.train(none), out="found").count() == 0


def test_quality_and_toxicity(spark, odd, none):
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    got = quality.op7(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").toPandas()
    assert (got["keep"] == (got["quality"] == 1)).mean() > 0.95 and got["expected_grade"].between(0, 2).all()
    got = toxicity.op1(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").toPandas()
    assert got[got["toxic"] == 0]["predicted"].mean() < 0.03 and got[got["toxic"] == 1]["predicted"].mean() > 0.5
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.grade(odd, quality.train(quality.bounded(odd, empty), 3)).count() == len(ODD)
    model, _ = toxicity.train(toxicity.labelled_rows(none, empty))
    assert toxicity.score(odd, model).where("toxicity between 0 and 1").count() == len(ODD)


def test_shouting_is_counted_over_the_whole_text():
    assert toxicity.pattern_votes("quiet words " * 400 + "LOUD WORDS " * 2000)[1]
    assert not toxicity.pattern_votes("LOUD WORDS " * 400 + "quiet words " * 2000)[1]


def test_roles(spark):
    got = chat.op2(spark, SF).toPandas()
    assert (got["roles"] == got["true_roles"]).mean() > 0.9
    odd = spark.createDataFrame([(1, 0, "user", None), (None, None, None, "hi"), (1, 0, "user", None), (1, 1, "x", "a\n\nb")], "conv_id long, turn long, role string, text string")
    assert chat.turns(odd).count() == 3


def test_audit_odd_rows(spark):
    pages = spark.createDataFrame([(0, "u", "a"), (0, "u", "a"), (None, None, None), (40, "u", "b"), (7000, "u", "")], "page_id long, url string, html string")
    other = spark.createDataFrame([(0, "u", "a"), (0, "u", "a"), (None, None, None), (40, "u", "B"), (9, "u", "")], "page_id long, url string, html string")
    got = {r.slot: r.status for r in warc.audit(warc.records(pages), warc.records(other)).collect()}
    assert got == {0: "ok", -1: "ok", 40: "corrupt", 7000: "missing", 9: "extra"}
    assert warc.audit(warc.records(pages.limit(0)), warc.records(pages.limit(0))).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
    # stage by stage is the same as run()
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == docs.count() > 100


def test_nodes_vouch_for_offset_ranges(spark):
    schema = "side int, node long, digest string, length long"
    at = lambda *rows: {(r.side, r.node): (r.digest, r.length) for r in warc.parents(spark.createDataFrame(rows, schema)).collect()}
    one = at((0, 0, "a", 5), (0, 1, "b", 7), (0, 16, "c", 1), (1, 0, "a", 7), (1, 1, "b", 5), (1, 16, "c", 1))
    assert one[0, 0] != one[1, 0] and one[0, 0][1] == one[1, 0][1] == 12 and one[0, 1] == one[1, 1]
    want = '[{"node":0,"start":0,"end":5,"digest":"a"},{"node":1,"start":5,"end":12,"digest":"b"}]'
    assert one[0, 0][0] == hashlib.sha256(want.encode()).hexdigest()


def test_language_counts_all_rows(spark):
    """Every 4-gram of about 4,000 counted rows of each language is in the model; words are let out in parts."""
    texts = spark.range(16000).selectExpr("id AS doc_id", "concat('word ', translate(cast(id AS string), '0123456789', 'abcdefghij')) AS text", "if(id % 2 = 0, 'x', 'y') AS lang")
    model = langid.train(texts)
    counted = texts.filter(part(texts["doc_id"]) < 2)
    grams = {k for t in counted.select("text").toPandas()["text"] for k in langid.grams(langid.words_of(t))[0].tolist()}
    assert set(model.levels[0].keys.tolist()) == grams
    batch = pa.RecordBatch.from_pydict({"text": ["ab cd ef gh", "ab cd", "ij"], "lang": ["x", "x", "x"]})
    whole = collections.Counter()
    for b in langid.count_grams([batch], "text", "lang"):
        whole.update(dict(zip(b.column("gram").to_pylist(), b.column("n").to_pylist(), strict=True)))
    few = collections.Counter()
    langid.MOST_WORDS, most = 2, langid.MOST_WORDS
    try:
        for b in langid.count_grams([batch], "text", "lang"):
            few.update(dict(zip(b.column("gram").to_pylist(), b.column("n").to_pylist(), strict=True)))
    finally:
        langid.MOST_WORDS = most
    assert few == whole
