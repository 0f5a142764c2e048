"""Near-duplicates by order MinHash and banded alignment (Marcais et al., 2019).

A text's k-mers are runs of two words, each labelled with how often the same run came before. For each of ``TABLES``
hash functions the ``PICKED`` smallest k-mers are taken and kept in text order: two texts agree with a probability that
follows their edit similarity. Texts of at most ``SHORT`` words have as many keys again of single words. Texts that agree
form a bucket. A first search compares each text of the buckets of ``FIRST`` hash functions with the bucket's first text
alone: it joins most copies at little cost. It may miss pairs; the second search misses none of unlike classes. Its k-mers have three words, and two if the
shorter text of a pair has less than ``LONG``. An edit changes at most k of them, so similar texts have t = m - k + 1 - k d k-mers in common (m words of the longer one, at most d edits). With all k-mers in one order, rare
before frequent ones, they share l of the first n - k + 1 - t + l, for every l: these are a text's keys, with l = 1 + n / ``MORE``. A pair that shares
l keys is a candidate. A key of more than ``LARGE`` texts (a common passage) makes no pairs: a pair then has to share as many keys less as the one of the two has such keys that has
fewer of them. Texts of which nothing is left by that form families by those keys, which are compared apart, in blocks of fitting sizes. Within two blocks the same rule holds for single words, in the order of their number there. Candidates are verified by alignment of their words in a band that is widened until the
distance is exact. The order is by a count over all texts in cells: it decides on the time only, any order finds the same pairs. Pairs of short texts that share a passage alone
seldom meet: each carries the parities of the numbers of its words in some cells, of which d edits change 2 d at most.
Classes are the components of the links. Equal word sequences are one class from the start and enter the search once.

The words are dealt to buckets of a table once, and joins read them there in place.
"""

from __future__ import annotations

import hashlib
import zlib
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import bucketed, discard, release, written
from ..components import components
from .tables import table
from .tokens import some
from .words import WORDS

K = 2
#: Words of a k-mer of the second search between texts of at least ``LONG`` words. Three words meet by accident far less often than two.
WIDE, LONG = 3, 24
SIMILARITY = 0.8
TABLES = 20
PICKED = 2
SHORT = 40
#: Hash functions of the first search. Copies that it leaves apart share many keys, and meet once more for each part of the keys where they do.
FIRST = 12
#: Texts of a key that are all candidates of each other; with more of them they are compared in blocks of about ``BLOCK`` texts.
LARGE, BLOCK = 256, 2048
#: Words for which a pair has to share one more key.
MORE = 50
#: Texts of at most so many words carry the parities of ``CELLS_OF_MARK`` cells of their words: most pairs that share a passage alone are told apart by them.
MARKED, CELLS_OF_MARK = 128, 128
#: Bits of the cells where the k-mers of all texts are counted: a table of 16 MB, whatever the corpus. It fixes the order of keys, not the pairs found.
CELLS = 24
#: A k-mer that more than ``LARGE`` of so many texts have is dealt by its texts, not to one part.
SHARE = 50_000
#: Texts for each part of the keys: with 300 keys a text, a part has half a million keys.
TEXTS_PER_PART = 1_700
#: Searches beyond the logarithm of the largest bucket that a chain of similar texts may take.
SPARE = 2
#: Parts into which the pairs of one text are dealt, and rows of a bucket of the words table.
SALTS = 32
ROWS_PER_BUCKET = 50_000
SEEDS = np.random.default_rng(20190708).integers(1, 2**63, size=TABLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and fold."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def joined_words(text: str | None) -> bytes:
    return " ".join(WORDS.findall(text.lower())).encode("utf-8", "surrogatepass") if text else b""


def hashes(words: bytes) -> np.ndarray:
    return np.array([zlib.crc32(w) for w in words.split(b" ")] if words else [], dtype=np.uint32)


def word_hashes(text: str | None) -> np.ndarray:
    return hashes(joined_words(text))


def kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers in text order, each with its occurrence number; one of all words if there are fewer."""
    return numbered(words, k)[0]


def numbered(words: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """The same hashes, and whether the k-mer occurs more than once."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    k, wide = min(k, len(words)), words.astype(np.uint64)
    h = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for i in range(k):
        h = mixed(h ^ wide[i : len(wide) - k + 1 + i] + np.uint64(i + 1))
    order = np.argsort(h, kind="stable")
    place = np.arange(len(h))
    new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
    occurrence = np.empty(len(h), dtype=np.uint64)
    occurrence[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    again = np.empty(len(h), dtype=bool)
    again[order] = ~new | np.concatenate((~new[1:], [False]))
    return mixed(h + occurrence * np.uint64(0xA24BAED4963EE407)), again


def smallest(h: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Keys of hashes in text order: for each seed, of the ``PICKED`` smallest ones in their order."""
    values = h[None, :] * seeds[:, None]
    row = np.arange(len(seeds))
    chosen = []
    for _ in range(min(PICKED, len(h))):
        at = values.argmin(1)
        values[row, at] = np.uint64(2**64 - 1)
        chosen.append(at)
    keys = seeds.copy()
    for at in np.sort(np.array(chosen), axis=0):
        keys = mixed(keys + h[at])
    return keys


def sketch(words: np.ndarray) -> np.ndarray:
    """Bucket keys: one for each hash function, and for a short text one more of its single words."""
    if not len(words):
        return np.zeros(0, dtype=np.int64)
    keys = smallest(kmers(words), SEEDS)
    if len(words) <= SHORT:
        keys = np.concatenate((keys, smallest(kmers(words, 1), ~SEEDS)))
    return keys.view(np.int64)


def labelled(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with their occurrence numbers, and those numbers."""
    order = np.argsort(words, kind="stable")
    place = np.arange(len(words))
    new = np.concatenate((np.ones(min(1, len(words)), dtype=bool), words[order][1:] != words[order][:-1]))
    number = np.empty(len(words), dtype=np.uint64)
    number[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return mixed(words.astype(np.uint64) + number * np.uint64(0xA24BAED4963EE407)), number


def split_keys(leader: int, first: np.ndarray, words: np.ndarray, letters: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """Keys of a text among those of a large bucket: of its words (a repeated one counts as often as it stands), in an order that follows
    from the word and the bucket's first text alone, the first (1 - ``least``) of all and one more. ``letters``: the words' lengths."""
    own, number = labelled(words)
    known = np.isin(own, labelled(first)[0])
    own = mixed(own ^ mixed(np.array([leader], dtype=np.uint64) + np.uint64(1)))
    order = np.lexsort((own, -letters, -number.astype(np.int64), known))
    return own[order[: int((1 - least) * len(words) + 1e-9) + 1]].view(np.int64)


def width(shorter: np.ndarray, least: float) -> np.ndarray:
    """Words of a k-mer of the second search, given the words of a pair's shorter text: as many as leave similar texts some in common for sure."""
    return np.where((shorter >= LONG) & (least >= SIMILARITY), WIDE, K if least >= 0.7 else 1)


def least_size(size: np.ndarray, least: float) -> np.ndarray:
    """Words of the shortest text that may be similar to one of ``size`` words."""
    return size - ((1 - least) * size + 1e-9).astype(np.int64)


def widths(size: int, least: float) -> list[int]:
    """Words of the k-mers that a text of ``size`` words may have to share with a similar one."""
    sizes = np.array([size])
    return np.unique(width(np.concatenate((least_size(sizes, least), sizes)), least)).tolist()


def common(words: np.ndarray, k: int, least: float) -> np.ndarray:
    """k-mers that two similar texts have in common at least, given the words of the longer one."""
    return words - k + 1 - k * ((1 - least) * words + 1e-9).astype(np.int64)


def prefix(tokens: np.ndarray, often: np.ndarray, size: int, k: int, least: float) -> np.ndarray:
    """Places of a text's keys among its ``tokens`` (k-mers), which occur ``often``, in the common order: the first so many that a similar text of at
    least the same size, and so any similar one, shares ``1 + size // MORE`` of them."""
    if size < k:
        return np.zeros(0, dtype=np.int64)
    needed = int(common(np.arange(size, int(size / least + 1e-9) + 1), k, least).min())
    return np.lexsort((tokens, often))[: max(0, len(tokens) - needed + 1 + size // MORE)]


def least_distance(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the edit distance: words that the other text lacks, with multiplicity."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return max(len(a), len(b)) - int(np.minimum(n[i], m[j]).sum())


def banded(pairs: list[tuple[np.ndarray, np.ndarray]], band: int) -> np.ndarray:
    """Edit distances of several pairs side by side, in a band of ``band`` off the diagonal: exact where at most
    ``band``, else some larger number. Pairs that can no longer come back into the band leave early."""
    far = np.int32(1 << 28)
    out = np.full(len(pairs), far, dtype=np.int64)
    n = np.array([len(a) for a, _ in pairs])
    m = np.array([len(b) for _, b in pairs])
    width, rows = 2 * band + 1, int(n.max(initial=0))
    left = np.zeros((len(pairs), rows + 1), dtype=np.int64)
    right = np.full((len(pairs), max(rows, int(m.max(initial=0))) + 2 * band + 2), -1, dtype=np.int64)
    for p, (a, b) in enumerate(pairs):
        left[p, : len(a)] = a
        right[p, band : band + len(b)] = b
    offset = np.arange(-band, band + 1, dtype=np.int32)
    cost = np.tile(np.where(offset >= 0, offset, far).astype(np.int32), (len(pairs), 1))
    alive = np.arange(len(pairs))
    for i in range(rows + 1):
        if i:
            # column j of row i compares left i-1 with right j-1; right is shifted by the band
            differs = left[:, i - 1, None] != right[:, i - 1 : i - 1 + width]
            step = cost + differs
            np.minimum(step[:, :-1], cost[:, 1:] + 1, out=step[:, :-1])
            cost = np.minimum.accumulate(step - offset, axis=1) + offset
        done = n[alive] == i
        if done.any():
            at = m[alive[done]] - i + band
            ok = (at >= 0) & (at < width)
            out[alive[done][ok]] = cost[np.flatnonzero(done)[ok], at[ok]]
        if done.any() or i % 32 == 31:
            stay = ~done & (cost.min(1) <= band)
            if not stay.all():
                alive, cost, left, right = alive[stay], cost[stay], left[stay], right[stay]
                if not len(alive):
                    break
    return out


def distances(pairs: list[tuple[np.ndarray, np.ndarray]], least: float = SIMILARITY, cells: int = 4_000_000) -> list[int | None]:
    """Exact word edit distance of each pair, or None where 1 - distance / longer length is below ``least``."""
    out: list[int | None] = [None] * len(pairs)
    open_: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # band, place, a, b
    limits = []
    for p, (a, b) in enumerate(pairs):
        longer = max(len(a), len(b))
        limits.append(int((1 - least) * longer + 1e-9))
        if np.array_equal(a, b):
            out[p] = 0
        elif abs(len(a) - len(b)) <= limits[p] and (low := least_distance(a, b)) <= limits[p]:
            short = min(len(a), len(b))
            same = np.flatnonzero(a[:short] != b[:short])
            a, b = (a[same[0] :], b[same[0] :]) if len(same) else (a[short:], b[short:])
            short = min(len(a), len(b))
            same = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
            cut = int(same[0]) if len(same) else short
            a, b = a[: len(a) - cut], b[: len(b) - cut]
            open_.append((min(limits[p], max(8, 2 * low)), p, a, b))
    while open_:
        open_.sort(key=lambda x: (x[0].bit_length(), len(x[2])))
        again = []
        while open_:
            group, top = [], 0
            while open_ and (not group or (x := open_[-1])[0].bit_length() == top.bit_length() and (len(group) + 1) * (len(group[0][2]) + 4 * top + 4) * 8 < cells):
                group.append(open_.pop())
                top = max(top, group[-1][0])
            got = banded([(a, b) for _, _, a, b in group], top)
            for (_, p, a, b), d in zip(group, got.tolist(), strict=True):
                if d <= min(top, limits[p]):
                    out[p] = d
                elif top < limits[p]:
                    again.append((min(limits[p], 4 * top), p, a, b))
        open_ = again
    return out


def sketched(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """uid, doc_id, text_hash, class (digest of the words), keys, size (number of words), words (compressed); bucketed by uid."""

    def make(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                c = b.slice(at, 512)
                found = [joined_words(t) for t in c.column("t").to_pylist()]
                words = [hashes(f) for f in found]
                digests = [hashlib.blake2b(f, digest_size=16).digest() for f in found]
                yield pa.RecordBatch.from_arrays(
                    [c.column("doc_id"), c.column("text_hash"), pa.array(digests), pa.array([sketch(w) for w in words], pa.list_(pa.int64())), pa.array([len(w) for w in words], pa.int64()), pa.array([zlib.compress(f, 1) for f in found])],
                    ["doc_id", "text_hash", "class", "keys", "size", "words"],
                )

    made = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.xxhash64(docs[text]).alias("text_hash"), docs[text].alias("t")).mapInArrow(make, "doc_id long, text_hash long, class binary, keys array<long>, size long, words binary")
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bucketed(made.withColumn("uid", F.monotonically_increasing_id()), "uid", max(least, docs.count() // ROWS_PER_BUCKET))


def verified(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, a_label, b_label) of similar texts with their edit distance. Only texts of pairs leave the words table. The pairs
    of a frequent ``a`` are dealt into ``SALTS`` parts."""
    first, second = (words.select(F.col("uid").alias(f"{x}_id"), F.col("words").alias(f"{x}_words")) for x in "ab")
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    left = salted.select("a", "salt").distinct().join(first, F.col("a") == F.col("a_id")).select("a_id", F.col("salt").alias("a_salt"), "a_words")
    right = salted.join(second, F.col("b") == F.col("b_id"))
    rows = right.join(left, (F.col("a") == F.col("a_id")) & (F.col("salt") == F.col("a_salt"))).select("a", "b", "a_label", "b_label", "a_words", "b_words")

    def verify(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                c = batch.slice(at, 256)
                found = distances([(hashes(zlib.decompress(x)), hashes(zlib.decompress(y))) for x, y in zip(c.column("a_words").to_pylist(), c.column("b_words").to_pylist(), strict=True)], least)
                keep = [i for i, d in enumerate(found) if d is not None]
                yield pa.RecordBatch.from_arrays(
                    [*(c.column(name).take(pa.array(keep, pa.int64())) for name in ("a", "b", "a_label", "b_label")), pa.array([found[i] for i in keep], pa.int64())], ["a", "b", "a_label", "b_label", "distance"]
                )

    return rows.mapInArrow(verify, "a long, b long, a_label long, b_label long, distance long")


def shared(rows: DataFrame) -> DataFrame:
    """The rows (key, uid, label, size) of buckets with several labels, with the bucket's size n and its first text: a,
    a_label, a_size."""
    first = F.min(F.struct("uid", "label", "size")).alias("first")
    stats = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), first).filter("low <> high")
    named = stats.select(F.col("key").alias("l_key"), "n", F.col("first.uid").alias("a"), F.col("first.label").alias("a_label"), F.col("first.size").alias("a_size"))
    return written(rows.join(named, rows["key"] == F.col("l_key")).drop("l_key"))


def fit(x: Column, y: Column, least: float) -> Column:
    return F.abs(x - y) <= (1 - least) * F.greatest(x, y) + 1e-9


def with_first(rows: DataFrame, least: float) -> DataFrame:
    """Candidates (a, b, a_label, b_label) of shared rows: the first text with each other one of a fitting size."""
    return rows.filter((F.col("uid") != F.col("a")) & fit(F.col("a_size"), F.col("size"), least)).select("a", F.col("uid").alias("b"), "a_label", F.col("label").alias("b_label")).distinct()


def counted(words: DataFrame, texts: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """How often the k-mers of all texts occur, on a scale of logarithms, in 2 ** ``CELLS`` cells by the upper bits of their hashes; and, sorted, those k-mers that stand
    in more than ``LARGE`` of ``SHARE`` texts, counted where a batch has several: no task takes all rows of such a key. Their number does not grow with the texts."""

    def count(batches):
        for b in batches:
            tokens = [kmers(w, k) for raw in b.column("words").to_pylist() for w in [hashes(zlib.decompress(raw))] for k in widths(len(w), least)]
            token, n = np.unique(np.concatenate(tokens) if tokens else np.zeros(0, np.uint64), return_counts=True)
            often = n > max(1, b.num_rows * LARGE // SHARE // 4)
            cell = (token >> np.uint64(64 - CELLS)).astype(np.uint32)
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(cell)), dtype=bool), cell[1:] != cell[:-1])))
            cell, total = cell[first], np.add.reduceat(n, first) if len(first) else n
            block, start = np.unique(cell >> 16, return_index=True)
            cells, numbers = (np.split(x, start[1:]) for x in ((cell & 0xFFFF).astype("<u2"), np.minimum(total, 0xFFFF).astype("<u2")))
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int64)), *(pa.array([x.tobytes() for x in c[: len(block)]], pa.binary()) for c in (cells, numbers))], ["block", "cells", "numbers"])
            token, n = token[often], n[often]
            for nth in np.unique(token % np.uint64(SALTS)).tolist():
                own = token % np.uint64(SALTS) == nth
                yield pa.RecordBatch.from_arrays([pa.array([-1 - nth], pa.int64()), pa.array([token[own].tobytes()], pa.binary()), pa.array([n[own].astype("<i8").tobytes()], pa.binary())], ["block", "cells", "numbers"])

    def add(t: pa.Table) -> pa.Table:
        block, cells, numbers = t.column("block")[0].as_py(), t.column("cells").to_pylist(), t.column("numbers").to_pylist()
        if block < 0:
            token, at = np.unique(np.frombuffer(b"".join(cells), np.uint64), return_inverse=True)
            found = token[np.bincount(at, np.frombuffer(b"".join(numbers), "<i8"), len(token)) > LARGE * (1 + texts // SHARE)]
        else:
            total = np.zeros(1 << 16)
            for cell, n in zip(cells, numbers, strict=True):
                total[np.frombuffer(cell, "<u2")] += np.frombuffer(n, "<u2")
            found = np.minimum(255, 10 * np.log2(1 + total)).astype(np.uint8)
        return pa.table({"block": t.column("block").slice(0, 1), "found": pa.array([found.tobytes()], pa.binary())})

    levels, hot = np.zeros((1 << (CELLS - 16), 1 << 16), np.uint8), [np.zeros(0, np.uint64)]
    for row in words.select("words").mapInArrow(count, "block long, cells binary, numbers binary").groupBy("block").applyInArrow(add, "block long, found binary").toArrow().to_pylist():
        if row["block"] < 0:
            hot.append(np.frombuffer(row["found"], np.uint64))
        else:
            levels[row["block"]] = np.frombuffer(row["found"], np.uint8)
    return levels.ravel(), np.sort(np.concatenate(hot))


def keys_of(words: np.ndarray, often: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """A text's keys, given the numbers of ``counted``; of each, its rank among those of as many words, and four times its place in the text, plus two if it has ``WIDE`` words,
    plus one if its k-mer occurs again."""
    found = []
    for k in widths(len(words), least):
        tokens, again = numbered(words, k)
        at = prefix(tokens, often[tokens >> np.uint64(64 - CELLS)], len(words), k, least)
        found.append((tokens[at], np.arange(len(at)), 4 * at + 2 * (k == WIDE) + again[at]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def mark(words: np.ndarray) -> np.ndarray:
    """For each cell, whether an odd number of the words fall into it: an inserted or deleted word changes one cell, a replaced one two at most."""
    odd = np.bincount(words & (CELLS_OF_MARK - 1), minlength=CELLS_OF_MARK) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def packed(key: np.ndarray, text: np.ndarray, at: np.ndarray, place: np.ndarray, uid: np.ndarray, label: np.ndarray, size: np.ndarray, marks: np.ndarray | None = None) -> bytes:
    """Rows (key, text, at, place) with what is told of their texts (places in ``uid``), column by column: some 12 bytes a key, and the texts' numbers once, with the
    marks of short texts."""
    own, text = np.unique(text, return_inverse=True)
    high = (key >> np.uint64(16)).astype("<u8")
    parts = [np.array([len(key), len(own)], "<i8"), (high & np.uint64(0xFFFFFFFF)).astype("<u4"), (high >> np.uint64(32)).astype("<u2"), text.astype("<u2"), *((x >> by & 0xFFFF).astype("<u2") for x in (at, place) for by in (0, 16))]
    if marks is not None:
        marks = marks[own[size[own] <= MARKED]]
    return b"".join(x.tobytes() for x in (*parts, uid[own].astype("<i8"), (label - uid)[own].astype("<i8"), size[own].astype("<i4"), *([] if marks is None else [marks])))


def unpacked_marks(rows: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The short texts among the rows, and their marks."""
    n, texts = np.frombuffer(rows, "<i8", 2).tolist()
    start = 16 + 16 * n
    uid, size = np.frombuffer(rows, "<i8", texts, start), np.frombuffer(rows, "<i4", texts, start + 16 * texts)
    return uid[size <= MARKED], np.frombuffer(rows, np.uint64, -1, start + 20 * texts).reshape(-1, CELLS_OF_MARK // 64)


def unpacked(rows: bytes) -> tuple[np.ndarray, ...]:
    """key (its upper 48 bits), uid, label, size, at, place of each row."""
    n, texts = np.frombuffer(rows, "<i8", 2).tolist()
    out, start = [], 16
    for kind, many in (("<u4", n), *[("<u2", n)] * 6, ("<i8", texts), ("<i8", texts), ("<i4", texts)):
        out.append(np.frombuffer(rows, kind, many, start))
        start += out[-1].nbytes
    low, high, text, at, at_high, place, place_high, uid, label, size = out
    key = low.astype(np.int64) | (high.astype(np.int64) << 32)
    return key, uid[text], (label + uid)[text], size[text].astype(np.int64), *(x.astype(np.int64) | (y.astype(np.int64) << 16) for x, y in ((at, at_high), (place, place_high)))


def meetings(key: np.ndarray, uid: np.ndarray, label: np.ndarray, size: np.ndarray, at: np.ndarray, place: np.ndarray, least: float, cells: int = 2_000_000, marked: tuple[np.ndarray, np.ndarray] | None = None) -> list[np.ndarray]:
    """a, b, size, n: pairs of texts of unlike labels and fitting sizes with the number n of keys of at most ``LARGE`` texts that they share early enough, and the
    smaller size. A k-mer that both texts have once does not count where its places alone take more edits than similar texts may have: no alignment keeps it. Nor do pairs meet whose marks (of the texts ``marked``) differ in more cells than those edits may change. With -n
    each text b of n keys of more texts, its own size, and the first text a of those that such keys connect here."""
    order = np.lexsort((uid, key))
    key, uid, label, size, at, place = (x[order] for x in (key, uid, label, size, at, place))
    again, wide, place = place & 1, place >> 1 & 1, place >> 2
    texts, own = np.unique(uid, return_inverse=True)
    cuts = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1], [True])))
    start, n = cuts[:-1], np.diff(cuts)
    unlike = np.minimum.reduceat(label, start) != np.maximum.reduceat(label, start) if len(start) else np.zeros(0, dtype=bool)
    many = unlike & (n > LARGE)
    row = np.concatenate([np.arange(s, s + m) for s, m in zip(start[many], n[many], strict=True)] or [np.zeros(0, np.int64)])
    code, times = np.unique(np.repeat(own[start[many]], n[many]) * len(texts) + own[row], return_counts=True)
    sizes = np.zeros(len(texts), np.int64)
    sizes[own] = size
    a, b = np.divmod(code, max(1, len(texts)))
    least_, before = np.arange(len(texts)), None
    while not np.array_equal(least_, before):
        before = least_.copy()
        np.minimum.at(least_, b, least_[a])
        np.minimum.at(least_, a, least_[b])
    each = np.unique(b)
    frequent = [texts[least_[each]], texts[each], sizes[each], -np.bincount(b, times, len(texts))[each].astype(np.int64)]
    codes, numbers, open_ = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    marks, has = np.zeros((len(texts), CELLS_OF_MARK // 64), np.uint64), np.zeros(len(texts), dtype=bool)
    if marked is not None:
        there = np.searchsorted(texts, marked[0])
        marks[there], has[there] = marked[1], True

    def merged() -> tuple[np.ndarray, np.ndarray]:
        code, again = np.unique(np.concatenate([codes, *open_]), return_inverse=True)
        return code, np.bincount(again, np.concatenate([numbers, np.ones(len(again) - len(numbers), np.int64)]), len(code)).astype(np.int64)

    for m in np.unique(n[unlike & (n <= LARGE)]).tolist():
        first, (i, j) = start[unlike & (n == m)], np.triu_indices(m, 1)
        step = max(1, cells // len(i))
        for f in range(0, len(first), step):
            x, y = ((first[f : f + step, None] + z).ravel() for z in (i, j))
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            longer, shorter = np.maximum(size[x], size[y]), np.minimum(size[x], size[y])
            edits, k = ((1 - least) * longer + 1e-9).astype(np.int64), width(shorter, least)
            slack = k * edits + shorter // MORE - longer
            shift = np.abs(place[x] - place[y]) + np.abs(size[x] - place[x] - size[y] + place[y])
            meet = (wide[x] == (k == WIDE)) & ((shift <= edits) | (again[x] + again[y] > 0)) & (longer - shorter <= (1 - least) * longer + 1e-9) & (at[x] <= size[x] + slack) & (at[y] <= size[y] + slack)
            x, y, most = own[x[meet]], own[y[meet]], (2 * edits - longer + shorter)[meet]
            near = ~(has[x] & has[y]) | (np.bitwise_count(marks[x] ^ marks[y]).sum(1, dtype=np.int64) <= most)
            open_.append(x[near] * len(texts) + y[near])
            if sum(len(o) for o in open_) > 2 * cells:
                codes, numbers = merged()
                open_ = []
    codes, numbers = merged()
    a, b = np.divmod(codes, max(1, len(texts)))
    return [np.concatenate(z) for z in zip([texts[a], texts[b], np.minimum(sizes[a], sizes[b]), numbers], frequent, strict=True)]


def hot_rows(key: np.ndarray, uid: np.ndarray, size: np.ndarray, least: float) -> list[np.ndarray]:
    """a, b, size, n of texts with keys of ``hot`` k-mers. Texts that have a family by these keys alone connect them, and keys that are connected here go by the name of
    the first of them. With -n each text b of n keys of name a, with 0 each other key b of name a. Names and keys are negative."""
    keys, own = np.unique(key, return_inverse=True)
    texts, first, text, many = np.unique(uid, return_index=True, return_inverse=True, return_counts=True)
    full = (many > least_size(size[first], least) // MORE)[text]
    name, before = np.arange(len(keys)), None
    while not np.array_equal(name, before):
        before, low = name, np.full(len(texts), len(keys))
        np.minimum.at(low, text, name[own])
        name = name.copy()
        np.minimum.at(name, own[full], low[text[full]])
        name = name[name]
    code, n = np.unique(text * len(keys) + name[own], return_counts=True)
    b, a = np.divmod(code, max(1, len(keys)))
    tied = np.flatnonzero(name != np.arange(len(keys)))
    none = np.zeros(len(tied), np.int64)
    return [np.concatenate(x) for x in ((-1 - keys[a], -1 - keys[name[tied]]), (texts[b], -1 - keys[tied]), (size[first][b], none), (-n, none))]


def keyed(texts: DataFrame, words: DataFrame, number: int, least: float) -> DataFrame:
    """Rows (a, b, size, n) of ``meetings`` of all keys of ``texts`` (uid, label); a pair has a row for each part of the keys where it meets. The keys are dealt to parts by their
    hash; the rows of a batch of texts that go to one part travel as one. Those of keys that ``counted`` names are dealt by their text and give ``hot_rows``."""
    often, hot = counted(words, number, least)
    parts = 1 + number // TEXTS_PER_PART

    def make(batches):
        for b in batches:
            for start in range(0, b.num_rows, 4096):
                c = b.slice(start, 4096)
                uid, label = (c.column(x).to_numpy() for x in ("uid", "label"))
                found, size, marks = [], np.zeros(len(uid), np.int64), np.zeros((len(uid), CELLS_OF_MARK // 64), np.uint64)
                for i, raw in enumerate(c.column("words").to_pylist()):
                    own = hashes(zlib.decompress(raw))
                    found.append(keys_of(own, often, least))
                    size[i] = len(own)
                    if len(own) <= MARKED:
                        marks[i] = mark(own)
                (key, at, place), text = (np.concatenate(x) for x in zip(*found, strict=True)), np.repeat(np.arange(len(uid)), [len(f[0]) for f in found])
                part = ((key & np.uint64(0xFFFF)) % np.uint64(parts)).astype(np.int64)
                part = np.where(np.isin(key, hot), parts + uid[text] % SALTS, part)
                order = np.argsort(part, kind="stable")
                ends = np.flatnonzero(np.concatenate((part[order][1:] != part[order][:-1], [True]))) + 1 if len(part) else []
                groups = np.split(order, ends)[: len(ends)]
                rows = [packed(key[g], text[g], at[g], place[g], uid, label, size, marks) for g in groups]
                yield pa.RecordBatch.from_arrays([pa.array([int(part[g[0]]) for g in groups], pa.int64()), pa.array(rows, pa.binary())], ["part", "rows"])

    def meet(t: pa.Table) -> pa.Table:
        raw = t.column("rows").to_pylist()
        rows = [np.concatenate(x) for x in zip(*map(unpacked, raw), strict=True)]
        if t.column("part")[0].as_py() < parts:
            out = meetings(*rows, least, marked=tuple(np.concatenate(x) for x in zip(*map(unpacked_marks, raw), strict=True)))
        else:
            out = hot_rows(*rows[:2], rows[3], least)
        return pa.table(dict(zip(("a", "b", "size", "n"), out, strict=True)))

    now = texts.select(F.col("uid").alias("t_uid"), "label")
    made = words.join(now, F.col("uid") == F.col("t_uid")).select("uid", "label", "words").mapInArrow(make, "part long, rows binary")
    return written(made.groupBy("part").applyInArrow(meet, "a long, b long, size long, n long"))


def shortest(size: Column, least: float) -> Column:
    """Words of the shortest text that may be similar to one of ``size`` words."""
    return size - F.floor((1 - least) * size + 1e-9)


def families(rows: DataFrame, least: float) -> DataFrame:
    """(node, size, frequent, family): the texts that have keys of more than ``LARGE`` texts, with their number. A pair that shares l keys shares l less the smaller of the two numbers
    without those. Only if both numbers are l or more this tells nothing: such texts have a family, those that such keys connect; of others it is null."""
    own = rows.filter("n < 0").groupBy("b")
    each = written(own.agg(F.max("size").alias("size"), (-F.sum("n")).alias("frequent"), F.min("a").alias("first"), F.collect_set("a").alias("firsts")))
    full = each.filter(F.col("frequent") > F.floor(shortest(F.col("size"), least) / MORE)).select(F.col("b").alias("full"), "first", "firsts")
    # a text's keys are connected by their first texts, a text by one of them
    between = full.select(F.explode("firsts").alias("full"), "first").filter("full <> first").union(rows.filter("n = 0").select("b", "a")).distinct()
    of = components(full.select("full", "first").union(between), "full", "first")
    found = each.join(full.select("full"), F.col("b") == F.col("full"), "left").join(of, F.col("full") == F.col("node"), "left")
    # a key's first text may be the only one that its other keys do not connect: it is a family by itself
    out = written(found.select(F.col("b").alias("node"), "size", "frequent", F.coalesce("label", "full").alias("family")))
    discard(each)
    return out


def candidates(rows: DataFrame, family: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Candidates (a, b, a_label, b_label): pairs that share keys enough and are not of one family. Texts of unlike families share no key of more than ``LARGE`` texts."""
    met = rows.filter("n > 0").groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("size").alias("size"))
    for x in "ab":
        met = met.join(family.select(F.col("node").alias(f"{x}_node"), F.col("frequent").alias(f"{x}_frequent"), F.col("family").alias(f"{x}_family")), F.col(x) == F.col(f"{x}_node"), "left")
    spared = F.when(F.col("a_family").isNotNull() & F.col("b_family").isNotNull(), 0).otherwise(F.least(F.coalesce("a_frequent", F.lit(0)), F.coalesce("b_frequent", F.lit(0))))
    enough = met.filter("a_family is null or b_family is null or a_family <> b_family").filter(F.col("n") > F.floor(F.col("size") / MORE) - spared).select("a", "b")
    for x in "ab":
        enough = enough.join(texts.select(F.col("uid").alias(f"{x}_uid"), F.col("label").alias(f"{x}_label")), F.col(x) == F.col(f"{x}_uid"))
    return enough.select("a", "b", "a_label", "b_label")


def block_links(labels: np.ndarray, words: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links between labels that similar texts of ``left`` and of ``right`` (places; both alike: within them) give; of those that connect what is
    connected already, some are left out."""
    tokens = [labelled(w)[0] for w in words]
    _, place, n = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    ends = np.cumsum([len(t) for t in tokens])
    size = np.array([len(w) for w in words])
    own = [place[e - s : e] for e, s in zip(ends, size, strict=True)]
    keys = [t[prefix(t, n[t], len(t), 1, least)] for t in own]
    key, text = np.concatenate(keys), np.repeat(np.arange(len(words)), [len(t) for t in keys])
    order = np.lexsort((text, key))
    key, text = key[order], text[order]
    on_left, on_right = np.full(len(words), -1), np.full(len(words), -1)
    on_left[left], on_right[right] = np.arange(len(left)), np.arange(len(right))
    shared_ = np.zeros((len(left), len(right)), dtype=np.int32)
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    for start, end in zip(cuts[:-1][np.diff(cuts) > 1], cuts[1:][np.diff(cuts) > 1], strict=True):
        x, y = on_left[text[start:end]], on_right[text[start:end]]
        shared_[np.ix_(x[x >= 0], y[y >= 0])] += 1
    x, y = size[left][:, None], size[right][None, :]
    open_ = (shared_ > np.minimum(x, y) // MORE) & (np.abs(x - y) <= (1 - least) * np.maximum(x, y) + 1e-9) & (labels[left][:, None] != labels[right][None, :])
    i, j = np.nonzero(open_ & (left[:, None] < right[None, :]) if np.array_equal(left, right) else open_)
    order = np.argsort(-shared_[i, j], kind="stable")
    i, j = left[i[order]], right[j[order]]
    parent = {int(x): int(x) for x in labels}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links, at, step = [], 0, 16
    while at < len(i):
        apart = [(a, b) for a, b in zip(i[at : at + step].tolist(), j[at : at + step].tolist(), strict=True) if root(int(labels[a])) != root(int(labels[b]))]
        for (a, b), d in zip(apart, distances([(words[a], words[b]) for a, b in apart], least), strict=True):
            if d is not None and (x := root(int(labels[a]))) != (y := root(int(labels[b]))):
                parent[x] = y
                links.append((int(labels[a]), int(labels[b])))
        at, step = at + step, min(1024, 2 * step)
    return links


def within_families(family: DataFrame, labels: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Links (a_label, b_label) between the texts of each family, compared in pairs of blocks. A block holds about ``BLOCK`` texts of one step of sizes; similar
    texts lie in the same step or the next one."""
    stepped = labels.join(family.filter("family is not null"), F.col("uid") == F.col("node")).select("family", "uid", "label", F.floor(F.log("size") / F.log(F.lit(1.001 / least))).alias("step"))
    blocks = stepped.groupBy("family", "step").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    for by in (-1, 0, 1):
        there = blocks.select(F.col("family").alias("f"), (F.col("step") - by).alias("s"), F.col("blocks").alias(f"blocks{by + 1}"))
        stepped = stepped.join(there, (F.col("family") == F.col("f")) & (F.col("step") == F.col("s")), "left").drop("f", "s")
    mine = F.pmod(F.xxhash64("uid"), F.col("blocks1"))
    others = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    group = lambda step, i, far, j: F.struct(step.alias("step"), i.alias("i"), far.alias("far"), j.alias("j"))
    step, block = F.col("step"), F.col("block")
    groups = F.concat(
        F.transform(others(F.col("blocks1")), lambda j: group(step, F.least(block, j), step, F.greatest(block, j))),
        F.transform(others(F.col("blocks2")), lambda j: group(step, block, step + 1, j)),
        F.transform(others(F.col("blocks0")), lambda j: group(step - 1, j, step, block)),
    )
    dealt = stepped.withColumn("block", mine).withColumn("group", groups).select("family", "uid", "label", "step", "block", "group")
    raw = words.select(F.col("uid").alias("w_uid"), "words")
    told = dealt.join(raw, F.col("uid") == F.col("w_uid")).select("family", "label", F.col("step").alias("own_step"), "block", "words", F.explode("group").alias("group")).select("*", "group.*").drop("group")

    def compare(t: pa.Table) -> pa.Table:
        own = np.stack([t.column(c).to_numpy() for c in ("own_step", "block")])
        left, right = (np.flatnonzero((own[0] == t.column(s)[0].as_py()) & (own[1] == t.column(b)[0].as_py())) for s, b in (("step", "i"), ("far", "j")))
        found = block_links(t.column("label").to_numpy(), [hashes(zlib.decompress(w)) for w in t.column("words").to_pylist()], left, right, least) if len(left) and len(right) else []
        return pa.table({"a_label": pa.array([a for a, _ in found], pa.int64()), "b_label": pa.array([b for _, b in found], pa.int64())})

    return told.groupBy("family", "step", "i", "far", "j").applyInArrow(compare, "a_label long, b_label long")


def tried(found: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """The similar pairs of these candidates, written."""
    found = written(found)
    pairs = written(verified(found, words, least))
    discard(found)
    return pairs


def relabelled(texts: DataFrame, links: DataFrame) -> DataFrame:
    """The texts (uid, label) with the smallest label of those that (a_label, b_label) connect."""
    merged = components(links, "a_label", "b_label").select("node", F.col("label").alias("least"))
    return written(texts.join(merged, texts["label"] == F.col("node"), "left").select("uid", F.coalesce("least", "label").alias("label")))


def searches(largest: int) -> int:
    """Most searches after the first two, given the texts of the largest bucket."""
    return SPARE + max(1, largest).bit_length()


def near_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, class_id, class_size, kept.

    class_id is the smallest doc_id of the class (null if all its rows have none). ``kept`` marks the row with that
    identifier (of rows that repeat it, one). Texts are compared as lower-cased words. A null text counts as empty, and
    texts without a word form one class. All links are found.
    """
    table_ = sketched(docs, text, doc_id)
    words = table_.select("uid", "words")
    rows = written(table_.select("uid", "doc_id", "text_hash", "class", "keys", "size"))
    # the row with the smallest identifier comes first, rows without one last
    lead = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    own = rows.groupBy("class").agg(F.min(F.struct("uid", "size", "keys")).alias("text"), F.min(lead).alias("lead"), F.count(F.lit(1)).alias("n"))
    own = written(own.select("class", F.col("text.uid").alias("id"), "text.size", "text.keys", "lead", "n"))
    texts = own.select(F.col("id").alias("uid"), F.col("id").alias("label"))
    found = shared(own.select(F.explode(F.filter("keys", lambda x: F.pmod(x, F.lit(TABLES)) < FIRST)).alias("key"), F.col("id").alias("uid"), F.col("id").alias("label"), "size"))
    pairs = tried(with_first(found, least), words, least)
    texts = relabelled(texts, pairs)
    discard(pairs, found)
    found = keyed(texts, words, own.count(), least)
    release(docs.sparkSession)
    family = families(found, least)
    pairs = tried(candidates(found, family, texts, least), words, least)
    links = written(within_families(family, texts, words, least))
    before, texts = texts, relabelled(texts, pairs.select("a_label", "b_label").union(links))
    discard(before, pairs, links, found, family)
    discard(table_)
    joined = written(own.join(texts, F.col("id") == F.col("uid")).select("class", "label", "lead", "n"))
    discard(texts, own)
    whole = joined.groupBy("label").agg(F.min("lead").alias("stay"), F.sum("n").alias("class_size")).withColumnRenamed("label", "w_label")
    classes = joined.join(whole, joined["label"] == F.col("w_label")).select(F.col("class").alias("c"), "stay", "class_size")
    out = rows.join(classes, F.col("class") == F.col("c")).select("doc_id", "text_hash", F.col("stay.doc_id").alias("class_id"), "class_size", (F.col("uid") == F.col("stay.uid")).alias("kept"))
    out = written(out)
    discard(rows, joined)
    return out


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_hash")
