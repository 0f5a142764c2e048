"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

P(word | context) = P(class | context) * P(word | class, context). The ``WORDS`` most frequent tokens lie in classes of
``SIZE`` by rank; all others are one more class, in which a token has its share of the counts plus one. So the
probabilities of the V known tokens and of one that stands for the unknown sum to 1, and without features the model is
the add-one unigram. Both softmaxes add, to the logarithms of the counts, a row of weights for each active feature: the word
before, the two before, and (a skip) the second word before. Rows are found by a hash of the feature, for words with the
class too. (Rosenfeld 1996; Goodman 2001; Mikolov et al. 2011.)

Token counts are a table that grows with the corpus and never leaves the executors; the driver and the workers hold the counts
of ``FREQUENT`` tokens of at most ``LONGEST`` bytes and the weights, whose number is fixed. Texts are encoded once, in a
written table. Training goes over all training texts: each task takes steps from the current weights (Adagrad with one
rate a row), and the steps of a row are averaged by how often it was seen.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import discard, written
from .tables import table
from .words import held

#: Tokens whose counts each worker holds, and the bytes of the longest of them.
FREQUENT, LONGEST = 65_536, 64
#: Words of the model, words of a class, classes with the one of all other tokens.
WORDS, SIZE = 1024, 32
CLASSES = WORDS // SIZE + 1
#: Rows of weights for classes and for words.
CLASS_ROWS, WORD_ROWS = 1 << 13, 1 << 16
FEATURES = 3
#: Codes of contexts are 16 bits: model words by rank, others by hash, the start of a text.
BEGIN = 65_535
#: Tokens of a step of training, and of a batch of scoring.
STEP, BATCH = 8192, 16_384
RATE = 0.25
#: Share of the training texts, by hash, of each round of training: the last one takes all.
ROUNDS = (16, 1)
#: Rows of weights that travel together, and groups in which the tasks' steps are first added.
ROWS_TOGETHER, GROUPS = 512, 32
#: Entries of a worker's table of counts before it is let out.
TABLE = 150_000
END = b"\n"
PARTS = 7
HELD = 2
#: Logarithm of a share of nothing, and the largest logit.
LOW, TOP = np.float32(-1e4), np.float32(60)


def held_out(doc_id: Column) -> Column:
    """crc32 of the identifier as text, modulo 7, is 2; a null identifier counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % PARTS == HELD


def tokens_of(text: str | None) -> list[bytes]:
    """Words between blanks, tabs and line ends with A-Z in lower case, then the end of the text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    words.append(END)
    return words


def key_of(token: bytes) -> bytes:
    """The token, or a digest of a long one: no token begins with the byte 255, which UTF-8 lacks."""
    return token if len(token) <= LONGEST else b"\xff" + hashlib.sha256(token).digest()


@dataclass
class Vocabulary:
    """Counts of the training tokens: the table (token, c), their sum, their number, and the most frequent ones by count."""

    counts: DataFrame
    total: int
    types: int
    frequent: list[bytes]
    frequent_counts: np.ndarray

    @property
    def mass(self) -> int:
        return self.total + self.types + 1

    @property
    def rest(self) -> int:
        """Counts plus one of all tokens that are no words of the model."""
        return self.mass - int((self.frequent_counts[:WORDS] + 1).sum())


def vocabulary(docs: DataFrame, text: str = "text") -> Vocabulary:
    def count(batches):
        seen: Counter = Counter()

        def out():
            rows = pa.RecordBatch.from_arrays([pa.array(list(map(key_of, seen)), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])
            seen.clear()
            return rows

        for batch in batches:
            for t in batch.column("t").to_pylist():
                seen.update(tokens_of(t))
                if len(seen) > TABLE:
                    yield out()
        yield out()

    counts = written(docs.select(docs[text].alias("t")).mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c")))
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.filter((F.length("token") <= LONGEST) & (F.substring("token", 1, 1) != F.lit(b"\xff"))).orderBy(F.desc("c"), "token").limit(FREQUENT).toArrow()
    return Vocabulary(counts, total, types, top.column("token").to_pylist(), top.column("c").to_numpy().astype(np.int64))


class Codes(dict):
    """Rank of a frequent token; other tokens have ``FREQUENT`` plus their code as a context."""

    def __missing__(self, token: bytes) -> int:
        return FREQUENT + context_code(token)


def context_code(token: bytes) -> int:
    return WORDS + zlib.crc32(token) % (BEGIN - WORDS)


ENCODED = "uid long, doc_id long, held_out boolean, n_tokens long, n_tail long, n_rare long, word_log double, tail_log double, codes binary, rare array<struct<token:binary,n:long>>"


def encoded(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """``docs`` (doc_id, text, held_out) as a written table: the codes of each text, sums of log10(count + 1) over its model
    words and over its other frequent tokens, and its rare tokens with their numbers. ``uid`` names a row."""
    shared = docs.sparkSession.sparkContext.broadcast((words.frequent, np.log10(words.frequent_counts + 1.0)))
    number = shared._jbroadcast.id()

    def tables():
        frequent, logs = shared.value
        codes = np.array([r if r < WORDS else context_code(t) for r, t in enumerate(frequent)], dtype=np.uint16)
        return Codes(zip(frequent, range(len(frequent)), strict=True)), codes, logs

    def encode(batches):
        ranks, codes, logs = held(("maxent words", number), tables)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = batch.slice(at, 256)
                rows = []
                for t in own.column("text").to_pylist():
                    tokens = tokens_of(t)
                    rank = np.fromiter(map(ranks.__getitem__, tokens), dtype=np.int64, count=len(tokens))
                    seldom = rank >= FREQUENT
                    where = np.flatnonzero(seldom)
                    rare = Counter(key_of(tokens[i]) for i in where.tolist())
                    code = np.empty(len(rank), dtype="<u2")
                    code[where] = rank[where] - FREQUENT
                    known = rank[~seldom]
                    code[~seldom] = codes[known]
                    tail = known >= WORDS
                    rows.append((len(rank), int(tail.sum()), len(where), logs[known[~tail]].sum(), logs[known[tail]].sum(), code.tobytes(), [{"token": k, "n": n} for k, n in rare.items()]))
                made = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.binary(), pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("uid", "doc_id", "held_out")), *(pa.array(m, k) for m, k in zip(made, kinds, strict=True))], [c.split()[0] for c in ENCODED.split(", ")])

    named = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    return written(named.mapInArrow(encode, ENCODED))


@dataclass
class Model:
    """Weights: logarithms of class and word shares, and rows by hashed features. ``seen`` counts the uses of a row."""

    class_bias: np.ndarray
    word_bias: np.ndarray
    class_rows: np.ndarray
    word_rows: np.ndarray

    @staticmethod
    def of(words: Vocabulary) -> Model:
        mass = np.zeros(WORDS)
        top = words.frequent_counts[:WORDS] + 1.0
        mass[: len(top)] = top
        log = lambda x: np.where(x > 0, np.log(np.maximum(x, 1e-300)), LOW).astype(np.float32)
        shares = np.append(mass.reshape(-1, SIZE).sum(1), words.rest) / words.mass
        inner = mass.reshape(-1, SIZE) / np.maximum(mass.reshape(-1, SIZE).sum(1, keepdims=True), 1)
        return Model(log(shares), log(inner), np.zeros((CLASS_ROWS, CLASSES), dtype=np.float32), np.zeros((WORD_ROWS, SIZE), dtype=np.float32))

    def logits(self, bias: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.take(weights, rows[0], axis=0)
        for r in rows[1:]:
            out += np.take(weights, r, axis=0)
        out += bias
        return np.minimum(out, TOP, out=out)

    def log_probabilities(self, targets: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Natural logarithm of P(class) and, for model words, of P(word | class), by token."""
        own = np.minimum(targets // SIZE, CLASSES - 1).astype(np.int64)
        x = self.logits(self.class_bias, self.class_rows, class_rows(contexts))
        out = (x[np.arange(len(x)), own] - log_sum(x)).astype(np.float64)
        word = np.flatnonzero(targets < WORDS)
        if len(word):
            own = own[word]
            y = self.logits(self.word_bias[own], self.word_rows, word_rows(contexts[:, word], own))
            out[word] += y[np.arange(len(y)), targets[word] % SIZE] - log_sum(y)
        return out


def log_sum(logits: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of the exponentials of each line; a product with ones sums faster than a sum over short lines."""
    e = np.exp(logits, out=logits)
    return np.log(e @ np.ones(e.shape[1], dtype=e.dtype))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def windows(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Targets and hashed contexts (one row for each feature) of texts that end at ``ends`` in ``codes``."""
    starts = np.concatenate(([0], ends[:-1]))
    place = np.arange(len(codes)) - np.repeat(starts, ends - starts)
    before = []
    for back in (1, 2):
        prior = np.full(len(codes), BEGIN, dtype=np.uint64)
        prior[back:] = codes[:-back] if back < len(codes) else codes[:0]
        prior[place < back] = BEGIN
        before.append(prior)
    one, two = before
    s = np.uint64(16)
    contexts = np.stack([one << np.uint64(3) | np.uint64(1), (two << s | one) << np.uint64(3) | np.uint64(2), two << np.uint64(3) | np.uint64(3)])
    return codes.astype(np.int64), mixed(contexts)


def class_rows(contexts: np.ndarray) -> np.ndarray:
    return (contexts & np.uint64(CLASS_ROWS - 1)).astype(np.int64)


def word_rows(contexts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return (mixed(contexts + classes.astype(np.uint64)[None, :] + np.uint64(1)) & np.uint64(WORD_ROWS - 1)).astype(np.int64)


def grouped_sums(x: np.ndarray, index: np.ndarray, first: np.ndarray, uses: np.ndarray, few: int = 6) -> np.ndarray:
    """Sums of the lines ``index[first[i] : first[i] + uses[i]]`` of ``x``: small groups side by side, large ones alone."""
    out = np.take(x, index[first], axis=0)
    small = np.flatnonzero((uses > 1) & (uses <= few))
    for nth in range(1, few):
        if not len(small):
            break
        out[small] += np.take(x, index[first[small] + nth], axis=0)
        small = small[uses[small] > nth + 1]
    for i in np.flatnonzero(uses > few).tolist():
        np.take(x, index[first[i] : first[i] + uses[i]], axis=0).sum(0, out=out[i])
    return out


class Steps:
    """Adagrad with one rate a row over a table of weights."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.squares, self.seen = weights.copy(), np.full(len(weights), 1.0, dtype=np.float32), np.zeros(len(weights), dtype=np.float32)

    def take(self, rows: np.ndarray, gradient: np.ndarray) -> None:
        """``rows``: one line for each feature, of a row for each line of ``gradient``."""
        flat = rows.ravel().astype(np.uint16)  # the tables have at most 2 ** 16 rows
        order = np.argsort(flat, kind="stable")
        own = flat[order]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        uses = np.diff(np.concatenate((first, [len(flat)])))
        own = own[first].astype(np.int64)
        sums = grouped_sums(gradient, order % len(gradient), first, uses)
        self.seen[own] += uses
        self.squares[own] += np.einsum("ij,ij->i", sums, sums)
        sums *= (RATE / np.sqrt(self.squares[own]))[:, None]
        self.weights[own] = np.take(self.weights, own, axis=0) - sums


class Trainer:
    def __init__(self, model: Model):
        self.model = Model(model.class_bias, model.word_bias, model.class_rows, model.word_rows)
        self.classes, self.words = Steps(model.class_rows), Steps(model.word_rows)
        self.model.class_rows, self.model.word_rows = self.classes.weights, self.words.weights

    def step(self, targets: np.ndarray, contexts: np.ndarray) -> None:
        own = np.minimum(targets // SIZE, CLASSES - 1)
        rows = class_rows(contexts)
        self.classes.take(rows, _slope(self.model.logits(self.model.class_bias, self.model.class_rows, rows), own))
        word = np.flatnonzero(targets < WORDS)
        if len(word):
            own = own[word]
            rows = word_rows(contexts[:, word], own)
            self.words.take(rows, _slope(self.model.logits(self.model.word_bias[own], self.model.word_rows, rows), targets[word] % SIZE))


def _slope(logits: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Softmax minus the target: the gradient by logit."""
    np.exp(logits, out=logits)
    logits /= (logits @ np.ones(logits.shape[1], dtype=logits.dtype))[:, None]
    logits[np.arange(len(logits)), targets] -= 1
    return logits


def _texts(batches, size: int):
    """Codes of some texts at a time, of about ``size`` tokens, and where each text ends; with the batch's rows."""
    for batch in batches:
        codes = [np.frombuffer(c, dtype="<u2") for c in batch.column("codes").to_pylist()]
        ends = np.cumsum([len(c) for c in codes])
        first = 0
        while first < len(codes):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size, "right")))
            yield batch, first, last, np.concatenate(codes[first:last]), ends[first:last] - (ends[first - 1] if first else 0)
            first = last


MOVED = "name string, block int, grp int, rows binary, seen binary, steps binary"


def _moves(name: str, before: np.ndarray, steps: Steps, grp: int):
    touched = np.flatnonzero(steps.seen)
    for block in np.unique(touched // ROWS_TOGETHER).tolist():
        own = touched[touched // ROWS_TOGETHER == block]
        yield name, block, grp, own.astype("<i4").tobytes(), steps.seen[own].tobytes(), (steps.weights[own] - before[own]).tobytes()


def _added(moves: pa.Table, width) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of one block, their uses, and their steps averaged by use."""
    base = moves.column("block")[0].as_py() * ROWS_TOGETHER
    seen = np.zeros(ROWS_TOGETHER)
    total = np.zeros((ROWS_TOGETHER, width))
    for r, s, x in zip(*(moves.column(c).to_pylist() for c in ("rows", "seen", "steps")), strict=True):
        own, uses = np.frombuffer(r, dtype="<i4") - base, np.frombuffer(s, dtype=np.float32)
        seen[own] += uses
        total[own] += np.frombuffer(x, dtype=np.float32).reshape(-1, width) * uses[:, None]
    own = np.flatnonzero(seen)
    return own + base, seen[own], total[own] / seen[own][:, None]


def trained(rows: DataFrame, words: Vocabulary, rounds=ROUNDS) -> Model:
    """``rows``: encoded texts to learn from. Without rows the model is the unigram."""
    context = rows.sparkSession.sparkContext
    model = Model.of(words)
    width = {"classes": CLASSES, "words": SIZE}

    def add(group: pa.Table) -> pa.Table:
        name = group.column("name")[0].as_py()
        own, seen, steps = _added(group, width[name])
        return pa.table({"name": [name], "block": pa.array([group.column("block")[0].as_py()], pa.int32()), "grp": pa.array([0], pa.int32()), "rows": [own.astype("<i4").tobytes()], "seen": [seen.astype(np.float32).tobytes()], "steps": [steps.astype(np.float32).tobytes()]})

    for share in rounds:
        current = context.broadcast(model)

        def learn(batches, current=current):
            trainer, left = Trainer(current.value), None
            for _, _, _, codes, ends in _texts(batches, STEP):
                targets, contexts = windows(codes, ends)
                if left is not None:
                    targets, contexts = np.concatenate((left[0], targets)), np.concatenate((left[1], contexts), axis=1)
                whole = len(targets) // STEP * STEP
                for at in range(0, whole, STEP):
                    trainer.step(targets[at : at + STEP], contexts[:, at : at + STEP])
                left = targets[whole:], contexts[:, whole:]
            if left is not None and len(left[0]):
                trainer.step(*left)
            grp = TaskContext.get().partitionId() % GROUPS
            for name, before, steps in (("classes", current.value.class_rows, trainer.classes), ("words", current.value.word_rows, trainer.words)):
                for move in _moves(name, before, steps, grp):
                    yield pa.RecordBatch.from_pylist([dict(zip(("name", "block", "grp", "rows", "seen", "steps"), move, strict=True))], schema=_MOVED)

        some = rows if share == 1 else rows.filter(F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(share)) == 0)
        moves = some.select("codes").coalesce(2 * context.defaultParallelism).mapInArrow(learn, MOVED)
        found = moves.groupBy("name", "block", "grp").applyInArrow(add, MOVED).groupBy("name", "block").applyInArrow(add, MOVED).toArrow()
        current.destroy()
        model = Model(model.class_bias, model.word_bias, model.class_rows.copy(), model.word_rows.copy())
        for name, r, x in zip(*(found.column(c).to_pylist() for c in ("name", "rows", "steps")), strict=True):
            weights = model.class_rows if name == "classes" else model.word_rows
            weights[np.frombuffer(r, dtype="<i4")] += np.frombuffer(x, dtype=np.float32).reshape(-1, width[name])
    return model


_MOVED = pa.schema([("name", pa.string()), ("block", pa.int32()), ("grp", pa.int32()), ("rows", pa.binary()), ("seen", pa.binary()), ("steps", pa.binary())])


def rare_counts(rows: DataFrame, words: Vocabulary) -> DataFrame:
    """(uid, rare_known, rare_log): how many rare tokens of each text are known, and the sum of log10(count + 1) over them.
    Each of them makes up at most one in ``FREQUENT`` of the tokens, so no key is hot."""
    each = rows.select("uid", F.explode("rare").alias("x")).select("uid", "x.token", "x.n")
    counts = words.counts.select(F.col("token").alias("c_token"), "c")
    joined = each.join(counts, F.col("token") == F.col("c_token"))
    return joined.groupBy("uid").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rare_log"))


def scored(rows: DataFrame, words: Vocabulary, model: Model) -> DataFrame:
    """Encoded texts with base_score and score, log10 probabilities of the whole text under the add-one unigram and under the
    model: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch, first, last, codes, ends in _texts(batches, BATCH):
            targets, contexts = windows(codes, ends)
            logs = np.concatenate([shared.value.log_probabilities(targets[at : at + BATCH], contexts[:, at : at + BATCH]) for at in range(0, len(targets), BATCH)])
            sums = np.add.reduceat(logs, np.concatenate(([0], ends[:-1]))) / math.log(10)
            own = batch.slice(first, last - first)
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in own.schema.names if c != "codes"), pa.array(sums)], [*(c for c in own.schema.names if c != "codes"), "model_log"])

    names = ["uid", "doc_id", "held_out", "n_tokens", "n_tail", "n_rare", "word_log", "tail_log"]
    kinds = dict(c.split() for c in ENCODED.split(", ")[:8])
    got = rows.select(*names, "codes").mapInArrow(score, ", ".join(f"{c} {kinds[c]}" for c in names) + ", model_log double")
    rare = rare_counts(rows, words).withColumnRenamed("uid", "r_uid")
    known, log = F.coalesce("rare_known", F.lit(0)), F.coalesce("rare_log", F.lit(0.0))
    base = F.col("word_log") + F.col("tail_log") + log - F.col("n_tokens") * math.log10(words.mass)
    full = F.col("model_log") + F.col("tail_log") + log - (F.col("n_tail") + F.col("n_rare")) * math.log10(max(1, words.rest))
    return got.join(rare, F.col("uid") == F.col("r_uid"), "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_tokens") - F.col("n_rare") + known).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"), base.alias("base_score"), full.alias("score")
    )


def scores(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", held: Column | None = None) -> DataFrame:
    """One row for each row of ``docs``, scored by a model of the rows that are not ``held`` (by default by identifier).

    Null texts count as empty: their only token is the end. Rows that repeat are scored alike, other columns are left out.
    Without training rows each token has probability 1, as the unknown token is the only one.
    """
    given = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), (held_out(docs[doc_id]) if held is None else held).alias("held_out"))
    words = vocabulary(given.filter(~F.col("held_out")))
    rows = encoded(given, words)
    model = trained(rows.filter(~F.col("held_out")), words)
    out = written(scored(rows, words, model))
    discard(rows, words.counts)
    return out


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
