"""Language identification by character language models.

One interpolated Kneser-Ney model of order 4 for each language, over the letters of each word with its borders.
Four characters of 16 bits are one 64-bit key; the n-grams of all languages lie in sorted key arrays with a column
of log-probabilities for each language. A text gets the language of lowest cross-entropy per symbol. Texts whose
cross-entropy lies far above that of unseen training texts are rejected (``accepted`` false).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import held_out, part
from .tables import added, table
from .words import LETTERS, WordTable, held

ORDER = 4
BEGIN, END = "\x01", "\x02"
#: Distinct words of a language that a task holds while it counts.
MOST_WORDS = 200_000
#: A text is rejected beyond this many standard deviations of unseen training texts.
REJECT_Z = 8.0
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the 4-grams that predict each letter and the end of each word; how many each word has."""
    codes = np.frombuffer("".join([f"{BEGIN}{BEGIN}{BEGIN}{w}{END}" for w in words]).encode("utf-16-le", "surrogatepass"), dtype=np.uint16).astype(np.uint64)
    if not len(codes):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    s = np.uint64(16)
    keys = ((codes[:-3] << s | codes[1:-2]) << s | codes[2:-1]) << s | codes[3:]
    ends = codes == 2
    per = np.diff(np.concatenate(([-1], np.flatnonzero(ends)))) - 3
    return keys[codes[3:] != 1], per


def count_grams(batches, text: str, lang: str):
    """Counts of a partition's 4-grams by language, from the counts of its words; a language's words are let out when there are
    ``MOST_WORDS``."""
    found: dict[str, Counter] = {}

    def let_out(name: str) -> pa.RecordBatch:
        counter = found.pop(name)
        words = list(counter)
        keys, per = grams(words)
        own, inverse = np.unique(keys, return_inverse=True)
        n = np.bincount(inverse, weights=np.repeat(np.fromiter(counter.values(), dtype=np.int64, count=len(words)), per), minlength=len(own)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(own.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    for b in batches:
        for t, name in zip(b.column(text).to_pylist(), b.column(lang).to_pylist(), strict=True):
            counter = found.setdefault(name, Counter())
            counter.update(words_of(t))
            if len(counter) >= MOST_WORDS:
                yield let_out(name)
    for name in list(found):
        yield let_out(name)


@dataclass
class Level:
    keys: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << (16 * n)) - 1)


@dataclass
class Model:
    """``levels[0]`` is the highest order. ``limits``: mean and deviation of each language's cross-entropy."""

    languages: list[str]
    levels: list[Level]
    symbols: int
    temperature: float = 8.0
    limits: np.ndarray | None = None

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros((len(keys), len(self.languages)))
        rest = np.arange(len(keys))
        for down, level in enumerate(self.levels):
            n = ORDER - down
            own = keys[rest] & _mask(n)
            at, there = _find(level.keys, own)
            out[rest[there]] += level.logp[at[there]]
            rest, own = rest[~there], own[~there]
            at, there = _find(level.contexts, own >> np.uint64(16))
            out[rest[there]] += level.backoff[at[there]]
        out[rest] -= np.log(self.symbols)
        return out

    def of_words(self, words: list[str]) -> np.ndarray:
        """For each word: the sum of log-probabilities by language, and the number of symbols."""
        keys, per = grams(words)
        logp = self.log_probabilities(keys)
        starts = np.concatenate(([0], np.cumsum(per)[:-1]))
        return np.column_stack([np.add.reduceat(logp, starts, axis=0), per]) if len(words) else np.zeros((0, len(self.languages) + 1))


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """``counts``: for each language its distinct 4-grams and how often each occurs."""
    languages = sorted(counts)
    symbols = len(np.unique(np.concatenate([k & _mask(1) for k, _ in counts.values()]))) + 1 if counts else 1
    tables: list[list] = []
    for name in languages:
        keys, n = counts[name]
        order = np.argsort(keys)
        keys, n = keys[order], n[order].astype(np.float64)
        own = []
        for size in range(ORDER, 0, -1):
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
            contexts, inverse = np.unique(keys >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(inverse, weights=n), np.bincount(inverse)
            own.append((keys, np.maximum(n - discount, 0) / total[inverse], contexts, discount * kinds / total))
            # lower orders count the different characters before them
            keys, n = np.unique(keys & _mask(size - 1), return_counts=True)
            n = n.astype(np.float64)
        tables.append(own)
    levels: list[Level] = []
    for down in range(ORDER - 1, -1, -1):
        size = ORDER - down
        keys = np.unique(np.concatenate([t[down][0] for t in tables])) if tables else np.zeros(0, dtype=np.uint64)
        contexts = np.unique(np.concatenate([t[down][2] for t in tables])) if tables else keys
        logp, backoff = np.zeros((len(keys), len(languages))), np.zeros((len(contexts), len(languages)))
        # the order below, for every key: its probability is what is interpolated
        lower = Model(languages, levels[::-1], symbols)
        below = np.exp(_lower(lower, keys, size - 1))
        for j, t in enumerate(tables):
            own, p, ctx, weight = t[down]
            at, there = _find(own, keys)
            high = np.where(there, p[at], 0.0)
            at, there = _find(ctx, keys >> np.uint64(16))
            logp[:, j] = np.log(high + np.where(there, weight[at], 1.0) * below[:, j])
            at, there = _find(ctx, contexts)
            backoff[:, j] = np.where(there, np.log(weight[at]), 0.0)
        levels.append(Level(keys, logp, contexts, backoff))
    return Model(languages, levels[::-1], symbols)


def _lower(model: Model, keys: np.ndarray, size: int) -> np.ndarray:
    """log-probabilities of the last ``size`` characters of each key under the orders up to ``size``."""
    out = np.zeros((len(keys), len(model.languages)))
    rest = np.arange(len(keys))
    for down, level in enumerate(model.levels):
        own = keys[rest] & _mask(size - down)
        at, there = _find(level.keys, own)
        out[rest[there]] += level.logp[at[there]]
        rest, own = rest[~there], own[~there]
        at, there = _find(level.contexts, own >> np.uint64(16))
        out[rest[there]] += level.backoff[at[there]]
    out[rest] -= np.log(model.symbols)
    return out


def _entropies(table_: WordTable, model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per symbol in each language, and symbols, of each text."""
    sums, _ = table_.sums(words_of(t) for t in texts)
    width = len(model.languages)
    if sums.shape[1] != width + 1:
        return np.zeros((len(texts), width)), np.zeros(len(texts))
    symbols = sums[:, width]
    return -sums[:, :width] / np.maximum(symbols, 1)[:, None], symbols


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Fitted on all rows with a language that are not held out (``sampling.part``): parts 0 and 1 are counted, part 3
    calibrates. The driver gets one row for each distinct 4-gram of a language."""
    labelled = docs.select(docs[text].alias("text"), docs[lang].alias("lang"), docs[doc_id].alias("doc_id")).filter("lang is not null and text is not null")
    counted = labelled.filter(part(F.col("doc_id")) < 2).select("text", "lang")
    grams_ = counted.mapInArrow(lambda it: count_grams(it, "text", "lang"), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if grams_.empty:
        return Model([], [Level(*[np.zeros(0, dtype=np.uint64), np.zeros((0, 0))] * 2) for _ in range(ORDER)], 1)
    counts = {name: (g["gram"].to_numpy().view(np.uint64), g["n"].to_numpy()) for name, g in grams_.groupby("lang")}
    model = kneser_ney(counts)
    return calibrated(model, labelled.filter(part(F.col("doc_id")) == 3))


#: Temperatures that calibration chooses from.
TEMPERATURES = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)


def calibrated(model: Model, rows: DataFrame) -> Model:
    shared = rows.sparkSession.sparkContext.broadcast(model)
    width = len(model.languages)

    def measure(batches):
        m = shared.value
        t = WordTable(m.of_words)
        place = {name: i for i, name in enumerate(m.languages)}
        for b in batches:
            own, symbols = _entropies(t, m, b.column("text").to_pylist())
            which = np.array([place.get(x, -1) for x in b.column("lang").to_pylist()], dtype=np.int64)
            ok = (which >= 0) & (symbols > 0)
            own, which = own[ok], which[ok]
            true = own[np.arange(len(own)), which] if width else np.zeros(0)
            loss = [np.log(np.exp(-(own - true[:, None]) * k).sum(1)).sum() for k in TEMPERATURES]
            for j in range(width):
                x = true[which == j]
                yield pa.RecordBatch.from_arrays([pa.array([j]), pa.array([len(x)], pa.int64()), pa.array([x.sum()]), pa.array([(x**2).sum()]), pa.array([loss if j == 0 else [0.0] * len(loss)])], ["j", "n", "s", "q", "loss"])

    found = rows.mapInArrow(measure, "j long, n long, s double, q double, loss array<double>").groupBy("j").agg(F.sum("n"), F.sum("s"), F.sum("q"), *[F.sum(F.col("loss")[i]) for i in range(len(TEMPERATURES))]).collect()
    limits, losses = np.full((width, 2), np.nan), np.zeros(len(TEMPERATURES))
    for r in found:
        n, s, q = r[1], r[2], r[3]
        if n >= 5:
            limits[r[0]] = s / n, max(0.02, np.sqrt(max(0.0, q / n - (s / n) ** 2)))
        losses += np.array(r[4:])
    model.limits = limits
    if losses.any():
        model.temperature = TEMPERATURES[int(np.argmin(losses))]
    return model


def predictor(spark: SparkSession, model: Model):
    """A column function: text -> struct(lang, score, cross_entropy, accepted)."""
    shared = spark.sparkContext.broadcast(model)
    number = shared._jbroadcast.id()

    @F.pandas_udf("lang string, score double, cross_entropy double, accepted boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        own, symbols = _entropies(held(("language", number), lambda: WordTable(m.of_words)), m, texts.where(texts.notna(), None).tolist())
        known = (symbols > 0) & (len(m.languages) > 0)
        if not len(m.languages):
            return pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": 0.0, "cross_entropy": np.nan, "accepted": False})
        best = own.argmin(1)
        low = own[np.arange(len(own)), best]
        score = 1 / np.exp(-(own - low[:, None]) * m.temperature).sum(1)
        mean, sd = (m.limits[best, 0], m.limits[best, 1]) if m.limits is not None else (np.full(len(own), np.nan),) * 2
        high = low > mean + REJECT_Z * sd * np.sqrt(1 + 200 / np.maximum(symbols, 1))
        names = np.array([*m.languages, UNKNOWN], dtype=object)
        return pd.DataFrame({"lang": names[np.where(known, best, len(m.languages))], "score": np.where(known, score, 0.0), "cross_entropy": np.where(known, low, np.nan), "accepted": known & ~high})

    return predict


def identify(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct ``out``: lang (``und`` for a null text or one without a letter), score (0 to 1; 0 for
    ``und``), cross_entropy (null for ``und``), accepted. Repeated rows and other columns pass as they are; a column
    named ``out`` is refused."""
    return added(docs, out, predictor(docs.sparkSession, model)(docs[text]))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = identify(docs.select("doc_id", "text"), train(docs))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.accepted").alias("accepted"))
