"""Toxicity by weak supervision.

1. Voters. A lexicon is mined from labelled texts: hashed words, word starts, word ends and pairs of neighbouring words
   that are far more frequent in toxic texts. Lexicon voters look for its entries by kind and strength, at their density
   and at entries beside second-person forms; pattern voters look at the form of the whole text: signs, capitals,
   exclamation, second person, masked words, stretched letters, doubled words. The given label is one more, noisy,
   annotator.
2. Label model. The votes of the sample are counted by pattern (at most 2 ** voters rows), and EM fits a
   generative model of an unseen true label: each voter's accuracies given the label, and for each label a tree of
   correlated voters (Chow and Liu, 1968) chosen by conditional mutual information.
3. End model. A logistic regression over the hashed features of a text's distinct words (those whose hashes are
   entries of the lexicon) is trained on the posterior labels. It alone scores texts.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut_lineage
from . import linear
from .sampling import held_out, thinned
from .tables import added, table
from .words import LETTERS, WordTable, held

DIM = 1 << 18
#: Labelled rows that voters, label model and classifier are fitted on, at most (about: taken by hash).
TRAIN_ROWS = 16_000
TRAIN_PARTS = 8
#: An entry of the lexicon is in at least so many texts, and its log-likelihood ratio has a root of at least LEAST_Z.
LEAST_TEXTS, LEAST_Z = 3, 4.0
#: At least this share of its texts is toxic; entries of each kind go to a strong and a weak voter, split at STRONG.
LEAST_SHARE, STRONG = 0.5, 0.8
#: Prior of the annotator: P(labelled toxic | not toxic, toxic), with the weight of this share of the rows. It ties
#: the unseen label to toxicity rather than to another property that the voters happen to share.
ANNOTATOR, ANNOTATOR_WEIGHT = (0.01, 0.9), 0.25
KINDS = ("word", "start", "end", "pair")
LEXICON_VOTERS = ["strong word", "weak word", "strong start", "strong end", "strong pair", "dense", "aimed"]
PATTERN_VOTERS = ["signs", "shouting", "exclamation", "second person", "masked", "stretched", "doubled"]
VOTERS = [*LEXICON_VOTERS, *PATTERN_VOTERS, "annotator"]
#: Words between an entry of the lexicon and a second-person form, and the share of entries among the words of a dense text.
REACH, DENSE = 4, 0.02
#: Second-person forms.
SECOND_PERSON = frozenset(("you", "your", "yours", "yourself", "u", "ur"))
#: A score of at least this is predicted toxic.
THRESHOLD = 0.3
_SIGNS = re.compile(r"[^\w\s.,;:'\"!?()-]")
_MASKED = re.compile(r"[^\W\d_][*@#$%]+[^\W\d_]|[^\W\d_][0134578]+[^\W\d_]")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")


def features(word: str) -> list[tuple[int, int]]:
    """(kind, hash) of a lower-cased word: whole, its starts of 4 to 6 and its ends of 5 and 6 letters."""
    parts = [(0, f"w {word}")] + [(1, f"s {word[:n]}") for n in (4, 5, 6) if len(word) >= n] + [(2, f"e {word[-n:]}") for n in (5, 6) if len(word) >= n]
    return [(k, zlib.crc32(p.encode("utf-8", "surrogatepass")) & (DIM - 1)) for k, p in parts]


def words_of(text: str | None) -> set[str]:
    return set(LETTERS.findall(text.lower())) if text else set()


def text_features(text: str | None) -> dict[int, int]:
    """hash -> kind over the distinct words."""
    return {h: k for w in words_of(text) for k, h in features(w)}


def pair_features(text: str | None) -> dict[int, int]:
    """hash -> kind over the distinct pairs of neighbouring words."""
    words = LETTERS.findall(text.lower()) if text else []
    return {DIM + (zlib.crc32(f"{v} {w}".encode("utf-8", "surrogatepass")) & (DIM - 1)): 3 for v, w in set(zip(words, words[1:], strict=False))}


def pattern_votes(text: str | None) -> list[bool]:
    t = text or ""
    letters = sum(map(str.isalpha, t))
    words = LETTERS.findall(t.lower())
    signs, capitals = len(_SIGNS.findall(t)) > 0.02 * len(t), sum(map(str.isupper, t)) > 0.3 * max(1, letters)
    you, doubled = sum(w in SECOND_PERSON for w in words) > 0.03 * len(words), sum(map(eq, words, words[1:])) > 0.02 * len(words)
    return [signs, capitals, t.count("!") > 0.01 * len(t), you, bool(_MASKED.search(t)), bool(_STRETCHED.search(t)), doubled]


@dataclass
class LabelModel:
    """P(y), and for each voter its parent (-1: none) and P(vote = 1 | y, parent's vote)."""

    prior: float
    parents: list[int]
    rates: np.ndarray  # voter, y, parent's vote

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        total = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for j, parent in enumerate(self.parents):
            up = votes[:, parent] if parent >= 0 else np.zeros(len(votes), dtype=np.int64)
            for y in (0, 1):
                p = self.rates[j, y, up]
                total[:, y] += np.log(np.where(votes[:, j] == 1, p, 1 - p))
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -50, 50)))


def fit_label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 25, smooth: float = 1.0) -> LabelModel:
    """EM over vote patterns with their counts. The annotator is last: it is the
    root of the tree and starts the labels."""
    voters = votes.shape[1]
    weight = counts.astype(np.float64)
    q = np.where(votes[:, -1] == 1, 0.9, 0.02)
    model = LabelModel(0.5, [-1] * voters, np.full((voters, 2, 2), 0.5))
    for at in range(rounds):
        by_label = np.stack([weight * (1 - q), weight * q])
        total = by_label.sum(1)
        prior = float((total[1] + smooth) / (total.sum() + 2 * smooth))
        # pairs[y, a, b, i, j]: weight of votes a of i and b of j
        one, zero = votes.astype(np.float64), 1.0 - votes
        pairs = np.array([[[(x * w[:, None]).T @ z for z in (zero, one)] for x in (zero, one)] for w in by_label]) + smooth / 4
        parents = tree(pairs) if at >= 3 else [-1] * voters
        rates = np.zeros((voters, 2, 2))
        for j, parent in enumerate(parents):
            for y in (0, 1):
                for up in (0, 1):
                    if parent >= 0:
                        rates[j, y, up] = pairs[y, up, 1, parent, j] / (pairs[y, up, 0, parent, j] + pairs[y, up, 1, parent, j])
                    else:
                        rates[j, y, up] = (by_label[y] @ votes[:, j] + smooth / 2) / (total[y] + smooth)
        root = parents.index(-1) if at >= 3 else voters - 1
        for y in (0, 1):
            strength = ANNOTATOR_WEIGHT * total[y]
            rates[root, y, :] = (rates[root, y, 0] * total[y] + ANNOTATOR[y] * strength) / (total[y] + strength)
        model = LabelModel(prior, parents, np.clip(rates, 1e-4, 1 - 1e-4))
        q = model.posterior(votes)
    return model


def tree(pairs: np.ndarray) -> list[int]:
    """Maximum spanning tree of the mutual information of voters given the label; parents, the root has -1."""
    joint = pairs / pairs.sum(axis=(0, 1, 2), keepdims=True)
    label = joint.sum(axis=(1, 2), keepdims=True)
    left, right = joint.sum(axis=2, keepdims=True), joint.sum(axis=1, keepdims=True)
    information = (joint * np.log(joint * label / (left * right))).sum(axis=(0, 1, 2))
    voters = information.shape[0]
    parents, inside = [-1] * voters, {voters - 1}
    while len(inside) < voters:
        _, i, j = max((information[i, j], -i, -j) for i in inside for j in range(voters) if j not in inside)
        parents[-j] = -i
        inside.add(-j)
    return parents


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float

    def of_words(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for i, w in enumerate(words):
            out[i] = sum(self.weights[h] for _, h in features(w))
        return out


def logistic_loss(scores: np.ndarray, targets: np.ndarray, extras: np.ndarray):
    slope = 1 / (1 + np.exp(-np.clip(scores + extras[0], -40, 40))) - targets
    return slope, np.array([slope.mean()])


def lexicon_of(labelled: DataFrame) -> dict[int, float]:
    """Hashed entry -> share of its texts that are toxic, for entries whose signed root of the log-likelihood ratio
    (Dunning, 1993) is high enough. Counted per partition first; the table has at most twice ``DIM`` rows."""

    def count(batches):
        texts, n, bad = np.zeros((2 * DIM, 2), dtype=np.int64), 0, 0
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                texts[[*text_features(t), *pair_features(t)], int(y)] += 1
                n, bad = n + 1, bad + y
        own = np.flatnonzero(texts.sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(own, -1)), pa.array(np.append(texts[own, 1], bad)), pa.array(np.append(texts[own, 0], n - bad))], ["h", "a", "b"])

    sums = labelled.select("text", "toxic").mapInArrow(count, "h long, a long, b long").groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    total = {r.h: (r.a, r.b) for r in sums.filter("h = -1").collect()}.get(-1, (0, 0))
    n1, n0 = map(float, total)
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    share = (F.col("a") + F.col("b")) / F.lit(max(1.0, n1 + n0))
    ratio = 2 * (term(F.col("a"), share * n1) + term(F.col("b"), share * n0) + term(n1 - F.col("a"), n1 - share * n1) + term(n0 - F.col("b"), n0 - share * n0))
    z = F.sqrt(F.greatest(ratio, F.lit(0.0))) * F.signum(F.col("a") / F.lit(max(1.0, n1)) - F.col("b") / F.lit(max(1.0, n0)))
    found = sums.filter(f"h >= 0 and a >= {LEAST_TEXTS}").select("h", z.alias("z"), (F.col("a") / (F.col("a") + F.col("b"))).alias("share"))
    return {r.h: r.share for r in found.filter((F.col("z") >= LEAST_Z) & (F.col("share") >= LEAST_SHARE)).collect()}


def votes_of(text: str | None, lexicon: dict[int, float], annotated: bool) -> list[int]:
    hits = [(k, lexicon[h]) for h, k in (text_features(text) | pair_features(text)).items() if h in lexicon]
    has = lambda kind, low, high: any(k == kind and low <= share < high for k, share in hits)
    words = LETTERS.findall(text.lower()) if text else []
    listed = {w for w in set(words) if any(h in lexicon for k, h in features(w) if not k)}
    entries = [i for i, w in enumerate(words) if w in listed]
    aimed = any(w in SECOND_PERSON for i in entries for w in words[max(0, i - REACH) : i + REACH + 1])
    votes = [has(0, STRONG, 2), has(0, 0, STRONG), has(1, STRONG, 2), has(2, STRONG, 2), has(3, STRONG, 2), len(entries) >= max(2, DENSE * len(words)), aimed]
    return [int(v) for v in [*votes, *pattern_votes(text), annotated]]


def train(labelled: DataFrame) -> tuple[Classifier, LabelModel | None]:
    """``labelled``: doc_id, text, toxic (0 or 1). Without rows the classifier gives a low constant score."""
    rows = cut_lineage(labelled.repartition(TRAIN_PARTS, F.xxhash64("doc_id", "text")).sortWithinPartitions("doc_id", "text"))
    lexicon = rows.sparkSession.sparkContext.broadcast(lexicon_of(rows))

    def vote(batches):
        for b in batches:
            own = [votes_of(t, lexicon.value, y == 1) for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True)]
            codes = [sum(v << j for j, v in enumerate(x)) for x in own]
            found = [[h for h in text_features(t) if h in lexicon.value] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), pa.array(found, pa.list_(pa.int32())), pa.array([[1.0] * len(f) for f in found], pa.list_(pa.float32()))], ["votes", "idx", "val"])

    voted = cut_lineage(rows.select("text", "toxic").mapInArrow(vote, "votes int, idx array<int>, val array<float>"))
    patterns = voted.groupBy("votes").count().collect()
    if not patterns:
        return Classifier(np.zeros(DIM), -4.0), None
    codes = np.array([r["votes"] for r in patterns])
    votes = (codes[:, None] >> np.arange(len(VOTERS))) & 1
    model = fit_label_model(votes, np.array([r["count"] for r in patterns]))
    posterior = dict(zip(codes.tolist(), model.posterior(votes).tolist(), strict=True))
    soft = F.create_map(*[F.lit(x) for kv in posterior.items() for x in kv])[F.col("votes")]
    weights, extras = linear.fit(voted.select("idx", "val", soft.alias("target")), DIM, np.array([-2.0]), logistic_loss, rounds=4, epochs=6, rate=0.2, l1=2e-4)
    return Classifier(weights, float(extras[0])), model


def predictor(spark: SparkSession, model: Classifier):
    """A column function: text -> score from 0 to 1."""
    shared = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))
    number = shared._jbroadcast.id()

    @F.pandas_udf("double")
    def predict(texts: pd.Series) -> pd.Series:
        own = Classifier(*shared.value)
        sums, _ = held(("toxicity", number), lambda: WordTable(own.of_words)).sums(list(words_of(t)) if isinstance(t, str) else () for t in texts)
        return pd.Series(1 / (1 + np.exp(-np.clip(sums[:, 0] + own.bias, -50, 50))))

    return predict


def score(docs: DataFrame, model: Classifier, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``out`` from 0 to 1. A null or empty text gets the score of the bias alone. Repeated
    rows and other columns pass as they are; a column named ``out`` is refused."""
    return added(docs, out, predictor(docs.sparkSession, model)(docs[text]))


def labelled_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """Texts with a toxic label, none of them held out; labels are thinned before the join. Of several labels of a
    document the largest counts."""
    own = thinned(labels.filter(~held_out(labels["doc_id"]) & labels["toxic"].isin(0, 1)), "doc_id", bound)
    own = own.groupBy(own["doc_id"].alias("l_id")).agg(F.max(own["toxic"].cast("int")).alias("toxic"))
    texts = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    return texts.join(own, texts["doc_id"] == own["l_id"]).select("doc_id", "text", "toxic")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, _ = train(labelled_rows(docs, table(spark, sf_dir, "labels")))
    got = score(docs, model)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
