"""Transcript parsing: roles of lines by a hidden Markov model, then canonical turns.

States are (role, first or later line of a turn). A line's features are independent given its state: the speaker marker
at its start, a blank line before it, its length, how it ends and how it starts. All probabilities are counted by Spark
from conversations whose roles are known; Viterbi finds the most probable states of a transcript, and each run of lines
is rendered as one turn. A marker is cut from the first line of a turn only, and blank lines inside a turn stay.

A long conversation lies in parts. Each part's best scores from any state before it to any state at its end form a
matrix; products of matrices (with maximum and sum) over ever larger blocks give the scores before each part and the
state at its end, so the parts are decoded apart and their states are those of one run over the whole conversation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import written
from .sampling import held_out
from .tables import table

ROLES = ("system", "user", "assistant")
STATES = [(r, first) for r in ROLES for first in (1, 0)]
#: Speaker markers, as pattern and class.
MARKERS = (
    ("system", r"^\s*(?:#+ *|\[|<\|?)?(?:system|context)\s*(?:\|?>|\]|:)+ ?"),
    ("user", r"^\s*(?:#+ *|\[|<\|?)?(?:user|human|question|q|instruction)\s*(?:\|?>|\]|:)+ ?"),
    ("assistant", r"^\s*(?:#+ *|\[|<\|?)?(?:assistant|ai|bot|answer|a|response)\s*(?:\|?>|\]|:)+ ?"),
)
#: Turns of a part of a conversation, and parts or blocks of a larger block.
TURNS_PER_PART, PARTS_PER_BLOCK = 256, 256
#: The state before a conversation, and a score that no path has.
START, NEVER = len(STATES), -1e300
FEATURES = (("marker", 4), ("blank", 2), ("size", 6), ("end", 4), ("start", 3))
_PATTERNS = [re.compile(p, re.I) for _, p in MARKERS]


def line_features(line: Column, blank: Column) -> list[Column]:
    """The features of a line as Spark columns, in the order of ``FEATURES``."""
    marker = F.lit(3)
    for i in (2, 1, 0):
        marker = F.when(line.rlike("(?i)" + MARKERS[i][1]), i).otherwise(marker)
    size = F.least(F.lit(5), F.floor(F.log2(1 + F.length(line) / 16.0))).cast("int")
    end = F.when(line.rlike(r"\?\s*$"), 0).when(line.rlike(r"[.!]\s*$"), 1).when(line.rlike(r":\s*$"), 2).otherwise(3)
    start = F.when(line.rlike(r"^\p{Lu}"), 0).when(line.rlike(r"^\p{Ll}"), 1).otherwise(2)
    return [marker, blank.cast("int"), size, end, start]


@dataclass
class Model:
    initial: np.ndarray
    transition: np.ndarray
    emission: list[np.ndarray]  # feature -> (state, value), logarithms

    def scores(self, features: np.ndarray) -> np.ndarray:
        return sum(e[:, features[:, i]] for i, e in enumerate(self.emission)).T

    def moves(self) -> np.ndarray:
        """Scores of a step from any state or ``START``."""
        return np.vstack((self.transition, self.initial))

    def matrix(self, features: np.ndarray) -> np.ndarray:
        """Best scores of these lines from each state before them (and ``START``) to each state at their end."""
        best, scores = self.moves(), self.scores(features)
        best = best + scores[0]
        for t in range(1, len(scores)):
            best = (best[:, :, None] + self.transition).max(1) + scores[t]
        return np.hstack((best, np.full((START + 1, 1), NEVER)))

    def decode(self, features: np.ndarray, entry: np.ndarray | None = None, exit_: int | None = None) -> np.ndarray:
        """Most probable states of lines with these features (lines x features); on a tie the earlier state. ``entry``:
        scores of the states before the lines (by default they begin a conversation); ``exit_``: the state at their end."""
        scores = self.scores(features)
        start = self.initial if entry is None else (np.asarray(entry)[:, None] + self.moves()).max(0)
        best, back = start + scores[0], np.zeros(scores.shape, dtype=np.int64)
        for t in range(1, len(scores)):
            reach = best[:, None] + self.transition
            back[t] = reach.argmax(0)
            best = reach[back[t], np.arange(len(STATES))] + scores[t]
        out = np.empty(len(scores), dtype=np.int64)
        out[-1] = best.argmax() if exit_ is None else exit_
        for t in range(len(scores) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out


def product(matrices: np.ndarray) -> np.ndarray:
    whole = matrices[0]
    for m in matrices[1:]:
        whole = (whole[:, :, None] + m).max(1)
    return whole


def dealt(matrices: np.ndarray, entry: np.ndarray, exit_: int) -> list[tuple[np.ndarray, int, int]]:
    """(scores before it, state before it, state at its end) for each of the matrices in a block with this entry and exit."""
    entries = [entry]
    for m in matrices[:-1]:
        entries.append((entries[-1][:, None] + m).max(0))
    out = []
    for m, e in zip(matrices[::-1], entries[::-1], strict=True):
        before = int((e + m[:, exit_]).argmax())
        out.append((e, before, exit_))
        exit_ = before
    return out[::-1]


def train(lines: DataFrame, smooth: float = 0.5) -> Model:
    """``lines``: part (any key), at (order), state, and the features. Counts per state pair and value only."""
    count = lambda *c: {tuple(r[:-1]): r[-1] for r in lines.groupBy(*c).count().collect()}
    order = Window.partitionBy("part").orderBy("at")
    pairs = lines.select(F.lag("state").over(order).alias("before"), "state").groupBy("before", "state").count().collect()
    n = len(STATES)
    moves, starts = np.full((n, n), smooth), np.full(n, smooth)
    for r in pairs:
        if r["before"] is None:
            starts[r["state"]] += r["count"]
        else:
            moves[r["before"], r["state"]] += r["count"]
    emission = []
    for name, values in FEATURES:
        e = np.full((n, values), smooth)
        for (state, value), c in count("state", name).items():
            e[state, value] += c
        emission.append(np.log(e / e.sum(1, keepdims=True)))
    return Model(np.log(starts / starts.sum()), np.log(moves / moves.sum(1, keepdims=True)), emission)


def lines_of(text: Column) -> Column:
    """The lines that are not blank as structs (line, blanks before it, and the features). A null text counts as empty."""
    numbered = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("at")))
    own = F.filter(numbered, lambda x: F.length(F.trim(x["line"])) > 0)
    before = F.slice(F.concat(F.array(F.lit(-1)), F.transform(own, lambda x: x["at"])), 1, F.size(own))

    def described(x, last):
        blanks = x["at"] - last - 1
        return F.struct(x["line"].alias("line"), blanks.alias("blanks"), *[f.alias(n) for f, (n, _) in zip(line_features(x["line"], blanks > 0), FEATURES, strict=True)])

    return F.zip_with(own, before, described)


def numbers(lines) -> np.ndarray:
    return np.array([[x[n] for n, _ in FEATURES] for x in lines], dtype=np.int64)


def turns_of(lines, states, before: int = START) -> tuple[list[str], list[str], str]:
    """(role, text) of each turn that starts in these lines, and the text that goes on with the turn before them."""
    roles, texts, rest, last = [], [], [], STATES[before][0] if before != START else None
    for state, x in zip(states, lines, strict=True):
        role, first = STATES[state]
        if first or role != last:
            line = x["line"]
            for p in _PATTERNS:
                line, cut = p.subn("", line, count=1)
                if cut:
                    break
            roles.append(role)
            texts.append([line])
        else:
            (texts[-1] if roles else rest).append("\n" * x["blanks"] + x["line"])
        last = role
    return roles, ["\n".join(t) for t in texts], "\n".join(rest)


def render(roles: list[str], texts: list[str], rest: str = "", opened: bool = False, closes: bool = True) -> str:
    """Canonical turns. ``rest`` goes on with a turn ``opened`` before; the last turn is left open unless it ``closes``."""
    out = [f"{rest}\n" if rest else ""]
    for i, (r, t) in enumerate(zip(roles, texts, strict=True)):
        out += ["<|end|>\n" if opened or i else "", f"<|{r}|>\n{t}\n"]
    return "".join(out) + ("<|end|>\n" if closes and (roles or opened) else "")


CHAT = "roles array<string>, texts array<string>, rendered string"


def parser(spark: SparkSession, model: Model):
    """A column function: (array of lines, scores before, state before, state at the end, whether the conversation ends)
    -> struct(roles, texts, rendered)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(CHAT)
    def parse(lines: pd.Series, entry: pd.Series, before: pd.Series, exit_: pd.Series, ends: pd.Series) -> pd.DataFrame:
        rows = []
        for own, e, b, x, z in zip(lines, entry, before, exit_, ends, strict=True):
            if own is None or not len(own):
                rows.append(([], [], ""))
                continue
            carried = e is not None
            states = shared.value.decode(numbers(own), e if carried else None, int(x) if carried else None)
            roles, texts, rest = turns_of(own, states, int(b) if carried else START)
            rows.append((roles, texts, render(roles, texts, rest, carried and b != START, bool(z))))
        return pd.DataFrame(rows, columns=["roles", "texts", "rendered"])

    return parse


def parse(transcripts: DataFrame, model: Model, keys: list[str], text: str = "transcript") -> DataFrame:
    """``keys`` and a struct ``chat`` (roles, texts, rendered) for each transcript. A null, empty or blank transcript has
    no turns. Transcripts that repeat in keys and text give equal rows; other columns are left out."""
    null = F.lit(None)
    chat = parser(transcripts.sparkSession, model)(lines_of(transcripts[text]), null.cast("array<double>"), null.cast("int"), null.cast("int"), F.lit(True))
    return transcripts.select(*[transcripts[k] for k in keys], chat.alias("chat"))


def parse_parts(parts: DataFrame, model: Model) -> DataFrame:
    """``parts`` (key, p, transcript and any other columns; p counts a conversation's parts from 0 or more) with a struct
    ``chat``: as if each conversation were one transcript. The turns are those that start in the part, and the ``rendered``
    of a conversation's parts make up its rendering. Key and p name one row. Blank lines before a
    line lie in its part. In long conversations, parts without a line give no row."""
    spark = parts.sparkSession
    shared, size = spark.sparkContext.broadcast(model), START + 1
    rich = written(parts.withColumn("lines", lines_of(F.col("transcript"))))
    last = rich.agg(F.max("p")).first()[0] or 0
    null = F.lit(None)
    if not last:
        whole = parser(spark, model)(F.col("lines"), null.cast("array<double>"), null.cast("int"), null.cast("int"), F.lit(True))
        return rich.withColumn("chat", whole).drop("lines")

    @F.pandas_udf("array<double>")
    def matrix(lines: pd.Series) -> pd.Series:
        return pd.Series([shared.value.matrix(numbers(x)).ravel() for x in lines])

    @F.pandas_udf("array<double>")
    def block(own: pd.Series) -> pd.Series:
        return pd.Series([product(np.array([x["m"] for x in o]).reshape(-1, size, size)).ravel() for o in own])

    @F.pandas_udf("array<struct<p:long,entry:array<double>,before:int,exit:int>>")
    def below(own: pd.Series, entry: pd.Series, exit_: pd.Series) -> pd.Series:
        out = []
        for o, e, x in zip(own, entry, exit_, strict=True):
            m = np.array([y["m"] for y in o]).reshape(-1, size, size)
            e = np.where(np.arange(size) == START, 0.0, NEVER) if e is None else np.asarray(e)
            x = int((e[:, None] + product(m)).max(0).argmax()) if pd.isna(x) else int(x)
            out.append([{"p": int(y["p"]), "entry": f.tolist(), "before": b, "exit": z} for y, (f, b, z) in zip(o, dealt(m, e, x), strict=True)])
        return pd.Series(out)

    def blocks(level: DataFrame) -> DataFrame:
        return level.groupBy("key", F.floor(F.col("p") / PARTS_PER_BLOCK).alias("up")).agg(F.sort_array(F.collect_list(F.struct("p", "m"))).alias("own"))

    levels = [written(rich.filter(F.size("lines") > 0).select("key", "p", matrix("lines").alias("m")))]
    while last >= PARTS_PER_BLOCK:
        levels.append(written(blocks(levels[-1]).select("key", F.col("up").alias("p"), block("own").alias("m"))))
        last //= PARTS_PER_BLOCK
    found = None
    for level in reversed(levels):
        own = blocks(level)
        if found is None:
            own = own.withColumn("entry", null.cast("array<double>")).withColumn("exit", null.cast("int"))
        else:
            above = found.select(F.col("key").alias("k"), F.col("p").alias("up_p"), "entry", "exit")
            own = own.join(above, (F.col("key") == F.col("k")) & (F.col("up") == F.col("up_p")))
        found = own.select("key", F.explode(below("own", "entry", "exit")).alias("x")).select("key", "x.*")
    ends = levels[0].groupBy("key").agg(F.max("p").alias("end")).select(F.col("key").alias("end_key"), "end")
    named = found.select(F.col("key").alias("k"), F.col("p").alias("k_p"), "entry", "before", "exit")
    whole = rich.join(named, (F.col("key") == F.col("k")) & (F.col("p") == F.col("k_p"))).join(ends, F.col("key") == F.col("end_key"))
    chat = parser(spark, model)("lines", "entry", "before", "exit", F.col("p") == F.col("end"))
    return whole.withColumn("chat", chat).drop("lines", "k", "k_p", "entry", "before", "exit", "end_key", "end")


#: Styles of speaker markers of the transcripts made from the conversations table.
STYLES = (("System: ", "User: ", "Assistant: "), ("Context: ", "Human: ", "AI: "), ("[system] ", "[user] ", "[assistant] "), ("System: ", "Q: ", "A: "))


def turns(conversations: DataFrame) -> DataFrame:
    """Turns of the conversations table: conv_id, part_no (``turn div TURNS_PER_PART``), key, turn, role, text. Rows that
    repeat count once; a row without a conversation or a turn is a conversation of its own; null texts are empty and null
    or unknown roles are users. ``key`` names a conversation."""
    c = conversations.select("conv_id", "turn", "role", "text").dropDuplicates()
    alone = F.when(F.col("conv_id").isNull() | F.col("turn").isNull(), F.xxhash64("turn", "role", "text")).otherwise(F.lit(0))
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), alone.cast("string"))
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("user")
    turn = F.coalesce("turn", F.lit(0))
    return c.select("conv_id", F.floor(turn / TURNS_PER_PART).alias("part_no"), key.alias("key"), turn.alias("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def surface(turn: DataFrame) -> Column:
    """A turn as transcript lines: a marker in the conversation's style, left out for one turn in five, and a blank line."""
    style, bare = F.pmod(F.xxhash64("conv_id", F.lit(1)), F.lit(len(STYLES))), F.pmod(F.xxhash64("conv_id", "turn", F.lit(2)), F.lit(5)) == 0
    marker = F.lit("")
    for i, own in enumerate(STYLES):
        for r, m in zip(ROLES, own, strict=True):
            marker = F.when((style == i) & (F.col("role") == r), m).otherwise(marker)
    return F.concat(F.lit("\n"), F.when(bare, "").otherwise(marker), "text")


def known_lines(turn: DataFrame) -> DataFrame:
    """Training lines: each turn's lines with their true states."""
    lines = turn.select(F.struct("key", "part_no").alias("part"), "turn", "role", F.posexplode(lines_of(surface(turn))).alias("no", "x"))
    state = F.lit(0)
    for i, (r, f) in enumerate(STATES):
        state = F.when((F.col("role") == r) & ((F.col("no") == 0) == bool(f)), i).otherwise(state)
    return lines.select("part", F.struct("turn", "role", "no").alias("at"), state.alias("state"), "x.*")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = turns(table(spark, sf_dir, "conversations"))
    model = train(known_lines(turn.filter(~held_out(F.col("conv_id")))))
    made = turn.withColumn("surface", surface(turn)).groupBy("key", "conv_id", "part_no").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "surface"))).alias("own"))
    scripts = made.select("key", "conv_id", "part_no", F.array_join(F.transform("own", lambda x: x["surface"]), "\n").alias("transcript"), F.array_join(F.transform("own", lambda x: x["role"]), ",").alias("true_roles"))
    base = turn.agg(F.min("part_no")).first()[0] or 0
    got = parse_parts(scripts.withColumn("p", F.col("part_no") - base), model)
    return got.select("conv_id", "part_no", held_out(F.col("conv_id")).alias("held_out"), F.size("chat.roles").alias("n_turns"), F.array_join("chat.roles", ",").alias("roles"), "true_roles", "chat.rendered")
