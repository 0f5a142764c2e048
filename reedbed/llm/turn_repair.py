"""Repair of conversations: the cheapest edits after which the turns read ``(s?(ua)+)?`` by role initials.

A turn is blank, a duplicate, truncated or sound; with its role initial that makes nine symbols. A symbol is a min-plus
matrix over the four states of the pattern (nothing yet, after the system turn, after a user, after an assistant). Equal
consecutive symbols are one run; a run is advanced through cached binary powers of its matrix, and the cheapest way is
then unrolled row by row into an audit of edit initials.

Rows that agree in conversation, turn, role and text are one row with a count from the start. Rows are dealt out by range,
so a conversation of any size lies in parts of bounded size; a part is one matrix to the others, and only the order of
edits and the digest of the result are put together for each conversation, as a stream.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache, reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import written
from .tables import table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NEVER = 1 << 50
#: State after a user's or assistant's turn in each state, and whose turn that is.
NEXT, TURN = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: State after a kept turn by (state, role initial).
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Least cost from each state to the end of a conversation: a pattern may end at once or after an assistant's turn.
END = (0, 2 * INSERT, INSERT, 0)
#: A row that must go.
GONE = ("", True)
FILLED = re.compile(r"[^\x20\x09-\x0D]")
COUNTS = ("blank", "duplicate", "truncated", "illegal")
PIECE = "conv {0}, part int, blank long, duplicate long, truncated long, illegal long, cost long, first string, last string, audit string, turns array<struct<role:string,text:string>>"


def fault_of(text: str, new: bool) -> str:
    """The first fault of a row: blank, duplicate, truncated or none."""
    tail = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
    return "blank" if not tail else "duplicate" if not new else "" if tail[-1] in ".!?" else "truncated"


def symbol_of(role: str, fault: str) -> tuple[str, bool]:
    return GONE if fault in ("blank", "duplicate") else (role[:1], fault == "truncated")


def _edits(symbol: tuple[str, bool], after: tuple[int, ...], state: int) -> list[tuple[int, str, int]]:
    """(cost to the end, edit, next state) of the edits of a row, without inserts before it."""
    out = [(DELETE + after[state], "D", state)]
    if symbol != GONE:
        extra = TRUNCATED * symbol[1]
        if (to := KEPT.get((state, symbol[0]))) is not None:
            out.append((KEEP + extra + after[to], "K", to))
        out.append((REROLE + extra + after[NEXT[state]], "R", NEXT[state]))
    return out


@lru_cache(maxsize=100_000)
def row(symbol: tuple[str, bool], after: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """Least cost before a row of this symbol by state, given the least costs after it; and for each state the
    ASCII-least edits that reach it, inserts before the row included, with the state after."""
    each = [_edits(symbol, after, q) for q in range(4)]
    least = [min(e)[0] for e in each]
    for _ in range(3):
        least = [min(c, INSERT + least[NEXT[q]]) for q, c in enumerate(least)]
    chosen = []
    for q in range(4):
        piece, at = "", q
        while True:
            fit = {edit: to for cost, edit, to in each[at] if cost == least[at]}
            if INSERT + least[NEXT[at]] == least[at]:
                fit["I"] = NEXT[at]
            edit = min(fit)
            piece, at = piece + edit, fit[edit]
            if edit != "I":
                break
        chosen.append((piece, at))
    return tuple(least), tuple(chosen)


def chained(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), NEVER)


@lru_cache(maxsize=4096)
def power(symbol: tuple[str, bool], bit: int) -> np.ndarray:
    """The transition of 2 ** bit rows of a symbol: [state before, state after] -> least cost."""
    if bit:
        half = power(symbol, bit - 1)
        return chained(half, half)
    units = [tuple(0 if q == to else NEVER for q in range(4)) for to in range(4)]
    return np.minimum(np.array([row(symbol, u)[0] for u in units], dtype=np.int64).T, NEVER)


def advanced(symbol: tuple[str, bool], n: int, after: np.ndarray) -> np.ndarray:
    """Least costs before ``n`` rows of a symbol, by the powers of the binary digits of ``n``."""
    for bit in range(n.bit_length()):
        if n >> bit & 1:
            after = (power(symbol, bit) + after[None, :]).min(1)
    return after


def collapsed(symbols: list[tuple[tuple[str, bool], int]]) -> list[tuple[tuple[str, bool], int]]:
    """Runs (symbol, length) of symbols that come with counts."""
    return [(s, sum(n for _, n in own)) for s, own in groupby(symbols, key=lambda x: x[0])]


def transition(runs) -> np.ndarray:
    """Min-plus matrix of a part."""
    out = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for symbol, n in runs:
        for bit in range(n.bit_length()):
            if n >> bit & 1:
                out = chained(out, power(symbol, bit))
    return out


def choices(runs, after: np.ndarray):
    """For each row in order, the edits and next state by state. Run ends are reached by powers, rows by steps until they
    no longer change."""
    ends = [np.asarray(after)]
    for symbol, n in reversed(runs[1:]):
        ends.append(advanced(symbol, n, ends[-1]))
    for (symbol, n), end in zip(runs, reversed(ends), strict=True):
        low = int(end.min())
        now, stack = tuple(int(c) - low for c in end), []
        while len(stack) < n:
            cost, chosen = row(symbol, now)
            before = tuple(c - min(cost) for c in cost)
            stack += [chosen] * (n - len(stack) if before == now else 1)
            now = before
        yield from reversed(stack)


def unrolled(runs, after: np.ndarray, state: int) -> tuple[str, int]:
    """The audit of a part that is entered in ``state``, and the state after it."""
    pieces = []
    for chosen in choices(runs, after):
        piece, state = chosen[state]
        pieces.append(piece)
    return "".join(pieces), state


def finish(state: int) -> str:
    """Edits after the last row."""
    return "I" * (END[state] // INSERT)


def cost_of(audit: str, kept_truncated: int) -> int:
    return REROLE * audit.count("R") + DELETE * audit.count("D") + INSERT * audit.count("I") + TRUNCATED * kept_truncated


class Part:
    """Some rows of a conversation in order: (role, text, copies, new). Further copies of a row are duplicates."""

    def __init__(self, rows: list[tuple[str, str, int, bool]]):
        self.rows, self.faults, symbols = rows, [], []
        self.counts = dict.fromkeys(COUNTS, 0)
        last = None
        for role, text, n, new in rows:
            fault, again = fault_of(text, new), fault_of(text, False)
            self.faults.append(fault)
            symbols += [(symbol_of(role, fault), 1)] + ([(GONE, n - 1)] if n > 1 else [])
            for f, k in ((fault, 1), (again, n - 1)):
                if f:
                    self.counts[f] += k
            self.counts["illegal"] += (last is not None and illegal(last, role)) + (n - 1) * illegal(role, role)
            last = role
        self.runs = collapsed(symbols)

    def repaired(self, after: np.ndarray, state: int, last: bool) -> tuple[str, int, list[tuple[str, str]]]:
        """Audit, cost and turns after the edits."""
        chosen, pieces, turns, truncated = choices(self.runs, after), [], [], 0
        for (role, text, n, _), fault in zip(self.rows, self.faults, strict=True):
            for _ in range(n):
                piece, to = next(chosen)[state]
                for edit in piece:
                    if edit == "K":
                        turns.append((role, text))
                    elif edit in "RI":
                        turns.append((TURN[state], text if edit == "R" else ""))
                    truncated += fault == "truncated" and edit in "KR"
                    state = KEPT[state, role[:1]] if edit == "K" else NEXT[state] if edit in "RI" else state
                pieces.append(piece)
        if last:
            for edit in finish(state):
                turns.append((TURN[state], ""))
                state = NEXT[state]
                pieces.append(edit)
        audit = "".join(pieces)
        return audit, cost_of(audit, truncated), turns


def illegal(before: str, role: str) -> bool:
    return before[:1] + role[:1] not in ("su", "ua", "au")


def in_turn(batches, keys: list[str]):
    """Consecutive rows of equal ``keys`` from sorted batches, as (key, rows as dicts)."""
    rows = (r for b in batches for at in range(0, b.num_rows, 1024) for r in b.slice(at, 1024).to_pylist())
    for key, own in groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
        yield key, list(own)


def _some(made, schema: pa.Schema, size: int = 512):
    """Dicts as record batches."""
    own = []
    for x in made:
        own.append(x)
        if len(own) == size:
            yield pa.RecordBatch.from_pylist(own, schema=schema)
            own = []
    if own:
        yield pa.RecordBatch.from_pylist(own, schema=schema)


def _part(rows: list[dict]) -> Part:
    return Part([(r["role"], r["text"], r["n"], r["new"]) for r in rows])


def _mapped(df: DataFrame, make, schema: str) -> DataFrame:
    """``make(batches)`` gives dicts of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    return df.mapInArrow(lambda batches: _some(make(batches), arrow), schema)


def parts_of(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text, n) with equal rows as one (n is the sum), ``new`` (no equal role and text came
    earlier in the conversation) and ``part``: parts follow each other in the order (turn, nulls first; role; text) and
    hold a bounded share of all rows. Null roles and texts are one space."""
    filled = rows.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "n")
    own = filled.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    first = own.groupBy("conv", "role", "text").agg(F.min(place).alias("f")).select(F.col("conv").alias("f_conv"), F.col("role").alias("f_role"), F.col("text").alias("f_text"), F.col("f.turn").alias("f_turn"))
    same = F.col("conv").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("text") == F.col("f_text"))
    marked = own.join(first, same).select("conv", "turn", "role", "text", "n", F.col("turn").eqNullSafe(F.col("f_turn")).alias("new"))
    return written(marked.repartitionByRange("conv", "turn", "role", "text").withColumn("part", F.spark_partition_id()))


def _ordered(df: DataFrame) -> DataFrame:
    return df.repartition("conv", "part").sortWithinPartitions("conv", "part", "turn", "role", "text")


def entries(parts: DataFrame) -> DataFrame:
    """(conv, part, state, after) of the parts of conversations that lie in several: the state in which the part is entered
    and the least costs to the end after it."""
    kind = parts.schema["conv"].dataType.simpleString()
    several = parts.select("conv", "part").distinct().groupBy("conv").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.col("conv").alias("s_conv"))
    split = written(parts.join(several, F.col("conv").eqNullSafe(F.col("s_conv")), "left_semi"))

    def matrices(batches):
        for (conv, part), rows in in_turn(batches, ["conv", "part"]):
            yield {"conv": conv, "part": part, "m": transition(_part(rows).runs).ravel().tolist()}

    def backward(batches):
        for (conv,), rows in in_turn(batches, ["conv"]):
            after = np.array(END)
            for r in reversed(rows):
                yield {"conv": conv, "part": r["part"], "after": after.tolist()}
                after = (np.array(r["m"]).reshape(4, 4) + after[None, :]).min(1)

    def exits(batches):
        for (conv, part), rows in in_turn(batches, ["conv", "part"]):
            runs, after = _part(rows).runs, rows[0]["after"]
            yield {"conv": conv, "part": part, "after": after, "exits": [unrolled(runs, np.array(after), q)[1] for q in range(4)]}

    def forward(batches):
        for (conv,), rows in in_turn(batches, ["conv"]):
            state = 0
            for r in rows:
                yield {"conv": conv, "part": r["part"], "state": state, "after": r["after"]}
                state = r["exits"][state]

    one = lambda df: df.repartition("conv").sortWithinPartitions("conv", "part")
    made = _mapped(_ordered(split), matrices, f"conv {kind}, part int, m array<long>")
    after = _mapped(one(made), backward, f"conv {kind}, part int, after array<long>")
    left = _mapped(_ordered(_with(split, after)), exits, f"conv {kind}, part int, after array<long>, exits array<int>")
    return _mapped(one(left), forward, f"conv {kind}, part int, state int, after array<long>")


def _with(parts: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    named = found.withColumnsRenamed({"conv": "x_conv", "part": "x_part"})
    return parts.join(named, F.col("conv").eqNullSafe(F.col("x_conv")) & (F.col("part") == F.col("x_part")), how).drop("x_conv", "x_part")


def repaired(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", n: str | None = None) -> DataFrame:
    """The parts of each conversation after the cheapest repair, in pieces (conv, part, counts of faults, illegal neighbours
    within the part, cost, first and last role, audit, turns): the pieces of a conversation by ``part`` are its repair.

    Rows are taken by turn (nulls first), then role, then text; ``n`` names a column of copies. A null role or text is one
    space. Rows without a conversation are a conversation. A row's first fault counts: blank, duplicate (role and text came
    earlier), truncated (last character not ``.!?``). Of equally cheap repairs the one of ASCII-least audit is taken. A
    conversation without rows gives no piece; other columns are left out.
    """
    c = conversations
    rows = c.select(c[conv].alias("conv"), c[turn].alias("turn"), c[role].alias("role"), c[text].alias("text"), (c[n] if n else F.lit(1)).cast("long").alias("n"))
    parts = parts_of(rows)
    kind = parts.schema["conv"].dataType.simpleString()
    ends = parts.groupBy("conv").agg(F.max("part").alias("part")).withColumn("last", F.lit(True))
    placed = _with(_with(parts, entries(parts), "left"), ends, "left")

    def pieces(batches):
        for (conv_, part), own in in_turn(batches, ["conv", "part"]):
            p, x = _part(own), own[0]
            audit, cost, turns = p.repaired(np.array(x["after"] or END), x["state"] or 0, bool(x["last"]))
            yield {"conv": conv_, "part": part, **p.counts, "cost": cost, "first": own[0]["role"], "last": own[-1]["role"], "audit": audit, "turns": [{"role": r, "text": t} for r, t in turns]}

    return _mapped(_ordered(placed), pieces, PIECE.format(kind))


def summed(pieces: DataFrame) -> DataFrame:
    """One row for each conversation of ``pieces``: conv, sums of the counts, cost, audit, repaired_sha256 (of ``role:text``
    joined by line feeds). Pieces stream through, so the texts of a conversation are never held together."""
    kind = pieces.schema["conv"].dataType.simpleString()

    def sums(batches):
        rows = (r for b in batches for at in range(0, b.num_rows, 64) for r in b.slice(at, 64).to_pylist())
        for conv, own in groupby(rows, key=lambda r: r["conv"]):
            total, audits, digest, joint, before = dict.fromkeys((*COUNTS, "cost"), 0), [], hashlib.sha256(), b"", None
            for r in own:
                for k in total:
                    total[k] += r[k]
                total["illegal"] += before is not None and illegal(before, r["first"])
                before = r["last"]
                audits.append(r["audit"])
                for t in r["turns"]:
                    digest.update(joint + f"{t['role']}:{t['text']}".encode("utf-8", "surrogatepass"))
                    joint = b"\n"
            yield {"conv": conv, **total, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}

    schema = f"conv {kind}, {', '.join(f'{k} long' for k in (*COUNTS, 'cost'))}, audit string, repaired_sha256 string"
    return _mapped(pieces.repartition("conv").sortWithinPartitions("conv", "part"), sums, schema)


def gaps_of(rows: DataFrame) -> DataFrame:
    """(conv, gaps): turns missing between the first and the last one of each conversation; nulls are ignored."""
    turns = rows.select("conv", "turn").distinct()
    return turns.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, n) of the conversations table with the faults that a checksum of conversation and turn plants."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(word("text"), r"[.!?]", "")).otherwise(word("text"))
    role = F.when(kind == 4, "user").otherwise(word("role"))
    return conversations.select(F.col("conv_id").alias("conv"), "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("n"), kind.alias("kind")).filter("kind <> 0").drop("kind")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    rows = damaged(given)
    found = summed(repaired(rows, "conv", n="n"))
    every = given.select("conv_id").distinct()
    for side in (found, gaps_of(rows)):
        every = every.join(side.withColumnRenamed("conv", "own"), F.col("conv_id").eqNullSafe(F.col("own")), "left").drop("own")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", *COUNTS, "cost")]
    return every.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: CRC-32 in SQL: eight steps of the polynomial for each byte of ``conv_id:turn``.
_CRC32 = """(select xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(length(w)), lambda i: cast(ascii(w[i + 1]) as bigint))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)), 4294967295)
  from (select coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as w))"""


def _least(*options: str) -> str:
    return f"list_sort([x for x in [{', '.join(options)}] if x is not null])[1]"


def _way(at: str, cost: str, edit: str, line: str) -> str:
    """SQL of the way ``at`` (costs and audit as text, repaired text) with one more edit."""
    return f"""case when ({at}) is not null then {{'k': lpad(cast(cast(({at}).k[1:9] as bigint) + {cost} as varchar), 9, '0') || ({at}).k[10:] || '{edit}', 't': ({at}).t || {line}}} end"""


def _inserted(q: list[str]) -> list[str]:
    """The best ways after inserts. The state after a user is reached from those before it, and so on."""
    user, bot = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    two = _least(q[2], _way(q[0], "3", "I", user), _way(q[1], "3", "I", user), _way(q[3], "3", "I", user))
    three = _least(q[3], _way(q[2], "3", "I", bot), _way(_way(q[0], "3", "I", user), "3", "I", bot), _way(_way(q[1], "3", "I", user), "3", "I", bot))
    return [q[0], q[1], two, three]


def _sql() -> str:
    delete, keep, rerole = (lambda q: _way(q, "4", "D", "''")), (lambda q, r: f"case when sym and ini = '{r}' then {_way(q, 'extra', 'K', kept)} end"), (lambda q, line: f"case when sym then {_way(q, '3 + extra', 'R', line)} end")
    kept, user, bot = "chr(10) || role || ':' || text", "chr(10) || 'user:' || text", "chr(10) || 'assistant:' || text"
    before = ["i0", "i1", "i2", "i3"]
    after = [
        delete("i0"), _least(delete("i1"), keep("i0", "s")),
        _least(delete("i2"), *[keep(q, "u") for q in ("i0", "i1", "i3")], *[rerole(q, user) for q in ("i0", "i1", "i3")]), _least(delete("i3"), keep("i2", "a"), rerole("i2", bot)),
    ]
    q = ["q0", "q1", "q2", "q3"]
    opened = ", ".join(f"{x} as {n}" for x, n in zip(_inserted(q), before, strict=True))
    stepped = ", ".join(f"{x} as {n}" for x, n in zip(after, q, strict=True))
    return f"""
with recursive given as (
  select conv_id, turn, coalesce(role, ' ') as role0, coalesce(text, ' ') as text0,
    (crc32_of % 20) as kind
  from (select *, {_CRC32} as crc32_of from conversations)
), hurt as (
  select conv_id, turn, case when kind = 4 then 'user' else role0 end as role,
    case when kind = 1 then '' when kind = 2 then regexp_replace(text0, '[.!?]', '', 'g') else text0 end as text, kind
  from given where kind <> 0
), rows_ as (
  select conv_id, turn, role, text from hurt union all select conv_id, turn, role, text from hurt where kind = 3
), numbered as (
  select *, row_number() over (partition by conv_id, role, text order by i) as again, lag(role) over (partition by conv_id order by i) as before_role
  from (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from rows_)
), faulty as (
  select *, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank' when again > 1 then 'duplicate'
      when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') then 'truncated' else '' end as fault,
    case when before_role is not null and left(before_role, 1) || left(role, 1) not in ('su', 'ua', 'au') then 1 else 0 end as bad
  from numbered
), symbols as (
  select conv_id, i, role, text, left(role, 1) as ini, fault in ('', 'truncated') as sym, case when fault = 'truncated' then 3 else 0 end as extra from faulty
), ways as (
  select conv_id, cast(0 as bigint) as i, {{'k': '000000000', 't': ''}} as q0, cast(null as struct(k varchar, t varchar)) as q1,
    cast(null as struct(k varchar, t varchar)) as q2, cast(null as struct(k varchar, t varchar)) as q3
  from (select distinct conv_id from faulty)
  union all
  select conv_id, i, {stepped} from (
    select o.conv_id, s.i, s.role, s.text, s.ini, s.sym, s.extra, o.i0, o.i1, o.i2, o.i3
    from (select conv_id, i, {opened} from ways) o join symbols s on s.conv_id is not distinct from o.conv_id and s.i = o.i + 1)
), last_ as (
  select conv_id, max(i) as i from numbered group by conv_id
), ended as (
  select conv_id, {_least('i0', 'i3')} as best
  from (select w.conv_id, {opened} from ways w join last_ l on w.conv_id is not distinct from l.conv_id and w.i = l.i)
), counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, sum(cast(fault = 'blank' as bigint)) as blank,
    sum(cast(fault = 'duplicate' as bigint)) as duplicate, sum(cast(fault = 'truncated' as bigint)) as truncated, sum(bad) as illegal
  from faulty group by conv_id
)
select c.conv_id, cast(coalesce(n.gaps, 0) as bigint) as gaps, cast(coalesce(n.blank, 0) as bigint) as blank, cast(coalesce(n.duplicate, 0) as bigint) as duplicate,
  cast(coalesce(n.truncated, 0) as bigint) as truncated, cast(coalesce(n.illegal, 0) as bigint) as illegal,
  cast(coalesce(e.best.k[1:9], '0') as bigint) as cost, coalesce(e.best.k[10:], '') as audit, sha256(coalesce(e.best.t[2:], '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join counted n on c.conv_id is not distinct from n.conv_id
left join ended e on c.conv_id is not distinct from e.conv_id
"""


OP13_SQL = _sql()
