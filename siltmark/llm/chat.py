"""Chat formatting: a hidden Markov model recovers who speaks in a transcript, then turns are rendered in one form."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .langid import remainder

ROLES = ("system", "user", "assistant")
#: Names by which a speaker may be marked at the start of a line.
MARKS = {"system": "system|instructions?", "user": "user|human|question|q|me", "assistant": "assistant|ai|bot|model|answer|a"}
_FORM = r"(?i)^\s*[*#\[(<|]*\s*({})\s*[*\])|]*\s*[:>]\s*"
#: Line features: a bucket of the length, whether it ends as a question, whether it looks like code or a list.
FEATURES = 16


@dataclass(frozen=True)
class Model:
    """Logarithms: first[s], turn[r, s] when a new row begins, line[r, s] within a row, emit[s, feature], and what a marker adds."""

    first: np.ndarray
    turn: np.ndarray
    line: np.ndarray
    emit: np.ndarray
    agree: float
    differ: float


def marker(line: Column) -> Column:
    """Index in ROLES of the speaker that a line names, or -1."""
    out = F.lit(-1)
    for k, r in reversed(list(enumerate(ROLES))):
        out = F.when(line.rlike(_FORM.format(MARKS[r])), k).otherwise(out)
    return out.cast("int")


def feature(line: Column) -> Column:
    size = F.least(F.floor(F.log2(F.length(line) + 1) / 3), F.lit(3)).cast("int")
    return size * 4 + F.when(line.rlike(r"\?\s*$"), 1).when(line.rlike(r"^\s*(```|[-*+] |\d+[.)] )"), 2).when(F.trim(line) == "", 3).otherwise(0)


def known_role(role: Column) -> Column:
    """Index in ROLES of a role in any case, or -1."""
    out = F.lit(-1)
    for k, r in enumerate(ROLES):
        out = F.when(F.lower(role) == r, k).otherwise(out)
    return out.cast("int")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def transcript(turns: DataFrame, marked: Column | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, given, raw) of turns: given is the role that is known, or null. Where `marked` is true the role is taken away and written before the text, as in a plain log."""
    marked = F.lit(False) if marked is None else marked
    named = F.when(marked & F.col(role).isNotNull(), F.concat(F.initcap(role), F.lit(": "))).otherwise("")
    return turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.when(~marked, F.col(role)).alias("given"), F.concat(named, F.coalesce(text, F.lit(""))).alias("raw"))


def fit(turns: DataFrame, agree: float = 0.97, stay: float = 0.98, smooth: float = 1.0) -> Model:
    """Count who follows whom, who begins, and which lines each role writes, over all lines of all turns (conv_id, turn, role, text) with a known role. At most a few dozen counts reach the driver.

    Of several rows of one turn, the lowest role counts for who follows whom.
    """
    known = turns.select("conv_id", "turn", known_role(F.col("role")).alias("s"), lines_of(F.col("text")).alias("l")).filter("s >= 0")
    n = len(ROLES)
    emit, turn, first = np.full((n, FEATURES), smooth), np.full((n, n), smooth), np.full(n, smooth)
    each = known.select("s", F.explode("l").alias("line")).select("s", feature(F.col("line")).alias("f"))
    for s, f, k in each.groupBy("s", "f").count().collect():
        emit[s, f] += k
    one = known.filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min("s").alias("s"))
    after = one.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("s").alias("r"))
    for r, s, k in one.join(after, ["conv_id", "turn"]).groupBy("r", "s").count().collect():
        turn[r, s] += k
    for s, k in one.groupBy("conv_id").agg(F.min_by("s", "turn").alias("s")).groupBy("s").count().collect():
        first[s] += k
    line = np.full((n, n), (1 - stay) / (n - 1))
    np.fill_diagonal(line, stay)
    log = lambda x: np.log(x / x.sum(-1, keepdims=True))
    return Model(log(first), log(turn), np.log(line), log(emit), float(np.log(agree)), float(np.log((1 - agree) / (n - 1))))


def scores(m: Model, marks: np.ndarray, features: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """(lines, roles): log-likelihood of each line in each state; a line whose row has a known role (fixed, or -1) is in that state."""
    e = m.emit[:, features].T.copy()
    named = np.flatnonzero((marks >= 0) & (fixed < 0))
    e[named] += m.differ
    e[named, marks[named]] += m.agree - m.differ
    sure = np.flatnonzero(fixed >= 0)
    kept = e[sure, fixed[sure]]
    e[sure] = -np.inf
    e[sure, fixed[sure]] = kept
    return e


def steps_of(m: Model, starts: np.ndarray, marks: np.ndarray, features: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """(lines, states, states): log-probability of moving into each line's state and of the line; the last state is that before a conversation.

    A named speaker inside a row may be a new turn.
    """
    n = len(ROLES)
    out = np.full((len(marks), n + 1, n + 1), -np.inf)
    out[:, :n, :n] = np.where((starts | (marks >= 0))[:, None, None], m.turn, m.line)
    out[:, n, :n] = m.first
    out[:, :, :n] += scores(m, marks, features, fixed)[:, None, :]
    return out


def only(state: int) -> np.ndarray:
    """Scores that leave one state."""
    return np.where(np.arange(len(ROLES) + 1) == state, 0.0, -np.inf)


def through(step: np.ndarray) -> np.ndarray:
    """Best scores from each state before the first of these steps to each after the last."""
    out = step[0]
    for s in step[1:]:
        out = (out[:, :, None] + s[None]).max(1)
    return out


def viterbi(step: np.ndarray, begin: np.ndarray, end: int | None = None) -> np.ndarray:
    """Best states after each step, from scores of the state before the first; ties go to the lower state."""
    back, at = [], begin
    for s in step:
        both = at[:, None] + s
        back.append(both.argmax(0))
        at = both.max(0)
    state = int(at.argmax()) if end is None else end
    path = [state]
    for b in reversed(back[1:]):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


_LEAD = re.compile(_FORM.format("|".join(MARKS.values())))


def pieces_of(raw: str, marks: np.ndarray, roles: np.ndarray) -> list[tuple[int, str]]:
    """(role, text) of the turns in a row: one begins where the role changes or a marker names the speaker; those markers are taken off."""
    out: list[tuple[int, list[str]]] = []
    for k, line in enumerate(raw.split("\n")):
        named = marks[k] == roles[k]
        if not out or named or roles[k] != roles[k - 1]:
            out.append((int(roles[k]), []))
        out[-1][1].append(_LEAD.sub("", line) if named else line)
    return [(r, "\n".join(x)) for r, x in out]


def parse(lines: DataFrame, model: Model, rows_a_part: int = 512) -> DataFrame:
    """(conv_id, turn, piece, role, text): the turns of each row (conv_id, turn, given, raw). A row with a given role is one turn of that role; the roles of the others are recovered.

    A conversation is cut into parts by turn number. Each part first gives its best score between any two states at its ends; those small
    tables settle the states at all ends, and each part then finds its best path between its own. So a very long conversation is spread over tasks,
    and one row for each `rows_a_part` turns of it comes together. Rows without a turn number have no order among themselves and spread over many parts, before all others.
    """
    key = F.coalesce(F.col("conv_id").cast("string"), F.concat(F.lit("row "), F.xxhash64("turn", "raw").cast("string")))
    loose = -1 - F.pmod(F.xxhash64("raw", F.lit(31)), F.lit(1024))
    cut = lines_of(F.col("raw"))
    rows = checkpointed(
        lines.select(
            key.alias("key"), F.coalesce(F.floor(F.col("turn") / rows_a_part), loose).cast("long").alias("part"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "given", "raw",
            F.transform(cut, lambda x: F.when(F.col("given").isNull(), marker(x)).otherwise(-1)).alias("marks"), F.transform(cut, lambda x: feature(x).cast("int")).alias("features"), known_role(F.col("given")).alias("fixed"),
        )
    )

    def steps(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        t = t.sort_by([("turn", "ascending"), ("raw", "ascending")])
        sizes = np.diff(t.column("marks").combine_chunks().offsets.to_numpy())
        marks, feats = (np.concatenate(t.column(c).combine_chunks().to_numpy(zero_copy_only=False)).astype(int) for c in ("marks", "features"))
        starts = np.zeros(len(marks), bool)
        starts[np.cumsum(sizes) - sizes] = True
        return t, sizes, marks, steps_of(model, starts, marks, feats, np.repeat(t.column("fixed").to_numpy(), sizes))

    ends = pa.schema([("key", pa.string()), ("part", pa.int64()), ("best", pa.list_(pa.float64()))])

    def summary(t: pa.Table) -> pa.Table:
        return pa.table([t.column("key").slice(0, 1), t.column("part").slice(0, 1), pa.array([through(steps(t)[3]).ravel()], pa.list_(pa.float64()))], schema=ends)

    chosen = pa.schema([("key", pa.string()), ("part", pa.int64()), ("before", pa.int32()), ("after", pa.int32())])

    def settle(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        n = len(ROLES) + 1
        path = viterbi(np.array(t.column("best").to_pylist()).reshape(-1, n, n), only(n - 1))
        before = np.concatenate([[n - 1], path[:-1]])
        return pa.table([t.column("key"), t.column("part"), pa.array(before.astype(np.int32)), pa.array(path.astype(np.int32))], schema=chosen)

    found = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("piece", pa.int32()), ("role", pa.string()), ("text", pa.string())])

    def decide(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return found.empty_table()
        t, sizes, marks, step = steps(left)
        path = viterbi(step, only(right.column("before")[0].as_py()), right.column("after")[0].as_py())
        stop = np.cumsum(sizes)
        out: list[tuple] = []
        for conv, turn, given, raw, a, b in zip(*(t.column(c).to_pylist() for c in ("conv_id", "turn", "given", "raw")), (stop - sizes).tolist(), stop.tolist(), strict=True):
            if given is None:
                out.extend((conv, turn, k, ROLES[r], x) for k, (r, x) in enumerate(pieces_of(raw, marks[a:b], path[a:b])))
            else:
                out.append((conv, turn, 0, given.lower() if given.lower() in ROLES else given, raw))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), found, strict=True)], schema=found)

    settled = rows.groupBy("key", "part").applyInArrow(summary, "key string, part long, best array<double>").groupBy("key").applyInArrow(settle, "key string, part long, before int, after int")
    return rows.groupBy("key", "part").cogroup(settled.groupBy("key", "part")).applyInArrow(decide, "conv_id long, turn long, piece int, role string, text string")


def render(parsed: DataFrame, opening: str = "<|{}|>\n", closing: str = "<|end|>\n") -> DataFrame:
    """The recovered turns, each with its canonical form."""
    head, tail = opening.split("{}")
    return parsed.withColumn("rendered", F.concat(F.lit(head), "role", F.lit(tail), "text", F.lit("\n" + closing)))


def format_chats(turns: DataFrame) -> DataFrame:
    """Each turn (conv_id, turn, role, text) in canonical form; roles that are missing are recovered from speaker marks and the lines' features.

    A role other than system, user or assistant is kept as it is; a row with a role stays one turn. A null text is empty; a row without a conversation is one of its own, equal ones following one another; a row
    without a turn comes before the others; repeated rows are each kept; an empty table gives no rows; other columns are dropped.
    """
    return render(parse(transcript(turns), fit(turns)))


def recovered_chats(turns: DataFrame) -> DataFrame:
    """format_chats() of a table whose roles are known, for measuring: of conversations with crc32(conv_id) mod 5 = 0 the roles are hidden, of those with 1 they are only marks in the text;
    the model is fitted on the others. hidden and marked say which they are."""
    rest = remainder(F.col("conv_id"), 5)
    hidden, marked = F.coalesce(rest == 0, F.lit(False)), F.coalesce(rest == 1, F.lit(False))
    model = fit(turns.filter(~(hidden | marked)))
    out = render(parse(transcript(turns.withColumn("role", F.when(~hidden, F.col("role"))), marked), model))
    return out.withColumn("hidden", hidden).withColumn("marked", marked)
