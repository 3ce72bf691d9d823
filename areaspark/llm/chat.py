"""Chat formatting: speakers of raw transcripts by a hidden Markov model, then canonical turns.

A transcript is a set of rows with one id, in the order of a column; a row holds one or more
lines. States are a role's first line and its further lines. A line is seen through its speaker
marker ("User:", "Assistant:" ...), its length, how it begins and ends, and whether a blank line or a row's
start precedes it. Transitions and features are counted on labelled rows of a bounded number of
transcripts; the most probable states follow by Viterbi. Each row is rendered with a header
before every turn that starts in it, markers and blank lines removed; rendered rows of a
transcript, in order, are its canonical text.

Rows are dealt out by ranges of (id, order, text), so that a transcript of any length is spread over
tasks. Whole transcripts of a task are decoded at once. Of the first and the last, which may
go on elsewhere, a table of best scores between entry and exit states is kept; these tables, two
for each task, are chained to fix the states at the cuts, and the pieces are then decoded.

Cases: a null or empty text has no lines, keeps its row, role null and empty rendering; rows
of a null id are one transcript; rows with equal order go by their text, equal rows stay
side by side; without labelled rows the roles are user and assistant in turns; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaspark.llm import common
from areaspark.session import keep as keep_table

#: At most about so many transcripts are learned from, and of these at most so many rows.
TRANSCRIPTS, ROWS = 4_000, 40_000
#: Words before a colon or angle bracket that mark a speaker.
MARKERS = {
    "system": ["system", "context", "instructions"],
    "user": ["user", "human", "q", "question", "customer", "me"],
    "assistant": ["assistant", "ai", "bot", "a", "answer", "model"],
}
_SAYS = {word: role for role, words in MARKERS.items() for word in words}
_MARK = re.compile(r"^\s*(?:<\|)?[*\[(]*(" + "|".join(sorted(_SAYS, key=len, reverse=True)) + r")[*\])]*(?:\|>)?\s*[:>]\s*", re.I)
#: Numbers of values of the features of a line besides its marker: length, start, end, after a blank.
SIZES = (14, 5, 5, 2)
#: Weight of the belief that a speaker's marker stands before that speaker's first line.
BELIEF = 200.0


def lines_of(text: str | None) -> list[tuple[str, bool, str]]:
    """Role of the marker or empty, whether a blank or the row's start precedes, and the line without its marker."""
    out: list[tuple[str, bool, str]] = []
    blank = True
    for line in (text or "").splitlines():
        if not line.strip():
            blank = True
            continue
        mark = _MARK.match(line)
        out.append((_SAYS[mark[1].lower()] if mark else "", blank, line[mark.end() :] if mark else line))
        blank = False
    return out


def features(line: str, blank: bool) -> tuple[int, int, int, int]:
    said = line.strip()
    first, last = said[:1], said[-1:]
    start = 0 if first.isupper() else 1 if first.islower() else 2 if first.isdigit() else 3 if first and first in "-*•>#`" else 4
    end = {".": 0, "?": 1, ":": 2, "!": 3}.get(last, 4)
    return min(len(said).bit_length(), SIZES[0] - 1), start, end, int(blank)


class Model:
    """Log scores: of the first state, between states, of markers and of features."""

    def __init__(self, roles: list[str], turns: list[list[tuple[str, str]]]):
        """``turns``: of each transcript, role and text in order."""
        self.roles = roles
        n = 2 * len(roles)
        first, step = np.full(n, 0.5), np.full((n, n), 0.1)
        seen = [np.full((n, size), 0.5) for size in SIZES]
        marks = ["", *MARKERS]
        mark = np.full((n, len(marks)), 0.5)
        first[1::2] = 1e-6  # no transcript starts inside a turn
        for k, role in enumerate(roles):
            step[np.arange(n)[None, :] % 2 * np.ones((n, 1)) == 1] = 0  # a further line follows its own role only
            mark[2 * k, 0] += BELIEF
            mark[2 * k + 1, 0] += 20 * BELIEF
            if role in MARKERS:
                mark[2 * k, marks.index(role)] += BELIEF
        for k in range(len(roles)):
            step[2 * k : 2 * k + 2, 2 * k + 1] = 0.1
            if not turns:
                step[2 * k : 2 * k + 2, [2 * j for j in range(len(roles)) if j != k]] = 1
        for transcript in turns:
            before = -1
            for role, text in transcript:
                for i, (said, blank, line) in enumerate(lines_of(text)):
                    state = 2 * roles.index(role) + (i > 0)
                    if before < 0:
                        first[state] += 1
                    else:
                        step[before, state] += 1
                    before = state
                    mark[state, marks.index(said)] += 1
                    for table, value in zip(seen, features(line, blank)):
                        table[state, value] += 1
        share = lambda x: np.log(np.maximum(x / x.sum(-1, keepdims=True), 1e-12))
        self.first, self.step, self.mark = share(first), share(step), dict(zip(marks, share(mark).T))
        self.seen = [share(t) for t in seen]

    def emission(self, line: tuple[str, bool, str]) -> np.ndarray:
        said, blank, text = line
        return self.mark[said] + sum(t[:, v] for t, v in zip(self.seen, features(text, blank)))

    def spans(self, lines: list, before: np.ndarray | None = None) -> np.ndarray:
        """Best scores from each entry state (the last row: from the transcript's start) to each exit state.

        ``before`` is such a table of the lines in front; no lines give no table.
        """
        table = before
        for line in lines:
            e = self.emission(line)
            if table is None:
                table = np.vstack((self.step, self.first)) + e
            else:
                table = (table[:, :, None] + self.step[None]).max(1) + e
        return table

    def states(self, lines: list, entry: int = -1, exit: int = -1) -> list[int]:
        """The most probable states, after state ``entry`` (-1: at the start) and ending in ``exit`` (-1: in any)."""
        if not lines:
            return []
        score = (self.first if entry < 0 else self.step[entry]) + self.emission(lines[0])
        back = []
        for line in lines[1:]:
            both = score[:, None] + self.step
            back.append(both.argmax(0))
            score = both.max(0) + self.emission(line)
        path = [int(score.argmax()) if exit < 0 else exit]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def render(self, lines: list, states: list[int]) -> str:
        out = []
        for (_, _, line), state in zip(lines, states):
            if state % 2 == 0:
                out.append(f"<|{self.roles[state // 2]}|>")
            out.append(line.strip())
        return "\n".join(out)


def fit(df: DataFrame, id: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> Model:
    """A model from labelled rows of a bounded number of transcripts, chosen by a hash of their ids."""
    common.needs(df, [id, order, role, text])
    df = df.where(df[role].isNotNull()).select(df[id].cast("string").alias("c"), df[order].alias("o"), df[role].alias("r"), df[text].alias("t"))
    n = df.agg(F.approx_count_distinct("c")).first()[0]
    share = min(1_000_000, 1_000_000 * TRANSCRIPTS // max(n, 1) + 1)
    chosen = df.where(F.pmod(F.xxhash64("c"), F.lit(1_000_000)) < share)
    rows = chosen.orderBy(F.xxhash64("c"), "c", "o", "t").limit(ROWS).collect()
    turns: dict[str, list[tuple[str, str]]] = {}
    for r in rows:
        turns.setdefault(r["c"], []).append((r["r"], r["t"]))
    roles = sorted({r["r"] for r in rows}) or ["assistant", "user"]
    return Model(roles, list(turns.values()))


def parse(df: DataFrame, model: Model, id: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """Of every row: id, order, ``role`` of its first line, ``n_turns`` that start in it, ``rendered``."""
    common.needs(df, [id, order, text])
    kinds = {c: df.schema[c].dataType.simpleString() for c in (id, order)}
    rows = df.select(df[id].alias("c"), df[order].alias("o"), df[text].alias("t"))
    rows = rows.repartitionByRange("c", "o", "t").sortWithinPartitions("c", "o", "t")
    schema = f"c {kinds[id]}, o {kinds[order]}, t string, role string, n_turns int, part int, at long, cut binary"
    names = ["c", "o", "t", "role", "n_turns", "part", "at", "cut"]
    fields = pa.schema([("role", pa.string()), ("n_turns", pa.int32()), ("part", pa.int32()), ("at", pa.int64()), ("cut", pa.binary())])

    def told(lines: list, states: list[int]) -> tuple[str, str | None, int]:
        return model.render(lines, states), model.roles[states[0] // 2] if states else None, sum(s % 2 == 0 for s in states)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        types: pa.Schema | None = None

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            cols = [pa.array([f[k] for f in found], types.field(k).type) for k in range(3)]
            cols += [pa.array([f[k + 3] for f in found], fields.field(k).type) for k in range(5)]
            return pa.RecordBatch.from_arrays(cols, names=names)

        def opened(table: np.ndarray | None, c: object, last: tuple) -> tuple:
            return (c, last[1], None, None, None, part, -1, b"" if table is None else table.tobytes())

        def whole(held: list[tuple]) -> list[tuple]:
            seen = [lines_of(r[2]) for r in held]
            states = model.states([x for lines in seen for x in lines])
            out = []
            for r, lines in zip(held, seen):
                mine, states = states[: len(lines)], states[len(lines) :]
                out.append((r[0], r[1], *told(lines, mine), None, None, None))
            return out

        first: object = None
        table: np.ndarray | None = None
        held: list[tuple] = []
        in_first, last = True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            types = types or batch.schema
            out = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if last is None:
                    first = row[0]
                if in_first and row[0] != first:
                    out.append(opened(table, first, last))
                    in_first = False
                if in_first:
                    table = model.spans(lines_of(row[2]), table)
                    out.append((*row, None, None, part, at, None))
                    at += 1
                else:
                    if held and held[-1][0] != row[0]:
                        out += whole(held)
                        held = []
                    held.append(row)
                last = row
            if out:
                yield batch_of(out)
        if last is not None:
            out = []
            if in_first:
                out.append(opened(table, first, last))
            else:
                for n, r in enumerate(held):
                    out.append((*r, None, None, part, at + n, None))
                out.append(opened(model.spans([x for r in held for x in lines_of(r[2])]), last[0], last))
            yield batch_of(out)

    done = keep_table(rows.mapInArrow(task, schema), "chat")

    def chain(cuts: pd.DataFrame) -> pd.DataFrame:
        cuts = cuts.sort_values("part")
        n = len(model.first)
        tables = [np.frombuffer(x).reshape(n + 1, n) if x else None for x in cuts["cut"]]
        held = [t for t in tables if t is not None]
        scores, back = [], []
        for k, t in enumerate(held):
            if k == 0:
                scores.append(t[n])
            else:
                both = scores[-1][:, None] + t[:n]
                back.append(both.argmax(0))
                scores.append(both.max(0))
        path = [int(scores[-1].argmax())] if held else []
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        ends = iter(path[::-1])
        entries, exits, now = [], [], -1
        for t in tables:
            entries.append(now)
            now = now if t is None else next(ends)
            exits.append(now if t is not None else -1)
        return pd.DataFrame({"c": cuts["c"], "part": cuts["part"], "entry": entries, "exit": exits})

    cuts = done.where(F.col("cut").isNotNull()).select("c", "part", "cut")
    bounds = cuts.groupBy("c").applyInPandas(chain, f"c {kinds[id]}, part int, entry int, exit int")
    open_rows = done.where("at >= 0").select("c", "o", "t", "part", "at").alias("r").join(
        bounds.alias("b"), (F.col("r.part") == F.col("b.part")) & F.col("r.c").eqNullSafe(F.col("b.c"))
    ).select("r.c", "r.o", "r.t", "r.part", "r.at", "entry", "exit")

    def rest(piece: pd.DataFrame) -> pd.DataFrame:
        piece = piece.sort_values("at")
        seen = [lines_of(t) for t in piece["t"]]
        states = model.states([x for lines in seen for x in lines], int(piece["entry"].iloc[0]), int(piece["exit"].iloc[0]))
        found = []
        for lines in seen:
            mine, states = states[: len(lines)], states[len(lines) :]
            found.append(told(lines, mine))
        return pd.DataFrame({
            "c": piece["c"], "o": piece["o"], "rendered": [f[0] for f in found],
            "role": [f[1] for f in found], "n_turns": [f[2] for f in found],
        })

    late = open_rows.groupBy("part", "c").applyInPandas(rest, f"c {kinds[id]}, o {kinds[order]}, rendered string, role string, n_turns int")
    early = done.where("part IS NULL").select("c", "o", F.col("t").alias("rendered"), "role", "n_turns")
    both = early.unionByName(late)
    return both.select(F.col("c").alias(id), F.col("o").alias(order), "role", "n_turns", "rendered")
