"""Transcript parsing: roles by a hidden Markov model, then canonical turns.

A transcript is lines of text with speaker markers of many styles, some missing or misleading. The
states are, for each role, the first line of a turn and a later line; a line's features are the role
its marker names, whether it is blank, whether it starts a piece or follows a blank line, and whether it
asks a question. Viterbi finds the best states of the whole conversation.

Viterbi is a chain of (max, +) matrix products, which may be grouped at will. Each row (one piece of
a transcript) becomes one matrix. Rows are sorted by range partitions; the matrices of ``CHUNK`` successive
rows are multiplied to one, those of a conversation in a partition again, and only these meet in one task
per conversation, which fixes the states at their borders; then the borders of the chunks are fixed, and
every chunk is traced back by itself. So a conversation with most of the rows is spread out, whatever its
turn numbers: its task holds one small matrix per partition, never its text.

Canonical form: every turn starts with a line ``<|role|>``, markers are removed, blank lines at the
ends of a turn's pieces are dropped.

Defined results: null or empty text has no lines and keeps the state; rows of one conversation are
ordered by turn (null first), equal turns by text; a null conversation is a conversation; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renewlens.llm.common import str_texts, table
from renewlens.session import stage

ROLES = ("system", "user", "assistant", "tool")
CHUNK = 64
N = 2 * len(ROLES) + 1  # first and later line of each role, and the start
START = N - 1
_NONE = -1e9

# Names that markers give the roles.
_NAMES = {
    "system": ("system", "sys", "instructions", "context"),
    "user": ("user", "human", "customer", "client", "q", "question", "instruction", "me", "prompter"),
    "assistant": ("assistant", "ai", "bot", "agent", "a", "answer", "response", "chatbot", "model", "gpt"),
    "tool": ("tool", "function", "observation"),
}
_ROLE_OF = {n: r for r, role in enumerate(ROLES) for n in _NAMES[role]}
_MARKER = re.compile(
    r"\s*(?:#{1,6}\s*|\*{1,2}|[\[(<{|]{1,3}\s*)?(?P<name>[A-Za-z]{1,12})(?:\s*#?\d{1,3})?"
    r"(?:\s*[\])>}|]{1,3}\s*:?|\*{0,2}\s*:\s*\*{0,2}|\s*>\s)\s*"
)


def marker(line: str) -> tuple[int, int]:
    """(role number or -1, length) of the speaker marker at the start of a line."""
    m = _MARKER.match(line)
    role = _ROLE_OF.get(m["name"].lower(), -1) if m else -1
    return (role, m.end()) if role >= 0 else (-1, 0)


def _transitions() -> np.ndarray:
    """Log scores of the next line's state. A turn goes on, or one of another role begins."""
    follow = {"system": "user", "user": "assistant", "assistant": "user", "tool": "assistant"}
    p = np.zeros((N, N))
    for r, role in enumerate(ROLES):
        for state in (2 * r, 2 * r + 1):
            p[state, 2 * r + 1] = 0.85
            for q, other in enumerate(ROLES):
                p[state, 2 * q] = 0.12 if other == follow[role] else 1e-4 if other == role else 0.01
    p[START, [2 * ROLES.index(x) for x in ROLES]] = (0.35, 0.6, 0.04, 0.01)
    with np.errstate(divide="ignore"):
        return np.maximum(np.log(p), _NONE)


TRANSITION = _transitions()
_BEGIN, _LATER = np.arange(0, N - 1, 2), np.arange(1, N - 1, 2)


def emissions(lines: list[str], roles: list[int]) -> np.ndarray:
    """Log scores of every line of a piece in every state."""
    out = np.full((len(lines), N), _NONE)
    blank_before = False
    for i, (line, role) in enumerate(zip(lines, roles)):
        blank = not line.strip()
        if blank:
            out[i, _BEGIN], out[i, _LATER] = np.log(1e-3), 0.0
        elif role >= 0:
            out[i, _BEGIN], out[i, _LATER] = np.log(1e-6), np.log(1e-4)
            out[i, 2 * role] = 0.0
        else:
            begin, later = (0.9, 0.1) if i == 0 else (0.15, 0.9) if blank_before else (0.02, 0.95)
            out[i, _BEGIN], out[i, _LATER] = np.log(begin), np.log(later)
            if line.rstrip().endswith("?"):
                out[i, 2 * ROLES.index("user")] += 0.5
        blank_before = blank
    return out


def _split(text: str) -> tuple[list[str], list[int], list[int]]:
    lines = text.split("\n") if text else []
    found = [marker(x) for x in lines]
    return lines, [r for r, _ in found], [n for _, n in found]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(max, +) product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def piece_matrix(text: str) -> np.ndarray:
    """Best score from each state before a piece to each state at its end."""
    lines, roles, _ = _split(text)
    total = np.where(np.eye(N, dtype=bool), 0.0, _NONE)
    for e in emissions(lines, roles):
        total = times(total, TRANSITION + e[None, :])
    return np.maximum(total, _NONE)


def trace(steps: list[np.ndarray], first: int, last: int | None) -> list[int]:
    """States after every step of the best path from ``first``, ending in ``last`` if given."""
    score = np.full(N, _NONE)
    score[first] = 0.0
    back = []
    for m in steps:
        both = score[:, None] + m
        back.append(both.argmax(0))
        score = np.maximum(both.max(0), 4 * _NONE)
    state, out = int(score.argmax()) if last is None else last, []
    for b in reversed(back):
        out.append(state)
        state = int(b[state])
    return out[::-1]


def decode(text: str, first: int, last: int) -> list[tuple[str, bool, str]]:
    """(role, begins a turn, text without markers) of the runs of a piece between two known states."""
    lines, roles, cut = _split(text)
    steps = [TRANSITION + e[None, :] for e in emissions(lines, roles)]
    runs: list[tuple[str, bool, list[str]]] = []
    for line, role, n, state in zip(lines, roles, cut, trace(steps, first, last)):
        r, begins = state // 2, state % 2 == 0
        if begins or not runs:
            runs.append((ROLES[min(r, len(ROLES) - 1)], begins, []))
        runs[-1][2].append(line[n:] if begins and role == r else line)
    return [(r, b, "\n".join(x).strip("\n")) for r, b, x in runs]


def render(runs: list[tuple[str, bool, str]]) -> str:
    return "\n".join((f"<|{r}|>\n" if b else "") + t for r, b, t in runs)


_M = pa.binary()


def _matrices(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.float32).reshape(N, N).astype(np.float64) for x in column.to_pylist()]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrix, chunk and place of every row of one partition, which is in order; a chunk has at most CHUNK
    rows of one conversation, a span all of its chunks in the partition."""
    number, size, span, conv, begun = TaskContext.get().partitionId() << 36, 0, 0, None, False
    for b in batches:
        matrices = [piece_matrix(t).astype(np.float32).tobytes() for t in str_texts(b.column(2))]
        chunks, spans, places = [], [], []
        for c in b.column(0).to_pylist():
            if not begun or c != conv or size == CHUNK:
                number, size = number + 1, 0
                if not begun or c != conv:
                    span, conv, begun = number, c, True
            chunks.append(number)
            spans.append(span)
            places.append(size)
            size += 1
        more = [pa.array(x, pa.int64()) for x in (spans, chunks, places)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], *more, pa.array(matrices, _M)], names=_ROW)


_ROW = ["conv_id", "turn", "text", "span", "chunk", "place", "matrix"]


def _multiplied(rows: DataFrame, key: str, order: str, above: list[str]) -> DataFrame:
    """One matrix for every ``key``, the product of its rows by ``order``."""

    def multiply(group: pa.Table) -> pa.Table:
        group, total = group.sort_by(order), None
        for m in _matrices(group.column("matrix")):
            total = m if total is None else times(total, m)
        total = np.maximum(total, _NONE).astype(np.float32).tobytes()
        return group.select(kept).slice(0, 1).append_column("matrix", pa.array([total], _M))

    kept = [key, *above]
    schema = ", ".join(f"{k} bigint" for k in kept) + ", matrix binary"
    return rows.select(*kept, order, "matrix").groupBy(key).applyInArrow(multiply, schema)


def _borders(parts: DataFrame, above: str, key: str) -> DataFrame:
    """State before and after every part; ``parts`` may have the states around their ``above``."""
    known = "enter" in parts.columns

    def borders(group: pa.Table) -> pa.Table:
        group = group.sort_by(key)
        first, last = (group.column("enter")[0].as_py(), group.column("leave")[0].as_py()) if known else (START, None)
        after = trace(_matrices(group.column("matrix")), first, last)
        out = group.select([key]).append_column("enter", pa.array([first, *after[:-1]], pa.int32()))
        return out.append_column("leave", pa.array(after, pa.int32()))

    return parts.groupBy(above).applyInArrow(borders, f"{key} bigint, enter int, leave int")


def parse(pieces: DataFrame) -> DataFrame:
    """conv_id, turn, text -> conv_id, turn, n_lines, runs (role, begins, text), rendered."""
    order = ["conv_id", "turn", "tie", "row"]  # rows equal but for the last are interchangeable
    rows = pieces.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("tie"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "conv_id bigint, turn bigint, text string, span bigint, chunk bigint, place bigint, matrix binary"
    rows = stage(rows.mapInArrow(_cut, schema), "pieces")
    chunks = stage(_multiplied(rows, "chunk", "place", ["span", "conv_id"]), "chunks")
    spans = stage(_multiplied(chunks, "span", "chunk", ["conv_id"]), "spans")
    around = _borders(spans, "conv_id", "span")
    known = stage(_borders(chunks.join(around, "span"), "span", "chunk"), "chunk-borders")

    def finish(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        enter, leave = group.column("enter")[0].as_py(), group.column("leave")[0].as_py()
        after = trace(_matrices(group.column("matrix")), enter, leave)
        runs = [
            decode(t, a, z)
            for t, a, z in zip(str_texts(group.column("text").combine_chunks()), [enter, *after[:-1]], after)
        ]
        kind = pa.list_(pa.struct([("role", pa.string()), ("begins", pa.bool_()), ("text", pa.string())]))
        dicts = [[{"role": r, "begins": b, "text": t} for r, b, t in x] for x in runs]
        lines = [len(t.split("\n")) if t else 0 for t in group.column("text").to_pylist()]
        out = group.select(["conv_id", "turn"])
        out = out.append_column("n_lines", pa.array(lines, pa.int64())).append_column("runs", pa.array(dicts, kind))
        return out.append_column("rendered", pa.array([render(x) for x in runs], pa.string()))

    return (
        rows.join(known, "chunk")
        .groupBy("chunk")
        .applyInArrow(
            finish,
            "conv_id bigint, turn bigint, n_lines bigint,"
            " runs array<struct<role:string,begins:boolean,text:string>>, rendered string",
        )
    )


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """Turns written as raw transcript pieces: one of six marker styles per conversation, and one
    marker in eight left out after the first turn."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(6))
    plain = F.when(F.col("role") == "user", "Human").when(F.col("role") == "assistant", "AI").otherwise(F.initcap("role"))
    name = (
        F.when(style == 0, F.concat(F.initcap("role"), F.lit(": ")))
        .when(style == 1, F.concat(plain, F.lit(": ")))
        .when(style == 2, F.concat(F.lit("### "), F.initcap("role"), F.lit(":\n")))
        .when(style == 3, F.concat(F.lit("["), F.col("role"), F.lit("] ")))
        .when(style == 4, F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n")))
        .otherwise(F.concat(F.lit("**"), plain, F.lit(":** ")))
    )
    left_out = (F.col("turn") > 0) & (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0)
    text = F.concat(F.when(left_out, "").otherwise(F.coalesce(name, F.lit(""))), F.coalesce("text", F.lit("")))
    return conversations.select("conv_id", "turn", "role", text.alias("text"))


def op3_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parse(as_transcripts(table(spark, sf_dir, "conversations")))
    begun = F.filter("runs", lambda r: r["begins"])
    return found.select(
        "conv_id",
        "turn",
        "n_lines",
        F.size(begun).cast("bigint").alias("n_turns"),
        F.array_join(F.transform("runs", lambda r: r["role"]), ",").alias("roles"),
        "rendered",
    )
