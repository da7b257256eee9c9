"""Repair of conversation structure by a square-root checkpointed dynamic program.

The cheapest edits (keep, rerole, delete a row, insert an empty turn) that make a conversation's
roles read ``(s?(ua)+)?`` are a shortest path over rows and the four states of that pattern. The cost
of what is left, one number per state, is computed backward and stored only at checkpoints: every
``max(MIN_BLOCK, ceil(sqrt(rows)))`` rows. Walking forward, each block between two checkpoints
recomputes its vectors from the one at its end and takes, at every step, the least edit letter that
keeps the cost tight.

A long conversation is a block table, not a group: blocks (codes of one letter a row) become 4 x 4
(min, +) matrices, whose products give the checkpoints of a conversation; a second pass gives each
block's exit per entry state, whose composition gives the entries; a third emits the edits. No step
holds more than about the square root of a conversation's rows, but for what the result itself
needs: its edits (one letter a row) are one string, and SHA-256 of its repaired rows is serial, so
one task reads a conversation's rows in order, as a stream and not as a group.

Defined results: a null in any column counts as one space (a null text is blank, a null role has
the initial of none); rows are taken by turn (null first), then role, the first 16 characters of the
text and its hash, rows alike in any order (the copy that the damage adds lies beside its row); a
conversation with a null id is one conversation; no rows after damage give zeros, an empty audit and
the hash of nothing; other columns have no effect.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from renewlens.llm.common import group_name, positions, table, workers_find_package
from renewlens.session import stage

MIN_BLOCK = 64
CELLS = 1 << 20  # rows of blocks worked on at once in a task
PREFIX = 16  # code points of a text that order rows of one turn and role; then its hash
SPACE = "\t\n\x0b\f\r "

# States of the pattern are 0 nothing yet, 1 after s, 2 after u, 3 after a.
ROLES = "sua"  # a row code is the place here (3: another) plus 4 * fault
FAULTS = ("sound", "required", "truncated")
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
_NEXT = (2, 2, 3, 2)  # state after the turn that may come next: u, u, a, u
_ENDS = (True, False, False, True)
_INF = 1 << 40
_EDITS = "DKR"
_CODE0 = 48  # codes and steps travel as characters from "0" on


def _inserts() -> tuple[np.ndarray, np.ndarray]:
    """Cost of going from one state to another by inserts alone; cost of ending from a state."""
    cost = np.full((4, 4), _INF, np.int64)
    for s in range(4):
        at, paid = s, 0
        while cost[s, at] > paid:
            cost[s, at], at, paid = paid, _NEXT[at], paid + INSERT
    return cost, np.where(_ENDS, cost, _INF).min(axis=1)


_INSERTS, _END = _inserts()


def _row_moves(code: int) -> list[list[tuple[str, int, int]]]:
    """Per state, the edits that consume a row with this code: (letter, cost, next state)."""
    role, fault = code % 4, FAULTS[code // 4]
    out = []
    for s in range(4):
        moves = [("D", DELETE, s)]
        if fault != "required":
            more = TRUNCATED if fault == "truncated" else 0
            if role < 3 and ("sua"[role] == "uuau"[s]):
                moves.append(("K", more, _NEXT[s]))
            elif s == 0 and role == 0:
                moves.append(("K", more, 1))
            moves.append(("R", REROLE + more, _NEXT[s]))
        out.append(moves)
    return out


_MOVES = [_row_moves(c) for c in range(12)]


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code: the 4 x 4 cost of a row with inserts before it; per code, edit and state: cost and next."""
    cost = np.full((12, 3, 4), _INF, np.int64)
    to = np.zeros((12, 3, 4), np.int8)
    step = np.full((12, 4, 4), _INF, np.int64)
    for c, moves in enumerate(_MOVES):
        for s in range(4):
            for letter, paid, t in moves[s]:
                e = _EDITS.index(letter)
                cost[c, e, s], to[c, e, s] = paid, t
                step[c, s, t] = min(step[c, s, t], paid)
        step[c] = (_INSERTS[:, :, None] + step[c][None]).min(axis=1)
    return step, cost, to


_STEP, _COST, _TO = _tables()


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row codes of blocks as one padded array, and the blocks' lengths."""
    length = np.array([len(x) for x in strings])
    out = np.full((len(strings), int(length.max(initial=0))), -1, np.int8)
    for row, x in zip(out, strings):
        row[: len(x)] = np.frombuffer(x.encode(), np.uint8) - _CODE0
    return out, length


def _chunks(strings: list[str]) -> Iterator[list[int]]:
    """Places of blocks, those of like length together, at most CELLS padded rows at once."""
    order, at = sorted(range(len(strings)), key=lambda i: len(strings[i])), 0
    while at < len(order):
        take = at + 1
        while take < len(order) and (take + 1 - at) * len(strings[order[take]]) <= CELLS:
            take += 1
        yield order[at:take]
        at = take


def block_matrices(strings: list[str]) -> np.ndarray:
    """(min, +) product of the rows' matrices of each block."""
    out = np.empty((len(strings), 4, 4), np.int64)
    for picked in _chunks(strings):
        codes, _ = _codes([strings[i] for i in picked])
        m = np.where(np.eye(4, dtype=bool), 0, _INF)[None].repeat(len(picked), axis=0)
        for k in range(codes.shape[1]):
            live = codes[:, k] >= 0
            m[live] = np.minimum((m[live][:, :, :, None] + _STEP[codes[live, k]][:, None]).min(axis=2), _INF)
        out[picked] = m
    return out


def _block_walk(strings: list[str], ends: np.ndarray) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks with their vectors recomputed: places, costs before the first row, steps and next
    states per row and entry state. A step is inserts + 3 * edit."""
    for picked in _chunks(strings):
        codes, _ = _codes([strings[i] for i in picked])
        n, width = codes.shape
        after = ends[picked].astype(np.int64)
        step = np.zeros((n, width, 4), np.int8)
        to = np.tile(np.arange(4, dtype=np.int8), (n, width, 1))
        for k in range(width - 1, -1, -1):
            live = np.flatnonzero(codes[:, k] >= 0)
            c, later = codes[live, k], after[live]
            before = (_STEP[c] + later[:, None]).min(axis=2)
            edit, paid, target = np.full(before.shape, -1, np.int8), _COST[c], _TO[c]
            via_insert = before == INSERT + before[:, list(_NEXT)]
            for e in (2, 1, 0):  # the least letter is set last; I lies between D and K
                tight = before == paid[:, e] + np.take_along_axis(later, target[:, e].astype(np.int64), 1)
                edit[tight] = e
                if e == 1:
                    edit[via_insert] = 3
            inserts = np.zeros(before.shape, np.int8)
            state = np.tile(np.arange(4), (len(live), 1))
            for _ in range(3):
                more = np.take_along_axis(edit, state, 1) == 3
                inserts += more
                state = np.where(more, np.array(_NEXT)[state], state)
            last = np.take_along_axis(edit, state, 1)
            step[live, k] = inserts + 3 * last
            to[live, k] = np.take_along_axis(target.transpose(0, 2, 1), state[:, :, None], 1)[
                np.arange(len(live))[:, None], np.arange(4)[None], last
            ]
            after[live] = before
        yield picked, after, step, to


def block_exits(strings: list[str], ends: np.ndarray) -> np.ndarray:
    """State after each block per state before it."""
    out = np.empty((len(strings), 4), np.int64)
    for picked, _, _, to in _block_walk(strings, ends):
        at = np.tile(np.arange(4), (len(picked), 1))
        for k in range(to.shape[1]):
            at = np.take_along_axis(to[:, k], at, 1).astype(np.int64)
        out[picked] = at
    return out


def block_edits(strings: list[str], ends: np.ndarray, entries: np.ndarray) -> list[tuple[int, int, str]]:
    """Cost from each block's start, state after it, and one character per row: step + 9 * state."""
    out: list = [None] * len(strings)
    for picked, costs, step, to in _block_walk(strings, ends):
        rows, at = np.arange(len(picked)), entries[picked].astype(np.int64)
        told = np.empty(step.shape[:2], np.uint8)
        first = costs[rows, at]
        for k in range(step.shape[1]):
            told[:, k] = step[rows, k, at] + 9 * at + _CODE0
            at = to[rows, k, at].astype(np.int64)
        for j, i in enumerate(picked):
            out[i] = (int(first[j]), int(at[j]), told[j, : len(strings[i])].tobytes().decode())
    return out


def _told(step: int) -> tuple[str, int, str]:
    """Letters of a row's edits, the inserted turns' initials and the turn's own ('' if it is deleted)."""
    state, (edit, inserts) = step // 9, divmod(step % 9, 3)
    added = ""
    for _ in range(inserts):
        added += "uuau"[state]
        state = _NEXT[state]
    return "I" * inserts + _EDITS[edit], added, "" if _EDITS[edit] == "D" else "uuau"[state]


_TOLD = [_told(s) for s in range(36)]
_FULL = {"u": "user", "a": "assistant"}


def _closing(state: int) -> str:
    """Initials of the turns inserted after the last row."""
    out = ""
    while not _ENDS[state]:
        out += "uuau"[state]
        state = _NEXT[state]
    return out


# --- Spark: rows to blocks to edits ---------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage: conv, turn, role, text of what is left (a row may come twice)."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).cast("int")
    text = F.when(kind == 1, "").when(kind == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    role = F.when(kind == 4, "user").otherwise(part("role"))
    left = rows.where(kind != 0).select(
        group_name(F.col("conv_id")).alias("conv"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind")
    )
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return left.select("conv", "turn", "role", "text", F.explode(times).alias("copy")).drop("copy")


def coded(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, rid) without texts, placed and coded: conv, pos, turn, the
    order's columns, code, blank, duplicate, truncated."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    narrow = rows.select(
        "conv", "turn", "role", F.substring("text", 1, PREFIX).alias("prefix"), F.xxhash64("text").alias("h"), "rid",
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("same"),
        (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("open"),
    )
    placed = stage(positions(narrow, "conv", ["turn", "role", "prefix", "h", "rid"], "turns"), "turns")
    first = placed.groupBy("conv", "same").agg(F.min("pos").alias("first"))
    got = placed.join(first, ["conv", "same"])
    blank = F.col("blank")
    duplicate = ~blank & (F.col("pos") > F.col("first"))
    truncated = ~blank & ~duplicate & F.col("open")
    role = F.greatest(F.instr(F.lit(ROLES), F.substring("role", 1, 1)), F.lit(0))
    role = F.when((role == 0) | (F.col("role") == ""), 3).otherwise(role - 1)
    code = role + F.when(blank | duplicate, 4).when(truncated, 8).otherwise(0)
    return got.select(
        "conv", "pos", "turn", "role", "prefix", "h", "rid", F.chr(code + _CODE0).alias("code"),
        *[f.cast("bigint").alias(n) for f, n in ((blank, "blank"), (duplicate, "duplicate"), (truncated, "truncated"))],
    )


def in_blocks(rows: DataFrame, sizes: DataFrame, min_block: int) -> DataFrame:
    """One row per block: conv, b, blocks, codes, first (order of its first row)."""
    length = F.greatest(F.lit(min_block), F.ceil(F.sqrt("n"))).cast("bigint")
    numbered = rows.join(sizes.select("conv", "n", length.alias("length")), "conv").select(
        "conv", F.floor(F.col("pos") / F.col("length")).cast("bigint").alias("b"),
        F.ceil(F.col("n") / F.col("length")).cast("bigint").alias("blocks"),
        "pos", "code", F.struct("turn", "role", "prefix", "h", "rid").alias("order"),
    )
    listed = F.array_sort(F.collect_list(F.struct("pos", "code")))
    blocks = numbered.groupBy("conv", "b", "blocks").agg(listed.alias("rows"), F.min("order").alias("first"))
    return blocks.select("conv", "b", "blocks", F.array_join(F.col("rows.code"), "").alias("codes"), "first")


def _int_lists(values: np.ndarray) -> pa.Array:
    flat = values.reshape(len(values), -1)
    return pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1], pa.array(flat.ravel()))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = block_matrices(batch.column("codes").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("b"), _int_lists(got)], ["conv", "b", "m"])


def _checkpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (conv, matrices of all blocks) to the cost vectors at the blocks' ends."""
    for batch in batches:
        out = []
        for blocks in batch.column("ms").to_pylist():
            v, kept = _END, []
            for m in reversed(blocks):
                kept.append(v.tolist())
                v = np.minimum((np.array(m["m"]).reshape(4, 4) + v).min(axis=1), _INF)
            out.append(kept[::-1])
        yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(out, pa.list_(pa.list_(pa.int64())))], ["conv", "ends"])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = block_exits(batch.column("codes").to_pylist(), np.array(batch.column("end").to_pylist()).reshape(-1, 4))
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("b"), _int_lists(got)], ["conv", "b", "exits"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.array([x or _END.tolist() for x in batch.column("end").to_pylist()]).reshape(-1, 4)
        entry = np.array([x or 0 for x in batch.column("entry").to_pylist()], np.int64)
        got = block_edits(batch.column("codes").to_pylist(), ends, entry)
        audit = ["".join(_TOLD[ord(c) - _CODE0][0] for c in told) for _, _, told in got]
        cols = [[x[0] for x in got], [x[1] for x in got], [x[2] for x in got], audit]
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("b"), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
            ["conv", "b", "cost", "state", "steps", "audit"],
        )


def edited(blocks: DataFrame) -> DataFrame:
    """Blocks with checkpoints, entry states and edits: conv, b, blocks, codes, first, cost, state, steps, audit."""
    long = blocks.where("blocks > 1").select("conv", "b", "codes")
    per_block = long.mapInArrow(_matrices, "conv string, b bigint, m array<bigint>")
    ms = per_block.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("b", "m"))).alias("ms"))
    ends = ms.mapInArrow(_checkpoints, "conv string, ends array<array<bigint>>")
    ends = stage(ends.select("conv", F.posexplode("ends").alias("b", "end")).withColumn("b", F.col("b").cast("bigint")), "ends")
    exits = long.join(ends, ["conv", "b"]).mapInArrow(_exits, "conv string, b bigint, exits array<bigint>")
    run = exits.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("b", "exits"))).alias("x"))
    # states before each block: the exits composed from state 0
    entry = F.aggregate(
        "x",
        F.array(F.lit(0).cast("bigint")),
        lambda acc, x: F.concat(acc, F.array(F.element_at(x["exits"], (F.element_at(acc, -1) + 1).cast("int")))),
    )
    entries = run.select("conv", F.posexplode(entry).alias("b", "entry")).withColumn("b", F.col("b").cast("bigint"))
    ready = blocks.join(ends, ["conv", "b"], "left").join(entries, ["conv", "b"], "left")
    told = ready.select("conv", "b", "codes", "end", "entry").mapInArrow(
        _edits, "conv string, b bigint, cost bigint, state int, steps string, audit string"
    )
    return blocks.join(told, ["conv", "b"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (conv, order, kind), blocks of steps before their rows: conv, repaired_sha256."""
    conv, digest, started, steps, at, state = None, None, False, "", 0, 0

    def put(line: str) -> None:
        nonlocal started
        digest.update((("\n" if started else "") + line).encode())
        started = True

    def finish() -> str:
        for x in _closing(state):
            put(f"{_FULL[x]}:")
        return digest.hexdigest()

    for batch in batches:
        done: list[tuple[str, str]] = []
        for name, told, last, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv", "steps", "state", "role", "text")]):
            if name != conv:
                if conv is not None:
                    done.append((conv, finish()))
                conv, digest, started, steps, at, state = name, hashlib.sha256(), False, "", 0, 0
            if told is not None:
                steps, at, state = steps[at:] + told, 0, last
                continue
            letters, added, turn = _TOLD[ord(steps[at]) - _CODE0]
            at += 1
            for x in added:
                put(f"{_FULL[x]}:")
            if turn:
                put(f"{_FULL[turn] if letters[-1] == 'R' else role}:{text}")
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in (0, 1)], ["conv", "repaired_sha256"])
    if conv is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([finish()])], ["conv", "repaired_sha256"])


def _illegal(blocks: DataFrame) -> DataFrame:
    """Per conversation: neighbours whose initials are not su, ua or au, within and between blocks."""
    letters = F.translate("codes", "".join(chr(_CODE0 + c) for c in range(12)), (ROLES + "x") * 3)
    pairs = F.transform(F.sequence(F.lit(1), F.length("l") - 1), lambda i: F.substring("l", i, F.lit(2)))
    bad = F.when(F.length("l") > 1, F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))).otherwise(0)
    own = blocks.select("conv", "b", letters.alias("l")).select("conv", "b", bad.cast("bigint").alias("bad"), F.substring("l", 1, 1).alias("a"), F.substring("l", -1, 1).alias("z"))
    ends = own.groupBy("conv").agg(F.sum("bad").alias("bad"), F.array_sort(F.collect_list(F.struct("b", "a", "z"))).alias("e"))
    between = F.zip_with(F.slice("e", 1, F.size("e") - 1), F.slice("e", 2, F.size("e")), lambda p, q: F.concat(p["z"], q["a"]))
    more = F.when(F.size("e") > 1, F.size(F.filter(between, lambda p: ~p.isin("su", "ua", "au")))).otherwise(0)
    return ends.select("conv", (F.col("bad") + more).alias("illegal"))


def repair(rows: DataFrame, *, min_block: int = MIN_BLOCK) -> DataFrame:
    """Per conversation of ``rows`` (conv, turn, role, text): gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256."""
    workers_find_package(rows.sparkSession)
    rows = stage(rows.withColumn("rid", F.monotonically_increasing_id()), "damaged")
    coded_rows = stage(coded(rows), "coded")
    turns = coded_rows.groupBy("conv", "turn").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    )
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint")
    totals = turns.groupBy("conv").agg(
        gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("n", "blank", "duplicate", "truncated")]
    )
    totals = stage(totals, "conversations")
    blocks = stage(edited(stage(in_blocks(coded_rows, totals, min_block), "blocks")), "edits")

    order = ["turn", "role", "prefix", "h", "rid"]
    told = blocks.select("conv", *[F.col(f"first.{c}").alias(c) for c in order], F.lit(0).alias("kind"), "steps", "state", F.lit(None).cast("string").alias("text"))
    texts = rows.select(
        "conv", "turn", "role", F.substring("text", 1, PREFIX).alias("prefix"), F.xxhash64("text").alias("h"), "rid",
        F.lit(1).alias("kind"), F.lit(None).cast("string").alias("steps"), F.lit(None).cast("int").alias("state"), "text",
    )
    stream = told.unionByName(texts).repartition("conv").sortWithinPartitions("conv", *order, "kind")
    hashes = stream.select("conv", "steps", "state", "role", "text").mapInArrow(_hashes, "conv string, repaired_sha256 string")

    closing = F.element_at(F.array(*[F.lit("I" * len(_closing(s))) for s in range(4)]), F.col("state") + 1)
    last = F.when(F.col("b") == F.col("blocks") - 1, closing).otherwise("")
    audits = blocks.select("conv", "b", "cost", F.concat("audit", last).alias("audit")).groupBy("conv").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("b", "audit")))["audit"], "").alias("audit"),
        F.max(F.when(F.col("b") == 0, F.col("cost"))).alias("cost"),
    )
    return totals.drop("n").join(_illegal(blocks), "conv").join(audits, "conv").join(hashes, "conv")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = repair(damaged(rows))
    every = rows.select("conv_id").distinct().withColumn("conv", group_name(F.col("conv_id")))
    zero: dict[str, Column] = {c: F.lit(0).cast("bigint") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    zero |= {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return every.join(found, "conv", "left").select("conv_id", *[F.coalesce(c, z).alias(c) for c, z in zero.items()])
