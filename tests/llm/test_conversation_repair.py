"""Repair against exhaustive shortest paths over whole conversations."""

import functools
import hashlib
import re
import zlib

import numpy as np
import pytest

from renewlens.llm import op12_conversation_repair as R

NOT_BLANK = re.compile(r"[^\x20\x09-\x0D]")
FULL = {"u": "user", "a": "assistant"}


def plain_damage(rows):
    """(conv, turn, role, text) -> rows of each conversation in order."""
    out = {}
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        out.setdefault(conv, [])
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def plain_repair(rows):
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        shown = NOT_BLANK.findall(text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    first = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    expect = {0: "u", 1: "u", 2: "a", 3: "u"}
    after = {0: 2, 1: 2, 2: 3, 3: 2}

    @functools.cache
    def best(i, state, inserts):
        """(cost, audit, lines) of what is left; at most four inserts in a row."""
        out = []
        if i == len(rows) and state in (0, 3):
            out.append((0, "", ()))
        if inserts < 4:
            c, a, l = best(i, after[state], inserts + 1)
            out.append((c + 2, "I" + a, (FULL[expect[state]] + ":",) + l))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, l = best(i + 1, state, 0)
            out.append((c + 3, "D" + a, l))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                c, a, l = best(i + 1, after[state], 0)
                out.append((c + 2 + more, "R" + a, (f"{FULL[expect[state]]}:{text}",) + l))
                if role[:1] == expect[state]:
                    out.append((c + more, "K" + a, (f"{role}:{text}",) + l))
                if role[:1] == "s" and state == 0:
                    c, a, l = best(i + 1, 1, 0)
                    out.append((c + more, "K" + a, (f"{role}:{text}",) + l))
        return min(out, default=(10**9, "", ()))

    for i in range(len(rows), -1, -1):  # from the end, so that the recursion stays shallow
        for k in range(16):
            best(i, k % 4, 4 - k // 4)
    cost, audit, lines = best(0, 0, 0)
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def check(spark, rows, **settings):
    found = R.repair(R.damaged(spark.createDataFrame(rows, SCHEMA)), **settings).collect()
    want = {("=" + str(c) if c is not None else ""): plain_repair(r) for c, r in plain_damage(rows).items() if r}
    assert {r.conv: tuple(r[c] for c in COLUMNS) for r in found} == want


def test_query_on_the_small_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: plain_repair(r) for c, r in plain_damage(rows).items()}
    got = R.op12_conversation_repair(spark, small).collect()
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got} == want
    assert len(got) == len(want) and len({r.audit for r in got}) > 5


@pytest.mark.parametrize("min_block", [1, 3, 64])
def test_random_conversations_in_blocks(spark, min_block):
    rng = np.random.default_rng(min_block)
    roles, texts = ["system", "user", "assistant", "tool", "s", None, ""], ["a.", "b", "c?\n", " ", "", "d! ", "é.", None, "x" * 300]
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(int(rng.integers(1, 40))):
            t = None if rng.random() < 0.1 else int(turn + rng.integers(0, 3))
            rows.append((conv, t, roles[rng.integers(0, 7)], texts[rng.integers(0, 9)]))
    check(spark, rows, min_block=min_block)


def test_hot_conversation_and_lost_rows(spark, tmp_path):
    rows = [(None, None, None, None)] * 50 + [(7, k % 400, ("user", "assistant")[k % 2], f"t{k % 97}.") for k in range(900)]
    gone = next(c for c in range(10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "hi"))
    check(spark, rows, min_block=4)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in R.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert (got[gone].cost, got[gone].audit, got[gone].repaired_sha256) == (0, "", hashlib.sha256().hexdigest())
    assert set(got) == {None, 7, gone}


def test_checkpoints_equal_one_backward_pass():
    rng = np.random.default_rng(0)
    codes = "".join(chr(48 + c) for c in rng.integers(0, 12, 1000))
    whole = R.block_edits([codes], R._END[None], np.array([0]))[0]
    blocks = [codes[k : k + 32] for k in range(0, 1000, 32)]
    ends, v = [], R._END
    for m in R.block_matrices(blocks)[::-1]:
        ends.append(v)
        v = (m + v).min(axis=1)
    ends = np.array(ends[::-1])
    state, told = 0, ""
    for exits, block, end in zip(R.block_exits(blocks, ends), blocks, ends):
        _, after, steps = R.block_edits([block], end[None], np.array([state]))[0]
        assert exits[state] == after
        state, told = after, told + steps
    assert told == whole[2] and v[0] == whole[0]
