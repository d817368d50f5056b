"""Repair of conversations against plain search, on blocks of every size."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from inkprint.llm import op12_turns as op

WORD = re.compile(r"[^\x20\x09-\x0D]")
GOAL = re.compile(r"(s?(ua)+)?")


def damage(rows):
    """The contract's damage, row by row."""
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if v is None else v for v in (conv, turn, role, text)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2], shown[3]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def fault_of(rows):
    seen, out = set(), []
    for role, text in rows:
        last = WORD.findall(text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[0] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, lines): a search forward over rows and states, every edit tried."""
    faults = fault_of(rows)
    best = {"": (0, "", ())}  # state: what the pattern has read last
    opens = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def inserted(states):
        for _ in range(2):
            for state, (cost, audit, lines) in list(states.items()):
                to = opens[state]
                new = (cost + 5, audit + "I", (*lines, f"{full[to]}:"))
                states[to] = min(states.get(to, new), new)
        return states

    for (role, text), fault in zip(rows, faults):
        after = {}

        def put(state, cost, audit, lines):
            after[state] = min(after.get(state, (cost, audit, lines)), (cost, audit, lines))

        for state, (cost, audit, lines) in inserted(best).items():
            put(state, cost + 2, audit + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            late, to = 5 * (fault == "truncated"), opens[state]
            if role[:1] == to or role[:1] == "s" and state == "":
                put(role[0], cost + late, audit + "K", (*lines, f"{role}:{text}"))
            put(to, cost + late + 1, audit + "R", (*lines, f"{full[to]}:{text}"))
        best = after
    best = inserted(best)
    return min(best[s] for s in ("", "a") if s in best)


def every_edit(rows):
    """All edit sequences of a very short conversation, insertions up to two in a place."""
    faults, n = fault_of(rows), len(rows)
    found = []
    gaps = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    for edits in itertools.product(("D", "K", "Ru", "Ra"), repeat=n):
        if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, faults)):
            continue
        for holes in itertools.product(gaps, repeat=n + 1):
            states, cost, audit = "", 0, ""
            for i, hole in enumerate(holes):
                states += "".join(hole)
                audit += "I" * len(hole)
                cost += 5 * len(hole)
                if i < n:
                    e = edits[i]
                    audit += e[0]
                    cost += {"D": 2, "K": 0, "R": 1}[e[0]] + 5 * (e != "D" and faults[i] == "truncated")
                    states += "" if e == "D" else rows[i][0][0] if e == "K" else e[1]
            if GOAL.fullmatch(states):
                found.append((cost, audit))
    return min(found)


def expected(original):
    """One row per conversation, by plain Python."""
    rows, out = damage(original), {}
    for conv in {r[0] for r in original}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (
            r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))
        turns = [r[1] for r in own if r[1] is not None]
        lines = [(r[2], r[3]) for r in own]
        faults = fault_of(lines)
        cost, audit, done = cheapest(lines)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"),
                     faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                     hashlib.sha256("\n".join(done).encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string, pos string, block string, kind string, cost string"


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)


def got(spark, rows):
    df = made(spark, rows)
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
            for r in op.report(df, op.damaged(df)).collect()}


def talk(rng, convs, length):
    rows = []
    for conv in convs:
        for turn in range(rng.randrange(length)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"])
            text = rng.choice(["a.", "b!", "c", " \n", "", None, f"{turn} long text\nwith lines.", f"{turn} cut off", "é?"])
            rows.append((conv, rng.choice([turn, turn, turn, turn // 2, None]), role, text))
    return rows + rng.sample(rows, min(len(rows), 5))


def test_search_tries_every_edit():
    rng = random.Random(2)
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b.", "c", ""])) for _ in range(rng.randrange(4))]
        assert cheapest(rows)[:2] == every_edit(rows)


@pytest.mark.parametrize("block", [1, 2, 3, 1 << 12])
def test_conversations_in_blocks(spark, monkeypatch, block):
    """The same rows whatever the size of a block; long conversations and null ids included."""
    monkeypatch.setattr(op, "BLOCK_ROWS", block)
    rng = random.Random(block)
    rows = talk(rng, range(60), 9) + talk(rng, [100, None, 101], 90)
    assert got(spark, rows) == expected(rows)


def test_awkward_rows(spark):
    rows = [(1, 0, None, None), (1, None, "user", "x."), (2, 5, "system", "x."), (None, None, None, None), (3, 1, "", "x."),
            (4, -3, "user", "y" * 50_000 + "."), (4, 9, "assistant", "z."), (4, 9, "assistant", "z."), (5, 1, "Über", "x.")]
    assert got(spark, rows) == expected(rows)


def test_conversation_that_loses_all_rows(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    assert got(spark, [(conv, 1, "user", "x.")]) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_no_rows(spark):
    assert got(spark, []) == {}


def test_ranks_order_nodes_by_their_audits():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 4, 64) + rng.choice([0, 0, 4, 8], 64)
    offsets = np.array([0, 1, 9, 30, 64])
    cost, target, _ = op.arcs(codes, offsets, np.tile(op.CLOSING, (4, 1)), np.ones(4, bool))
    rank, letter, jumps = op.ranked(target)
    audits, _ = op.spelled(np.arange(len(rank)), letter, jumps)
    place = {a: i for i, a in enumerate(sorted(set(audits)))}
    assert len(set(rank.tolist())) == len(place)
    assert np.array_equal(np.argsort(rank, kind="stable"), np.argsort([place[a] for a in audits], kind="stable"))
    spent = [sum({"D": 2, "I": 5, "K": 0, "R": 1}[x] for x in a) for a in audits]
    assert all(c >= s and (c - s) % 5 == 0 for c, s in zip(cost.tolist(), spent))


def test_repaired_turns_read_as_they_must(spark):
    rows = talk(random.Random(9), range(30), 12)
    df = op.damaged(made(spark, rows))
    out = op.repaired(df, op.audits(op.faults(df))).orderBy("conv_id", "place").collect()
    for conv, own in itertools.groupby(out, key=lambda r: r["conv_id"]):
        own = list(own)
        assert GOAL.fullmatch("".join(r["role"][0] for r in own))
        assert [r["place"] for r in own] == list(range(len(own)))
    want = expected(rows)
    text = {c: "\n".join(f"{r['role']}:{r['text']}" for r in out if r["conv_id"] == c) for c in want}
    assert {c: hashlib.sha256(t.encode()).hexdigest() for c, t in text.items()} == {c: w[-1] for c, w in want.items()}
