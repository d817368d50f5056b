"""Repair of conversation structure: cheapest edits, the least audit among them.

Rows of a conversation in the order of their turns (nulls first, then role, then digest of
the text) become one string of role initials, which must read as an optional s and pairs
of u and a. Keep costs 0, reroling to user or assistant 1, deleting 2, inserting an
empty user or assistant turn 5, and a row that is cut off and not deleted 5 more. Blank
rows and repeats must go.

Costs. A node is a place between rows and a state of the pattern: nothing yet, after s,
after u, after a. The cost from a node to the end is a minimum over the edits there.
Rows are numbered over the whole table and cut into blocks of at most ``BLOCK_ROWS`` of
one conversation, so a conversation of any length is many tasks' work: a block's costs
from entry to exit state are a 4 x 4 matrix, and the matrices of a long conversation are
multiplied (least sums) by doubling: after k rounds a block's reaches 2^k blocks on.

Audit. Arcs that the costs allow lead from node to node; letters of the arcs out of one
node differ, so a node has one least path of each length. Nodes are ranked by their
least letter, then by (rank, rank of the node that many letters on), with lengths of
1, 2, 4 ..., and the pointers double along; ranks of full length order the nodes by their
whole audits, pick the arc of each node, and the doubled pointers of the picked arcs spell
all audits of a group of blocks at once. The states in which a long conversation enters
its blocks come from the blocks' exit states, composed by doubling again.

Repaired turns are made by a pass over each conversation's rows in order that holds one
row at a time. SHA-256 of a conversation's whole text is one chain over its bytes by
definition, so that pass, and only that, reads one conversation in one task, as a stream.

Defined cases: null role and text read as one blank; null conv_ids are one conversation;
rows with null turns come first; equal rows repeat each other; an empty role fits no place
and is reroled or deleted; a conversation without rows has zeros, an empty audit and the
hash of the empty text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkprint.llm.common import few, rows_by_python, stage, table

BLOCK_ROWS = 1 << 12
GROUP_ROWS = 1 << 16  # rows of blocks that are ranked together
RETYPE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
NEVER = 1 << 40
NOTHING, SYSTEM, USER, ASSISTANT = range(4)  # states: what the pattern has read last
LETTERS = "DIKR"  # in ASCII order
BLANKS = " \t\n\x0b\x0c\r"
AFTER_INSERT = np.array([USER, USER, ASSISTANT, USER])  # also after reroling
# The state after keeping a row by its initial s, u, a or another; -1: it doesn't fit.
AFTER_KEEP = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
CLOSING = np.array([0, 2 * INSERT, INSERT, 0])  # cost of ending in each state
MUST_GO, CUT = 4, 8  # flags of a row's code beside its initial
ROLES = {USER: "user", ASSISTANT: "assistant"}


# --- rows and their faults -----------------------------------------------------------


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that crc32 of ``conv_id:turn`` decides."""
    kind = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn"))) % 20
    d = rows.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"), kind.alias("k"))
    d = d.where("k <> 0").select(
        "conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"), "k")
    return d.withColumn("copy", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))))).drop("k", "copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with the digest of their text, which with turn and role orders them."""
    return rows.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text")).withColumn(
        "mark", F.md5("text"))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, mark, pos, initial, fault): all rows numbered in order, with their first fault.

    Narrow columns only are moved. The first row of each (conversation, role, text) is found
    by a grouped minimum and joined back on its number, so a text that a conversation
    repeats a million times is no large group anywhere.
    """
    ended = F.expr(f"trim(TRAILING '{BLANKS}' FROM text)")
    narrow = _keyed(rows).withColumn("_end", F.substring(ended, -1, 1)).select(
        "conv_id", "turn", "role", "mark", F.monotonically_increasing_id().alias("_n"),
        F.when(F.col("_end") == "", "blank").when(~F.col("_end").isin(".", "!", "?"), "truncated").alias("fault"))
    order = ["conv_id", "turn", "role", "mark", "_n"]
    spread = stage(narrow.repartitionByRange(*order).sortWithinPartitions(*order).drop("_n").withColumn(
        "_part", F.spark_partition_id()).withColumn(
        "_row", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33)), "turns-order")
    parts = spread.groupBy("_part").agg(F.count("*").alias("_rows"))  # a row per task
    parts = parts.select("_part", F.coalesce(F.sum("_rows").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = spread.join(F.broadcast(parts), "_part").withColumn("pos", F.col("_before") + F.col("_row")).drop(
        "_part", "_row", "_before")
    blank = F.coalesce(F.col("fault") == "blank", F.lit(False))
    first = numbered.where(~blank).groupBy("conv_id", "role", "mark").agg(F.min("pos").alias("pos")).select(
        "pos", F.lit(True).alias("_first"))
    return numbered.join(first, "pos", "left").withColumn(
        "fault", F.when(~blank & F.col("_first").isNull(), "duplicate").otherwise(F.col("fault"))).drop(
        "_first").withColumn("initial", F.substring("role", 1, 1))


def _blocks(rows: DataFrame) -> DataFrame:
    """A row per conversation and run of ``BLOCK_ROWS`` numbers: codes in order, and counts of faults."""
    initial, fault = F.col("initial"), F.coalesce("fault", F.lit(""))
    code = (F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
            + F.when(fault.isin("blank", "duplicate"), MUST_GO).when(fault == "truncated", CUT).otherwise(0))
    coded = rows.select("conv_id", "pos", "turn", "role", "mark", F.floor(F.col("pos") / BLOCK_ROWS).alias("block"),
                        code.cast("int").alias("code"), fault.alias("fault"))
    return coded.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("pos", "code")))["code"].alias("codes"),
        F.min(F.struct("pos", "turn", "role", "mark")).alias("first"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])


# --- costs and audits of blocks, in numpy --------------------------------------------


def backward(codes: np.ndarray, offsets: np.ndarray, end: np.ndarray, whole: bool) -> np.ndarray:
    """Costs from every state before a block's first row, or with ``whole`` before each row.

    ``end`` (blocks, 4, columns) has the costs after the last row. All blocks take one row a step.
    """
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    last, sizes = offsets[1:][order], sizes[order]
    cost, keep = end[order].copy(), np.zeros((len(codes) if whole else 0, 4), np.int64)
    for step in range(1, int(sizes.max(initial=0)) + 1):
        live = int(np.searchsorted(-sizes, -step, "right"))
        code = codes[last[:live] - step]
        after = cost[:live]
        own = DELETE + after
        stays = np.where(code & MUST_GO, NEVER, np.where(code & CUT, CUT_OFF, 0))[:, None]
        for state in range(4):
            to = AFTER_KEEP[state][code & 3]
            kept = np.where(to < 0, NEVER, 0)[:, None] + after[np.arange(live), to]
            retyped = RETYPE + after[:, AFTER_INSERT[state]]
            own[:, state] = np.minimum(own[:, state], np.minimum(stays + np.minimum(kept, retyped), NEVER))
        user = np.minimum(own[:, USER], INSERT + own[:, ASSISTANT])
        own[:, ASSISTANT] = np.minimum(own[:, ASSISTANT], INSERT + own[:, USER])
        own[:, USER] = user
        own[:, NOTHING] = np.minimum(own[:, NOTHING], INSERT + user)
        own[:, SYSTEM] = np.minimum(own[:, SYSTEM], INSERT + user)
        cost[:live] = own
        if whole:
            keep[last[:live] - step] = own[:, :, 0]
    if whole:
        return keep
    out = np.empty_like(cost)
    out[order] = cost
    return out


def arcs(codes: np.ndarray, offsets: np.ndarray, end: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(costs, targets, first nodes): per node the targets of its optimal arcs by letter, -1 where there is none.

    A block of n rows has n + 1 places of four states; in the last place only a block that
    closes its conversation has arcs, the insertions that complete it.
    """
    sizes = np.diff(offsets)
    places = np.concatenate([[0], np.cumsum(sizes + 1)])
    cost = np.empty((places[-1], 4), np.int64)
    row_place = np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)
    cost[row_place] = backward(codes, offsets, end[:, :, None], True)
    cost[places[1:] - 1] = end
    target = np.full((places[-1], 4, len(LETTERS)), -1, np.int64)
    after, node = cost[row_place + 1], row_place[:, None] * 4
    below = node + 4
    states = np.arange(4)
    here = cost[row_place]
    stays = np.where(codes & MUST_GO, NEVER, np.where(codes & CUT, CUT_OFF, 0))[:, None]
    to = AFTER_KEEP[:, codes & 3].T
    kept = np.where(to < 0, NEVER, stays + np.take_along_axis(after, np.maximum(to, 0), 1))
    target[row_place, :, 0] = np.where(here == DELETE + after, below + states, -1)
    target[row_place, :, 1] = np.where(here == INSERT + here[:, AFTER_INSERT], node + AFTER_INSERT, -1)
    target[row_place, :, 2] = np.where(here == kept, below + to, -1)
    target[row_place, :, 3] = np.where(here == stays + RETYPE + after[:, AFTER_INSERT], below + AFTER_INSERT, -1)
    tail = (places[1:] - 1)[closes]
    for state in (SYSTEM, USER):
        target[tail, state, 1] = tail * 4 + AFTER_INSERT[state]
    return cost.reshape(-1), target.reshape(-1, len(LETTERS)), places[:-1] * 4


def picked(target: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per node the letter (0: none) and target of the arc that is least by letter, then rank of its target."""
    key = np.where(target < 0, np.int64(1) << 60, np.arange(1, len(LETTERS) + 1) * (len(rank) + 1) + rank[target])
    arc = key.argmin(1)
    found = target[np.arange(len(target)), arc]
    return np.where(found < 0, 0, arc + 1), np.where(found < 0, np.arange(len(target)), found)


def ranked(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(ranks, letters, doubled pointers): nodes ordered by their whole least audits.

    Round k ranks audits of 2^k letters by two ranks of half the length, until every
    pointer has come to a node without arcs.
    """
    letter, step = picked(target, np.zeros(len(target), np.int64))
    rank, jump = letter, step
    while letter[jump].any():
        rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)[1]
        jump = jump[jump]
    letter, step = picked(target, rank)
    jumps = [step]
    while letter[jumps[-1]].any():
        jumps.append(jumps[-1][jumps[-1]])
    return rank, letter, jumps


def spelled(start: np.ndarray, letter: np.ndarray, jumps: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
    """Audits from the start nodes, and the node in which each ends: every pointer doubles the known path."""
    path = start[:, None]
    for jump in jumps:
        path = np.concatenate([path, jump[path]], 1)
    marks = np.frombuffer(f"\0{LETTERS}".encode(), np.uint8)[letter[path]]
    sizes = np.cumsum((marks > 0).sum(1)).tolist()
    text = marks[marks > 0].tobytes().decode()
    return [text[a:b] for a, b in zip([0, *sizes], sizes)], jumps[-1][path[:, -1]]


def solve(codes: np.ndarray, offsets: np.ndarray, end: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
    """(costs, audits, exit states) of each block from each of the four entry states.

    Blocks of about the same length are ranked together, ``GROUP_ROWS`` rows at a time.
    """
    sizes = np.diff(offsets)
    costs, exits = np.zeros((len(sizes), 4), np.int64), np.zeros((len(sizes), 4), np.int64)
    audits: list = [None] * len(sizes)
    width = np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    for w in np.unique(width).tolist():
        of = np.flatnonzero(width == w)
        for which in np.array_split(of, max(1, len(of) * (1 << w) // GROUP_ROWS)):
            rows = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in which])
            own = np.concatenate([[0], np.cumsum(sizes[which])])
            cost, target, first = arcs(codes[rows], own, end[which], closes[which])
            _, letter, jumps = ranked(target)
            start = (first[:, None] + np.arange(4)).reshape(-1)
            texts, final = spelled(start, letter, jumps)
            costs[which], exits[which] = cost[start].reshape(-1, 4), (final % 4).reshape(-1, 4)
            for k, i in enumerate(which.tolist()):
                audits[i] = texts[4 * k:4 * k + 4]
    return costs, audits, exits


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].astype(np.int64), offsets - offsets[0]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, offsets = _codes(batch.column("codes"))
        end = np.where(np.eye(4, dtype=bool), 0, NEVER)[None].repeat(len(batch), 0)
        matrix = np.minimum(backward(codes, offsets, end, False), NEVER).reshape(len(batch), 16)
        yield pa.RecordBatch.from_arrays(
            [*batch.select(["conv_id", "block"]).columns, pa.array(list(matrix), pa.list_(pa.int64()))],
            ["conv_id", "block", "costs"])


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    legal = np.zeros((4, 4), bool)
    legal[[0, 1, 2], [1, 2, 1]] = True  # su, ua, au
    for batch in batches:
        codes, offsets = _codes(batch.column("codes"))
        closes = batch.column("ahead").is_null().to_numpy(zero_copy_only=False)
        end = np.array([CLOSING if v is None else v for v in batch.column("ahead").to_pylist()], np.int64).reshape(-1, 4)
        costs, audits, exits = solve(codes, offsets, end, closes)
        initial = codes & 3
        broken = np.zeros(len(codes), np.int64)
        broken[1:] = ~legal[initial[:-1], initial[1:]]
        behind = batch.column("behind").to_pylist()
        broken[offsets[:-1]] = [0 if b is None else int(not legal[b & 3, c]) for b, c in zip(behind, initial[offsets[:-1]])]
        yield pa.RecordBatch.from_arrays(
            [*batch.select(["conv_id", "block"]).columns, pa.array(np.add.reduceat(broken, offsets[:-1])),
             pa.array(costs[:, 0]), pa.array(audits, pa.list_(pa.string())), pa.array(list(exits), pa.list_(pa.int64()))],
            ["conv_id", "block", "illegal", "cost", "audits", "exits"])


# --- conversations of several blocks ----------------------------------------------------


def _beside(df: DataFrame, other: DataFrame, shift: int, column: str, name: str) -> DataFrame:
    """``df`` with ``column`` of the same conversation's block ``shift`` numbers on, as ``name``."""
    o = other.select(F.col("conv_id").alias("_conv"), (F.col("block") - shift).alias("_block"), F.col(column).alias(name))
    return df.join(o, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")), "left").drop(
        "_conv", "_block")


def _doubled(df: DataFrame, column: str, combine, most: int, way: int, name: str) -> DataFrame:
    """``column`` combined over all blocks from each one to the conversation's end (way 1) or start (-1)."""
    step = 1
    while step < most:
        d = _beside(df, df, way * step, column, "_far")
        df = stage(d.withColumn(column, F.when(F.col("_far").isNull(), F.col(column)).otherwise(
            combine(F.col(column), F.col("_far")))).drop("_far"), name)
        step *= 2
    return df


def _product(a: Column, b: Column) -> Column:
    """Least sums of two 4 x 4 matrices."""
    return F.array(*[F.least(*[a[4 * i + k] + b[4 * k + j] for k in range(4)], F.lit(NEVER))
                     for i in range(4) for j in range(4)])


def _composed(late: Column, early: Column) -> Column:
    return F.transform(early, lambda s: F.element_at(late, (s + 1).cast("int")))


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, block, blank, duplicate, truncated, illegal, cost, audit) of ``faults(rows)``.

    ``cost`` is the cost from the block's start to the conversation's end. Blocks of a
    conversation that has one are done at once; the others are matched by key (conversation,
    block), so no conversation is in one task.
    """
    blocks = stage(_blocks(rows), "turns-blocks")
    span = blocks.groupBy("conv_id").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("hi > lo")
    span = stage(span.withColumnRenamed("conv_id", "_conv"), "turns-long")  # a conversation per end of a block at most
    most = span.agg(F.max(F.col("hi") - F.col("lo"))).first()[0]
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    none = "CAST(NULL AS array<long>) AS ahead", "CAST(NULL AS int) AS behind"
    if most is None:
        solved = rows_by_python(blocks.selectExpr("conv_id", "block", "codes", *none), _solved, _SOLVED)
        return stage(_joined(solved.withColumn("audit", F.col("audits")[0]), blocks), "turns-audits")
    spans = few(span)
    long = stage(blocks.join(spans, same).drop("_conv"), "turns-long-blocks")
    reach = stage(rows_by_python(long.select("conv_id", "block", "codes"), _matrices,
                                 "conv_id long, block long, costs array<long>"), "turns-costs")
    reach = _doubled(reach, "costs", _product, most + 1, 1, "turns-costs")
    ahead = F.array(*[F.least(*[F.col("_m")[4 * i + j] + int(CLOSING[j]) for j in range(4)]) for i in range(4)])
    last = long.select("conv_id", "block", F.element_at("codes", -1).alias("code"))
    fitted = _beside(_beside(long, reach, 1, "costs", "_m"), last, -1, "code", "behind").select(
        "conv_id", "block", "codes", F.when(F.col("_m").isNotNull(), ahead).alias("ahead"), "behind")
    short = blocks.join(spans, same, "left_anti").selectExpr("conv_id", "block", "codes", *none)
    solved = stage(rows_by_python(short.unionByName(fitted), _solved, _SOLVED), "turns-solved")
    # Where each block of a long conversation is entered: the exits of all blocks before it.
    exits = stage(solved.join(spans, same).select("conv_id", "block", "exits"), "turns-exits")
    exits = _doubled(exits, "exits", _composed, most + 1, -1, "turns-exits")
    entry = F.coalesce(F.col("_e")[0], F.lit(0))
    chosen = _beside(solved, exits, -1, "exits", "_e").withColumn(
        "audit", F.element_at("audits", (entry + 1).cast("int")))
    return stage(_joined(chosen, blocks), "turns-audits")


_SOLVED = "conv_id long, block long, illegal long, cost long, audits array<string>, exits array<long>"


def _joined(solved: DataFrame, blocks: DataFrame) -> DataFrame:
    """Solved blocks and their counts of faults in one row each."""
    parts = solved.select("conv_id", "block", "illegal", "cost", "audit").unionByName(
        blocks.select("conv_id", "block", "blank", "duplicate", "truncated", "first"), allowMissingColumns=True)
    return parts.groupBy("conv_id", "block").agg(*[F.max(c).alias(c) for c in parts.columns[2:]])


# --- repaired turns -------------------------------------------------------------------------


def _in_order(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Audits and rows of each conversation in one stream: a block's audit comes before its first row."""
    first = found.select("conv_id", F.lit(0).alias("kind"), "block", "first.turn", "first.role", "first.mark",
                         F.col("audit").alias("text"))
    lines = _keyed(rows).select("conv_id", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("block"), "turn",
                                "role", "mark", "text")
    return first.unionByName(lines).repartition("conv_id").sortWithinPartitions(
        "conv_id", "turn", "role", "mark", "kind", "block").select("conv_id", "kind", "role", "text")


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, role, text) of every repaired turn; (conv_id, None, None) begins a conversation."""
    conv, pending, state, begun = None, deque(), NOTHING, False

    def inserted():
        nonlocal state
        while pending and pending[0][0] == "I":
            state = int(AFTER_INSERT[state])
            yield conv, ROLES[state], ""
            _use(pending)

    for batch in batches:
        for key, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text"))):
            if not begun or key != conv:
                if begun:
                    yield from inserted()
                conv, pending, state, begun = key, deque(), NOTHING, True
                yield key, None, None
            if kind == 0:
                pending.append(text)
                continue
            while pending and not pending[0]:
                pending.popleft()
            yield from inserted()
            edit = _use(pending)
            if edit == "D":
                continue
            if edit == "K":
                state = int(AFTER_KEEP[state]["sua".index(role[0])])
            else:
                state = int(AFTER_INSERT[state])
                role = ROLES[state]
            yield conv, role, text
    if begun:
        yield from inserted()


def _use(pending: deque) -> str:
    """The next letter of the audits in line."""
    letter, rest = pending[0][0], pending[0][1:]
    pending.popleft()
    if rest:
        pending.appendleft(rest)
    return letter


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns of each conversation after its edits, from place 0."""
    def work(batches):
        held, place = [], 0
        for conv, role, text in _turns(batches):
            if role is None:
                place = 0
                continue
            held.append({"conv_id": conv, "place": place, "role": role, "text": text})
            place += 1
            if len(held) == 512:
                yield pa.RecordBatch.from_pylist(held, _REPAIRED)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, _REPAIRED)

    return rows_by_python(_in_order(rows, found), work, "conv_id long, place long, role string, text string")


_REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the lines ``role:text`` of the repaired turns."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def work(batches):
        held, conv, sha, fresh = [], None, None, True
        for key, role, text in _turns(batches):
            if role is None:
                if sha is not None:
                    held.append({"conv_id": conv, "repaired_sha256": sha.hexdigest()})
                conv, sha, fresh = key, hashlib.sha256(), True
            else:
                sha.update(("" if fresh else "\n").encode() + f"{role}:{text}".encode())
                fresh = False
            if len(held) >= 512:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if sha is not None:
            held.append({"conv_id": conv, "repaired_sha256": sha.hexdigest()})
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return rows_by_python(_in_order(rows, found), work, "conv_id long, repaired_sha256 string")


def report(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """A row per conversation of ``ids``: faults, costs, audit and hash of the repaired turns."""
    known = faults(rows)
    found = audits(known)
    turns = rows.select("conv_id", "turn").distinct().groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    whole = found.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], F.min_by("cost", "block").alias("cost"),
        F.array_join(F.sort_array(F.collect_list(F.struct("block", "audit")))["audit"], "").alias("audit"))
    parts = ids.select("conv_id").distinct()
    for part in (turns, whole, digests(rows, found)):
        parts = parts.unionByName(part, allowMissingColumns=True)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return parts.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_turns(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    rows = table(spark, sf, "conversations")
    return report(rows, damaged(rows))


_SPACE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
# A place's states after up to two insertions, then the three edits of the next row.
_OPENED = f"""SELECT conv_id, i + 1 AS i, n, CASE j WHEN 0 THEN s WHEN 1 THEN [2, 2, 3, 2][s + 1] ELSE [3, 3, 2, 3][s + 1] END AS s,
  b.cost + {INSERT} * j AS cost, b.audit || repeat('I', j) AS audit,
  b.out || array_to_string(list_transform(range(j), lambda x: chr(10) || CASE WHEN (s = 2) = (x = 0) THEN 'assistant:' ELSE 'user:' END), '') AS out
  FROM dp, (SELECT unnest([0, 1, 2]) AS j)"""
_LATE = f"CASE WHEN fault = 'truncated' THEN {CUT_OFF} ELSE 0 END"
_EDITS = f"""SELECT q.conv_id, q.i, q.n,
  CASE a WHEN 'D' THEN s WHEN 'K' THEN CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE s WHEN 2 THEN 3 ELSE 2 END END AS s,
  cost + CASE a WHEN 'D' THEN {DELETE} WHEN 'K' THEN {_LATE} ELSE {RETYPE} + {_LATE} END AS cost, audit || a AS audit,
  out || CASE a WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text
    ELSE chr(10) || CASE s WHEN 2 THEN 'assistant' ELSE 'user' END || ':' || text END AS out
  FROM ({_OPENED}) q JOIN r ON r.conv_id IS NOT DISTINCT FROM q.conv_id AND r.i = q.i, (SELECT unnest(['D', 'K', 'R']) AS a)
  WHERE a = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (a = 'R' OR (initial = 's' AND s = 0) OR (initial = 'u' AND s <> 2)
    OR (initial = 'a' AND s = 2)))"""
_STEP = "x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
_ROUNDS = "i"
for _ in range(8):
    _ROUNDS = f"(SELECT CASE WHEN {_STEP} FROM (SELECT {_ROUNDS} AS x))"

QUERIES = {"op12_turns": op12_turns}
SQL = {"op12_turns": f"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, {_ROUNDS} AS v FROM (SELECT unnest(range(256)) AS i))),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (SELECT src.*, xor(list_reduce([4294967295] || list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT),
  lambda a, b: xor(a >> 8, tab.t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS d FROM src, tab),
dam AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role,
  CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE d WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE d <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
  count(*) OVER (PARTITION BY conv_id) AS n, substr(role, 1, 1) AS initial, right(rtrim(text, {_SPACE}), 1) AS last FROM dam),
r AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM num),
f AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, any_value(n) AS n, 0 AS s, {{'cost': 0, 'audit': '', 'out': ''}} AS b FROM r GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, any_value(n) AS n, s, min({{'cost': cost, 'audit': audit, 'out': out}}) AS b FROM ({_EDITS}) GROUP BY conv_id, i, s),
done AS (SELECT conv_id, min({{'cost': b.cost + [0, {2 * INSERT}, {INSERT}, 0][s + 1], 'audit': b.audit || repeat('I', [0, 2, 1, 0][s + 1]),
  'out': b.out || ['', chr(10) || 'user:' || chr(10) || 'assistant:', chr(10) || 'assistant:', ''][s + 1]}}) AS b
  FROM dp WHERE i = n GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit,
  sha256(coalesce(substr(b.out, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id"""}
