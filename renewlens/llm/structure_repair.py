"""Conversation structure repair by Hirschberg's divide and conquer over four states.

A legal conversation's role initials match ``(s?(ua)+)?``: four states (start, after s, after u,
after a), and in each only one of u and a may follow. Every turn is kept, reroled, deleted,
or preceded by inserted turns; the cheapest edits are wanted, and of those the ones whose
initials are least in ASCII order.

Forward and backward four-state cost vectors meet in the middle of a stretch of turns; the
crossing state with the least sum is chosen and both halves are solved in the same way, so
that no table of turns by states is kept. States cross right after a turn's own edit. All audits
up to there hold the same number of such edits and end in one, so none is a prefix of
another: which is least does not depend on what follows. The forward vector carries the
rank of its audits beside the cost, and the audit-least of the cheapest crossings is taken.

A conversation is cut into blocks of ``BLOCK`` turns, each summed up as the 4 x 4 costs and
ranks from every entry to every exit state; blocks are summed up by ``FAN`` in the same way
until one is left. Then the crossings are found from the top down to the turns. So no task
holds a whole conversation; only the digest of the repaired text (SHA-256 is a chain)
and the audit itself (one cell by contract) pass through one task, as a stream.

Rows: turns go by turn (null first), then role, then text. Null ids are a conversation of
their own, null roles and texts one space; repeated rows are duplicates. A role whose first
character is none of s, u, a (the empty role too) cannot be kept. Very long texts pass
unchanged, one Arrow batch at a time. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewlens.llm.common import list_array, python_columns, table, written
from renewlens.llm.turn_order import numbered

BLOCK = 256
FAN = 256
#: Blocks that are worked on in step.
LOCKSTEP = 512

START, AFTER_S, AFTER_U, AFTER_A = range(4)
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
NEVER = 1 << 40
BLANKS = " \t\n\v\f\r"

#: Codes of a turn: role class (0 s, 1 u, 2 a, 3 other) + 4 * (0 sound, 1 truncated, 2 to be deleted).
CODES = 12
#: The state after the one turn of u and a that may follow.
_NEXT = [AFTER_U, AFTER_U, AFTER_A, AFTER_U]
#: Inserted turns that end a conversation from each state.
CLOSING = ["", "II", "I", ""]


def _edits(code: int, state: int):
    """(cost, letters, state after) of every way to treat one turn, turns inserted before it included."""
    role, fault = code % 4, code // 4
    cost, letters = 0, ""
    for _ in range(3):  # a third insert would come back to a state already left
        if role == 0 and fault < 2 and state == START:
            yield cost + KEEP + TRUNCATED * fault, letters + "K", AFTER_S
        if role in (1, 2) and fault < 2 and _NEXT[state] == role + 1:
            yield cost + KEEP + TRUNCATED * fault, letters + "K", role + 1
        if fault < 2:
            yield cost + REROLE + TRUNCATED * fault, letters + "R", _NEXT[state]
        yield cost + DELETE, letters + "D", state
        cost, letters, state = cost + INSERT, letters + "I", _NEXT[state]


@cache
def turn_tables():
    """(cost, rank, letters) by [code][entry][exit]; ranks order the letters of one entry."""
    cost = np.full((CODES, 4, 4), NEVER, np.int64)
    rank = np.zeros((CODES, 4, 4), np.int64)
    letters = [[[""] * 4 for _ in range(4)] for _ in range(CODES)]
    for code in range(CODES):
        for s in range(4):
            best = {}
            for c, l, t in _edits(code, s):
                best[t] = min(best.get(t, (NEVER, "")), (c, l))
            for r, t in enumerate(sorted(best, key=lambda t: best[t][1])):
                cost[code, s, t], letters[code][s][t] = best[t]
                rank[code, s, t] = r
    return cost, rank, letters


def forward(f, k, cost, rank):
    """One step of (n, 4) costs and audit ranks through (n, 4, 4) costs and ranks."""
    each = (np.minimum(f[:, :, None] + cost, NEVER) << 3) + k[:, :, None]
    came = each.argmin(axis=1)
    rows, to = np.arange(len(f))[:, None], np.arange(4)[None, :]
    best = each[rows, came, to] >> 3
    order = np.where(best < NEVER, (k[rows, came] << 3) + rank[rows, came, to], 1 << 20)
    return best, order.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")


def backward(g, cost):
    """One step of (n, 4) costs to the exit, backwards through (n, 4, 4) costs."""
    return np.minimum((cost + g[:, None, :]).min(axis=2), NEVER)


def _single(n, state):
    out = np.full((n, 4), NEVER, np.int64)
    out[np.arange(n), state] = 0
    return out


def summed(lengths, step):
    """(costs, ranks), each (n, 4, 4): whole sequences from every entry to every exit.

    ``step(rows, at)`` gives the (m, 4, 4) costs and ranks of item ``at`` of the sequences ``rows``.
    """
    n = len(lengths)
    f = _single(4 * n, np.tile(np.arange(4), n))
    k = np.zeros((4 * n, 4), np.int64)
    for at in range(int(lengths.max(initial=0))):
        on = np.flatnonzero(lengths > at)
        four = (on[:, None] * 4 + np.arange(4)).ravel()
        c, r = step(on, np.full(len(on), at))
        f[four], k[four] = forward(f[four], k[four], np.repeat(c, 4, axis=0), np.repeat(r, 4, axis=0))
    return f.reshape(n, 4, 4), k.reshape(n, 4, 4)


def crossings(lengths, entry, exit_, step):
    """The states between items: (n, longest + 1), by repeated halving with four-state vectors."""
    n = len(lengths)
    states = np.zeros((n, int(lengths.max(initial=0)) + 1), np.int8)
    states[:, 0] = entry
    states[np.arange(n), lengths] = exit_
    row, lo, hi = np.arange(n), np.zeros(n, np.int64), lengths.astype(np.int64)
    while True:
        wide = hi - lo > 1
        row, lo, hi = row[wide], lo[wide], hi[wide]
        if not len(row):
            return states
        mid = (lo + hi) // 2
        f, k = _single(len(row), states[row, lo]), np.zeros((len(row), 4), np.int64)
        for i in range(int((mid - lo).max())):
            on = np.flatnonzero(lo + i < mid)
            c, r = step(row[on], lo[on] + i)
            f[on], k[on] = forward(f[on], k[on], c, r)
        g = _single(len(row), states[row, hi])
        for i in range(1, int((hi - mid).max()) + 1):
            on = np.flatnonzero(hi - i >= mid)
            g[on] = backward(g[on], step(row[on], hi[on] - i)[0])
        states[row, mid] = (((f + g) << 3) + k).argmin(axis=1)
        row, lo, hi = np.concatenate([row, row]), np.concatenate([lo, mid]), np.concatenate([mid, hi])


def close(costs, ranks):
    """(cost, exit state) of whole conversations: the cheapest legal end, of equals the audit-least."""
    end = np.array([INSERT * len(x) for x in CLOSING], np.int64)
    each = ((costs[:, START, :] + end) << 3) + ranks[:, START, :]
    to = each.argmin(axis=1)
    return each[np.arange(len(to)), to] >> 3, to


def _lists(batch, column, width=None):
    """(lengths, values padded to a rectangle) of a list column."""
    arr = batch.column(column)
    offsets = arr.offsets.to_numpy().astype(np.int64)
    values = arr.values.to_numpy(zero_copy_only=False)
    unit = width or 1
    lengths = np.diff(offsets) // unit
    out = np.zeros((len(lengths), int(lengths.max(initial=0)), unit), np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        out[i, : (b - a) // unit] = values[a:b].reshape(-1, unit)
    return lengths, out


def _steps(batch, items: str):
    """(lengths, step) of a batch of blocks, whose items are turn codes or summaries of blocks."""
    if items == "codes":
        lengths, codes = _lists(batch, items)
        cost, rank, _ = turn_tables()
        return lengths, lambda row, at: (cost[codes[row, at, 0]], rank[codes[row, at, 0]])
    lengths, sums = _lists(batch, items, 32)
    c, r = sums[:, :, :16].reshape(*sums.shape[:2], 4, 4), sums[:, :, 16:].reshape(*sums.shape[:2], 4, 4)
    return lengths, lambda row, at: (c[row, at], r[row, at])


def _in_step(df: DataFrame, work, new: str, drop=()) -> DataFrame:
    """``python_columns`` over at most LOCKSTEP rows at a time."""

    def make():
        def run(batch):
            parts = [work(batch.slice(a, LOCKSTEP)) for a in range(0, batch.num_rows, LOCKSTEP)]
            return {n: pa.concat_arrays([p[n] for p in parts]) if parts else [] for n in (x.split()[0] for x in new.split(", "))}

        return run

    return python_columns(df, make, new, text=None, drop=drop)


def _sum_up(blocks: DataFrame, items: str) -> DataFrame:
    def work(batch):
        lengths, step = _steps(batch, items)
        costs, ranks = summed(lengths, step)
        flat = np.concatenate([costs.reshape(-1, 16), ranks.reshape(-1, 16)], axis=1)
        return {"sums": list_array(flat.ravel(), np.full(len(flat), 32), np.int64)}

    return _in_step(blocks, work, "sums array<long>")


def _cross(blocks: DataFrame, items: str) -> DataFrame:
    """``blocks`` with (entry, exit) solved: ``states`` between their items."""

    def work(batch):
        lengths, step = _steps(batch, items)
        entry, exit_ = (batch.column(c).to_numpy().astype(np.int64) for c in ("entry", "exit"))
        states = crossings(lengths, entry, exit_, step)
        flat = np.concatenate([states[i, : n + 1] for i, n in enumerate(lengths)])
        return {"states": list_array(flat, lengths + 1)}

    return _in_step(blocks, work, "states array<int>", drop=(items,))


def _grouped(rows: DataFrame, at: str, size: int, value: str, name: str) -> DataFrame:
    """(_key, block, ``name``): ``value`` of ``size`` consecutive rows each, in order of ``at`` (from 0)."""
    each = F.array_sort(F.collect_list(F.struct(F.col(at).alias("i"), F.col(value).alias("v"))))
    return rows.groupBy("_key", F.expr(f"{at} div {size}").alias("block")).agg(F.transform(each, lambda x: x["v"]).alias(name))


def solve(turns: DataFrame, block: int = BLOCK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """((_key, cost, exit) per conversation, (_key, block, codes, states) per block) of (_key, i, code) rows."""
    level = written(_sum_up(_grouped(turns, "i", block, "code", "codes"), "codes"), "blocks")
    items, levels = "codes", []
    while True:
        levels.append((level, items))
        if level.where("block > 0").isEmpty():
            break
        # Conversations that are one block already stay as they are.
        up = _grouped(level.withColumnRenamed("block", "b"), "b", fan, "sums", "parts").withColumn("parts", F.flatten("parts"))
        level, items = written(_sum_up(up, "parts"), "blocks"), "parts"

    def work(batch):
        _, sums = _lists(batch, "sums", 32)
        cost, to = close(sums[:, 0, :16].reshape(-1, 4, 4), sums[:, 0, 16:].reshape(-1, 4, 4))
        return {"cost": pa.array(cost), "exit": pa.array(to.astype(np.int32))}

    top = written(_in_step(level.select("_key", "sums"), work, "cost long, exit int", drop=("sums",)), "top")
    ends = top.select("_key", F.lit(0).cast("long").alias("block"), F.lit(START).alias("entry"), "exit")
    while len(levels) > 1:
        level, items = levels.pop()
        met = written(_cross(level.select("_key", "block", items).join(ends, ["_key", "block"]), items).drop("entry", "exit"), "crossed")
        pairs = F.transform(F.sequence(F.lit(0), F.size("states") - 2), lambda i: F.struct(
            i.alias("i"), F.get("states", i).alias("entry"), F.get("states", i + 1).alias("exit")))
        ends = met.select("_key", "block", F.explode(pairs).alias("p")).select(
            "_key", (F.col("block") * fan + F.col("p.i")).alias("block"), "p.entry", "p.exit")
    level, items = levels.pop()
    codes = level.select("_key", "block", "codes")
    met = written(_cross(codes.withColumn("kept", F.col("codes")).join(ends, ["_key", "block"]), "codes"), "crossed")
    return top, met.select("_key", "block", F.col("kept").alias("codes"), "states")


_ROLES = {AFTER_S: "system", AFTER_U: "user", AFTER_A: "assistant"}


def _repaired(batches):
    """(_key, audit, repaired_sha256) from a stream by (_key, i, tag): the edits of a block come before its
    turns, those of the end after the last turn."""
    *_, letters = turn_tables()
    out: list[tuple] = []
    at, audit, digest, edits, first = None, [], None, None, True

    def line(role, text):
        nonlocal first
        if not first:
            digest.update(b"\n")
        first = False
        digest.update(f"{role}:".encode())
        digest.update(text)

    def inserted(n, state):
        for _ in range(n):
            state = _NEXT[state]
            line(_ROLES[state], b"")
        return state

    def rows():
        cols = list(zip(*out)) or [[], [], []]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["_key", "audit", "repaired_sha256"])

    for batch in batches:
        keys, tags, states, codes, ends = (batch.column(c).to_pylist() for c in ("_key", "tag", "states", "codes", "exit"))
        roles, texts = batch.column("role"), batch.column("text")
        for i, (key, tag) in enumerate(zip(keys, tags)):
            if key != at:
                if at is not None:
                    out.append((at, "".join(audit), digest.hexdigest()))
                at, audit, digest, first = key, [], hashlib.sha256(), True
            if tag == 0:
                edits = iter(zip(codes[i], states[i], states[i][1:]))
            elif tag == 1:
                code, s, t = next(edits)
                word = letters[code][s][t]
                audit.append(word)
                state = inserted(len(word) - 1, s)
                if word[-1] == "K":
                    line(roles[i].as_py(), texts[i].as_buffer().to_pybytes())
                elif word[-1] == "R":
                    line(_ROLES[_NEXT[state]], texts[i].as_buffer().to_pybytes())
            else:
                audit.append(CLOSING[ends[i]])
                inserted(len(CLOSING[ends[i]]), ends[i])
        yield rows()
    if at is not None:
        out.append((at, "".join(audit), digest.hexdigest()))
        yield rows()


def repair(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """One row per conversation of ``conversations``: gaps, fault counts, illegal pairs, cost and audit of the
    cheapest edits, and the digest of the repaired turns."""
    named = F.coalesce(F.col(key).cast("string"), F.lit(" "))  # no id's text is a space
    rows = conversations.select(named.alias("k"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"),
                                F.coalesce(text, F.lit(" ")).alias("text"))
    end = F.rtrim("text", F.lit(BLANKS))
    blank = end == ""
    # The first of equal turns is found by the digest of its role and text.
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    first_char = F.substring("role", 1, 1)
    kind = F.when(first_char == "s", 0).when(first_char == "u", 1).when(first_char == "a", 2).otherwise(3)
    rows = rows.withColumns({"blank": blank, "same": F.when(~blank, same), "kind": kind,
                             "cut": ~F.substring(end, -1, 1).isin(".", "!", "?")})
    turns = numbered(rows, "k", ["turn", "role", "text"], ["turn", "role", "text", "blank", "same", "kind", "cut"], "turns")
    firsts = turns.where("same is not null").groupBy("_key", "same").agg(F.min("_n").alias("_n")).select("_key", "_n", F.lit(True).alias("new"))
    marks = turns.select("_key", "_n", "turn", "blank", "kind", "cut").join(firsts, ["_key", "_n"], "left")
    new = F.coalesce("new", F.lit(False))
    fault = F.when(F.col("blank"), 1).when(~new, 2).when(F.col("cut"), 3).otherwise(0)
    marks = marks.select("_key", (F.col("_n") - 1).alias("i"), "turn", "kind", fault.alias("fault"))
    marks = written(marks.withColumn("code", F.col("kind") + 4 * F.when(F.col("fault") == 3, 1).when(F.col("fault") > 0, 2).otherwise(0)), "marks")
    top, met = solve(marks.select("_key", "i", "code"), block, fan)
    counted = lambda f: F.sum((F.col("fault") == f).cast("long"))
    gaps = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    counts = marks.groupBy("_key").agg(F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), counted(1).alias("blank"),
                                       counted(2).alias("duplicate"), counted(3).alias("truncated"))
    # Neighbouring roles: inside a block, and from each block's last turn to the next one's first.
    kinds = met.select("_key", "block", F.transform("codes", lambda c: c % 4).alias("k"))
    wrong = lambda a, b: (~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)))).cast("long")
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.size("k") - 1), lambda i: i < F.size("k") - 1), lambda i: wrong(F.get("k", i), F.get("k", i + 1)))
    inner = kinds.select("_key", F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    ahead = kinds.select("_key", (F.col("block") - 1).alias("block"), F.get("k", F.lit(0)).alias("b")).where("block >= 0")
    outer = kinds.select("_key", "block", F.element_at("k", -1).alias("a")).join(ahead, ["_key", "block"]).select("_key", wrong(F.col("a"), F.col("b")).alias("n"))
    illegal = inner.union(outer).groupBy("_key").agg(F.sum("n").alias("illegal"))
    # One shuffle of the texts: edits travel to their turns as rows of the same stream.
    none = lambda t: F.lit(None).cast(t)
    text_rows = turns.select("_key", (F.col("_n") - 1).alias("i"), F.lit(1).alias("tag"), none("array<int>").alias("states"),
                             none("array<int>").alias("codes"), none("int").alias("exit"), "role", F.col("text").cast("binary").alias("text"))
    edit_rows = met.select("_key", F.col("block") * block, F.lit(0), "states", "codes", none("int"), none("string"), none("binary"))
    end_rows = top.select("_key", F.lit(2**62), F.lit(2), none("array<int>"), none("array<int>"), "exit", none("string"), none("binary"))
    stream = text_rows.union(edit_rows).union(end_rows).repartition("_key").sortWithinPartitions("_key", "i", "tag")
    repaired = stream.mapInArrow(_repaired, "_key string, audit string, repaired_sha256 string")
    found = repaired.join(counts, "_key").join(illegal, "_key").join(top.select("_key", "cost"), "_key")
    return found.select(F.when(F.col("_key") != " ", F.col("_key")).cast(conversations.schema[key].dataType).alias(key), "gaps", "blank",
                        "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2
    takes its ``.!?`` away, 3 repeats it, 4 sets its role to user. Nulls are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fate.alias("fate")).where("fate > 0")
    rows = rows.withColumn("text", F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")))
    twice = F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("copy", F.explode(twice)).select("conv_id", "turn", "role", "text")


def digests(conversations: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """The damaged conversations repaired; those with no row left are empty."""
    found = repair(damaged(conversations), block=block, fan=fan).withColumn("conv_none", F.col("conv_id").isNull())
    all_ = conversations.select(F.col("conv_id").alias("id")).distinct()
    met = all_.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return met.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def query(spark, sf_dir):
    return digests(table(spark, sf_dir, "conversations"))
