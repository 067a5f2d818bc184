"""op12 and op13: against brute force."""

import hashlib
import heapq
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_data import SF_ORACLE, with_extras
from oracle import compare
from pyspark.sql import functions as F

from renewlens.llm import prefix_trie, structure_repair

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def talks():
    """Nulls everywhere, ties, repeated rows, deep and common conversations, missing first ones."""
    rng = random.Random(12)
    texts = ["", " ", "Yes.", "No!", "why", "café \U0001F600.", "well? \n", "x" * 3000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None]
    rows = []
    for c in [0, 1, 2, 3, 5, 17, 99, 100, 104, 150, 199, 250, 251, 299, 1003, 1004, -1, -150]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.8 else rng.choice(roles), rng.choice(texts)))
    for c in [300, 301, 302, 303, 304, 305]:  # one deep conversation for many
        rows += [(c, t, ["user", "assistant"][t % 2], f"turn {t % 7}.") for t in range(90)]
    rows += [(306, t, "user", "turn 1.") for t in range(45)]
    rows += [(7, None, "user", "late."), (7, None, "user", "late."), (7, 2, None, None), (7, 2, "user", "b."), (7, 2, "user", "a."), (7, 11, "assistant", "z.")]
    rows += [(None, 1, "user", "a."), (None, None, None, "b."), (8, 0, None, None), (9, 4, "system", "s.")]
    rng.shuffle(rows)
    return rows


def ordered(rows):
    out = defaultdict(list)
    for c, t, r, x in rows:
        out[c].append((t is not None, t or 0, r, x))
    return {c: [(r, x) for *_, r, x in sorted(v, key=lambda w: (w[0], w[1], w[2].encode(), w[3].encode()))] for c, v in out.items()}


def trie(rows):
    own = ordered([(c, t, r or "", x or "") for c, t, r, x in rows if c is not None])
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        block = c - (abs(c) % 100) * (1 if c > 0 else -1)
        built[c] = tuple(own.get(block, [])[:h] + ts[h:])
    at = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            at[ts[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for n in at:
        if n:
            kids[n[:-1]] += 1
    for n, m in at.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += (len(m) - 1) * (len(n[-1][1]) if n else 0)
    return sorted((min(m), len(n), min(at[n[:-1]]) if n else -10**9, len(m), kids[n], leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(n)))).encode()).hexdigest()) for n, m in at.items())


def nodes(df):
    return sorted((r["conv_id"], r["depth"], -10**9 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"],
                   r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


def test_trie_equals_brute_force(spark, talks):
    df = with_extras(spark.createDataFrame(talks, SCHEMA)).withColumns({"c": F.lit(1), "depth": F.lit(2), "x1": F.lit(3), "band": F.lit(4)})
    want = trie(talks)
    assert max(r[1] for r in want) == 90
    # bands of 16 leave one rollup of band roots, bands of 3 four
    assert nodes(prefix_trie.prefix_trie(df)) == want
    assert nodes(prefix_trie.prefix_trie(df, band=3)) == want
    empty = prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0


@pytest.fixture
def many_ranges(spark):
    """No joining of small partitions: conversations reach over several ranges."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_trie_over_many_ranges(spark, talks, many_ranges):
    assert nodes(prefix_trie.prefix_trie(spark.createDataFrame(talks, SCHEMA), band=5)) == trie(talks)


def test_trie_long_end_lists(spark):
    """More conversations end at one node than fit one piece."""
    rows = [(c, 0, "user", "same") for c in range(0, 3 * 4096 + 5, 3) if zlib.crc32(str(c).encode()) % 6 == 0]
    assert nodes(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == trie(rows)


def test_trie_sql(spark, duck):
    ok, msg = compare(prefix_trie.query(spark, SF_ORACLE), duck, prefix_trie.ORACLE)
    assert ok, msg


def test_positions_over_many_ranges(spark, many_ranges):
    """One key over all ranges, with equal rows, is numbered without gaps."""
    from renewlens.llm.turn_order import numbered

    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 7L, id % 11) as k", "if(id % 2 = 0, null, id div 50) as t", "id % 4 as x")
    got = numbered(rows.repartition(6), "k", ["t"], ["t", "x"], "n").toPandas()
    for _, g in got.groupby("_key"):
        assert sorted(g["_n"]) == list(range(1, len(g) + 1))
        t = g.sort_values("_n")["t"].fillna(-1).tolist()
        assert t == sorted(t)
    assert got.groupby("_key")["_part"].nunique().max() > 2


BLANK = " \t\n\v\f\r"
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}
NAMES = {"s": "system", "u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for c, t, r, x in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(key.encode()) % 20
        if k == 1:
            x = ""
        if k == 2:
            x = x.translate({ord(a): None for a in ".!?"})
        if k == 4:
            r = "user"
        out += [(c, t, r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def cheapest(turns, faults):
    """Dijkstra by (cost, audit) over (turn, last initial): every edit one letter."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(turns) and last in ("", "a"):
            return cost, audit, out
        for z in FOLLOWS[last].replace("s", ""):
            heapq.heappush(heap, (cost + 3, audit + "I", i, z, (*out, f"{NAMES[z]}:")))
        if i < len(turns):
            role, text = turns[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, out))
            if faults[i] in (None, "truncated"):
                more = 3 * (faults[i] == "truncated")
                if role[:1] and role[:1] in FOLLOWS[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*out, f"{role}:{text}")))
                for z in FOLLOWS[last].replace("s", ""):
                    heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, z, (*out, f"{NAMES[z]}:{text}")))


def all_audits(turns, faults, most):
    """The least (cost, audit) by plain enumeration of edits of up to ``most`` letters."""
    best = None
    for n in range(most + 1):
        for word in itertools.product("DIKR", repeat=n):
            i, last, cost = 0, "", 0
            for z in word:
                if z == "I":
                    last, cost = FOLLOWS[last].replace("s", ""), cost + 3
                    continue
                if i == len(turns):
                    break
                if z == "D":
                    cost += 4
                else:
                    if faults[i] in ("blank", "duplicate") or z == "K" and turns[i][0][:1] not in list(FOLLOWS[last]):
                        break
                    cost += 3 * (faults[i] == "truncated") + 3 * (z == "R")
                    last = turns[i][0][0] if z == "K" else FOLLOWS[last].replace("s", "")
                i += 1
            else:
                if i == len(turns) and last in ("", "a"):
                    best = min(best or (10**9, ""), (cost, "".join(word)))
    return best


def fault_list(turns):
    seen, out = set(), []
    for r, x in turns:
        end = x.rstrip(BLANK)
        out.append("blank" if not end else "duplicate" if (r, x) in seen else "truncated" if end[-1] not in ".!?" else None)
        seen.add((r, x))
    return out


def repairs(rows):
    bad = damage(rows)
    left, ts = ordered(bad), defaultdict(list)
    for c, t, *_ in bad:
        ts[c].append(t)
    out = []
    for c in {r[0] for r in rows}:
        turns = left.get(c, [])
        faults = fault_list(turns)
        known = {t for t in ts[c] if t is not None}
        cost, audit, lines = cheapest(turns, faults)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(turns, turns[1:])]
        out.append((str(c), max(known) - min(known) + 1 - len(known) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((str(r["conv_id"]), *(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))) for r in df.collect())


def test_repair_equals_shortest_paths(spark, talks):
    df = with_extras(spark.createDataFrame(talks, SCHEMA)).withColumns({"code": F.lit(1), "i": F.lit(2), "states": F.lit(3), "same": F.lit(4)})
    want = repairs(talks)
    assert rows_of(structure_repair.digests(df)) == want
    # blocks of 4 turns, summed up by 3: four levels
    assert rows_of(structure_repair.digests(df, block=4, fan=3)) == want
    assert structure_repair.digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repair_over_many_ranges(spark, talks, many_ranges):
    assert rows_of(structure_repair.digests(spark.createDataFrame(talks, SCHEMA), block=7, fan=2)) == repairs(talks)


def test_repair_given_table(spark):
    df = spark.read.parquet(f"{SF_ORACLE}/conversations.parquet")
    assert rows_of(structure_repair.query(spark, SF_ORACLE)) == repairs([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_crossings_are_cheapest_and_least():
    """Random turns: blocks, ranks and halving against enumeration and shortest paths."""
    rng = random.Random(5)
    cost, rank, letters = structure_repair.turn_tables()
    for trial in range(300):
        n = rng.randint(0, 4 if trial < 60 else 40)
        turns = [(rng.choice(["system", "user", "assistant", "tool", ""]), "") for _ in range(n)]
        faults = [rng.choice([None, None, "blank", "truncated"]) for _ in range(n)]
        codes = np.array([["s", "u", "a"].index(r[0]) if r[:1] in ("s", "u", "a") and r else 3 for r, _ in turns], int)
        codes += np.array([{None: 0, "truncated": 4, "blank": 8}[f] for f in faults], int)
        want = cheapest(turns, faults)[:2]
        if n <= 4 and trial < 60:
            assert want == all_audits(turns, faults, 2 * n if n < 4 else 6)
        if n == 0:
            continue
        lengths = np.array([n])
        step = lambda row, at: (cost[codes[at]], rank[codes[at]])  # noqa: B023, E731
        total, to = structure_repair.close(*structure_repair.summed(lengths, step))
        states = structure_repair.crossings(lengths, np.zeros(1, int), to, step)[0]
        audit = "".join(letters[c][s][t] for c, s, t in zip(codes, states, states[1:])) + structure_repair.CLOSING[to[0]]
        assert (total[0], audit) == want
