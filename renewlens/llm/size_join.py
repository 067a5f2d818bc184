"""N-gram Jaccard join: a size-aware heavy-light join over word-shingle sets.

Two sets of a and b shingles link when they have at least ``need(a, b)`` in common. Sets
below a boundary are small: they enumerate, for every pair of sizes, all their subsets of
that many shingles, and sets that have a subset in common are linked, with no pair ever
compared. All others are large: they are posted in inverted lists and scanned. The
boundary is the size at which enumerating costs as much as scanning, by the number of sets
of each size.

An inverted list of a large set is not one shingle's (those of common passages would hold
unrelated texts) but a part's: shingles are dealt by hash to a number of parts fixed by size
class, and linked sets differ in at most d = a + b - 2 need(a, b) shingles, so in at most d
parts. A set with p non-empty parts has at least p - d of them in common with any set it
links with, so of its rarest d + 1 (in one order of all parts, by how many documents hold
them) one is common too. Parts that no other set holds are the rarest: a set with more than
d of these, as of own words around a common passage, is in no list at all.

Links only matter between different components, so a list's sets meet its hub first, and others
only where a link may still join components (``linking``). Every link of large sets is confirmed
on the full sets; no list, set or partner is cut.

Rows: equal sets are one node (a 64-bit digest of the set). Null, empty and wordless texts
have no shingles and no links and are components of their own; a text of fewer words than
a shingle is one shingle. Very long texts are read whole. A component's id is the
smallest id of its rows, null only if all are null; repeated rows give repeated rows. An
empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import cache, lru_cache
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from renewlens.llm.common import python_columns, select_as, table, texts_of, written
from renewlens.llm.linking import connect, with_labels
from renewlens.llm.shingles import node_of, shingle_set

WORDS = 4
PERCENT = 85
#: Sizes up to this one may be small; their shingles are kept for enumeration.
MOST_SMALL = 32
#: What posting, meeting and confirming one entry of a large set costs, in enumerated subsets.
SCAN_COST = 6
#: Ratio of neighbouring size classes, and parts beyond the differences of a class's largest pair.
CLASS_RATIO = 1.4
SPARE_PARTS = 1.25

_U = np.uint64
_CLASSES = sorted({int(CLASS_RATIO**j) for j in range(120)})


def _mix(x):
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def need(a: int, b: int, percent: int = PERCENT) -> int:
    """Common shingles that sets of a and b need: the least i with 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def _sizes(n: int, percent: int) -> tuple[int, int]:
    """Smallest and largest size of a set that one of n can link with."""
    return -(-percent * n // 100), 100 * n // percent


@lru_cache(1 << 14)
def subset_plan(n: int, bound: int, percent: int = PERCENT) -> tuple[tuple[int, int, int], ...]:
    """(smaller size, larger size, subset size) of all pairs of sizes below ``bound`` that n takes part in."""
    low, high = _sizes(n, percent)
    return tuple((min(n, m), max(n, m), need(n, m, percent)) for m in range(max(low, 1), min(high, bound - 1) + 1))


@lru_cache(1 << 14)
def part_plan(n: int, percent: int = PERCENT) -> tuple[tuple[int, int, int], ...]:
    """(class, parts of the class, most parts that differ) for each class of the smaller size of a pair that n takes part in."""
    low, high = _sizes(n, percent)
    differ = lambda total: total * (100 - percent) // (100 + percent)  # noqa: E731  at most, for a + b = total
    out = []
    own = bisect_right(_CLASSES, n) - 1
    for j in range(bisect_right(_CLASSES, max(low, 1)) - 1, own + 1):
        last = _CLASSES[j + 1] - 1
        parts = int(SPARE_PARTS * differ(last + 100 * last // percent)) + 3
        out.append((j, parts, differ(n + (high if j == own else last))))
    return tuple(out)


def boundary(counts: dict[int, int], percent: int = PERCENT) -> int:
    """The size below which sets are small, least in cost over ``counts`` (sets of each size up to MOST_SMALL)."""
    def cost(x):
        small = sum(k * sum(comb(n, s) for *_, s in subset_plan(n, x, percent)) for n, k in counts.items() if n < x)
        large = sum(k * sum(min(n, parts) for _, parts, _ in part_plan(n, percent)) for n, k in counts.items() if n >= _sizes(x, percent)[0])
        return small + SCAN_COST * large

    return min(range(1, MOST_SMALL + 2), key=lambda x: (cost(x), x))


@cache
def _subsets(n: int, size: int) -> np.ndarray:
    return np.array(list(combinations(range(n), size)), np.int64).reshape(-1, size)


def subset_keys(shingles: np.ndarray, bound: int, percent: int = PERCENT):
    """(key, second key, whether this set has the smaller size) of all subsets of a small set."""
    n = len(shingles)
    one, two = _mix(shingles), _mix(shingles + _U(0x9E3779B97F4A7C15))
    first, second, small = [], [], []
    for a, b, size in subset_plan(n, bound, percent):
        at, tag = _subsets(n, size), _mix(np.array([a << 20 | b], _U))
        first.append(_mix(one[at].sum(axis=1, dtype=_U) + tag))
        second.append(_mix(two[at].sum(axis=1, dtype=_U) ^ tag))
        small.append(np.full(len(at), n == a))
    return tuple(np.concatenate(x) for x in (first, second, small))


def part_keys(shingles: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(hash of (class, part, the part's shingles), class << 40 | least number in common) of a set's non-empty parts."""
    out, least = [], []
    for j, parts, differ in part_plan(len(shingles), percent):
        part = (_mix(shingles + _U(j + 1)) % _U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        at, start = np.unique(part[order], return_index=True)
        content = np.add.reduceat(_mix(shingles[order]), start)
        keys = _mix(content + _mix((at + (j << 32)).astype(_U)))
        common = max(len(at) - differ, 0)
        if not common:  # two such sets may only have empty parts in common
            keys = np.append(keys, _mix(np.array([(1 << 60) + j], _U)))
        out.append(keys)
        least.append(np.full(len(keys), (j << 40) + common, np.int64))
    return np.concatenate(out).view(np.int64), np.concatenate(least)


def _signed(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(_id, n_shingles, node, keys, least, small) per document; ``small`` holds the shingles of a set of at most MOST_SMALL."""

    def make():
        def sign(batch):
            sets = [shingle_set(t, size) for t in texts_of(batch, "_text")]
            keys = [part_keys(s, percent) if len(s) else (None, None) for s in sets]
            return {"n_shingles": [len(s) for s in sets], "node": [node_of(s) for s in sets],
                    "keys": [k for k, _ in keys], "least": [x for _, x in keys],
                    "small": [s.view(np.int64) if 0 < len(s) <= MOST_SMALL else None for s in sets]}

        return sign

    return python_columns(select_as(docs, id_col, text_col), make, "n_shingles long, node long, keys array<long>, least array<long>, small array<long>", drop=("_text",))


def _small_links(nodes: DataFrame, bound: int, percent: int) -> DataFrame:
    """(a, b): sets of each subset with the smallest of those of the smaller size; all of them have the subset."""

    def make():
        def spell(batch):
            keys = [subset_keys(np.asarray(s, np.int64).view(_U), bound, percent) for s in batch.column("small").to_pylist()]
            return {"first": [k.view(np.int64) for k, *_ in keys], "second": [k.view(np.int64) for _, k, _ in keys], "least": [x for *_, x in keys]}

        return spell

    spelled = python_columns(nodes.select("node", "small"), make, "first array<long>, second array<long>, least array<boolean>", text=None, drop=("small",))
    rows = spelled.select("node", F.explode(F.arrays_zip("first", "second", "least")).alias("k")).select("node", "k.*")
    hubs = (rows.groupBy("first", "second").agg(F.min(F.when(F.col("least"), F.col("node"))).alias("hub"), F.count(F.lit(1)).alias("k"))
            .where("hub is not null and k > 1").drop("k"))
    return rows.join(hubs, ["first", "second"]).where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()


def _lists(signed: DataFrame) -> DataFrame:
    """(key, node, n, central): the rarest parts of each set that decide, of those that at least two sets
    share. A set is central by how many documents hold its parts."""
    post = signed.select("node", F.col("n_shingles").alias("n"), F.explode(F.arrays_zip("keys", "least")).alias("k")).select("node", "n", "k.keys", "k.least")
    shared = (post.groupBy("keys").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("lo"), F.max("node").alias("hi"))
              .where("lo != hi").select("keys", "k"))
    rows = post.join(shared, "keys").groupBy("node", "least", "keys").agg(F.max("n").alias("n"), F.max("k").alias("k"))
    # A set's own parts: as many as its size has.
    own, mine = Window.partitionBy("node", "least"), F.col("least") % (1 << 40)
    rows = rows.withColumns({"at": F.row_number().over(own.orderBy("k", "keys")), "all": F.count(F.lit(1)).over(own), "sum": F.sum(F.log2("k")).over(own)})
    rows = rows.where(F.col("at") <= F.col("all") - F.greatest(mine, F.lit(1)) + 1)
    return written(rows.select(F.col("keys").alias("key"), "node", "n", (1000 * F.col("sum") / F.col("n")).cast("long").alias("central")), "lists")


def links(nodes: DataFrame, signed: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame | None:
    """(node, label) of all nodes that link with another (their components), or None."""
    counts = {r["n"]: r["k"] for r in nodes.where(F.col("n") <= MOST_SMALL).groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    bound = boundary(counts, percent)
    edges = written(_small_links(nodes.where(F.col("n") < bound), bound, percent), "links")
    lists = _lists(signed.where(F.col("n_shingles") >= _sizes(bound, percent)[0]))
    return connect(lists, nodes, docs, id_col, text_col, size, percent, edges)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per document."""
    signed = written(_signed(docs, id_col, text_col, size, percent), "signed")
    nodes = written(signed.where("node is not null").groupBy("node").agg(
        F.min("_id").alias("rep"), F.max("n_shingles").alias("n"), F.first("small").alias("small")), "nodes")
    labels = links(nodes, signed, docs, id_col, text_col, size, percent)
    marked = with_labels(nodes.select("node", "rep"), labels)
    names = marked.groupBy("label").agg(F.min("rep").alias("name"))
    marked = marked.join(names, "label").select("node", "name")
    found = signed.select("_id", "n_shingles", "node").join(marked, "node", "left")
    return found.select(F.col("_id").alias(id_col), "n_shingles", F.coalesce("name", "_id").alias("component_id"))


def query(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, counted on the full sets, then components by reachability.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id
      GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.v)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM d JOIN r ON r.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
