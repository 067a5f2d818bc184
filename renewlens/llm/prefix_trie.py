"""Conversation prefix trie by a depth-band rollup.

Every distinct sequence of first turns is a node, named by its depth and two 64-bit sums
(exclusive or) of hashes of (position, role, text), so that a prefix sum over a
conversation's turns names all its nodes; rows of a conversation may lie in many tasks.
No text is moved beyond the sort that puts turns in order.

Subtree totals go up in bands of ``BAND`` depths. Each node is represented by its smallest
member, whose own path holds all its ancestors: a node's values explode to those of its
band only (summed along the path on the way), and are summed per ancestor. The
band roots form a trie of their own with a depth ``BAND`` times smaller, which is rolled
up in the same way, until one band is left; its totals are complete. Then completed
band-root totals go to the ancestors in the band above, level by level downwards. A trie of
depth D takes 2 log(D) / log(BAND) rounds, and every round makes at most one row for
each (conversation, turn).

Rows: those with a null id belong to no conversation. Turns go by turn (null first), then
role, then text; repeated rows are turns of their own. Null roles and texts are empty. Very
long texts are hashed where they lie. An empty table has no nodes, not even a root. The
shared prefix of ``conv_id - conv_id % 100`` follows SQL's ``%`` (sign of the id).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from renewlens.llm.common import table, written
from renewlens.llm.turn_order import numbered, spans

#: Depths of a band.
BAND = 16
#: Ids of one piece of a node's list of ended conversations span at most this many numbers.
PIECE_BITS = 12
#: Nodes with at least this share of all nodes as children (so at most as many) are broadcast.
HOT_PARENTS = 1000
#: Most turns taken from the first conversation of a block, and ids of a block.
HEAD = 5
BLOCK = 100

NODE = ["depth", "x1", "x2"]


def _element(position, seed: int):
    return F.xxhash64(F.lit(seed), position, F.col("h1"), F.col("h2"))


def members(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            head: int = HEAD, block: int = BLOCK) -> DataFrame:
    """(c, depth, x1, x2, p1, p2, len, ends): every rebuilt conversation's nodes with their parents, root
    included; ``len`` is the length of the last text, ``ends`` whether the conversation ends here."""
    rows = conversations.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("c"), F.col(turn).alias("t"), F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"))
    slim = rows.withColumns({"h1": F.xxhash64(F.lit(1), "role", "text"), "h2": F.xxhash64(F.lit(2), "role", "text"),
                             "len": F.length("text").cast("long")})
    turns = numbered(slim, "c", ["t", "role", "text"], ["h1", "h2", "len"], "turns").withColumnRenamed("_key", "c")
    own_block = F.col("c") - F.col("c") % block
    # The first turns of every block's first conversation, with prefix names: at most ``head`` rows a block.
    first = turns.where((F.col("c") % block == 0) & (F.col("_n") <= head)).withColumns(
        {"e1": _element(F.col("_n"), 3), "e2": _element(F.col("_n"), 4)})
    up_to = Window.partitionBy("c").orderBy("_n")
    first = first.withColumns({"x1": F.bit_xor("e1").over(up_to), "x2": F.bit_xor("e2").over(up_to)})
    heads = written(first.groupBy(F.col("c").alias("block")).agg(F.sort_array(F.collect_list(
        F.struct(F.col("_n").alias("depth"), "x1", "x2", "e1", "e2", "len"))).alias("heads")), "heads")
    # One row for each conversation and range: a conversation's own rows never meet in one place.
    wanted = F.crc32(F.col("c").cast("string").cast("binary")) % (head + 1)
    parts = turns.groupBy("c", "_part").agg(F.count(F.lit(1)).alias("rows")).withColumns({"block": own_block, "h": wanted})
    parts = parts.join(heads, "block", "left").withColumn("heads", F.slice(F.coalesce("heads", F.array()), 1, F.col("h").cast("int")))
    parts = written(parts.withColumn("m", F.size("heads").cast("long")).drop("block"), "parts")
    # Own turns after the first h, at their rebuilt depths, with prefix names inside their range.
    own = turns.join(parts.select("c", "_part", "h", "m", F.try_element_at("heads", F.lit(-1)).alias("end")), ["c", "_part"])
    own = own.where("_n > h").withColumn("depth", F.col("_n") - F.col("h") + F.col("m"))
    own = own.withColumns({"e1": _element(F.col("depth"), 3), "e2": _element(F.col("depth"), 4)})
    inside = Window.partitionBy("c", "_part").orderBy("_n")
    own = own.withColumns({"x1": F.bit_xor("e1").over(inside), "x2": F.bit_xor("e2").over(inside)})
    own = written(own.select("c", "_part", "depth", "e1", "e2", "x1", "x2", "len", "end"), "own")
    carried = spans(own.withColumnRenamed("c", "_key"), F.bit_xor("e1").alias("t1"), F.bit_xor("e2").alias("t2"))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(F.col("_key").alias("c"), "_part", F.bit_xor("t1").over(earlier).alias("b1"), F.bit_xor("t2").over(earlier).alias("b2"))
    own = own.join(F.broadcast(carried), ["c", "_part"], "left")  # at most two rows a range
    whole = {f"x{i}": F.col(f"x{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0))).bitwiseXOR(F.coalesce(f"end.x{i}", F.lit(0))) for i in (1, 2)}
    named = ["c", "depth", "x1", "x2", "e1", "e2", "len"]
    own = own.withColumns(whole).select(*named)
    convs = parts.groupBy("c").agg(F.sum("rows").alias("rows"), F.max("h").alias("h"), F.max("m").alias("m"),
                                   F.max("heads").alias("heads"))
    convs = convs.withColumn("total", F.col("m") + F.greatest(F.col("rows") - F.col("h"), F.lit(0)))
    zero = F.lit(0).cast("long")
    taken = convs.select("c", F.explode("heads").alias("t")).select("c", *[F.col(f"t.{n}") for n in named[1:]])
    root = convs.select("c", *[zero.alias(n) for n in named[1:]])
    every = own.union(taken).union(root)
    every = every.join(convs.select("c", F.col("total").alias("depth"), F.lit(True).alias("ends")), ["c", "depth"], "left")
    return written(every.select("c", *NODE, F.col("x1").bitwiseXOR(F.col("e1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("e2")).alias("p2"),
                                "len", F.coalesce("ends", F.lit(False)).alias("ends")), "members")


def _nodes(paths: DataFrame) -> DataFrame:
    """(depth, x1, x2, c, p1, p2, n_convs, n_children, leaf, saved) per node; ``c`` is its smallest member."""
    nodes = written(paths.groupBy(*NODE).agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n_convs"), F.min("p1").alias("p1"),
                                             F.min("p2").alias("p2"), F.min("len").alias("len")), "nodes")
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    return written(nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"),
                                      "saved": (F.col("n_convs") - 1) * F.col("len")}), "nodes")


def subtree_totals(paths: DataFrame, nodes: DataFrame, band: int = BAND) -> DataFrame:
    """(depth, x1, x2, leaf, saved): sums over the subtree of every node, itself included."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = [F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")]
    value, stride, levels = nodes.select("c", *NODE, "leaf", "saved"), 1, []
    while True:
        # Upwards: each node's values to its ancestors in its band, along the path of its smallest member.
        here = paths.where(F.col("depth") % stride == 0).select("c", *NODE).withColumn("band", F.expr(f"depth div {stride * band}"))
        rep = value.select("c", "depth", F.expr(f"depth div {stride * band}").alias("band"), "leaf", "saved")
        below = Window.partitionBy("c", "band").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
        sent = here.join(rep, ["c", "band", "depth"], "left").withColumns({n: F.sum(n).over(below) for n in ("leaf", "saved")})
        inside = sent.where("leaf is not null").groupBy(*NODE).agg(F.min("c").alias("c"), *sums)
        levels.append((stride, written(inside, "band")))
        stride *= band
        if stride > deepest:
            break
        value = levels[-1][1].where(F.col("depth") % stride == 0)
    total = levels.pop()[1]
    while levels:
        # Downwards: each completed band root's total to its ancestors in the band above.
        stride, inside = levels.pop()
        wide = stride * band
        roots = total.where("depth > 0").select("c", F.expr(f"depth div {wide} - 1").alias("band"), "leaf", "saved")
        above = paths.where(F.col("depth") % stride == 0).select("c", *NODE).withColumn("band", F.expr(f"depth div {wide}"))
        got = above.join(roots, ["c", "band"]).select("c", *NODE, "leaf", "saved")
        both = inside.select("c", *NODE, "leaf", "saved").union(got)
        total = written(both.groupBy(*NODE).agg(F.min("c").alias("c"), *sums), "band")
    return total.drop("c")


def _with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with parent_conv_id. Parents of many nodes are broadcast (at most HOT_PARENTS rows), the rest joined."""
    most = nodes.count() / HOT_PARENTS
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"),
                                                   F.col("c").alias("parent_conv_id"), "n_children")
    up = ["depth", "p1", "p2"]
    hot = F.broadcast(parents.where(F.col("n_children") >= most).drop("n_children"))
    cold = parents.where(F.col("n_children") < most).drop("n_children")
    kids = nodes.where("depth > 0")
    met = kids.join(hot, up).unionByName(kids.join(hot, up, "left_anti").join(cold, up))
    return met.unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))


def _long_digests(batches):
    """(depth, x1, x2, sha) from pieces in order: SHA-256 is a chain, so a node's pieces stream through one
    task, one at a time."""
    at, digest, out = None, None, []

    def rows():
        cols = list(zip(*out)) or [[], [], [], []]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 3 + (pa.string(),))], names=[*NODE, "sha"])

    for batch in batches:
        cols = batch.to_pydict()
        for *node, piece in zip(*(cols[n] for n in (*NODE, "piece"))):
            if node != at:
                if at is not None:
                    out.append((*at, digest.hexdigest()))
                at, digest = node, hashlib.sha256(piece.encode())
            else:
                digest.update(b",")
                digest.update(piece.encode())
        yield rows()
    if at is not None:
        out.append((*at, digest.hexdigest()))
        yield rows()


def end_digests(paths: DataFrame) -> DataFrame:
    """(depth, x1, x2, sha): SHA-256 of the ascending ids of the conversations that end at a node, if any."""
    pieces = written(paths.where("ends").groupBy(*NODE, F.shiftright("c", PIECE_BITS).alias("at")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("piece")), "ends")
    count = pieces.groupBy(*NODE).agg(F.count(F.lit(1)).alias("k"), F.min("at").alias("at"))
    one = pieces.join(count.where("k = 1"), [*NODE, "at"]).select(*NODE, F.sha2(F.col("piece").cast("binary"), 256).alias("sha"))
    long = pieces.join(count.where("k > 1").select(*NODE), NODE, "left_semi")
    many = long.repartition(*NODE).sortWithinPartitions(*NODE, "at").select(*NODE, "piece").mapInArrow(
        _long_digests, "depth long, x1 long, x2 long, sha string")
    return one.union(many)


def prefix_trie(conversations: DataFrame, band: int = BAND, **columns) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    paths = members(conversations, **columns)
    nodes = _nodes(paths)
    totals = subtree_totals(paths, nodes, band)
    found = _with_parents(nodes).join(totals.select(*NODE, F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens")), NODE)
    found = found.join(end_digests(paths), NODE, "left")
    return found.select(F.col("c").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def query(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: crc32 of the text {s} (ASCII), bit by bit.
CRC32 = """(4294967295 - list_reduce(list_transform(range(1, length({s}) + 1), lambda i: CAST(ascii(substr({s}, CAST(i AS INT), 1)) AS BIGINT)),
    lambda r, b: list_reduce(range(8), lambda q, k: CASE WHEN q & 1 = 1 THEN xor(q >> 1, 3988292384) ELSE q >> 1 END, xor(r, b)), 4294967295))"""

#: Every rebuilt conversation as a list, its prefixes grouped as they are.
ORACLE = f"""
WITH o AS (SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t, turn FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, list(t ORDER BY turn NULLS FIRST, t.role, t.text) AS ts FROM o GROUP BY conv_id),
h AS (SELECT conv_id, ts, CAST({CRC32.format(s='s')} % 6 AS INT) AS h FROM l),
r AS (SELECT h.conv_id, list_concat(coalesce(f.ts[1:h.h], []), h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN l f ON f.conv_id = h.conv_id - h.conv_id % 100),
m AS (SELECT conv_id, ts, d, ts[1:d] AS path FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM r)),
n AS (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(ts) = d), '')) AS ends_sha256
      FROM m GROUP BY d, path),
k AS (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, (n.n_convs - 1) * CASE WHEN n.d = 0 THEN 0 ELSE length(n.path[n.d].text) END AS saved
      FROM n LEFT JOIN k ON k.d = n.d AND k.path = n.path),
t AS (SELECT m.d, m.path, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, sum(v.saved) AS saved_tokens
      FROM v JOIN m ON m.conv_id = v.conv_id AND m.d <= v.d GROUP BY ALL)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, t.n_leaves,
       CAST(t.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN t ON t.d = v.d AND t.path = v.path LEFT JOIN n p ON v.d > 0 AND p.d = v.d - 1 AND p.path = v.path[1:v.d - 1]
"""
