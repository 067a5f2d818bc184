"""Resharding by minimum-cost flow.

Documents lie in old shards (by default the hash of the text decides, so equal
texts lie together). Each old shard is divided into blocks; the sizes of the old
shards and the capacities of the new ones (the total divided evenly) make a
transport problem: a byte that stays costs nothing, a byte that moves costs one.
The flow that moves the fewest bytes is solved on the driver over the shard
graph alone (old x new shards); blocks, in a fixed order, are then dealt to the
flow's intervals, and only files of blocks that move are rewritten.

The law is ``bytes``: shard sizes differ by about a block. A text whose copies exceed
the block limit is split by document; the rest of a block over the limit is split by
text, so all other equal texts stay together. Null texts have size 1 and belong together
with empty ones of size 1. Repeated rows are placed like any others and get
slots of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from renewlens.llm.common import table, written

#: Blocks per old shard before hot ones are split.
BLOCKS = 2048
#: Old shards of the registered query; it goes from these to the new number.
OLD_SHARDS = 12
NEW_SHARDS = 16


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> list[list[int]]:
    """Cheapest flow of all of ``supply`` into ``capacity``; successive shortest paths with potentials.

    ``cost(i, j)`` is the cost of a byte from old shard i in new shard j (>= 0).
    The graph has one node per shard, whatever the number of rows.
    """
    a, b = len(supply), len(capacity)
    n, src, dst = a + b + 2, a + b, a + b + 1
    arcs: list[list[int]] = []
    out: list[list[int]] = [[] for _ in range(n)]

    def arc(u, v, room, price):
        out[u].append(len(arcs))
        arcs.append([v, room, price])
        out[v].append(len(arcs))
        arcs.append([u, 0, -price])

    for i, s in enumerate(supply):
        arc(src, i, s, 0)
    for i in range(a):
        for j in range(b):
            arc(i, a + j, supply[i], cost(i, j))
    for j, c in enumerate(capacity):
        arc(a + j, dst, c, 0)
    potential = [0] * n
    while True:
        dist, came = [None] * n, [-1] * n
        dist[src] = 0
        heap = [(0, src)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for k in out[u]:
                v, room, price = arcs[k]
                if room > 0:
                    e = d + price + potential[u] - potential[v]
                    if dist[v] is None or e < dist[v]:
                        dist[v], came[v] = e, k
                        heapq.heappush(heap, (e, v))
        if dist[dst] is None:
            break
        for v in range(n):
            if dist[v] is not None:
                potential[v] += dist[v]
        push, v = None, dst
        while v != src:
            k = came[v]
            push = arcs[k][1] if push is None else min(push, arcs[k][1])
            v = arcs[k ^ 1][0]
        v = dst
        while v != src:
            k = came[v]
            arcs[k][1] -= push
            arcs[k ^ 1][1] += push
            v = arcs[k ^ 1][0]
    flow = [[0] * b for _ in range(a)]
    for u in range(a):
        for k in out[u]:
            v = arcs[k][0]
            if k % 2 == 0 and a <= v < a + b:
                flow[u][v - a] = arcs[k ^ 1][1]
    return flow


def even_capacities(total: int, shards: int) -> list[int]:
    """``total`` bytes over ``shards``, at most one byte apart."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus one; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def block_table(rows: DataFrame, blocks: int) -> DataFrame:
    """(old, block, bytes, limit): every block's size and the size from which it is split.

    One row per old shard and block, so its size does not depend on the rows.
    """
    sums = rows.groupBy("old", "block").agg(F.sum("size").alias("bytes"))
    total = sums.agg(F.sum("bytes").alias("total"), F.countDistinct("old").alias("n_old"))
    limit = F.greatest(F.lit(1), 2 * F.col("total") / (F.greatest(F.col("n_old"), F.lit(1)) * blocks))
    return sums.join(F.broadcast(total)).select("old", "block", "bytes", limit.cast("double").alias("limit"))


def hot_tables(rows: DataFrame, table_of_blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(old, block, parts) of blocks over the limit and (old, block, _h, first, split) of texts over it.

    A hot block's other texts are dealt by hash to its ``parts``; a hot text's documents to the
    ``split`` parts from ``first`` on. Both tables are bounded: what exceeds the limit is at most
    half as often as there are blocks.
    """
    over = table_of_blocks.where(F.col("bytes") > F.col("limit"))
    texts = (rows.join(F.broadcast(over.select("old", "block", "limit")), ["old", "block"])
             .groupBy("old", "block", "_h", "limit").agg(F.sum("size").alias("b")).where(F.col("b") > F.col("limit"))
             .select("old", "block", "_h", "b", F.ceil(F.col("b") / F.col("limit")).cast("int").alias("split")))
    texts = written(texts, "hot-texts")
    rest = (over.join(texts.groupBy("old", "block").agg(F.sum("b").alias("hot")), ["old", "block"], "left")
            .withColumn("rest", F.col("bytes") - F.coalesce("hot", F.lit(0))))
    blocks = rest.select("old", "block", F.greatest(F.lit(1), F.ceil(F.col("rest") / F.col("limit"))).cast("int").alias("parts"))
    before = F.sum("split").over(Window.partitionBy("old", "block").orderBy("_h")) - F.col("split")
    split = texts.join(blocks, ["old", "block"]).select(
        "old", "block", "_h", (F.col("parts") + before).cast("int").alias("first"), "split")
    return written(blocks, "hot-blocks"), written(split, "hot-split")


def reshard(docs: DataFrame, new_shards: int = NEW_SHARDS, old: Column | None = None, old_shards: int = OLD_SHARDS,
            id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS, with_text: bool = False) -> DataFrame:
    """Place every document: ``doc_id, size, text_crc32, old_shard, shard, slot, moved`` (and ``text``).

    ``old`` is the old shard (0 ..) of a row; by default the text's hash over ``old_shards``.
    """
    text = F.col(text_col)
    named = docs.select(
        F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_h"),
        (old if old is not None else F.lit(None).cast("int")).alias("_old"))
    rows = named.select(
        "_id", *(["_text"] if with_text else []), text_size(F.col("_text")).alias("size"),
        F.crc32(F.coalesce(F.col("_text"), F.lit("")).cast("binary")).alias("crc"), "_h",
        F.coalesce(F.col("_old"), F.pmod("_h", F.lit(old_shards)).cast("int")).alias("old"),
        F.pmod(F.shiftright("_h", 20), F.lit(blocks)).cast("int").alias("block"))
    # The placement is planned on block sums: at most old shards x blocks rows (plus the parts of hot
    # blocks, of which there are at most old shards x blocks / 2), so these tables may be broadcast.
    hot_blocks, hot_texts = hot_tables(rows, written(block_table(rows, blocks), "blocks"))
    by_doc = F.col("first") + F.pmod(F.xxhash64("_id", F.col("_h")), F.col("split").cast("long"))
    by_text = F.pmod(F.xxhash64("_h"), F.coalesce("parts", F.lit(1)).cast("long"))
    placed = (rows.join(F.broadcast(hot_blocks), ["old", "block"], "left")
              .join(F.broadcast(hot_texts), ["old", "block", "_h"], "left")
              .withColumn("part", F.coalesce(by_doc, by_text).cast("int")).drop("parts", "first", "split"))
    sums = written(placed.groupBy("old", "block", "part").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "block-parts")
    supply_of = {r["old"]: int(r["b"]) for r in sums.groupBy("old").agg(F.sum("bytes").alias("b")).collect()}
    a = max(supply_of, default=-1) + 1
    supply = [supply_of.get(i, 0) for i in range(a)]
    flow = min_cost_flow(supply, even_capacities(sum(supply), new_shards), lambda i, j: 0 if i == j else 1)
    # Each old shard's bytes are an interval, cut where the flow says; a block goes where its middle lies.
    cuts = []
    for i, row in enumerate(flow):
        at = 0
        order = ([i] if i < new_shards else []) + [j for j in range(new_shards) if j != i]
        for j in order:
            if row[j]:
                cuts.append((i, at, at + row[j], j))
                at += row[j]
    spark = docs.sparkSession
    cut = spark.createDataFrame(cuts or [(0, 0, 0, 0)], "old int, low long, high long, shard int")
    w = Window.partitionBy("old").orderBy("block", "part")
    middle = sums.withColumn("mid", F.sum("bytes").over(w) - F.col("bytes") + F.floor(F.col("bytes") / 2))
    dealt = (middle.join(F.broadcast(cut), "old").where("mid >= low and mid < high")
             .withColumn("first", F.sum("n").over(Window.partitionBy("shard").orderBy("old", "block", "part")) - F.col("n"))
             .select("old", "block", "part", "shard", "first"))
    dealt = written(dealt, "dealt")
    within = Window.partitionBy("old", "block", "part").orderBy("_id", "crc", "size")
    full = placed.join(F.broadcast(dealt), ["old", "block", "part"])
    return full.withColumn("slot", F.col("first") + F.row_number().over(within) - 1).select(
        F.col("_id").alias(id_col), *([F.col("_text").alias(text_col)] if with_text else []), "size",
        F.col("crc").alias("text_crc32"), F.col("old").alias("old_shard"), "shard", "slot",
        (F.col("old") != F.col("shard")).alias("moved"))


def rewrite_shards(placed: DataFrame, path: str, affected_only: bool = True) -> None:
    """Write the new shards' files under ``path`` (``shard=N/``).

    With ``affected_only`` just the rows that changed shard are written, one set of
    files per receiving shard; what stays is left in the old files.
    """
    rows = placed.where("moved") if affected_only else placed
    rows.write.partitionBy("shard").option("compression", "zstd").parquet(path)


def query(spark, sf_dir):
    """Law ``bytes``: from 12 shards to 16; the shard files are written and read back."""
    from renewlens.llm.common import scratch_path

    placed = reshard(table(spark, sf_dir, "documents"), with_text=True)
    path = scratch_path(spark, "shards")
    rewrite_shards(placed, path, affected_only=False)
    back = spark.read.schema(placed.schema).parquet(path)
    return back.select(
        "doc_id", text_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")
