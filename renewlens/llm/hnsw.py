"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Equal vectors are one node; nodes are dealt to shards by hash. A shard's graph has
levels: every node lies on level 0, one in ``1 / LEVEL`` of a level's nodes on the next.
Nodes are inserted in random order, in groups that double in size; a node links to near
nodes inserted before or with it, chosen so that links point in different directions,
and links are returned within each node's limit. Levels are stored as flat neighbour
arrays. For inner products the vectors are padded to one length with one more number
(zero in queries), so near and large-inner-product agree.

A search descends from the top level and walks level 0 with a beam, many queries at a
time; every query visits every shard, results are scored in double precision on the
original vectors and merged per query. Queries travel in blocks, so that a task holds
one shard and one block.

Rows: vectors that are null, empty, zero or hold a null or non-finite number take no
part, nor do null ids; vectors of different lengths are indexed apart and never meet;
equal rows count once; components keep the column's type (single or double precision); equal vectors keep as many of their smallest ids as any result
can hold; ties go to the smaller id; with fewer candidates all are returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from renewlens.llm.common import table, written

SHARD = 8192
BLOCK = 8192
LEVEL = 16
LINKS = 32
UPPER_LINKS = 16
#: Nearest nodes among which links are chosen.
CANDIDATES = 64
BEAM = 128
UPPER_BEAM = 8
#: Nodes of a query's beam that are opened at a time.
OPEN = 4
#: Queries that walk together.
LANES = 256


def _diverse(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Up to m of each row's candidates (nearest first, -1 for none): first those nearer to the
    row's node than to any candidate taken before, then the nearest of the rest."""
    out = np.full((len(cand), m), -1, np.int32)
    for a in range(0, len(cand), 512):
        c, s = cand[a : a + 512], sims[a : a + 512]
        v = x[np.maximum(c, 0)]
        between = v @ v.transpose(0, 2, 1)
        taken = np.zeros(c.shape, bool)
        for r in range(c.shape[1]):
            close = np.where(taken, between[:, r, :], -np.inf).max(axis=1)
            taken[:, r] = (c[:, r] >= 0) & (close < s[:, r])
        rank = np.where(c < 0, 2, np.where(taken, 0, 1)) * c.shape[1] + np.arange(c.shape[1])[None, :]
        first = np.argsort(rank, axis=1, kind="stable")[:, :m]
        out[a : a + 512, : first.shape[1]] = np.take_along_axis(c, first, 1)
    return out


def build_level(x: np.ndarray, m: int) -> np.ndarray:
    """(n, m) neighbour array of the nodes ``x``, inserted in their order."""
    n = len(x)
    links = np.full((n, m), -1, np.int32)
    a = 0
    while a < n:
        b = min(n, max(2 * m, 2 * a))
        c = min(CANDIDATES, b - 1)
        if c < 1:
            break
        chosen = []
        for i in range(a, b, 1024):
            rows = np.arange(i, min(b, i + 1024))
            s = x[rows] @ x[:b].T
            s[np.arange(len(rows)), rows] = -np.inf
            near = np.argpartition(-s, c - 1, axis=1)[:, :c]
            sim = np.take_along_axis(s, near, 1)
            order = np.argsort(-sim, axis=1, kind="stable")
            near, sim = np.take_along_axis(near, order, 1), np.take_along_axis(sim, order, 1)
            chosen.append(_diverse(x, near.astype(np.int32), sim, m // 2))
        links[a:b, : m // 2] = np.concatenate(chosen)
        _return_links(x, links, a, b, m)
        a = b
    return links


def _return_links(x: np.ndarray, links: np.ndarray, a: int, b: int, m: int) -> None:
    """Add the links from [a, b) in the other direction; nodes over their limit choose anew."""
    src = np.repeat(np.arange(a, b, dtype=np.int32), m // 2)
    dst = links[a:b, : m // 2].ravel()
    ok = dst >= 0
    src, dst = src[ok], dst[ok]
    touched = np.unique(dst)
    old = links[touched]
    keep = old >= 0
    node = np.concatenate([dst, np.repeat(touched, keep.sum(axis=1))])
    other = np.concatenate([src, old[keep]])
    pair = np.unique(node.astype(np.int64) * len(x) + other)
    node, other = pair // len(x), pair % len(x)
    sim = np.einsum("ij,ij->i", x[node], x[other])
    order = np.lexsort((other, -sim, node))
    node, other, sim = node[order], other[order], sim[order]
    start = np.searchsorted(node, touched)
    place = np.arange(len(node)) - np.repeat(start, np.diff(np.append(start, len(node))))
    width = int(min(CANDIDATES, place.max() + 1)) if len(place) else 0
    row = np.searchsorted(touched, node)
    cand, sims = np.full((len(touched), width), -1, np.int32), np.full((len(touched), width), -np.inf, np.float32)
    fit = place < width
    cand[row[fit], place[fit]], sims[row[fit], place[fit]] = other[fit], sim[fit]
    links[touched] = _diverse(x, cand, sims, m) if width > m else np.pad(cand, ((0, 0), (0, m - width)), constant_values=-1)


def _single(x: np.ndarray) -> np.ndarray:
    """Single precision for the walk; vectors beyond its comfortable range are scaled, which keeps the order."""
    top = float(np.abs(x).max(initial=0))
    return (x if 1e-15 < top < 1e15 or not top else x / top).astype(np.float32)


class Graph:
    """One shard: vectors, and per level the nodes' neighbour rows (flat arrays)."""

    def __init__(self, vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors, self.levels = vectors, levels

    @staticmethod
    def padded(vectors: np.ndarray) -> np.ndarray:
        square = np.einsum("ij,ij->i", vectors.astype(float), vectors.astype(float))
        return np.hstack([vectors, np.sqrt(np.maximum(square.max(initial=0) - square, 0))[:, None]]).astype(np.float32)

    @staticmethod
    def build(vectors: np.ndarray, seed: int) -> "Graph":
        n = len(vectors)
        rng = np.random.default_rng(seed)
        order, height = rng.permutation(n), (-np.log(1 - rng.random(n)) / np.log(LEVEL)).astype(int)
        x = Graph.padded(vectors)
        levels = []
        for level in range(int(height.max(initial=0)) + 1):
            ids = order[height[order] >= level]
            if level and len(ids) <= 1:
                break
            local = build_level(x[ids], LINKS if level == 0 else UPPER_LINKS)
            levels.append((ids, np.where(local >= 0, ids[np.maximum(local, 0)], -1).astype(np.int32)))
        return Graph(vectors, levels)

    def search(self, queries: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(ids, single-precision products) of the k best found per query, best first; -1 for none."""
        n = len(self.vectors)
        top = self.levels[-1][0]
        entry = np.repeat(top[:UPPER_BEAM][None, :], len(queries), axis=0)
        for level in range(len(self.levels) - 1, -1, -1):
            ids, rows = self.levels[level]
            links = np.full((n, rows.shape[1]), -1, np.int32)
            links[ids] = rows
            entry, sims = self._walk(queries, links, entry, UPPER_BEAM if level else max(beam, k))
        return entry[:, :k], sims[:, :k]

    def _walk(self, q: np.ndarray, links: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        x, b = self.vectors, len(q)
        ids = np.full((b, width), -1, np.int64)
        sims = np.full((b, width), -np.inf, np.float32)
        opened = np.ones((b, width), bool)
        seen = np.zeros((b, len(x) + 1), bool)  # the last column stands for -1
        w = min(width, entry.shape[1])
        ids[:, :w] = entry[:, :w]
        good = ids[:, :w] >= 0
        sims[:, :w] = np.where(good, np.matmul(x[np.maximum(ids[:, :w], 0)], q[:, :, None])[:, :, 0], -np.inf)
        opened[:, :w] = ~good
        seen[np.arange(b)[:, None], ids] = True
        while True:
            live = np.flatnonzero(~opened.all(axis=1))
            if not len(live):
                break
            waiting = np.where(opened[live], -np.inf, sims[live])
            width_open = min(OPEN, width)
            pick = np.argpartition(-waiting, width_open - 1, axis=1)[:, :width_open]
            real = np.take_along_axis(waiting, pick, 1) > -np.inf
            nodes = np.where(real, ids[live[:, None], pick], -1)
            opened[live[:, None], pick] = True
            near = np.where((nodes >= 0)[:, :, None], links[np.maximum(nodes, 0)], -1).reshape(len(live), -1)
            near.sort(axis=1)
            fresh = (near >= 0) & ~seen[live[:, None], near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            seen[live[:, None], near] = True
            s = np.full(near.shape, -np.inf, np.float32)
            r, c = np.nonzero(fresh)
            s[r, c] = np.einsum("ij,ij->i", x[near[r, c]], q[live[r]])
            all_s = np.concatenate([sims[live], s], axis=1)
            all_i = np.concatenate([ids[live], near], axis=1)
            all_o = np.concatenate([opened[live], ~fresh], axis=1)
            best = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            sims[live] = np.take_along_axis(all_s, best, 1)
            ids[live] = np.where(np.isneginf(sims[live]), -1, np.take_along_axis(all_i, best, 1))
            opened[live] = np.take_along_axis(all_o, best, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(_id, v) of the rows that take part; v stays in single precision if it is, all else is double."""
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    v = F.col(vector_col).cast(f"array<{'float' if kind == 'float' else 'double'}>")
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), v.alias("v"))
    return rows.where(F.col("_id").isNotNull() & _usable(F.col("v")))


def _type(vectors: DataFrame) -> tuple[str, type]:
    """Spark's and numpy's type of the components of ``v``."""
    kind = vectors.schema["v"].dataType.elementType.simpleString()
    return kind, np.float32 if kind == "float" else np.float64


def nodes_of(vectors: DataFrame, id_col: str, vector_col: str, keep: int) -> DataFrame:
    """(node, v, members): distinct vectors, named by their smallest id, with at most ``keep`` smallest ids."""
    rows = _rows(vectors, id_col, vector_col).distinct()
    # A limit on the row number is applied in every task before the exchange, so a common vector is a few rows there.
    w = Window.partitionBy("v").orderBy("_id")
    few = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep)
    return few.groupBy("v").agg(F.sort_array(F.collect_set("_id")).alias("members")).select(
        F.element_at("members", 1).alias("node"), "v", "members")


def build_index(nodes: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """(dim, shard, node, v, levels): per node its neighbour row on each of its levels (nodes' positions)."""
    n = nodes.count()
    shards = max(1, -(-n // shard_size))
    exact = _type(nodes)[1]
    rows = nodes.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"), "node", "v")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable").reset_index(drop=True)
        graph = Graph.build(_single(np.array(pdf["v"].tolist(), exact)), int(pdf["shard"].iloc[0]))
        levels: list[list[bytes]] = [[] for _ in range(len(pdf))]
        for ids, links in graph.levels:
            for i, row in zip(ids.tolist(), links):
                levels[i].append(row.tobytes())
        return pd.DataFrame({"dim": pdf["dim"], "shard": pdf["shard"], "node": pdf["node"], "pos": np.arange(len(pdf)),
                             "v": [np.asarray(v, exact).tobytes() for v in pdf["v"]], "levels": levels})

    return rows.groupBy("dim", "shard").applyInPandas(
        build, "dim int, shard int, node long, pos int, v binary, levels array<binary>")


def _graph(pdf: pd.DataFrame, exact: type) -> tuple[Graph, np.ndarray, np.ndarray]:
    """The graph, its nodes' names and their vectors in the column's precision."""
    pdf = pdf.sort_values("pos", kind="stable")
    vectors = np.frombuffer(b"".join(pdf["v"]), exact).reshape(len(pdf), -1)
    high = pdf["levels"].map(len).to_numpy()
    levels = []
    for level in range(int(high.max())):
        ids = np.flatnonzero(high > level)
        rows = [pdf["levels"].iloc[i][level] for i in ids]
        levels.append((ids, np.frombuffer(b"".join(rows), np.int32).reshape(len(ids), -1)))
    return Graph(_single(vectors), levels), pdf["node"].to_numpy(), vectors


def search(index: DataFrame, queries: DataFrame, k: int, block_size: int = BLOCK, beam: int = BEAM) -> DataFrame:
    """(node_q, node, score): for each query node the k best nodes of every shard.

    ``queries`` has (node, v); both sides meet in groups of one shard and one block of queries.
    """
    n = queries.count()
    blocks = max(1, -(-n // block_size))
    shards = index.select("dim", "shard").distinct()
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(blocks)).cast("int")
    empty = F.array().cast("array<binary>")
    kind, exact = _type(queries)
    asked = (queries.select(F.size("v").alias("dim"), "node", block.alias("block"), "v").join(F.broadcast(shards), "dim")
             .select("dim", "shard", "block", "node", F.lit(-1).alias("pos"), "v", F.lit(None).cast("binary").alias("b"), empty.alias("levels")))
    held = (index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            .select("dim", "shard", "block", "node", "pos", F.lit(None).cast(f"array<{kind}>").alias("v"), F.col("v").alias("b"), "levels"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ask, have = pdf[pdf["pos"] < 0].sort_values("node", kind="stable"), pdf[pdf["pos"] >= 0]
        if not len(ask) or not len(have):
            return pd.DataFrame({"node_q": [], "node": [], "score": []}).astype({"node_q": "int64", "node": "int64", "score": float})
        graph, names, vectors = _graph(have.drop(columns="v").rename(columns={"b": "v"}), exact)
        q = np.array(ask["v"].tolist(), exact)
        who = ask["node"].to_numpy()
        out = []
        for a in range(0, len(q), LANES):
            part = q[a : a + LANES]
            ids, _ = graph.search(_single(part), k + 8, beam)
            good = ids >= 0
            r, c = np.nonzero(good)
            hit = ids[r, c]
            score = np.einsum("ij,ij->i", vectors[hit].astype(float), part[r].astype(float))
            got = pd.DataFrame({"node_q": who[a : a + LANES][r], "node": names[hit], "score": score})
            got = got.sort_values(["node_q", "score", "node"], ascending=[True, False, True], kind="stable")
            out.append(got.groupby("node_q", sort=False).head(k))
        return pd.concat(out)

    return asked.unionByName(held).groupBy("dim", "shard", "block").applyInPandas(run, "node_q long, node long, score double")


def nearest(vectors: DataFrame, asked: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            shard_size: int = SHARD) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows found for every row that ``asked`` (on ``_id``) selects."""
    nodes = written(nodes_of(vectors, id_col, vector_col, k + 1), "nodes")
    index = written(build_index(nodes, shard_size), "hnsw")
    ids = _rows(vectors, id_col, vector_col).where(asked).distinct()
    who = written(ids.join(nodes.select("v", "node"), "v").select(F.col("_id").alias("query_id"), F.col("node").alias("node_q")), "asked")
    queries = nodes.join(who.select(F.col("node_q").alias("node")).distinct(), "node", "left_semi").select("node", "v")
    found = search(index, queries, k + 1)
    best = (found.withColumn("r", F.row_number().over(Window.partitionBy("node_q").orderBy(F.desc("score"), "node")))
            .where(F.col("r") <= k + 1).select("node_q", "node", "score"))
    members = best.join(nodes.select("node", "members"), "node").select("node_q", "score", F.explode("members").alias("vec_id"))
    # Of a query's equal vectors k + 1 rows are enough, whichever the query is.
    few = (members.withColumn("r", F.row_number().over(Window.partitionBy("node_q").orderBy(F.desc("score"), "vec_id")))
           .where(F.col("r") <= k + 1).select("node_q", "score", "vec_id"))
    rows = who.join(few, "node_q").where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("_id") % 20 == 0)
