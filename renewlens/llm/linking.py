"""From inverted lists to components: sets that share a list and are similar, linked without all pairs.

Each set of a list first meets the list's hub, its most central set; then those outside the hub's
component meet the most central of their own; then sets of different components in a list
meet unless a bound rules the link out: what both have of the hub, less the parts of it that
either lacks, and what they have outside it, less the buckets only one of them has. Lists
that are one component are skipped, every link is confirmed on the full sets, and no list, set or
partner is cut.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewlens.llm.common import python_columns, select_as, texts_of, written
from renewlens.llm.shingles import node_of, overlap, shingle_set

#: 64-bit words of the bucket masks that bound a pair's overlap.
MASKS = 8
#: Positions of the filter that thins the texts before they are shuffled for confirmation.
FILTER_POSITIONS = 1 << 20

_U = np.uint64


def _mix(x):
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, by alternating large-star and small-star steps.

    A hub's neighbours are never gathered: minima are aggregated, then joined back.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        around = e.union(e.select("b", "a")) if large else e.select(F.greatest("a", "b"), F.least("a", "b")).toDF("a", "b")
        low = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        met = around.join(low, "a")
        out = met.where("b > a" if large else "b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(low.select("a", F.col("m").alias("b")))
        return out.where("a != b").distinct()

    def mark(e: DataFrame):
        r = e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 30)))).first()
        return tuple(r)

    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    while True:
        e = written(star(star(e, True), False), "star")
        now = mark(e)
        if now == before:
            return e.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
        before = now


def _sets(lists: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(node, set): full shingle sets of the listed nodes, made anew from their texts."""
    wanted = written(lists.select("node").distinct().join(nodes.select("node", "rep"), "node"), "wanted")
    spot = F.pmod(F.xxhash64("rep"), F.lit(FILTER_POSITIONS))
    spots = wanted.select(spot.alias("spot")).distinct()  # at most FILTER_POSITIONS longs
    texts = select_as(docs, id_col, text_col).withColumn("rep", F.col("_id")).withColumn("spot", spot)
    texts = texts.join(F.broadcast(spots), "spot", "left_semi")
    reps = wanted.select(F.col("rep").alias("_rep")).distinct()
    texts = texts.join(reps, F.col("_id").eqNullSafe(F.col("_rep")), "left_semi").select("_text")

    def make():
        def build(batch):
            sets = [shingle_set(t, size) for t in texts_of(batch, "_text")]
            return {"node": [node_of(s) for s in sets], "set": [s.tobytes() for s in sets]}

        return build

    built = python_columns(texts, make, "node long, set binary", drop=("_text",))
    return written(built.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    return (pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def make():
        def compare(batch):
            ok = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = overlap(x, y)
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            return {"ok": ok}

        return compare

    return python_columns(_with_sets(pairs, sets), make, "ok boolean", text="set_a", drop=("set_a", "set_b")).where("ok").select("a", "b")


def _mask(shingles: np.ndarray) -> list[int]:
    bits = np.zeros(64 * MASKS, bool)
    bits[(_mix(shingles) % _U(64 * MASKS)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64).tolist()


_MASKED = [f"{side}{i}" for side in ("lack", "own") for i in range(MASKS)]


def _against_hubs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, inside, hub_n, masks): for a set a and its hub b, how much it has of the hub, and the buckets of
    what it lacks of it and of what it has besides."""

    def make():
        def measure(batch):
            out = {n: [] for n in ("inside", "hub_n", *_MASKED)}
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                lack, own = np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)
                out["inside"].append(len(x) - len(own))
                out["hub_n"].append(len(y))
                for n, v in zip(_MASKED, _mask(lack) + _mask(own)):
                    out[n].append(v)
            return out

        return measure

    return python_columns(_with_sets(pairs, sets), make, "inside long, hub_n long, " + ", ".join(f"{n} long" for n in _MASKED),
                          text="set_a", drop=("set_a", "set_b"))


def with_labels(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return lists.withColumn("label", F.col("node"))
    return lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _several(lists: DataFrame) -> DataFrame:
    """The lists whose sets are not all in one component."""
    rest = lists.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key")
    return lists.join(rest, "key")


def _hubs(lists: DataFrame) -> DataFrame:
    return lists.groupBy("key").agg(F.max(F.struct("central", "node", "n", "label")).alias("h"))


def _with_hub(lists: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """(a, b): each set with its list's hub, where their components differ and their sizes allow a link."""
    met = lists.join(hubs, "key").where("label != h.label")
    met = met.where(100 * F.least("n", "h.n") >= percent * F.greatest("n", "h.n"))
    return met.select(F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b")).distinct()


def _rest_pairs(lists: DataFrame, hubs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): sets of different components in one list that may link by what they share with its hub."""
    rows = lists.join(hubs.select("key", F.col("h.node").alias("hub")), "key").select("key", "node", "n", "label", "hub")
    rows = written(rows, "rest")
    measured = written(_against_hubs(rows.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), sets), "measured")
    rows = rows.join(measured.withColumnsRenamed({"a": "node", "b": "hub"}), ["node", "hub"]).drop("hub")
    other = rows.select("key", *[F.col(c).alias(f"{c}_") for c in rows.columns if c != "key"])
    bits = lambda side, f: sum((F.bit_count(f(F.col(f"{side}{i}"), F.col(f"{side}{i}_"))) for i in range(MASKS)), F.lit(0))
    inside = F.least(F.col("inside"), F.col("inside_"), F.col("hub_n") - bits("lack", lambda x, y: x.bitwiseOR(y)))
    alone = lambda x, y: x.bitwiseAND(F.bitwise_not(y))
    outside = F.least(F.col("n") - F.col("inside") - bits("own", alone), F.col("n_") - F.col("inside_") - bits("own", lambda x, y: alone(y, x)))
    both, total = inside + outside, F.col("n") + F.col("n_")
    pairs = rows.join(other, (rows["key"] == other["key"]) & (F.col("node") < F.col("node_")) & (F.col("label") != F.col("label_"))
                      & ((100 + percent) * both >= percent * total))
    return pairs.select(F.col("node").alias("a"), F.col("node_").alias("b")).distinct()


def connect(lists: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int,
            edges: DataFrame | None = None, hub_rounds: int = 2, likely: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame | None:
    """(node, label) of all nodes that link with another, or None if none does.

    ``lists`` (key, node, n, central) come from a table; ``nodes`` have node and rep, a row id of
    a text of theirs; ``edges`` (a, b) are links known already; ``likely`` thins pairs (a, b) before the
    full sets are compared.
    """
    labels = None if edges is None or edges.isEmpty() else components(edges)
    if lists.isEmpty():
        return labels
    sets = _sets(lists, nodes, docs, id_col, text_col, size)

    def found(pairs: DataFrame) -> None:
        nonlocal edges, labels
        pairs = written(pairs, "pairs")
        new = written(_confirmed(likely(pairs) if likely else pairs, sets, percent), "links")
        if not new.isEmpty():
            edges = new if edges is None else edges.union(new)
            labels = components(edges)

    rest = lists
    for round_ in range(hub_rounds):
        here = with_labels(rest, labels)
        if round_:  # those outside the first hub's component, with the most central of them
            here = written(_several(here.join(_hubs(here), "key").where("label != h.label").drop("h")), "apart")
        found(_with_hub(here, _hubs(here), percent))
        rest = written(_several(with_labels(rest, labels)).drop("label"), "several")
        if rest.isEmpty():
            return labels
    rest = _several(with_labels(rest, labels))
    found(_rest_pairs(rest, _hubs(rest), sets, percent))
    return labels
