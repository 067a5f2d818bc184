"""MinHash near-duplicate detection by a signature-coordinate inverted join.

Each distinct shingle set is a node with ``COORDINATES`` minimum hashes. A node is
posted under (coordinate, value) pairs. Two nodes whose sets have the wanted
similarity agree on at least ``MATCHES`` of them (expected 48 of 64 at 0.75; the
chance of fewer than 32 is below 1 in 100,000), so with any one order of all pairs
they share one among the first ``COORDINATES - MATCHES + 1`` of each: the prefix.
The order puts rare pairs first, by how many nodes have them, so a node of whose pairs fewer
than ``MATCHES`` are anyone else's, as of own text around a common passage, is in no list. Nodes of
a list meet its hub first and others only where that may still join components (``linking``);
collisions on the full signatures are counted, pairs under the threshold skipped, and the
rest confirmed on the full shingle sets. No list is cut and no link between components is lost.
(``size_join.jaccard_join`` with 5 words and 75 percent finds links at exactly 0.75 for certain.)

Rows: documents with equal sets are one node; null, empty and wordless texts have
no shingles, no links, and are components of their own; a text of fewer words than
a shingle is one shingle. A null id never names a component unless all its ids are
null. Repeated rows give repeated rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from renewlens.llm.common import python_columns, select_as, table, texts_of, written
from renewlens.llm.linking import components, connect, with_labels  # noqa: F401
from renewlens.llm.shingles import node_of, overlap, shingle_set  # noqa: F401

WORDS = 5
COORDINATES = 64
MATCHES = 32
#: Hub rounds before the remaining components of a list meet directly.
HUB_ROUNDS = 2

_U = np.uint64
_RNG = np.random.default_rng(20240501)
_MUL = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The COORDINATES minimum hashes (upper 32 bits of a multiply-add) of a non-empty set."""
    return np.array([(((shingles * a) + b) >> _U(32)).min() for a, b in zip(_MUL, _ADD)], np.uint32) \
        if len(shingles) > 20_000 else \
        (((shingles[None, :] * _MUL[:, None]) + _ADD[:, None]) >> _U(32)).min(axis=1).astype(np.uint32)


def _keys(sig: np.ndarray) -> np.ndarray:
    """(rows, COORDINATES) long keys of (coordinate, value) pairs."""
    return (np.arange(COORDINATES, dtype=np.int64) << 32)[None, :] | sig.astype(np.int64)


def _sigs(batch, column: str) -> np.ndarray:
    data = b"".join(batch.column(column).to_pylist())
    return np.frombuffer(data, np.uint32).reshape(-1, COORDINATES)


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int = WORDS) -> DataFrame:
    """(_id, text_hash, n_shingles, node, sig) per document; node and sig are null without shingles."""

    def make():
        def sign(batch):
            out = {"n_shingles": [], "node": [], "sig": []}
            for t in texts_of(batch, "_text"):
                s = shingle_set(t, size)
                out["n_shingles"].append(len(s))
                out["node"].append(node_of(s))
                out["sig"].append(signature(s).tobytes() if len(s) else None)
            return out

        return sign

    rows = select_as(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("_text"))
    return python_columns(rows, make, "n_shingles long, node long, sig binary",
                          drop=("_text",))


def postings(nodes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(key, node, n, central): the pairs of each node's prefix that other nodes share too.

    Pairs are ordered by how many nodes have them, rarest first. Of a node's pairs, those that it
    alone has come first and are in no list; of s shared ones the first s - matches + 1 decide.
    ``central`` grows with the frequency of the node's pairs: of copies with edits, the one
    nearest to what they have in common has the most frequent pairs.
    """

    def make():
        return lambda batch: {"keys": list(_keys(_sigs(batch, "sig")))}

    post = python_columns(nodes.select("node", "n", "sig"), make, "keys array<long>", text="sig", drop=("sig",))
    post = post.select("node", "n", F.explode("keys").alias("key"))
    shared = post.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    own = Window.partitionBy("node")  # at most COORDINATES rows
    rows = post.join(shared, "key").withColumns({"at": F.row_number().over(own.orderBy("k", "key")), "s": F.count(F.lit(1)).over(own),
                                                 "often": F.sum(F.log2("k")).over(own)})
    rows = rows.where(F.col("at") <= F.col("s") - matches + 1)
    return rows.select("key", "node", "n", (1000 * F.col("often") / COORDINATES).cast("long").alias("central"))


def _count_matches(pairs: DataFrame, nodes: DataFrame, matches: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree on at least ``matches`` coordinates."""
    sa = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    sb = nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))

    def make():
        def compare(batch):
            same = (_sigs(batch, "sig_a") == _sigs(batch, "sig_b")).sum(axis=1)
            return {"same": same}

        return compare

    both = pairs.join(sa, "a").join(sb, "b")
    return (python_columns(both, make, "same long", text="sig_a", drop=("sig_a", "sig_b"))
            .where(F.col("same") >= matches).select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS,
                    percent: int = 75, matches: int = MATCHES) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_hash, label`` per document.

    ``component_id`` is an id and may be shared by unrelated components (repeated and null ids);
    ``label`` is the component's own: its smallest node, null without words.
    """
    signed = written(signatures(docs, id_col, text_col, size), "signed")
    nodes = written(signed.where("node is not null").groupBy("node").agg(
        F.min("_id").alias("rep"), F.max("n_shingles").alias("n"), F.first("sig").alias("sig")), "nodes")
    lists = written(postings(nodes, matches), "lists")
    labels = connect(lists, nodes, docs, id_col, text_col, size, percent, hub_rounds=HUB_ROUNDS,
                     likely=lambda pairs: _count_matches(pairs, nodes, matches))
    marked = with_labels(nodes.select("node", "rep"), labels)
    names = marked.groupBy("label").agg(F.min("rep").alias("name"))
    marked = marked.join(names, "label").select("node", "label", "name")
    result = signed.select("_id", "n_shingles", "node", "text_hash").join(marked, "node", "left")
    result = result.withColumn("component_id", F.coalesce("name", "_id"))
    return result.select(F.col("_id").alias(id_col), "n_shingles", "component_id",
                         F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash", "label")


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash", "label")


#: All pairs that share a shingle, counted on the full sets, then components by reachability.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id
      GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.v)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id,
       d.doc_id = min(r.c) AS kept
FROM d JOIN r ON r.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
