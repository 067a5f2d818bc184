"""Byte-level BPE by monoid tree reduction.

A piece is encoded by halves: each half is encoded by itself and the two token
rows are joined. The join encodes a window of bytes around the seam anew, starting
with one token on either side and growing on a side until the tokens next to the
window are stable: a row of tokens is the encoding of its bytes exactly when every
two neighbours, encoded together, stay as they are, so once the window's outer
neighbours pass that test nothing outside can change. Decoding concatenates the
tokens' bytes up the same kind of tree.

Texts are split by the tokenizer's pattern first; a piece that is a token as a
whole is that token. Null texts count as empty and give no ids. A text of any
length is handled whole; its memory grows with its own length only.
"""

from __future__ import annotations

import base64
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renewlens.llm.common import list_array, named, python_columns, resident, select_as, table, texts_of

#: Pieces of at most this many bytes are merged directly, as leaves of the tree.
LEAF = 6
#: Windows of more bytes are merged with a heap.
HEAP = 64
#: Entries a worker's caches of pieces, of chunks between blanks, and of short windows and pairs hold;
#: beyond them, new ones are encoded each time.
CACHE = 350_000
CHUNK_CACHE = 120_000
SMALL_CACHE = 150_000
#: Longer pieces are not cached.
CACHED_BYTES = 48
#: Where a cut before a blank could part white space that the pattern takes in one match.
_RUNS = re.compile(r"  |\s \s| $")
_CHUNK = re.compile(" ?[^ ]+")


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token ranks of a rank file (base64 token, blank, rank per line) at any path the driver or Spark reads."""
    if "://" in path:
        lines = (r[0] for r in spark.read.text(path).collect())  # one row per token of a fixed vocabulary
    else:
        with open(path, encoding="ascii") as f:
            lines = f.read().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class TreeBpe:
    """Encoder and decoder over a rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.tokens = {r: t for t, r in ranks.items()}
        self._leaf: dict[bytes, list[int]] = {}
        self._pair: dict[tuple[int, int], bool] = {}
        self._piece: dict[str, tuple[int, ...]] = {}
        self._chunk: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Merge the lowest-ranked neighbours of ``data`` until none is left (short inputs)."""
        known = self._leaf.get(data)
        if known is not None:
            return known
        if len(data) > HEAP:
            return self._merge_long(data)
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out = [ranks[p] for p in parts]
        if len(self._leaf) < SMALL_CACHE:
            self._leaf[data] = out
        return out

    def _merge_long(self, data: bytes) -> list[int]:
        """``merge`` for a long window (repetitive text): a heap of neighbours instead of scans."""
        ranks = self.ranks
        n = len(data)
        part: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j >= n or ranks.get(part[i] + part[j]) != r:
                continue
            part[i], part[j] = part[i] + part[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (q := ranks.get(part[k] + part[after[k]])) is not None:
                    heapq.heappush(heap, (q, k))
        return [ranks[p] for p in part if p is not None]

    def stable(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens stay as they are when encoded together."""
        known = self._pair.get((left, right))
        if known is None:
            known = self.reduce(self.tokens[left] + self.tokens[right], halve=False) == [left, right]
            if len(self._pair) < SMALL_CACHE:
                self._pair[left, right] = known
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the concatenation of two encoded byte strings."""
        if not left or not right:
            return left + right
        if self.stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = b"".join(map(self.tokens.__getitem__, chain(left[-i:], right[:j])))
            inner = self.reduce(window, halve=False)
            left_ok = i >= len(left) or self.stable(left[-i - 1], inner[0])
            right_ok = j >= len(right) or self.stable(inner[-1], right[j])
            if left_ok and right_ok:
                return left[:-i] + inner + right[j:]
            if not left_ok:
                i = min(len(left), 2 * i)
            if not right_ok:
                j = min(len(right), 2 * j)

    def reduce(self, data: bytes, halve: bool = True) -> list[int]:
        """Encoding of any byte string; windows of joins are merged directly."""
        if not halve or len(data) <= LEAF:
            return self.merge(data)
        mid = len(data) // 2
        return self.join(self.reduce(data[:mid]), self.reduce(data[mid:]))

    def piece(self, text: str) -> tuple[int, ...]:
        """Encoding of one match of the pattern."""
        known = self._piece.get(text)
        if known is not None:
            return known
        data = text.encode("utf-8")
        whole = self.ranks.get(data)
        out = (whole,) if whole is not None else tuple(self.reduce(data))
        if len(data) <= CACHED_BYTES and len(self._piece) < CACHE:
            self._piece[text] = out
        return out

    def chunk(self, text: str) -> tuple[int, ...]:
        """Encoding of a blank and what follows up to the next blank, split by the pattern."""
        out = tuple(chain.from_iterable(map(self.piece, self.pattern.findall(text))))
        if len(text) <= CACHED_BYTES and len(self._chunk) < CHUNK_CACHE:
            self._chunk[text] = out
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text. No match of the pattern runs from a letter, digit or sign into white space, so a
        text without longer white space falls apart before each blank."""
        if _RUNS.search(text):
            return list(chain.from_iterable(map(self.piece, self.pattern.findall(text))))
        known, one = self._chunk.get, self.chunk
        return list(chain.from_iterable(known(c) or one(c) for c in _CHUNK.findall(text)))

    def decode(self, ids: list[int]) -> bytes:
        """Concatenation up the tree; ids that the table lacks raise KeyError."""
        if len(ids) <= 4096:
            return b"".join(map(self.tokens.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def _coder(shared):
    """One encoder per Python worker, so caches outlive a task, but not the operator."""
    key = shared._path if hasattr(shared, "_path") else id(shared)
    return resident(("tree_bpe", key), lambda: TreeBpe(*shared.value))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           keep: tuple[str, ...] = (), with_decoded: bool = False) -> DataFrame:
    """``doc_id``, the columns of ``keep`` and ``ids`` (array of token ranks) per document.

    With ``with_decoded`` the ids are decoded again in the same task: the column ``decoded``.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((read_ranks(spark, ranks_path), pattern))  # a fixed vocabulary

    def make():
        coder = _coder(shared)

        def run(batch):
            rows = [coder.encode(t.decode("utf-8")) for t in texts_of(batch, "_text")]
            more = {"decoded": [coder.decode(r) for r in rows]} if with_decoded else {}
            return more | {"ids": list_array(np.concatenate([np.array(r, np.int32) for r in rows]) if rows else [], [len(r) for r in rows])}

        return run

    out = python_columns(select_as(docs, id_col, text_col, keep), make,
                         "ids array<int>" + ", decoded binary" * with_decoded, drop=("_text",), chars=2_000_000)
    return out.select(*named(id_col, keep), "ids", *["decoded"] * with_decoded)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the column ``decoded`` (the bytes of its ids; null ids give no bytes)."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast((read_ranks(spark, ranks_path), ""))
    inner = encoded.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(encoded.columns)])
    at = encoded.columns.index(ids_col)

    def make():
        coder = _coder(shared)

        def run(batch):
            ids = batch.column(f"_c{at}")
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            return {"decoded": [coder.decode(flat[a:b].tolist()) for a, b in zip([0, *ends.tolist()], ends.tolist())]}

        return run

    out = python_columns(inner, make, "decoded binary", text=None)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(encoded.columns) if c != "decoded"], "decoded")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes."""
    return encoded.select(
        id_col, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, with_decoded=True))
