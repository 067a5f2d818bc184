"""Benchmark decontamination by Wu-Manber multi-pattern search.

The test strings are the benchmark's word windows. Text and windows are brought
to one form (lower-cased words, one blank between, one at either end), so an
occurrence of a window is an occurrence of its byte string. Per length class a
block shift table says how far a position can jump; where it says zero, the
hash of the block at the end selects a bucket of test strings and a direct
byte comparison decides. The scan moves many lanes (overlapping pieces of all
texts of a batch) at once with numpy.

Rows: a null or wordless text has no words and is never contaminated; a null or
wordless item has no windows; equal items under several ids all count; repeated
documents give repeated rows. Very long texts are cut into lanes that overlap by
the longest test string, so nothing is missed at a cut.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewlens.llm.common import named, python_columns, select_as, table, texts_of

WINDOW = 13
#: Windows searched in one pass over the documents; more take further passes.
PASS_WINDOWS = 200_000
LANE = 4096
BLOCK = 8
#: Upper lengths (bytes) of the classes of test strings that share a shift table.
CLASSES = (8, 16, 32, 64, 1 << 30)

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the UTF-8 text with A-Z lower-cased."""
    return text.translate(_FOLD).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """All windows of ``size`` words; one shorter window for fewer words, none for none."""
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def _blocks(buf: bytes) -> np.ndarray:
    """The eight bytes from every position, as one integer each (a view; ``buf`` ends in eight spare bytes)."""
    return np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))


class WuManber:
    """Shift tables and suffix buckets of one length class of test strings.

    Blocks have up to eight bytes: with thousands of strings, short blocks of
    running text nearly always end some string and shifts would be nil.
    """

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = m = min(map(len, patterns))
        self.block = min(BLOCK, m)
        self.mask = np.uint64((1 << (8 * self.block)) - 1)
        bits = int(np.clip(np.ceil(np.log2(4 * len(patterns) * m)), 12, 22))
        self.down = np.uint64(64 - bits)
        shift = np.full(1 << bits, m - self.block + 1, np.int64)
        heads = _blocks(b"".join(p[:m] for p in patterns) + bytes(8))
        base = np.arange(len(patterns)) * m
        for end in range(self.block - 1, m):
            np.minimum.at(shift, self._hash(heads, base + end), m - 1 - end)
        self.shift = shift
        self.buckets: dict[int, dict[bytes, list[int]]] = {}
        for i, h in enumerate(self._hash(heads, base + m - 1).tolist()):
            self.buckets.setdefault(h, {}).setdefault(patterns[i][:m], []).append(i)

    def _hash(self, blocks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of the block that ends at each position of ``at``."""
        x = (blocks[at - (self.block - 1)] & self.mask) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> self.down

    def search(self, buf: bytes, blocks: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Yield (position, pattern index) of every occurrence that starts in a lane [start, end)."""
        at = starts + self.m - 1
        last = np.minimum(ends + self.m - 1, len(buf) - 8)
        live = at < last
        at, last = at[live], last[live]
        while len(at):
            h = self._hash(blocks, at)
            s = self.shift[h]
            zero = np.flatnonzero(s == 0)
            if len(zero):
                for e, k in zip(at[zero].tolist(), h[zero].tolist()):
                    p = e - self.m + 1
                    found = self.buckets.get(k, {}).get(buf[p : e + 1])
                    for i in found or ():
                        if buf.startswith(self.patterns[i], p):
                            yield p, i
                s = np.maximum(s, 1)
            at = at + s
            live = at < last
            if not live.all():
                at, last = at[live], last[live]


class Searcher:
    """All test strings: (window bytes, item ids), split into length classes."""

    def __init__(self, windows: list[tuple[bytes, list[str]]]):
        self.items = [items for _, items in windows]
        self.n_words = np.array([w.count(b" ") + 1 for w, _ in windows], np.int64)
        framed = [b" " + w + b" " for w, _ in windows]
        self.classes = []
        low = 0
        for high in CLASSES:
            ids = [i for i, p in enumerate(framed) if low < len(p) <= high]
            low = high
            if ids:
                self.classes.append((ids, WuManber([framed[i] for i in ids])))

    def scan(self, texts: list[bytes]):
        """Per text: (number of words, hit word indices, indices of occurring windows)."""
        forms = [b" ".join(words_of(t)) for t in texts]
        buf = b"\x00" + b"".join(b" " + f + b" \x00" for f in forms) + bytes(8)
        blocks = _blocks(buf)
        data = np.frombuffer(buf, np.uint8)
        lengths = np.array([len(f) + 3 for f in forms], np.int64)
        begins = np.concatenate([[1], 1 + np.cumsum(lengths)[:-1]]) if len(forms) else np.zeros(0, np.int64)
        pieces = -(-lengths // LANE)
        doc_of = np.repeat(np.arange(len(forms)), pieces)
        nth = np.arange(len(doc_of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = begins[doc_of] + nth * LANE
        ends = np.minimum(starts + LANE, (begins + lengths)[doc_of])
        found: dict[int, list[tuple[int, int]]] = {}
        for ids, wm in self.classes:
            hits = list(wm.search(buf, blocks, starts, ends))
            for p, i in hits:
                d = int(np.searchsorted(begins, p, "right")) - 1
                found.setdefault(d, []).append((p, ids[i]))
        for d, form in enumerate(forms):
            n = form.count(b" ") + 1 if form else 0
            if d not in found:
                yield n, np.zeros(0, np.int64), []
                continue
            hits = found[d]
            blanks = np.flatnonzero(data[begins[d] : begins[d] + len(form) + 2] == 32) + begins[d]
            edge = np.zeros(n + 1, np.int64)
            which = np.array([w for _, w in hits])
            first = np.searchsorted(blanks, np.array([p for p, _ in hits]))
            np.add.at(edge, first, 1)
            np.add.at(edge, first + self.n_words[which], -1)
            yield n, np.flatnonzero(np.cumsum(edge)[:n] > 0), sorted(set(which.tolist()))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text",
                      size: int = WINDOW, unnamed: bool = False) -> DataFrame:
    """(window, item_ids): each distinct window of the benchmark with the ids of its items.

    With ``unnamed``, the windows of rows without an id count too; they bring no id.
    """

    def make():
        return lambda batch: {"w": [sorted(set(windows_of(words_of(t), size))) for t in texts_of(batch, "_text")]}

    items = select_as(benchmark, item_col, text_col).where(F.lit(unnamed) | F.col("_id").isNotNull())
    pairs = (python_columns(items, make, "w array<binary>", drop=("_text",))
             .select(F.col("_id").cast("string").alias("i"), F.explode("w").alias("w")).distinct())
    return pairs.groupBy("w").agg(F.sort_array(F.collect_list("i")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW,
                  keep: tuple[str, ...] = (), pass_windows: int = PASS_WINDOWS, unnamed: bool = False) -> DataFrame:
    """Search all windows of ``benchmark`` in all documents.

    Returns per document ``doc_id``, ``n_words``, ``n_hit``, ``n_items``,
    ``items_sha256``, ``contaminated`` (1 hit word in 20 or more), ``hit_words``
    (indices) and the columns named in ``keep``. The windows are sent to the tasks
    in passes of at most ``pass_windows``; a benchmark beyond that is searched in
    several passes whose findings are merged per document.
    """
    windows = benchmark_windows(benchmark, item_col, item_text_col, size, unnamed)
    n = windows.count()
    # The windows of a pass travel in the task's closure: at most ``pass_windows`` strings.
    if n <= pass_windows:
        packs = [windows.collect()]
    else:
        spread = -(-2 * n // pass_windows)
        packs = [windows.where(F.pmod(F.xxhash64("w"), F.lit(spread)) == i).collect() for i in range(spread)]
    packed = docs.sparkSession.sparkContext.broadcast(
        [[(bytes(r["w"]), list(r["items"])) for r in pack] for pack in packs])

    def make():
        searchers = [Searcher(pack) for pack in packed.value if pack]

        def scan(batch):
            texts = texts_of(batch, "_text")
            hit, items = [set() for _ in texts], [set() for _ in texts]
            count = [len(words_of(t)) for t in texts] if not searchers else [0] * len(texts)
            for s in searchers:
                for d, (k, where, which) in enumerate(s.scan(texts)):
                    count[d] = k
                    hit[d].update(where.tolist())
                    for w in which:
                        items[d].update(s.items[w])
            return {
                "n_words": count, "n_hit": [len(h) for h in hit], "n_items": [len(i) for i in items],
                "items_sha256": [hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items],
                "contaminated": [len(h) > 0 and 20 * len(h) >= k for h, k in zip(hit, count)],
                "hit_words": [sorted(h) for h in hit],
            }

        return scan

    found = python_columns(
        select_as(docs, id_col, text_col, keep), make,
        "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_words array<long>",
        drop=("_text",))
    return found.select(*named(id_col, keep), "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_words")


def query(spark, sf_dir):
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: Windows by position; a document word is hit when a window that covers it occurs in the benchmark.
ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i
             FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
f AS (SELECT r, i, dw.k AS k, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM f) GROUP BY r),
n AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
      FROM f GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""
