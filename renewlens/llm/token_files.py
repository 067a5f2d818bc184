"""Token ids in a byte-aligned variable-length file format, and back.

Texts are encoded with a public tokenizer; ids are ranked by how often they occur in
all documents, so frequent ids take one byte, rarer ones two, three or four. A block
holds the length codes of its ids (two bits each) as control bytes, apart from the
data bytes; decoding looks whole control bytes up in numpy tables. Blocks are rows of
Parquet files in ascending order of documents, each with the ids and lengths of its
documents and their place in the stream; the rank table lies beside them in the same folder.

Rows: null and empty texts give the end id alone; null ids come first; ids may be of any
type that sorts; documents of one id (or of none) have an order by a hash of their text where
that id fills whole parts, then by their ids' bytes; an empty table gives no rows. A text of
any length is encoded whole and may make a block of its own.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, LongType, NumericType, StructField, StructType

from renewlens.llm.common import python_columns, scratch_path, select_as, table, written

END = 1
#: Ids of a block, about: it closes behind the document that passes a multiple of this in its part.
BLOCK_IDS = 1 << 18
#: Runs a worker remembers between batches (others are encoded again where they occur).
RUN_CACHE = 500_000
#: Text bytes of a part, about.
PART_BYTES = 64 << 20

_BLANK, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
#: Runs of letters alone or of ASCII marks alone but the apostrophe.
_SIMPLE = re.compile("[!-&(-/:-@\\[-`{-~]+|[A-Za-zÀ-ÖØ-öø-įı-ſ]+")


def _byte_classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    out[33:127] = _MARK
    for first, last, kind in (("0", "9", _DIGIT), ("A", "Z", _LETTER), ("a", "z", _LETTER)):
        out[ord(first) : ord(last) + 1] = kind
    out[[0x09, 0x0A, 0x20]] = _BLANK
    return out


_CLASSES = _byte_classes()


def run_starts(data: np.ndarray) -> np.ndarray:
    """True at every byte of UTF-8 text where the tokenizer surely begins a new word.

    Cuts lie beside blanks and between letters, digits and marks of ASCII, letters also of the
    Latin blocks U+00C0 to U+017F without multiplication, division and dotted capital I (whose small form
    ends in a mark). No cut follows an apostrophe, which may take letters, and none
    touches any other byte, so what composes or joins across stays in one run.
    """
    kind = _CLASSES[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5) & ((data[1:] & 0xC0) == 0x80))
    pair = data[lead].astype(np.int32) << 8 | data[lead + 1]
    lead = lead[(pair != 0xC397) & (pair != 0xC3B7) & (pair != 0xC4B0)]
    kind[lead] = kind[lead + 1] = _LETTER
    before, after = kind[:-1], kind[1:]
    cut = np.ones(len(data), bool)
    cut[1:] = (before != after) | (after == _DIGIT)
    blank = (before == _BLANK) | (after == _BLANK)
    kept = (before == _OTHER) | (after == _OTHER) | ((data[:-1] == 0x27) & (after == _LETTER))
    cut[1:] &= blank | ~kept
    return cut


class Encoder:
    """Exact ids of a tokenizer that drops blanks and never merges across them.

    A batch of texts is cut into runs (``run_starts``), equal runs are found by Arrow's
    dictionary coding, and only runs not yet known go through the tokenizer: those of letters
    or marks alone in a few calls, without its normaliser, which would only make them small.
    The ids of the texts are then gathered from one flat array.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.bare.encode_special_tokens = True
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        size = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.last = np.zeros(size + 1, bool)
        for token, i in self.tok.get_vocab().items():
            if token.endswith("</w>"):
                self.last[i] = True
        # Number of each known run; run i has flat[at[i]:at[i + 1]]. Run 0 is the end of a text.
        self.known: dict[bytes, int] = {}
        self.flat = np.array([END], self.dtype)
        self.at = np.array([0, 1], np.int64)

    def _simple(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of small-letter or mark runs, each one word of the tokenizer: its ids end with a word-end token."""
        flat, size = [], []
        for a in range(0, len(runs), 20_000):
            part = runs[a : a + 20_000]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(self.last[ids]) + 1
            got = (ids, np.diff(ends, prepend=0)) if len(ends) == len(part) else self._whole(part)
            flat.append(got[0])
            size.append(got[1])
        return np.concatenate(flat), np.concatenate(size)

    def _whole(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tok.encode_batch_fast(runs, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], self.dtype), np.array([len(x) for x in ids], np.int64)

    def _learn(self, runs: list[bytes]) -> None:
        """Give numbers to new runs."""
        simple, other, texts = [], [], {}
        for r in runs:
            t = r.decode("utf-8", "replace")
            (simple if _SIMPLE.fullmatch(t) else other).append(r)
            texts[r] = t
        for names, encode in ((simple, self._simple), (other, self._whole)):
            if names:
                flat, size = encode([texts[r].lower() if encode == self._simple else texts[r] for r in names])
                self.known.update(zip(names, range(len(self.at) - 1, len(self.at) - 1 + len(names))))
                self.flat = np.concatenate([self.flat, flat])
                self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(size)])

    def _forget(self) -> None:
        """Keep the runs met first, up to the bound."""
        if len(self.known) > RUN_CACHE:
            for r in list(islice(self.known, RUN_CACHE, None)):
                del self.known[r]
            self.at = self.at[: RUN_CACHE + 2].copy()
            self.flat = self.flat[: self.at[-1]].copy()

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text (null: empty), end id included, as little-endian integers."""
        texts = pc.fill_null(pc.cast(texts, pa.large_binary()), b"")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        ends = np.zeros(len(texts), np.int64)
        runs = np.zeros(0, np.int64)
        if len(data):
            # ASCII letters may become small before anything else: the normaliser would give the same.
            data = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)
            cut = run_starts(data)
            cut[bounds[:-1][bounds[:-1] < len(data)]] = True
            starts = np.append(np.flatnonzero(cut), len(data))
            parts = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)])
            coded = parts.dictionary_encode()
            values = coded.dictionary.to_pylist()
            fresh = [v for v in values if v not in self.known]
            if fresh:
                self._learn(fresh)
            runs = np.fromiter(map(self.known.__getitem__, values), np.int64, len(values))[coded.indices.to_numpy()]
            ends = np.searchsorted(starts, bounds[1:])
        runs = np.insert(runs, ends, 0)  # run 0 behind each text
        size = np.diff(self.at)[runs]
        stops = np.cumsum(size)
        ids = self.flat[np.repeat(self.at[runs] - (stops - size), size) + np.arange(size.sum())]
        offsets = np.append(0, stops[ends + np.arange(len(ends))]) * self.dtype.itemsize
        self._forget()
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)])


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# -- the block coding ---------------------------------------------------------

_CODES = ((np.arange(256)[:, None] >> (2 * np.arange(4))[None, :]) & 3) + 1  # (256, 4) lengths
_SUMS = _CODES.sum(axis=1)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    r = ranks.astype("<u4")
    length = 1 + (r > 0xFF).astype(np.int64) + (r > 0xFFFF) + (r > 0xFFFFFF)
    code = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    code[: len(r)] = length - 1
    control = (code.reshape(-1, 4) << (2 * np.arange(4, dtype=np.uint8))[None, :]).sum(axis=1).astype(np.uint8)
    wide = r.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), wide[np.arange(4)[None, :] < length[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers of a block, by table lookup of its control bytes."""
    c = np.frombuffer(control, np.uint8)
    length = _CODES[c].ravel()[:n]
    at = np.cumsum(length) - length
    words = np.ndarray((len(data) + 1,), "<u4", data + bytes(4), 0, (1,))
    return words[at] & _MASKS[length]


@dataclass
class TokenFiles:
    """A folder of token files: ``blocks`` (Parquet rows of blocks) and ``ranks`` (the id of each rank).

    The folder is all that reading needs; any process may open it by its path.
    """

    path: str

    def ranks(self, spark) -> np.ndarray:
        """The id of each rank, one entry per id of the vocabulary."""
        rows = spark.read.parquet(f"{self.path}/ranks").toPandas()
        out = np.zeros(len(rows), np.uint32)
        out[rows["rank"].to_numpy(np.int64)] = rows["id"].to_numpy(np.int64)
        return out

    def read(self, spark) -> DataFrame:
        """``_id, part, off, n, ids`` (unsigned 32-bit little-endian bytes) per document."""
        return decode_blocks(spark.read.parquet(f"{self.path}/blocks"), self.ranks(spark))

    def digests(self, spark) -> DataFrame:
        """``_id, part, off, n, ids_crc32`` per document, taken where the ids are decoded."""
        return decode_blocks(spark.read.parquet(f"{self.path}/blocks"), self.ranks(spark), crc=True)


def _cuts(src: DataFrame, id_type: DataType, parts: int) -> list[tuple]:
    """``(id, extra)``: ids that cut the documents into about equal parts, ascending, and into how many
    further parts the rows of a cutting id go that holds more than its share."""
    if isinstance(id_type, NumericType):
        got = src.select(F.percentile_approx("_id", [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
        times = Counter(got)
        return [(v, n if n > 1 else 0) for v, n in sorted(times.items())]
    # Other types have no approximate quantiles: only the ids are dealt by range, and counted.
    ranges = src.where("_id is not null").select("_id").repartitionByRange(parts, "_id").select(F.spark_partition_id().alias("p"), "_id")
    ids = ranges.groupBy("p", "_id").agg(F.count(F.lit(1)).alias("n"))
    rows = ids.groupBy("p").agg(F.max(F.struct("_id", "n")).alias("last"), F.sum("n").alias("n")).orderBy("p").collect()
    share = max(1.0, sum(r["n"] for r in rows) / parts)
    return [(r["last"]["_id"], int(r["last"]["n"] // share) if r["last"]["n"] >= 2 * share else 0) for r in rows]


def _dealt(src: DataFrame) -> tuple[Column, int]:
    """The part of a row, and the number of parts: ranges of ids of about ``PART_BYTES``, null ids
    before them; the rows of one common id (or of none) are further dealt by a hash of their text."""
    text = F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long")
    size = src.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_id").isNull()).alias("none"), F.sum(text).alias("bytes")).first()
    parts = max(2, int(src.sparkSession.conf.get("spark.sql.shuffle.partitions")), (size["bytes"] or 0) // PART_BYTES + 1)
    cuts = _cuts(src, src.schema["_id"].dataType, parts)
    none = -(-size["none"] * parts // max(1, size["n"]))

    def among(k):
        return F.pmod(F.xxhash64(F.coalesce("_text", F.lit(""))), k).cast("int")

    if not cuts:
        return (among(F.lit(none)) if none else F.lit(0)), max(1, none)
    first = np.concatenate([[0], np.cumsum([1 + k for _, k in cuts])]) + none  # of each range
    ids, firsts = F.array(*[F.lit(v) for v, _ in cuts]), F.array(*[F.lit(int(f)) for f in first])
    extra = F.array(*[F.lit(k) for _, k in cuts])
    below = F.size(F.filter(ids, lambda v: v < F.col("_id")))  # a range ends with its cut
    k = F.when(F.get(ids, below) == F.col("_id"), F.get(extra, below)).otherwise(0)
    part = F.get(firsts, below) + F.when(k > 0, 1 + among(F.greatest(k, F.lit(1)))).otherwise(0)
    return (F.when(F.col("_id").isNull(), among(F.lit(none))).otherwise(part) if none else part), int(first[-1]) + 1


def encoded(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """``_id, part, n, ids, off``: in each part documents ascend, and ``off`` counts the part's ids before one."""
    src = select_as(docs, id_col, text_col)
    part, parts = _dealt(src)

    def make():
        def run(batch):
            enc = _encoder(path)
            ids = enc.encode(batch.column("_text"))
            n = pc.cast(pc.divide(pc.binary_length(ids), enc.dtype.itemsize), pa.int64())
            return {"ids": pc.cast(ids, pa.binary()), "n": n}

        return run

    rows = python_columns(src.withColumn("part", part.cast("int")), make, "ids binary, n long", drop=("_text",))
    dealt = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "_id", "ids")
    schema = StructType(dealt.schema.fields + [StructField("off", LongType())])

    def offsets(batches):
        at: dict[int, int] = {}
        for b in batches:
            parts_, n = b.column("part").to_numpy(), b.column("n").to_numpy()
            off = np.zeros(len(n), np.int64)
            for p in np.unique(parts_).tolist():
                mine = parts_ == p
                off[mine] = at.get(p, 0) + np.cumsum(n[mine]) - n[mine]
                at[p] = at.get(p, 0) + int(n[mine].sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(off)], names=[*b.schema.names, "off"])

    return dealt.mapInArrow(offsets, schema)


def _flat(ids: pa.Array, dtype: np.dtype) -> np.ndarray:
    """All ids of a column of binary values, one after the other."""
    ids = pc.cast(ids, pa.large_binary())
    ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
    return np.frombuffer(ids.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(dtype)


def ranked_ids(rows: DataFrame, dtype: np.dtype, size: int) -> np.ndarray:
    """All ids by falling count (ties: smaller id first); one number per id of the vocabulary."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(_flat(b.column("ids"), dtype), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    sums = rows.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[sums["id"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return np.lexsort((np.arange(size), -counts)).astype(np.uint32)


def write_tokens(docs: DataFrame, path: str, out: str, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encode all documents and write the blocks and the rank table under ``out``."""
    spark = docs.sparkSession
    rows = written(encoded(docs, path, id_col, text_col), "ids")
    enc = _encoder(path)
    dtype, by_rank = enc.dtype, ranked_ids(rows, enc.dtype, len(enc.last))
    rank = np.zeros(len(by_rank), np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)  # one number per id of the vocabulary
    id_type = rows.schema["_id"].dataType
    arrow_id = to_arrow_type(id_type)
    fields = f"part int, docs array<{id_type.simpleString()}>, n array<long>, off array<long>, control binary, data binary"

    def block(held):
        part = held[0].column("part")[0].as_py()
        control, data = pack(shared.value[np.concatenate([_flat(b.column("ids"), dtype) for b in held])])
        docs_, n, off = [pa.concat_arrays([b.column(c) for b in held]) for c in ("_id", "n", "off")]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (docs_.cast(arrow_id), n, off)]
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), *lists, pa.array([control], pa.binary()), pa.array([data], pa.binary())],
            names=["part", "docs", "n", "off", "control", "data"])

    def blocks(batches):
        held, now = [], None
        for b in batches:
            # A block ends with its part, or where its part's offset passes a multiple of BLOCK_IDS.
            part, nth = b.column("part").to_numpy(), b.column("off").to_numpy() // BLOCK_IDS
            new = np.flatnonzero((np.diff(part) != 0) | (np.diff(nth) != 0)) + 1
            for a, z in zip([0, *new.tolist()], [*new.tolist(), b.num_rows]):
                if a == z:
                    continue
                if held and now != (part[a], nth[a]):
                    yield block(held)
                    held = []
                now = (part[a], nth[a])
                held.append(b.slice(a, z - a))
        if held:
            yield block(held)

    rows.select("_id", "part", "n", "off", "ids").mapInArrow(blocks, fields).write.option("compression", "zstd").parquet(f"{out}/blocks")
    table_ = pa.table({"rank": pa.array(np.arange(len(by_rank))), "id": pa.array(by_rank.astype(np.int64))})
    spark.createDataFrame(table_).coalesce(1).write.parquet(f"{out}/ranks")
    return TokenFiles(out)


def decode_blocks(blocks: DataFrame, ids_by_rank: np.ndarray, crc: bool = False) -> DataFrame:
    """The documents of blocks, with their ids or (``crc``) only the ids' checksum."""
    shared = blocks.sparkSession.sparkContext.broadcast(ids_by_rank)  # one number per id of the vocabulary
    id_type = blocks.schema["docs"].dataType.elementType.simpleString()
    last = ("ids_crc32", pa.int64()) if crc else ("ids", pa.binary())

    def run(batches):
        for b in batches:
            cols = [b.column(c) for c in ("part", "docs", "n", "off", "control", "data")]
            for row in range(b.num_rows):
                part, docs, n, off, control, data = [c[row] for c in cols]
                n = n.values.to_numpy(zero_copy_only=False)
                ids = memoryview(shared.value[unpack(control.as_py(), data.as_py(), int(n.sum()))].astype("<u4").tobytes())
                ends = (np.cumsum(n) * 4).tolist()
                texts = [ids[a:z] for a, z in zip([0, *ends[:-1]], ends)]
                values = [zlib.crc32(x) for x in texts] if crc else [bytes(x) for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [docs.values, pa.array(np.full(len(n), part.as_py(), np.int32)), off.values, pa.array(n), pa.array(values, last[1])],
                    names=["_id", "part", "off", "n", last[0]])

    return blocks.mapInArrow(run, f"_id {id_type}, part int, off long, n long, {last[0]} {'long' if crc else 'binary'}")


def query(spark, sf_dir):
    import public_tokenizers

    files = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                         scratch_path(spark, "token-files"))
    back = written(files.digests(spark), "token-digests")
    # One row per part; the parts before one hold ``base`` ids.
    sizes = sorted(back.groupBy("part").agg(F.sum("n").alias("n")).collect())
    base, at = [], 0
    for r in sizes:
        base.append((r["part"], at))
        at += r["n"]
    bases = spark.createDataFrame(base or [(0, 0)], "part int, base long")
    return back.join(F.broadcast(bases), "part").select(
        F.col("_id").alias("doc_id"), (F.col("base") + F.col("off")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32")
