"""op5 and op7: exact ids against the libraries, exact round trips."""

import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from llm_data import docs, no_docs, rows  # noqa: F401
from tokenizers import Tokenizer

from renewlens.llm import common, token_files, tree_bpe
from renewlens.llm.common import python_columns, scratch_path, select_as

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def coder():
    return tree_bpe.TreeBpe(tree_bpe.read_ranks(None, RANKS), P.PATTERN)


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def random_texts(seed, n, alphabet):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


ODD = ["a", "e", "th", "ing", "É", "ü", "ñ", "中", "́", "\U0001F600", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "'s", "'ll", "0", "123", "!?", "_",
       "<|endoftext|>", "İ", "Σ", "ß"]


def test_tree_equals_library(coder, library):
    for t in random_texts(1, 4000, ODD):
        assert coder.encode(t) == library.encode_ordinary(t), repr(t)


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 2500, "".join(random.Random(2).choices("etaoinsh", k=8000)), " " * 500 + "x"])
def test_tree_long_pieces(coder, library, text):
    ids = coder.encode(text)
    assert ids == library.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


def test_every_join_of_halves_is_the_whole(coder):
    rng = random.Random(3)
    for _ in range(400):
        data = bytes(rng.choices(b"theinganrsto \xc3\xa9", k=rng.randint(2, 24)))
        cut = rng.randint(1, len(data) - 1)
        assert coder.join(coder.merge(data[:cut]), coder.merge(data[cut:])) == coder.merge(data)


def test_tree_documents(spark, docs, rows, no_docs, library):
    got = tree_bpe.decode(tree_bpe.encode(docs, RANKS, P.PATTERN), RANKS).collect()
    want = sorted((str(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["ids"], bytes(r["decoded"])) for r in got) == want
    assert tree_bpe.decode(tree_bpe.encode(no_docs, RANKS, P.PATTERN), RANKS).count() == 0


def test_pieces_equal_library():
    tok = Tokenizer.from_file(WORDS)
    tok.encode_special_tokens = True
    enc = token_files.Encoder(WORDS)
    texts = random_texts(5, 4000, ODD + ["’", "É", "İ", "한", "ㅏ", "Ǆ"])
    texts += random_texts(9, 4000, ODD + ["'", "×", "÷", "ı", "ŉ", "=", "\u0338", "²", "½", "\x00", "S", "'S", ",", "ª", "ſ", "K"])
    for t, ids in zip(texts, enc.encode(pa.array(texts)).to_pylist()):
        assert np.frombuffer(ids, enc.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids + [1], repr(t)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    ranks = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
    control, data = token_files.pack(ranks)
    assert len(control) == -(-n // 4)
    assert (token_files.unpack(control, data, n) == ranks).all()


def test_token_files(spark, docs, rows, no_docs):
    tok = Tokenizer.from_file(WORDS)
    tok.encode_special_tokens = True
    files = token_files.write_tokens(docs, WORDS, scratch_path(spark, "test-files"))
    got = sorted((r["part"], r["off"], r["_id"], bytes(r["ids"])) for r in files.read(spark).collect())
    ids = [r[2] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = sorted((str(i), np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, t in rows)
    assert sorted((str(r[2]), r[3]) for r in got) == want
    at = {}
    for part, off, _, data in got:
        assert off == at.get(part, 0)
        at[part] = off + len(data) // 4
    empty = token_files.write_tokens(no_docs, WORDS, scratch_path(spark, "test-files"))
    assert empty.read(spark).count() == 0


def test_query_offsets(spark):
    got = token_files.query(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    tok = Tokenizer.from_file(WORDS)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    for r in got[:50]:
        ids = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [1]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_files_decode_in_a_fresh_process(spark, docs, rows):
    """The folder alone suffices: no object of the writer, no tokenizer."""
    out = scratch_path(spark, "test-files")
    token_files.write_tokens(docs, WORDS, out)
    code = """
import sys, glob, numpy as np, pyarrow.parquet as pq
from renewlens.llm.token_files import unpack
out = sys.argv[1]
ranks = pq.read_table(out + "/ranks").sort_by("rank").column("id").to_numpy()
for row in pq.read_table(out + "/blocks").to_pylist():
    ids, at = ranks[unpack(row["control"], row["data"], sum(row["n"]))], 0
    for i, n in zip(row["docs"], row["n"]):
        print(i, *ids[at:at + n]); at += n
"""
    done = subprocess.run([sys.executable, "-c", code, out.removeprefix("file:")], capture_output=True, text=True, check=True, cwd=ROOT)
    tok = Tokenizer.from_file(WORDS)
    tok.encode_special_tokens = True
    want = sorted(" ".join(map(str, [i, *tok.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows)
    assert sorted(done.stdout.splitlines()) == want


def test_hot_and_text_ids(spark):
    """An id that holds most rows, null ids and text ids: parts ascend, nothing is lost, a hot id is split."""
    data = [(None, f"none {i}") for i in range(300)] + [("m", f"hot {i}") for i in range(500)] + [(f"k{i}", "x") for i in range(100)]
    numbers = [(None if i is None else 7 if i == "m" else 100 + int(i[1:]) if i[1:] < "50" else -int(i[1:]), t) for i, t in data]
    for given, kind in ((data, "string"), (numbers, "long")):
        got = token_files.write_tokens(spark.createDataFrame(given, f"doc_id {kind}, text string"), WORDS,
                                       scratch_path(spark, "test-files")).read(spark).collect()
        got.sort(key=lambda r: (r["part"], r["off"]))
        ids = [r["_id"] for r in got]
        assert ids == sorted((i for i, _ in given), key=lambda i: (i is not None, i if i is not None else 0))
        hot = "m" if kind == "string" else 7
        assert len({r["part"] for r in got if r["_id"] == hot}) > 2 and len({r["part"] for r in got if r["_id"] is None}) > 1


def test_encoders_leave_workers_with_their_operator(spark):
    """A worker keeps an encoder's caches between tasks of its operator only, not beside another operator's."""
    texts = spark.createDataFrame([(i, f"stone light {i}") for i in range(400)], "doc_id long, text string").repartition(16)

    def make():
        import gc

        return lambda batch: {"held": [sum(isinstance(o, tree_bpe.TreeBpe) for o in gc.get_objects())] * batch.num_rows}

    tree_bpe.encode(texts, RANKS, P.PATTERN).write.format("noop").mode("overwrite").save()
    after = python_columns(select_as(texts, "doc_id", "text"), make, "held int").collect()
    assert len(after) == 400 and max(r["held"] for r in after) == 0


def test_resident_object_is_one_and_goes():
    made = []

    def of(key):
        return lambda: common.resident(key, lambda: made.append(key) or [key])

    first = common.begun(of("a"))
    assert common.begun(of("a")) is first and made == ["a"]  # the next task of the operator finds it
    assert common.begun(of("b")) == ["b"] and common.begun(of("a")) is not first and made == ["a", "b", "a"]
    common.begun(lambda: None)
    assert not {"key", "value"} & set(common._RESIDENT)
