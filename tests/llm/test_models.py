"""op6, op8, op10 and the pipeline."""

import hashlib
import itertools
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from llm_data import SF_ORACLE, docs, no_docs, rows, sentence, with_extras  # noqa: F401
from pyspark.sql import functions as F

from renewlens.llm import decontaminate, language_id, minhash, resharding, toxicity, tree_bpe
from test_texts import base_spans, shingles

SMALL = "/root/testdata/sf0.001"


# -- op6 ------------------------------------------------------------------


def brute_marginals(e, a):
    """Sums of marginals by listing all label rows."""
    n, k = e.shape
    total, z = np.zeros(k), 0.0
    for labels in itertools.product(range(k), repeat=n):
        s = sum(e[i, y] for i, y in enumerate(labels)) + sum(a[x, y] for x, y in zip(labels, labels[1:]))
        s += np.log(np.exp(a[:, labels[0]]).sum())  # any state before the first word
        p = np.exp(s)
        z += p
        for y in labels:
            total[y] += p
    return total / z


def test_forward_backward_equals_enumeration(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(language_id, "STEP", 3)
    lengths = np.array([1, 0, 5, 7, 3, 8])
    e, a = rng.normal(0, 1.5, (lengths.sum(), 3)), rng.normal(0, 1, (3, 3))
    got = language_id.shares(e.astype(np.float32), lengths, a)
    at = 0
    for row, n in zip(got, lengths):
        want = brute_marginals(e[at : at + n], a) if n else np.zeros(3)
        assert np.allclose(row, want, atol=1e-4)
        at += n


def test_code_switched_words_get_their_languages(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    field = language_id.learned_field(docs, F.col("doc_id") % 2 == 0)
    en, de = (docs.where((F.col("lang") == x) & (F.col("n_chars") > 900) & (F.col("doc_id") % 2 == 1)).orderBy("doc_id").first()["text"] for x in ("en", "de"))
    half = [x.encode().split()[:60] for x in (en, de)]
    mixed = b" ".join(half[0] + half[1] + half[0])
    pred, score = field.predict([mixed, b" ".join(half[1]), b"", b"123 !!", en.encode()])
    assert pred == ["en", "de", "und", "und", "en"]
    assert 0.45 < score[0] < 0.8 and score[1] > 0.8 and score[2] == score[3] == 0.0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "lang")
    got = language_id.query(spark, SF_ORACLE)
    n, right = got.join(docs, "doc_id").where("held_out").agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert right >= 0.97 * n


def test_long_words_count_by_all_their_bytes(spark):
    """Text without blanks is judged by its inside too, and learned from whole."""
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    field = language_id.learned_field(docs, F.col("doc_id") % 2 == 0)
    en, de = (docs.where((F.col("lang") == x) & (F.col("n_chars") > 900) & (F.col("doc_id") % 2 == 1)).orderBy("doc_id").first()["text"].encode() for x in ("en", "de"))
    for sep in (b"", b"_"):
        end = sep.join(de.split())[:40].decode("utf-8", "ignore").encode()
        inside = sep.join(en.split())
        pred, _ = field.predict([end + inside + end, sep.join(de.split()), inside])
        assert pred == ["en", "de", "en"]
    word = "grüße中文".encode() * 40
    cut = language_id.split_words(b"a " + word + b" " + b"x" * 64)
    assert b"".join(cut) == b"a" + word + b"x" * 64 and cut[-1] == b"x" * 64
    assert all(len(p) <= language_id.WORD_BYTES and p.decode() for p in cut)
    one = spark.createDataFrame([(1, word.decode(), "xx")], "doc_id long, text string, lang string")
    (_, learned), = language_id.sample(one, "lang", "doc_id", "text", F.lit(True))
    assert b"".join(learned) == word


def test_language_rows(spark, docs, rows, no_docs):
    labelled = docs.withColumn("lang", F.when(F.col("doc_id") < 3, "en").when(F.col("doc_id") < 6, "xx"))
    field = language_id.learned_field(labelled, F.lit(True))
    got = language_id.identify(labelled, field, keep=("_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
        assert 0 <= r["score"] <= 1 and r["_id"] == 7
    assert language_id.identify(no_docs, field).count() == 0
    nothing = language_id.learned_field(labelled.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r["lang_pred"] for r in language_id.identify(labelled, nothing).collect()} == {"und"}


# -- op8 ------------------------------------------------------------------


def test_flow_is_cheapest():
    rng = random.Random(6)
    for _ in range(150):
        a, b = rng.randint(1, 3), rng.randint(1, 3)
        supply = [rng.randint(0, 6) for _ in range(a)]
        cost = [[rng.randint(0, 3) for _ in range(b)] for _ in range(a)]
        capacity = resharding.even_capacities(sum(supply), b)
        flow = resharding.min_cost_flow(supply, capacity, lambda i, j: cost[i][j])
        assert [sum(r) for r in flow] == supply and [sum(c) for c in zip(*flow)] == capacity
        got = sum(f * c for r, cs in zip(flow, cost) for f, c in zip(r, cs))
        units = [i for i, s in enumerate(supply) for _ in range(s)]
        slots = [j for j, s in enumerate(capacity) for _ in range(s)]
        if len(units) <= 7:
            assert got == min((sum(cost[i][j] for i, j in zip(units, p)) for p in set(itertools.permutations(slots))), default=0)


def test_flow_moves_fewest_bytes():
    supply = [100, 300, 0, 50]
    flow = resharding.min_cost_flow(supply, resharding.even_capacities(450, 5), lambda i, j: int(i != j))
    assert sum(flow[i][i] for i in range(4)) == sum(min(s, 90) for s in supply)


def test_reshard(spark, docs, rows, no_docs):
    got = resharding.reshard(docs, new_shards=5, old_shards=3, with_text=True).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    for r in got:
        data = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        assert r["moved"] == (r["old_shard"] != r["shard"])
    for s in range(5):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert resharding.reshard(no_docs).count() == 0


def test_reshard_even_and_stays(spark):
    rng = random.Random(1)
    hot = sentence(rng, 40)
    data = [(i, hot if i % 3 == 0 else sentence(rng, rng.randint(1, 60))) for i in range(6000)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = resharding.reshard(df).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() - sizes.min() < 0.02 * sizes.mean()
    stays = resharding.reshard(df, old=F.lit(0)).toPandas()
    assert (~stays["moved"]).mean() == pytest.approx(1 / 16, abs=0.01)


def test_only_hot_texts_are_split(spark):
    rng = random.Random(5)
    hot = sentence(rng, 40)
    texts = [sentence(rng, rng.randint(5, 40)) for _ in range(400)]
    data = [(i, hot if i % 3 == 0 else rng.choice(texts)) for i in range(9000)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = resharding.reshard(df, new_shards=5, old_shards=3, blocks=16, with_text=True).toPandas()
    assert len(got) == 9000
    assert got[got["text"] == hot]["shard"].nunique() > 1
    rest = got[got["text"] != hot]
    assert (rest.groupby("text")["shard"].nunique() == 1).all()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() < 1.25 * sizes.mean()


def test_affected_files_only(spark, docs, tmp_path):
    placed = resharding.reshard(docs, new_shards=5, old_shards=3, with_text=True)
    resharding.rewrite_shards(placed, str(tmp_path / "moved"))
    assert spark.read.parquet(str(tmp_path / "moved")).count() == placed.where("moved").count()


# -- op10 -----------------------------------------------------------------


def test_toxicity_held_out(spark):
    got = toxicity.query(spark, SF_ORACLE).join(spark.read.parquet(f"{SF_ORACLE}/labels.parquet"), "doc_id").where("held_out").toPandas()
    y, s = got["toxic"].to_numpy(), got["score"].to_numpy()
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert auc > 0.8
    assert (got["predicted"] == (s >= 0.5)).all()


def test_counterfactual_penalty_frees_neutral_mentions():
    """Toxic texts mention one group more often; with the penalty the mention alone weighs almost nothing."""
    rng = random.Random(4)
    groups = (("alphans", "betans"),)
    labels, words = [], []
    for i in range(1200):
        toxic = i % 3 == 0
        w = {x.encode() for x in sentence(rng, 12).split()}
        if toxic:
            w.add(rng.choice([b"vile", b"scummy"]))
        if rng.random() < (0.7 if toxic else 0.1):
            w.add(b"alphans")
        labels.append(int(toxic))
        words.append(sorted(w))
    text = b"the alphans garden music letter"
    other = b"the betans garden music letter"
    plain = toxicity.fit(labels, words, groups, fairness=0.0)
    fair = toxicity.fit(labels, words, groups, fairness=5.0)
    gap = lambda m: abs(np.subtract(*[np.log(s / (1 - s)) for s in m.score([text, other])]))
    assert gap(fair) < 0.2 * gap(plain)
    assert fair.score([text])[0] < 0.5 < fair.score([b"you vile garden", b"scummy music"]).min()


def test_toxicity_rows(spark, docs, rows, no_docs):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (3, 0), (3, 0), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.learned(docs, labels)
    got = toxicity.score(docs, model, keep=("_id",)).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (12, 13, 14, 16)}) == 1
    one = toxicity.learned(docs, labels.where("toxic = 1"))
    assert {r["predicted"] for r in toxicity.score(docs, one).collect()} == {1}
    none = toxicity.learned(docs, labels.limit(0))
    assert toxicity.score(docs, none).count() == len(rows)
    assert toxicity.score(no_docs, model).count() == 0


def test_toxicity_learns_rare_words_of_all_sampled_labels(spark):
    """Words of 24 among 6,000 labelled texts reach a weight; the table form fits as the plain one does."""
    rng = random.Random(6)
    rows = [(i, sentence(rng, 8) + (f" women vile{'qwertyuiop'[i % 125]}x" if i % 2 and i % 125 < 10 else "")) for i in range(6000)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.learned(texts, labels)
    order = sorted(rows, key=lambda r: str(r[0]))
    plain = toxicity.fit([i % 2 for i, _ in order], [sorted(toxicity.word_list(t.encode())) for _, t in order])
    assert (model.features == plain.features).all() and np.allclose(model.weights, plain.weights) and np.isclose(model.bias, plain.bias)
    words = {w for _, t in rows for w in t.encode().split() if w.startswith(b"vile")}
    assert len(words) > 5 and {toxicity.feature(w) for w in words} <= set(model.features.tolist())


# -- the pipeline -----------------------------------------------------------


def test_pipeline_equals_brute_force(spark):
    """Stage by stage in plain Python; the fitted language field is the stage's own."""
    all_docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    final = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    field = language_id.learned_field(all_docs, corpus_pipeline.fold(F.col("doc_id"), 4) != 2)
    docs = {r["doc_id"]: r["text"] for r in all_docs.collect()}
    pred, score = field.predict([(t or "").encode() for t in docs.values()])
    docs = {d: t for (d, t), p, s in zip(docs.items(), pred, score) if p != "und" and s >= corpus_pipeline.MIN_SHARE}
    ids = sorted(docs)
    sets = {d: shingles(docs[d]) for d in ids}
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for j, y in enumerate(ids):
        for x in ids[:j]:
            if sets[x] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    docs = {d: docs[d] for d in ids if find(d) == d}
    windows = {w for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() for w in decontaminate.windows_of(decontaminate.words_of((r["text"] or "").encode()))}
    searcher = decontaminate.Searcher([(w, ["x"]) for w in sorted(windows)])
    scanned = searcher.scan([t.encode() for t in docs.values()])
    docs = {d: t for (d, t), (n, hit, _) in zip(docs.items(), scanned) if not (len(hit) and 20 * len(hit) >= n)}
    assert set(final) == set(docs)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tree_bpe.read_ranks(None, P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for d, t in docs.items():
        if not base_spans(t):
            row = final[d]
            assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, library.encode_ordinary(t))).encode()).hexdigest()
            assert row["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_stages_keep_columns_and_take_empty_tables(spark, no_docs):
    empty = no_docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, empty, SMALL)
        assert out.count() == 0
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == empty.columns and out.dtypes == empty.dtypes


def test_personal_data_stage_redacts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = corpus_pipeline.without_personal_data(spark, docs, SMALL)
    assert out.count() == docs.count()
    left = [t for t in (r["text"] for r in out.collect()) if base_spans(t)]
    assert not left
    assert out.where("n_chars != length(text)").count() == 0
    marked = {r["doc_id"] for r in out.collect() if re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", r["text"] or "")}
    assert marked >= {r["doc_id"] for r in docs.collect() if base_spans(r["text"] or "")}


def test_repeated_and_null_rows_through_the_stages(spark, docs, rows):
    five = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, five, SMALL).collect()
    seen = [r["text"] for r in kept if r["text"] and r["text"].split()]
    assert len(seen) == len(set(seen))
    assert {0, 1, 2, 3, 5, 12, 13, 14, 15, 16, 17, 18} <= {r["doc_id"] for r in kept}
    assert 10 not in {r["doc_id"] for r in kept}


def test_near_duplicates_keep_unrelated_texts_under_null_and_repeated_ids(spark):
    """Null ids and repeated ids do not make one group of unrelated texts; wordless rows all stay."""
    rng = random.Random(12)
    a, b, c, d = (sentence(rng, 60) for _ in range(4))
    rows = [(None, a), (None, a + " end"), (None, b), (None, b), (7, c), (7, d), (9, d), (12, c + " end"), (None, None), (None, ""), (5, " \n"), (5, " \n")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, SMALL).collect()]
    with_words = [(i, t) for i, t in kept if t and t.split()]
    assert sorted(t[:60] for i, t in with_words if i is None) == sorted([a[:60], b[:60]])
    assert sorted(t for i, t in with_words if i is not None) == sorted([c, d]) and {i for i, _ in with_words} == {None, 7}
    assert sorted(map(str, (x for x in kept if x not in with_words))) == sorted(map(str, rows[-4:]))


def test_benchmark_items_without_an_id_contaminate(spark, tmp_path):
    rng = random.Random(15)
    passage, clean = sentence(rng, 30), sentence(rng, 30)
    spark.createDataFrame([(None, passage), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.createDataFrame([(1, passage), (2, clean)], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.clean_of_benchmark(spark, df, str(tmp_path)).collect()] == [2]
    bench = spark.read.parquet(str(tmp_path / "benchmark.parquet"))
    found = {r["doc_id"]: r for r in decontaminate.decontaminate(df, bench, unnamed=True).collect()}
    assert (found[1]["n_hit"], found[1]["n_items"], found[1]["contaminated"]) == (30, 0, True)
    assert found[1]["items_sha256"] == hashlib.sha256(b"").hexdigest()
