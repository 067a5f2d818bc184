"""op1, op3, op4: against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_data import SF_ORACLE, docs, no_docs, rows, sentence, with_extras  # noqa: F401
from oracle import compare
from pyspark.sql import functions as F

from renewlens.llm import lm_scoring, minhash, pii


# -- op4 ------------------------------------------------------------------


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        name = min(ids) if ids else None
        out.append((str(d), len(sets[i]), str(name), d == name))
    return sorted(out)


def found_components(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in df.collect())


def test_near_duplicates(spark, docs, rows, no_docs):
    assert found_components(minhash.near_duplicates(docs)) == brute_components(rows)
    assert minhash.near_duplicates(no_docs).count() == 0
    only_null = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert found_components(minhash.near_duplicates(only_null)) == [("1", 0, "1", True), ("2", 0, "2", True)]


def test_near_duplicate_chains_and_thresholds(spark):
    """Chains of edits, a large group of near copies and texts around the threshold."""
    rng = random.Random(8)
    rows, at = [], 0
    for n in (40, 80, 200):
        words = sentence(rng, n).split()
        for _ in range(12):
            rows.append((at, " ".join(words)))
            at += 1
            words[rng.randrange(n)] = f"new{at}"
    base = sentence(rng, 120).split()
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(120)] = f"x{rng.randrange(1000)}"
        rows.append((at, " ".join(w)))
        at += 1
    passage = sentence(rng, 30)
    for _ in range(40):
        rows.append((at, passage + " " + sentence(rng, 25)))
        at += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_components(minhash.near_duplicates(df)) == brute_components(rows)


def test_near_duplicates_without_hub_rounds(spark, monkeypatch):
    """The last round alone also finds every link."""
    monkeypatch.setattr(minhash, "HUB_ROUNDS", 0)
    rng = random.Random(2)
    base = sentence(rng, 50)
    rows = [(i, base + f" tail{i}") for i in range(9)] + [(20, base.upper()), (21, sentence(rng, 50))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_components(minhash.near_duplicates(df)) == brute_components(rows)


def test_near_duplicates_sql(spark, duck):
    ok, msg = compare(minhash.query(spark, SF_ORACLE), duck, minhash.ORACLE)
    assert ok, msg


# -- op3 ------------------------------------------------------------------


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub(r"\D", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return out


PARTS = ["a", "b", "@", ".", "-", "_", "%", "+", " ", "1", "2", "9", "0", "255", "256", "00255", "4111111111111111", "4111 1111 1111 1111", "é", "中",
         "\U0001F600", "\n", "(", ")", "x@y.z", "1.2.3.4", "+1 (988) 555-2485"]


def test_base_spans(spark, no_docs):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += [None, "", "a@b.c" * 300, "9" * 30000, "a." * 9000 + "@" + "b.c" * 9000, "+1" + " 2" * 9000, "1.2.3.4 " * 700]
    df = with_extras(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = pii.find(df).select("doc_id", "base").collect()
    assert len(got) == len(texts)
    for r in got:
        assert [(x["kind"], x["s"], x["e"]) for x in r["base"]] == base_spans(texts[r["doc_id"]] or "")
    assert pii.find(no_docs).count() == 0


def test_context_discovers_unseen_identifiers(spark):
    rows = [(i, f"please email bob{i}@x.com now, or call +1 555 000 {1000 + i} today") for i in range(8)]
    rows += [(100, "please email bob999(at)x.com now, so"), (101, "nothing 12345678 here"), (102, None), (103, ""), (100, "please email bob999(at)x.com now, so")]
    df = with_extras(spark.createDataFrame(rows, "doc_id long, text string"))
    added = [(r["doc_id"], [(x["kind"], x["s"], x["e"]) for x in r["added"]]) for r in pii.find(df).where("size(added) > 0").collect()]
    assert added == [(100, [("email", 13, 28)])] * 2
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[3] == "please email [EMAIL] now, or call [PHONE] today"
    assert clean[100] == "please email [EMAIL] now, so"
    assert (clean[101], clean[102], clean[103]) == ("nothing 12345678 here", None, "")
    assert pii.redact(df).columns == df.columns


#: What is seen around each kind, and forms of it that no base pattern knows.
PLACES = {
    "email": ("write mail to {} for details", ["{n}(at)firma.de", "{n} [at] haus (dot) org", "{n} at buero dot com", "{n}@intern", "jörg.{n}(at)übung.de"]),
    "ip": ("packets from host {} were lost", ["10-0-7-{d}", "10 0 8 {d}", "fe80::a{d}:1:2", "10_1_2_{d}"]),
    "card": ("charged to card {} last night", ["4111 1111 1111 2{d}", "4111-1111-2222-3{d}", "411111111113{d}"]),
    "phone": ("ring me under {} after work", ["0171 23 45 {d}", "(030) 99 8{d}", "0049/30/77{d}", "0171.55.{d}"]),
}
NAMES = "anna bernd clara dora emil frida".split()


def test_masked_seeds_come_back(spark):
    """A third of the identifiers is rewritten into forms that no base pattern matches; the contexts find them."""
    rng = random.Random(8)
    rows, masked, kinds = [], {}, {}
    for i in range(900):
        kind = rng.choice(list(PLACES))
        place, forms = PLACES[kind]
        number = rng.randrange(100, 250)
        if rng.random() < 1 / 3:
            value = rng.choice(forms).format(n=rng.choice(NAMES), d=number)
            value += "9" * (kind == "card" and luhn(re.sub(r"\D", "", value)))  # else a base pattern knows it
            masked[i] = (kind, place.index("{"), place.index("{") + len(value))
        else:
            digits = f"41111111111{rng.randrange(10000):04d}"
            value = {"email": f"u{i}@x{number}.org", "ip": f"10.0.{i % 250}.{number}", "phone": f"+49 30 {100000 + i}",
                     "card": next(digits + str(c) for c in range(10) if luhn(digits + str(c)))}[kind]
        rows.append((i, place.format(value) + ", " + " ".join(rng.choice(NAMES) for _ in range(5))))
    # Numbers, versions, at-phrases and handles in other places, and words in the places themselves.
    others = ["order {d} 44 55{d} has shipped", "version 1-2-3-{d} is out", "meet anna at home dot matrix now", "see note (at) end of page",
              "ring me under pressure after work", "write mail to friends for details", "charged to card X{d}Y{d} last night", "page {d} of 10 20 30 40 then"]
    rows += [(1000 + i, rng.choice(others).format(d=rng.randrange(100, 999))) for i in range(600)]
    df = with_extras(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = dict(rows)
    found = {(r["doc_id"], x["kind"], x["s"], x["e"]) for r in pii.find(df).collect() for x in r["added"]}
    right = {(i, *m) for i, m in masked.items()}
    recall, precision = len(found & right) / len(right), len(found & right) / max(1, len(found))
    assert recall >= 0.95 and precision >= 0.98, (
        recall, precision, [(k, texts[k[0]]) for k in sorted(right - found)[:9]], [(k, texts[k[0]]) for k in sorted(found - right)[:9]])
    for kind in PLACES:
        assert any(f[1] == kind for f in found)


def test_long_texts_of_candidates(spark):
    """Long runs without an end are read in linear time and nothing is added without seeds."""
    texts = ["a" * 200000, "1 " * 100000, "a:" * 60000, "a at b dot " * 20000, "(" * 50000, "1:" * 50000, "a.b" * 50000 + "@", "+" * 50000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["n"] for r in pii.find(df).selectExpr("size(added) n").collect()] == [0] * len(texts)


def test_pii_query_is_native(spark):
    from renewlens.llm import queries

    df = queries.QUERIES["op3_pii"](spark, "/root/testdata/sf0.001")
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in df.collect():
        spans = base_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]


# -- op1 ------------------------------------------------------------------


def test_scores(spark, docs, rows, no_docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "FREQUENT", 12)
    learn = F.col("_id") % 2 == 0
    counts, words, model = lm_scoring.fitted(docs, learn)
    c = Counter(w for i, t in rows if i is not None and i % 2 == 0 for w in lm_scoring.tokens((t or "").encode()))
    n, v = sum(c.values()), len(c)
    got = lm_scoring.score(docs, counts, lm_scoring.vocabulary(counts, 12), model).collect()
    want = []
    for i, t in rows:
        w = lm_scoring.tokens((t or "").encode())
        want.append((str(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 5)))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == sorted(want)
    assert all(r["score"] < 0 for r in got)
    # The model's probability of every token, one at a time.
    few = lm_scoring.vocabulary(counts, 12)
    own, stop = lm_scoring.CLASSES - lm_scoring.TAIL, lm_scoring.STOP
    table = model.table().astype(float)
    at = {w: i for i, w in enumerate(few.words[:own])}
    cls = lambda w: at[w] if w in at else lm_scoring.tail_class(w)
    sums = []
    for i, t in rows:
        ws = lm_scoring.tokens((t or "").encode())
        total = 0.0
        for j, w in enumerate(ws):
            two = cls(ws[j - 1]) if j else cls(stop)
            one = cls(ws[j - 2]) if j > 1 else cls(stop)
            total += table[one * lm_scoring.CLASSES + two, cls(w)]
            total += 0 if w in at else math.log10(c[w] + 1) - few.places[cls(w)]
        sums.append((str(i), round(total, 3)))
    mine = sorted((str(r["doc_id"]), round(r["score"], 3)) for r in got)
    assert [i for i, _ in mine] == [i for i, _ in sorted(sums)]
    assert [x for _, x in mine] == pytest.approx([x for _, x in sorted(sums)], rel=1e-4, abs=0.01)
    assert lm_scoring.score(no_docs, counts, words, model).count() == 0
    none = lm_scoring.fitted(docs, F.lit(False))
    assert {(r["n_known"], r["train_tokens"]) for r in lm_scoring.score(docs, *none).collect()} == {(0, 0)}


def test_long_words_are_counted_whole(spark):
    long = "x" * 3000
    texts = [long + "a b", long + "b b", long + "a c", "x" * 64 + " b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts, words, model = lm_scoring.fitted(df)
    got = {r["doc_id"]: r for r in lm_scoring.score(df, counts, words, model).collect()}
    c = Counter(w for t in texts for w in [*t.split(), "\n"])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        want = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*t.split(), "\n"])
        assert got[i]["base_score"] == pytest.approx(want, abs=1e-9) and got[i]["n_known"] == got[i]["n_tokens"] == 3


def test_frequent_words_stay_within_their_number(spark):
    counts = spark.createDataFrame([(f"w{i:05d}".encode(), 1 + 5000 // (i + 1)) for i in range(9000)], "w binary, n long")
    words = lm_scoring.vocabulary(counts, 1000)
    assert lm_scoring.CLASSES <= len(words.words) <= 1000
    assert words.words == [f"w{i:05d}".encode() for i in range(len(words.words))]


def test_probabilities_sum_to_one(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts, words, model = lm_scoring.fitted(df)
    p = 10.0 ** model.table().astype(float)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    own = lm_scoring.CLASSES - lm_scoring.TAIL
    inside = np.zeros(lm_scoring.TAIL)
    top = set(words.words[:own])
    for r in counts.collect():
        w = bytes(r["w"])
        if w not in top:
            k = lm_scoring.tail_class(w)
            inside[k - own] += (r["n"] + 1) / 10 ** words.places[k]
    unseen = 1 / 10 ** words.places[own:]
    assert np.allclose(inside + unseen, 1)


def test_model_beats_base_on_held_out_text(spark):
    got = lm_scoring.query(spark, SF_ORACLE).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


@pytest.mark.parametrize("seed", [1, 2])
def test_contrastive_training_learns_a_grammar(seed):
    """Class b always follows a, c follows b: the trained model must see it."""
    rng = np.random.default_rng(seed)
    noise = np.full(lm_scoring.CLASSES, 1e-6)
    noise[:4] = 0.25
    noise /= noise.sum()
    trainer = lm_scoring.Trainer(lm_scoring.LogBilinear.start(noise), noise, seed)
    seq = np.concatenate([np.array([0, 1, 2, 3] if rng.random() < 0.9 else [3, 2, 1, 0]) for _ in range(40000)])
    trainer.learn(seq, 3)
    p = 10.0 ** trainer.m.table()[0 * lm_scoring.CLASSES + 1]
    assert p[2] > 0.6
