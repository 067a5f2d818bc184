"""op11: against all pairs."""

import random

import numpy as np
from llm_data import SF_ORACLE, WORDS, docs, no_docs, rows, sentence, with_extras  # noqa: F401
from oracle import compare
from pyspark.sql import functions as F

from renewlens.llm import size_join
from renewlens.llm.minhash import shingle_set


def brute(rows, size=4, percent=85):
    sets = [set(shingle_set((t or "").encode(), size).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    name = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted((str(d), len(sets[i]), str(name[find(i)])) for i, (d, _) in enumerate(rows))


def as_rows(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def changed(rng, words, k):
    words = list(words)
    for _ in range(k):
        at, how = rng.randrange(len(words)), rng.random()
        if how < 0.6:
            words[at] = f"w{rng.randrange(10**6)}"
        elif how < 0.8:
            del words[at]
        else:
            words.insert(at, f"v{rng.randrange(10**6)}")
    return words


def near(rng):
    """Copies with edits around the threshold, of all sizes, in chains and stars; common passages; small sets."""
    out, n = [], 0
    passage = sentence(rng, 50)
    for size in [4, 5, 6, 8, 9, 10, 12, 14, 15, 17, 19, 22, 25, 30, 33, 40, 60, 100, 180, 400]:
        base = [f"a{rng.randrange(5000)}" for _ in range(size)]
        for _ in range(14):
            words = changed(rng, base if rng.random() < 0.7 else words, rng.randint(0, max(1, size // 30)))  # noqa: F821
            out.append((n, " ".join(words)))
            n += 1
        out.append((n, " ".join(base + [passage] * (size % 3))))
        out.append((n + 1, " ".join(base[1:])))
        out.append((n + 2, " ".join(base[: max(1, size * 9 // 10)])))
        n += 3
    out += [(n + i, f"{sentence(rng, 20)} {passage} {sentence(rng, 15)}") for i in range(30)]
    return out


def test_join_equals_all_pairs(spark, docs, rows, no_docs):
    assert as_rows(size_join.jaccard_join(docs)) == brute(rows)
    many = near(random.Random(3))
    many += [(None, many[5][1]), (None, None), (7, many[40][1]), (3, "")]
    df = with_extras(spark.createDataFrame(many, "doc_id long, text string"))
    for percent in (85, 70):
        want = brute(many, percent=percent)
        assert len({r[2] for r in want}) < len(many) - 100
        assert as_rows(size_join.jaccard_join(df, percent=percent)) == want
    assert size_join.jaccard_join(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert as_rows(size_join.jaccard_join(blank)) == [("1", 0, "1"), ("2", 0, "2")]


def test_star_of_near_copies(spark):
    """Many copies around one text, most of which link with nothing: nothing is merged, nothing lost."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, " ".join(changed(rng, base, rng.randint(0, 9)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_rows(size_join.jaccard_join(df)) == brute(rows)


def test_keys_meet():
    """Every two sets that link have a subset (both small) or a posted part in common, whatever the sizes."""
    rng = np.random.default_rng(2)
    fresh = lambda k: rng.integers(0, 2**63, k, dtype=np.uint64)
    for trial in range(4000):
        percent = (60, 75, 85, 95)[trial % 4]
        n = int(rng.integers(1, 22 if percent >= 75 else 12)) if trial % 2 else int(rng.integers(1, 400))
        x = np.unique(fresh(n))
        cut, add = int(rng.integers(0, n * (100 - percent) // 100 + 2)), int(rng.integers(0, n * (100 - percent) // 100 + 2))
        y = np.unique(np.concatenate([rng.permutation(x)[min(cut, n - 1):], fresh(add)]))
        both = len(np.intersect1d(x, y))
        if 100 * both < percent * (len(x) + len(y) - both):
            continue
        one, two = (size_join.part_keys(s, percent) for s in (x, y))
        met = False
        for j in set(one[1] >> 40) & set(two[1] >> 40):
            heads = []
            for keys, least in (one, two):
                mine, most = keys[least >> 40 == j], least[least >> 40 == j][0] % (1 << 40)
                heads.append(set(np.sort(mine)[: len(mine) - max(most, 1) + 1]))  # any one order of all keys
            met |= bool(heads[0] & heads[1])
        assert met
        if max(len(x), len(y)) < 22:
            one, two = (set(zip(*(k.tolist() for k in size_join.subset_keys(s, 22, percent)[:2]))) for s in (x, y))
            assert one & two


def test_subsets_never_meet_below():
    """A common subset proves the link (a set of the smaller size is in it)."""
    rng = np.random.default_rng(3)
    for _ in range(500):
        x = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 16)), dtype=np.uint64))
        y = np.unique(np.concatenate([rng.permutation(x)[int(rng.integers(0, 3)):], rng.integers(0, 2**63, int(rng.integers(0, 4)), dtype=np.uint64)]))
        if not len(y):
            continue
        one, two = ({(a, b): c for a, b, c in zip(*(k.tolist() for k in size_join.subset_keys(s, 20)))} for s in (x, y))
        both = len(np.intersect1d(x, y))
        # two sets of the larger size in one subset's list only link through one of the smaller size
        assert any(one[k] or two[k] for k in one.keys() & two.keys()) == (100 * both >= 85 * (len(x) + len(y) - both))


def test_boundary_follows_counts():
    few, many = size_join.boundary({n: 1 for n in range(1, 33)}), size_join.boundary({5: 10**6, 30: 1})
    assert 8 <= few <= 32 and many >= 6
    assert size_join.boundary({}) == 1


def test_join_sql(spark, duck):
    ok, msg = compare(size_join.query(spark, SF_ORACLE), duck, size_join.ORACLE)
    assert ok, msg
