"""Toxicity with a counterfactually regularised classifier.

A logistic classifier over word features is fitted on labelled texts. For every
training sentence with identity terms a counterfactual is made by swapping the terms
for others of their group; the loss adds the squared difference of the two logits,
so the score cannot lean on which group a text mentions. What a toxic text says about
a group still counts, the mention alone does not.

Features are the distinct words of a text (lower-cased, outer punctuation removed),
their beginnings of 3 to 6 and ends of 3 to 5 bytes, all hashed. Only features whose
share of toxic texts differs from the sample's by more than chance (and identity terms)
get a weight; a text's logit is the bias plus the weights of its distinct words, so one
toxic word shows in a text of any length.

The classifier is fitted on a bounded sample: at most ``PER_CLASS`` texts of either
label, chosen by hash, of each all words. Tasks count the sample's features and cut the
texts down to those with a weight, so words do not pass through the driver, only numbers
below ``MAX_FEATURES``. Training and scoring read every word of a text, whole.

Rows: null and empty texts get the score of a text without words; rows with a null
label are not learned from; a document labelled several times is learned from as
often; with only one label present the score is that label's share. Labels without
a document and documents without a label are fine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from renewlens.llm.common import fold, named, python_columns, select_as, table, text_slices, texts_of, written

PER_CLASS = 4000
#: Texts of the sample that must hold a word before it is a feature.
MIN_TEXTS = 4
#: Deviations of a feature's toxic share from the sample's before it is used.
DEVIATIONS = 4.0
#: Features with a weight, at most.
MAX_FEATURES = 20_000
BITS = 40
EPOCHS = 20
BATCH = 64
RATE = 0.2
L2 = 1e-3
#: Weight of the squared logit difference between a text and its counterfactual.
FAIRNESS = 1.0
#: Words a worker remembers the weight of.
CACHE = 400_000

#: Identity terms by group; a term is swapped for the next of its group.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"), ("she", "he"),
    ("her", "his"), ("mother", "father"), ("wife", "husband"), ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "native"), ("african", "european", "american", "arab"),
    ("immigrant", "citizen", "refugee"), ("immigrants", "citizens", "refugees"), ("old", "young"),
    ("deaf", "blind", "disabled", "autistic"), ("frauen", "männer"), ("mujeres", "hombres"), ("femmes", "hommes"),
    ("juden", "christen", "muslime"), ("judíos", "cristianos", "musulmanes"), ("juifs", "chrétiens", "musulmans"),
)

_OUTER = b".,!?*$%&#|:;()\"'[]{}<>-_/\\~`^+="


def word_list(text: bytes) -> set[bytes]:
    """Distinct words at blanks, lower-cased, without outer punctuation."""
    words = {w.strip(_OUTER) for w in set(text.decode("utf-8", "replace").lower().encode("utf-8").split())}
    words.discard(b"")
    return words


def feature(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) & ((1 << BITS) - 1)


def features(word: bytes) -> list[int]:
    """The word itself, then its beginnings and ends."""
    n = len(word)
    ends = [b"^" + word[:k] for k in (3, 4, 5, 6) if n > k] + [word[-k:] + b"$" for k in (3, 4, 5) if n > k]
    return [feature(word), *map(feature, ends)]


class Classifier:
    """Weights by feature and a bias."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(features)
        self.features, self.weights, self.bias = features[order], weights[order], bias
        self._by_word: dict[bytes, float] = {}

    def _learned(self, words: list[bytes]) -> list[float]:
        """Weight of each word: the sum over its features."""
        if not len(self.features) or not words:
            return [0.0] * len(words)
        each = [features(w) for w in words]
        n = np.fromiter(map(len, each), np.int64, len(each))
        f = np.fromiter((x for e in each for x in e), np.int64, int(n.sum()))
        at = np.minimum(np.searchsorted(self.features, f), len(self.features) - 1)
        w = np.where(self.features[at] == f, self.weights[at], 0.0)
        return np.add.reduceat(w, np.cumsum(n) - n).tolist()

    def score(self, texts: list[bytes]) -> np.ndarray:
        rows = [word_list(t) for t in texts]
        new = list(set().union(*rows).difference(self._by_word)) if rows else []
        fresh = dict(zip(new, self._learned(new)))
        if len(self._by_word) < CACHE:
            self._by_word.update(fresh)
            get = self._by_word.__getitem__
        else:
            known = self._by_word

            def get(w):
                return fresh[w] if w in fresh else known[w]

        logit = np.array([self.bias + sum(map(get, sorted(r))) for r in rows])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def selected(y: np.ndarray, rows: list[np.ndarray], min_texts: int) -> np.ndarray:
    """Features whose toxic share deviates from the sample's by more than DEVIATIONS, the strongest first."""
    sets = [np.unique(r) for r in rows]
    flat = np.concatenate(sets)
    owner = np.repeat(y, [len(s) for s in sets])
    found, inverse, n = np.unique(flat, return_inverse=True, return_counts=True)
    toxic = np.bincount(inverse, owner, len(found))
    share = y.mean()
    z = np.abs(toxic - n * share) / np.sqrt(n * share * (1 - share))
    good = np.flatnonzero((n >= min_texts) & (z >= DEVIATIONS))
    return np.sort(found[good[np.argsort(-z[good], kind="stable")[:MAX_FEATURES]]])


def fit(labels, words: list[list[bytes]], groups=IDENTITY_GROUPS, fairness: float = FAIRNESS,
        min_texts: int = MIN_TEXTS, seed: int = 5) -> Classifier:
    """AdaGrad on log-loss plus the counterfactual penalty; ``words`` holds each text's distinct words."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return constant(y)
    terms, of = swaps(groups), feature_rows()
    used = np.union1d(selected(y, [of(ws) for ws in words], min_texts), term_features(terms))
    data, other = zip(*[placed(ws, used, terms, of) for ws in words])
    return descend(y, used, data, other, fairness, seed)


def constant(y: np.ndarray) -> Classifier:
    """The share of the only label as everyone's score."""
    share = float(y.mean()) if len(y) else 0.5
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Classifier(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))


def swaps(groups) -> dict[bytes, bytes]:
    """Each identity term's counterpart."""
    terms = {}
    for group in groups:
        g = [t.lower().encode("utf-8") for t in group]
        terms.update(zip(g, g[1:] + g[:1]))
    return terms


def term_features(terms: dict[bytes, bytes]) -> np.ndarray:
    return np.array([x for t in terms for x in features(t)], np.int64)


def feature_rows():
    """A function from words to all their features; it remembers at most CACHE words."""
    made: dict[bytes, np.ndarray] = {}

    def of(w):
        got = made.get(w)
        if got is None:
            got = np.array(features(w), np.int64)
            if len(made) < CACHE:
                made[w] = got
        return got

    return lambda ws: np.concatenate([of(w) for w in ws]) if ws else np.zeros(0, np.int64)


def placed(words: list[bytes], used: np.ndarray, terms: dict[bytes, bytes], of) -> tuple[np.ndarray, np.ndarray | None]:
    """Places in ``used`` of a text's features, and of its counterfactual's if it has identity terms."""

    def place(f):
        at = np.minimum(np.searchsorted(used, f), max(len(used) - 1, 0)).astype(np.int32)
        return at[used[at] == f] if len(used) else at[:0]

    return place(of(words)), place(of([terms.get(w, w) for w in words])) if any(w in terms for w in words) else None


def descend(y: np.ndarray, used: np.ndarray, data, other, fairness: float, seed: int) -> Classifier:
    """The descent over the texts' places (and their counterfactuals') in ``used``."""
    # Labels are weighed evenly, so the limit of one half does not depend on how many of each were sampled.
    share = y.mean()
    prior = float(np.log(share / (1 - share)))
    w, bias = np.zeros(len(used)), prior
    seen, seen_b = np.full(len(used), 1e-6), 1e-6
    rng = np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        rate = RATE / (1 + epoch / 4)
        for a in range(0, len(order), BATCH):
            batch = order[a : a + BATCH]
            idx, val, g_bias = [], [], 0.0
            for i in batch:
                z = bias + w[data[i]].sum()
                g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]
                g_bias += g
                idx.append(data[i])
                val.append(np.full(len(data[i]), g))
                if other[i] is not None:
                    d = 2 * fairness * (w[data[i]].sum() - w[other[i]].sum())
                    idx += [data[i], other[i]]
                    val += [np.full(len(data[i]), d), np.full(len(other[i]), -d)]
            at, inverse = np.unique(np.concatenate(idx), return_inverse=True)
            g = np.bincount(inverse, np.concatenate(val), len(at)) / len(batch) + L2 * w[at]
            seen[at] += g**2
            w[at] -= rate * g / np.sqrt(seen[at])
            g_bias /= len(batch)
            seen_b += g_bias**2
            bias -= rate * g_bias / np.sqrt(seen_b)
    return Classifier(used, w, float(bias))


def sample(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str,
           per_class: int = PER_CLASS) -> DataFrame:
    """(_id, _y, words) of at most ``per_class`` labelled texts of either label, chosen by hash; words are distinct."""
    known = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
             .where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull()))
    known = known.where(learn)
    h = F.xxhash64(F.col("_id").cast("string"), F.lit("toxicity"))
    sizes = known.groupBy("_y").agg(F.count(F.lit(1)).alias("n"))  # two rows
    near = (known.withColumn("h", h).join(F.broadcast(sizes), "_y")
            .where(F.pmod("h", F.lit(1 << 20)) * F.col("n") < 2 * per_class * (1 << 20))
            .withColumn("r", F.row_number().over(Window.partitionBy("_y").orderBy("h", "_id")))
            .where(F.col("r") <= per_class).select("_id", "_y"))  # at most 2 x per_class rows
    texts = select_as(docs, id_col, text_col).join(F.broadcast(near), "_id")

    def make():
        def run(batch):
            return {"words": [b"\n".join(sorted(word_list(t))) for t in texts_of(batch, "_text")]}

        return run

    return python_columns(texts, make, "words binary", drop=("_text",))


def _words(batch) -> list[list[bytes]]:
    return [w.split(b"\n") if w else [] for w in batch.column("words").to_pylist()]


def selected_of(texts: DataFrame, min_texts: int = MIN_TEXTS) -> np.ndarray:
    """``selected`` for a sample in a table: counts per batch, sums by feature; at most MAX_FEATURES come back."""

    def count(batches):
        of = feature_rows()
        for batch in batches:
            for part in text_slices(batch, "words"):
                y = part.column("_y").to_numpy()
                sets = [np.unique(of(ws)) for ws in _words(part)]
                found, inverse, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
                toxic = np.bincount(inverse, np.repeat(y, [len(s) for s in sets]), len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n), pa.array(toxic)], names=["f", "n", "toxic"])

    size = texts.agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("toxic")).first()
    share = size["toxic"] / size["n"]
    n = F.col("n").cast("double")
    z = F.abs(F.col("toxic") - n * share) / F.sqrt(n * share * (1 - share))
    sums = (texts.select("_y", "words").mapInArrow(count, "f long, n long, toxic long").groupBy("f")
            .agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")))
    best = sums.where(F.col("n") >= min_texts).withColumn("z", z).where(F.col("z") >= DEVIATIONS).orderBy(F.desc("z"), "f").limit(MAX_FEATURES)
    return np.sort(np.array([r["f"] for r in best.select("f").collect()], np.int64))


def learned(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
            label_col: str = "toxic", groups=IDENTITY_GROUPS) -> Classifier:
    """The classifier fitted on the labelled rows that ``learn`` (a condition on ``_id``) allows."""
    texts = written(sample(docs, labels, F.lit(True) if learn is None else learn, id_col, text_col, label_col), "toxic-sample")
    present = [r["_y"] for r in texts.select("_y").distinct().collect()]
    if len(present) < 2:
        return constant(np.array(present, float))
    terms = swaps(groups)
    used = np.union1d(selected_of(texts), term_features(terms))
    shared = docs.sparkSession.sparkContext.broadcast((used, terms))  # at most MAX_FEATURES and the terms' features

    def make():
        used, terms = shared.value
        of = feature_rows()

        def run(batch):
            data, other = zip(*[placed(ws, used, terms, of) for ws in _words(batch)])
            return {"data": list(data), "other": list(other)}

        return run

    got = python_columns(texts, make, "data array<int>, other array<int>", text="words", drop=("words",)).collect()
    got = sorted(((str(r["_id"]), r["_y"], r["data"], r["other"]) for r in got), key=lambda r: r[:3])
    array = lambda x: None if x is None else np.array(x, np.int32)
    return descend(np.array([r[1] for r in got], float), used, [array(r[2]) for r in got], [array(r[3]) for r in got],
                   FAIRNESS, 5)


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text",
          keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns of ``keep``, ``score`` and ``predicted`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.bias))  # a bounded model

    def make():
        local = Classifier(*shared.value)
        return lambda batch: {"tox_score": local.score(texts_of(batch, "_text"))}

    out = python_columns(select_as(docs, id_col, text_col, keep), make, "tox_score double", drop=("_text",))
    return out.select(*named(id_col, keep), F.col("tox_score").alias("score"),
                      (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = learned(docs, table(spark, sf_dir, "labels"), fold(F.col("_id"), 5) != 0)
    held_out = (fold(F.col("doc_id"), 5) == 0).alias("held_out")
    return score(docs, model).select("doc_id", held_out, "score", "predicted")
