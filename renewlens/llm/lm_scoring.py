"""Language-model scoring with a log-bilinear neural model trained by noise-contrastive estimation.

Tokens are lower-cased words between blanks and one end per document. The most
frequent words are classes of their own, all others share classes by their endings.
The model predicts a token's class from the vectors of the two classes before it
(each weighed by its position's vector) by an inner product with the class's own
vector plus a bias; inside a shared class the word has its smoothed share of the
class's training count, with one place for unseen words. So the probabilities of all
words, the unseen one of each class included, sum to one after any context.

Counts cover all training documents and are shuffled by word. Every task trains on
all its training tokens in mini-batches with shared noise samples; the tasks' vectors
are averaged by tokens. Normalised log-probabilities of all contexts come from batched
matrix products. Words outside a bounded list of frequent ones meet their counts in a
shuffled join, so no vocabulary is held whole anywhere.

A word over ``WORD_BYTES`` is counted under its SHA-256. Averages follow how the rows lie
in tasks, so ``score`` (not the base score) can differ between layouts of one table.

Rows: a null or empty text is its end alone; an empty table gives no rows; repeated rows are scored as often and, in
training, counted as often; with no training documents all words are unseen; a very
long text is scored whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewlens.llm.common import fold, python_columns, select_as, table, text_slices, texts_of, written

#: Classes in all; the last TAIL of them are shared by endings.
CLASSES = 256
TAIL = 32
ENDING = 3
DIM = 32
#: Frequent words whose counts are sent to every task, at most.
FREQUENT = 150_000
#: Longer words go by the end token's byte, which no word holds, and their SHA-256.
WORD_BYTES = 64
BATCH = 2048
NOISE = 48
RATE = 0.05
#: The end token; no word can hold a line break.
STOP = b"\n"
#: Distinct words a task counts before it passes its counts on.
FLUSH = 300_000


def tokens(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text, A-Z lower-cased (long ones by digest), then the end."""
    words = text.lower().split()
    if words and max(map(len, words)) > WORD_BYTES:
        words = [w if len(w) <= WORD_BYTES else STOP + sha256(w).digest() for w in words]
    words.append(STOP)
    return words


def tail_class(word: bytes) -> int:
    """The shared class of a word by its last bytes."""
    return CLASSES - TAIL + zlib.crc32(word[-ENDING:]) % TAIL


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, n): how often each token occurs in all documents of ``_text``."""

    def count(batches):
        total: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())],
                                              names=["w", "n"])

        for batch in batches:
            for part in text_slices(batch, "_text"):
                for t in texts_of(part, "_text"):
                    total.update(tokens(t))
                if len(total) > FLUSH:
                    yield out()
                    total.clear()
        if total:
            yield out()

    return docs.select("_text").mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Totals, class shares and the frequent words, all of bounded size."""

    def __init__(self, total: int, distinct: int, frequent: list[tuple[bytes, int]], tail_n, tail_v):
        self.total, self.distinct = total, distinct
        self.words = [w for w, _ in frequent]
        self.n = np.array([n for _, n in frequent], np.int64)
        own = CLASSES - TAIL
        self.cls = np.array([i if i < own else tail_class(w) for i, w in enumerate(self.words)], np.int64)
        mass = np.zeros(CLASSES)
        mass[: min(own, len(self.n))] = self.n[:own]
        mass[own:] = tail_n
        self.noise = (mass + 1) / (mass + 1).sum()
        #: log10 of a class's places: its tokens, its words and one for unseen ones (own classes hold one word).
        self.places = np.zeros(CLASSES)
        self.places[own:] = np.log10(np.asarray(tail_n, float) + np.asarray(tail_v, float) + 1)
        self.index: dict[bytes, int] = {}

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Index among the frequent words, -1 for others."""
        if not self.index:
            self.index = {w: i for i, w in enumerate(self.words)}
        get = self.index.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def classes(self, words: list[bytes], ids: np.ndarray) -> np.ndarray:
        out = self.cls[ids] if len(self.cls) else np.zeros(len(ids), np.int64)
        for i in np.flatnonzero(ids < 0).tolist():
            out[i] = tail_class(words[i])
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "index"} | {"index": {}}


def vocabulary(counts: DataFrame, frequent: int = FREQUENT) -> Vocabulary:
    """Totals over all counts, at most ``frequent`` of the most frequent words (ties: smaller word first), class sums.

    The words above a count are taken, and the count is found in a histogram, so that no more
    than ``frequent`` of them leave the executors; with too few above it the first CLASSES.
    """
    own = CLASSES - TAIL
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    step = F.floor(F.log2("n") * 16)  # a few hundred steps in all
    taken, lowest = 0, None
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("v")).collect(), key=lambda r: -r["s"]):
        if taken + r["v"] > frequent:
            break
        taken, lowest = taken + r["v"], r["s"]
    if taken < min(CLASSES, sums["v"]):
        near = counts.orderBy(F.desc("n"), "w").limit(min(CLASSES, frequent))
    else:
        near = counts.where(F.lit(False) if lowest is None else step >= lowest)
    top = sorted(((bytes(r["w"]), int(r["n"])) for r in near.collect()), key=lambda x: (-x[1], x[0]))
    # Own words are taken out of the class sums by subtraction: no join, one pass.
    cls = (F.crc32(F.expr(f"substring(w, greatest(length(w) - {ENDING - 1}, 1), {ENDING})")) % TAIL).cast("int")
    tail_n, tail_v = np.zeros(TAIL, np.int64), np.zeros(TAIL, np.int64)
    for r in counts.groupBy(cls.alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tail_n[r["c"]], tail_v[r["c"]] = r["n"], r["v"]
    for w, n in top[:own]:
        c = tail_class(w) - own
        tail_n[c] -= n
        tail_v[c] -= 1
    return Vocabulary(int(sums["n"] or 0), int(sums["v"]), top, tail_n, tail_v)


class LogBilinear:
    """Context vectors r, target vectors q, position weights c and biases b."""

    def __init__(self, r, q, c, b):
        self.r, self.q, self.c, self.b = (np.asarray(x, np.float32) for x in (r, q, c, b))
        self._table = None

    @staticmethod
    def start(noise: np.ndarray, seed: int = 11) -> "LogBilinear":
        """Small random vectors and the classes' shares as biases: the unigram model."""
        rng = np.random.default_rng(seed)
        draw = lambda: rng.normal(0, 0.1, (CLASSES, DIM))
        return LogBilinear(draw(), draw(), np.ones((2, DIM)), np.log(noise))

    def rows(self) -> np.ndarray:
        """All parameters as rows of DIM + 1 numbers: r, q with b, c."""
        zero = np.zeros((CLASSES, 1), np.float32)
        return np.concatenate([np.hstack([self.r, zero]), np.hstack([self.q, self.b[:, None]]), np.hstack([self.c, zero[:2]])])

    @staticmethod
    def of_rows(rows: np.ndarray) -> "LogBilinear":
        k = CLASSES
        return LogBilinear(rows[:k, :DIM], rows[k : 2 * k, :DIM], rows[2 * k :, :DIM], rows[k : 2 * k, DIM])

    def table(self) -> np.ndarray:
        """(CLASSES * CLASSES, CLASSES) log10 probabilities of a class after each pair of classes."""
        if self._table is None:
            out = np.empty((CLASSES * CLASSES, CLASSES), np.float32)
            near = self.c[1] * self.r
            for a in range(CLASSES):
                s = (self.c[0] * self.r[a] + near) @ self.q.T + self.b
                s -= s.max(axis=1, keepdims=True)
                s -= np.log(np.exp(s).sum(axis=1, keepdims=True))
                out[a * CLASSES : (a + 1) * CLASSES] = s / np.float32(np.log(10))
            self._table = out
        return self._table


def _by_class(cls: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Sum of the rows of ``g`` per class."""
    order = np.argsort(cls.astype(np.uint16), kind="stable")
    c = cls[order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(c)) + 1])
    out = np.zeros((CLASSES, g.shape[1]), np.float32)
    out[c[starts]] = np.add.reduceat(g[order], starts, axis=0)
    return out


class Trainer:
    """Noise-contrastive estimation in mini-batches with AdaGrad; one per task."""

    def __init__(self, model: LogBilinear, noise: np.ndarray, seed: int):
        self.m, self.noise = model, noise
        self.log_kn = np.log(NOISE * noise).astype(np.float32)
        self.cum = np.cumsum(noise)
        self.rng = np.random.default_rng(seed)
        self.seen = [np.full_like(x, 1e-4) for x in (model.r, model.q, model.c, model.b)]
        self.tokens = 0

    def step(self, first: np.ndarray, second: np.ndarray, target: np.ndarray) -> None:
        """One batch: contexts (two classes each) and the classes that follow."""
        m, n = self.m, len(target)
        r1, r2 = m.r[first], m.r[second]
        h = m.c[0] * r1 + m.c[1] * r2
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE) * self.cum[-1]), CLASSES - 1)
        qt, qn = m.q[target], m.q[noise]
        delta_t = np.einsum("ij,ij->i", h, qt) + m.b[target] - self.log_kn[target]
        delta_n = h @ qn.T + (m.b[noise] - self.log_kn[noise])
        g_t = (1 / (1 + np.exp(-np.clip(delta_t, -30, 30))) - 1)[:, None].astype(np.float32)
        g_n = (1 / (1 + np.exp(-np.clip(delta_n, -30, 30)))).astype(np.float32)
        dh = g_t * qt + g_n @ qn
        dq = _by_class(target, np.hstack([g_t * h, g_t]))
        np.add.at(dq, noise, np.hstack([g_n.T @ h, g_n.sum(axis=0)[:, None]]))
        dr = _by_class(first, dh * m.c[0]) + _by_class(second, dh * m.c[1])
        dc = np.stack([np.einsum("ij,ij->j", dh, r1), np.einsum("ij,ij->j", dh, r2)])
        for x, s, g in zip((m.r, m.q, m.c, m.b), self.seen, (dr, dq[:, :DIM], dc, dq[:, DIM])):
            g = g / n
            s += g * g
            x -= RATE * g / np.sqrt(s)
        self.tokens += n

    def learn(self, classes: np.ndarray, stop: int) -> None:
        """All tokens of a row of documents that each end with the end's class."""
        before = np.concatenate([[stop, stop], classes])
        # The first context of a document is two ends: the one before it, and the class before that is no context.
        one, two = before[:-2].copy(), before[1:-1]
        one[two == stop] = stop
        for a in range(0, len(classes), BATCH):
            self.step(one[a : a + BATCH], two[a : a + BATCH], classes[a : a + BATCH])


def train(docs: DataFrame, words: Vocabulary) -> LogBilinear:
    """Train on all tokens of all documents of ``_text``, averaging the tasks' models by tokens."""
    spark = docs.sparkSession
    start = LogBilinear.start(words.noise)
    shared = spark.sparkContext.broadcast((words, start))

    def fit(batches):
        vocab, model = shared.value
        model = LogBilinear(*[x.copy() for x in (model.r, model.q, model.c, model.b)])
        trainer = Trainer(model, vocab.noise, 17)
        stop = int(vocab.classes([STOP], vocab.ids([STOP]))[0])
        for batch in batches:
            for part in text_slices(batch, "_text", chars=2_000_000):
                flat = [w for t in texts_of(part, "_text") for w in tokens(t)]
                trainer.learn(vocab.classes(flat, vocab.ids(flat)), stop)
        rows = model.rows()
        if trainer.tokens:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(np.full(len(rows), float(trainer.tokens)))]
                + [pa.array(rows[:, k].astype(float)) for k in range(DIM + 1)],
                names=["i", "n"] + [f"v{k}" for k in range(DIM + 1)])

    parts = docs.select("_text").mapInArrow(fit, "i int, n double, " + ", ".join(f"v{k} double" for k in range(DIM + 1)))
    mean = parts.groupBy("i").agg(*[(F.sum(F.col("n") * F.col(f"v{k}")) / F.sum("n")).alias(f"v{k}") for k in range(DIM + 1)])
    got = mean.orderBy("i").collect()  # one row per class vector
    return LogBilinear.of_rows(np.array([list(r)[1:] for r in got])) if got else start


def score(docs: DataFrame, counts: DataFrame, words: Vocabulary, model: LogBilinear, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((words, model))
    base_places = float(np.log10(words.total + words.distinct + 1))

    def make():
        vocab, lm = shared.value
        log_n = np.log10(np.append(vocab.n, 0) + 1.0)
        own = CLASSES - TAIL
        stop = int(vocab.classes([STOP], vocab.ids([STOP]))[0])
        table_ = lm.table()

        def run(batch):
            rows = [tokens(t) for t in texts_of(batch, "_text")]
            flat = [w for r in rows for w in r]
            lengths = np.fromiter(map(len, rows), np.int64, len(rows))
            ids = vocab.ids(flat)
            cls = vocab.classes(flat, ids)
            begin = np.cumsum(lengths) - lengths
            before = np.concatenate([[stop, stop], cls])
            one, two = before[:-2].copy(), before[1:-1].copy()
            two[begin] = stop
            one[begin] = stop
            one[np.minimum(begin + 1, len(one) - 1)[lengths > 1]] = stop
            logs = log_n[ids]  # -1 is the last entry: log10(0 + 1), the join adds the rest
            inside = np.where(cls < own, 0.0, logs - vocab.places[cls])
            model_part = table_[one * CLASSES + two, cls].astype(float) + inside
            add = lambda x: np.add.reduceat(x, begin) if len(begin) else np.zeros(0)
            rare = np.flatnonzero(ids < 0)
            doc_of = np.searchsorted(begin, rare, "right") - 1
            found = [Counter() for _ in rows]
            for i, d in zip(rare.tolist(), doc_of.tolist()):
                found[d][flat[i]] += 1
            return {
                "n_tokens": lengths, "top_known": add((ids >= 0).astype(np.int64)),
                "base_part": add(logs) - lengths * base_places, "model_part": add(model_part),
                "rare": [[{"w": w, "tf": n} for w, n in f.items()] for f in found],
            }

        return run

    src = select_as(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id())
    parts = written(python_columns(
        src, make, "n_tokens long, top_known long, base_part double, model_part double, rare array<struct<w:binary,tf:long>>",
        drop=("_text",), chars=2_000_000), "lm-parts")  # rows keep their number from here on
    rare = parts.where(F.size("rare") > 0).select("_row", F.explode("rare").alias("x")).select("_row", "x.w", "x.tf")
    known = rare.join(counts, "w").groupBy("_row").agg(
        F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("s"), F.sum("tf").alias("k"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return parts.join(known, "_row", "left").select(
        F.col("_id").alias(id_col), "n_tokens", (F.col("top_known") + zero("k")).cast("long").alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"), (F.col("base_part") + zero("s")).alias("base_score"),
        (F.col("model_part") + zero("s")).alias("score"))


def fitted(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text"):
    """Counts, vocabulary and model of the documents that ``learn`` (a condition on ``_id``) allows."""
    training = select_as(docs, id_col, text_col).where(F.lit(True) if learn is None else learn)
    counts = written(word_counts(training), "lm-counts")
    words = vocabulary(counts)
    return counts, words, train(training, words)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counts, words, model = fitted(docs, fold(F.col("_id"), 7) != 2)
    held_out = (fold(F.col("doc_id"), 7) == 2).alias("held_out")
    return score(docs, counts, words, model).select(
        "doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")
