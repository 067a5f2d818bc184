"""Language identification with a linear-chain conditional random field over words.

Every word gets a language: its emission score is a sum of learned weights of its
affixes (first and last one to four bytes), byte n-grams (two and three, with word
edges) and of the word itself (lexicon); learned transitions between the languages
of neighbouring words let a text switch. Forward-backward gives each word's
marginals; a text's language is the one with the largest share of them, its score
that share. A word over ``WORD_BYTES`` is as many positions of the chain as it has
pieces of that size, in training and in prediction, so text without blanks counts
by all its bytes.

The field is fitted on a bounded sample: at most ``PER_LANGUAGE`` documents a
language, of each at most ``SEGMENT`` neighbouring words. Half of the training
sequences join segments of two languages, so transitions are learned from
switches. Prediction covers every word of every text.

Rows: null texts and texts without a letter are ``und`` with score 0; a text whose
words are all one language scores near 1; ties go to the first language in order;
rows with a null language are predicted but not learned from; with nothing to learn
from everything is ``und``.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from renewlens.llm.common import fold, named, python_columns, select_as, table, texts_of

PER_LANGUAGE = 600
SEGMENT = 64
WEIGHTS = 1 << 17
EPOCHS = 4
BATCH = 32
RATE = 0.15
#: Longest position of the chain (bytes); longer words are cut into several.
WORD_BYTES = 64
#: Bytes of words whose features are taken at once.
FEATURE_BYTES = 500_000
#: Words per step of the forward-backward scan.
STEP = 64
#: Text bytes predicted at once: vocabulary, features and states of a slice take about twenty times as much.
SLICE_CHARS = 2_000_000

_ASCII_LETTER = re.compile(rb"[a-z]")


def pieces(word: bytes) -> list[bytes]:
    """A word in consecutive pieces of nearly equal size and at most WORD_BYTES, cut between characters."""
    k = -(-len(word) // (WORD_BYTES - 3))
    cuts = [len(word) * i // k for i in range(k + 1)]
    for i in range(1, k):
        while word[cuts[i]] & 0xC0 == 0x80:
            cuts[i] -= 1
    return [word[a:b] for a, b in zip(cuts, cuts[1:])]


def split_words(text: bytes) -> list[bytes]:
    """Lower-cased words at blanks, long ones in pieces; lower-casing follows Unicode."""
    words = text.decode("utf-8", "replace").lower().encode("utf-8").split()
    if not words or max(map(len, words)) <= WORD_BYTES:
        return words
    return [p for w in words for p in (pieces(w) if len(w) > WORD_BYTES else (w,))]


def has_letter(word: bytes) -> bool:
    """Whether a lower-cased UTF-8 word has a letter (Unicode category L; numerals and digits of any script are none)."""
    if _ASCII_LETTER.search(word):
        return True
    return not word.isascii() and any(map(str.isalpha, word.decode("utf-8", "replace")))


def _hash(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - 17)


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Weight indices of all words' features, flat, and the number of features of each word."""
    buf = b"".join(b"\x01" + w + b"\x02" for w in words) + bytes(8)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begin = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64) if len(words) else np.zeros(0, np.int64)
    blocks = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
    owner = np.repeat(np.arange(len(words)), lens)
    pos = np.arange(len(owner))
    left = (begin + lens)[owner] - pos
    idx, own = [], []
    for n in (2, 3):
        ok = left >= n
        idx.append(_hash(blocks[pos[ok]] & np.uint64((1 << 8 * n) - 1), n))
        own.append(owner[ok])
    for n in (1, 2, 3, 4):
        ok = np.flatnonzero(lens - 2 >= n)
        mask = np.uint64((1 << 8 * n) - 1)
        idx += [_hash(blocks[begin[ok] + 1] & mask, 10 + n), _hash(blocks[begin[ok] + lens[ok] - 1 - n] & mask, 20 + n)]
        own += [ok, ok]
    whole = np.fromiter((hash_word(w) for w in words), np.uint64, len(words))
    idx.append(_hash(whole, 30))
    own.append(np.arange(len(words)))
    idx, own = np.concatenate(idx).astype(np.int64), np.concatenate(own)
    order = np.argsort(own, kind="stable")
    return idx[order], np.bincount(own, minlength=len(words))


def hash_word(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def emissions(words: list[bytes], weights: np.ndarray, chunk: int = FEATURE_BYTES) -> np.ndarray:
    """(words, languages) emission scores."""
    out = np.zeros((len(words), weights.shape[1]), np.float32)
    at = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) // chunk
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(words)]
    for a, b in zip(cuts, cuts[1:]):
        idx, n = features(words[a:b])
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        out[a:b] = np.add.reduceat(weights[idx], starts, axis=0) / np.sqrt(n)[:, None]
    return out


def _normed(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def shares(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Sums of word marginals per sequence, by forward-backward.

    Sequences are cut into steps of STEP words: all steps' transfer matrices first,
    then the states at the cuts along each sequence, then the marginals inside all
    steps at once; the result is that of one uncut scan.
    """
    lang = emission.shape[1]
    x = np.exp(emission - emission.max(axis=1, keepdims=True)).astype(np.float32)
    a = np.exp(transition).astype(np.float32)
    out = np.zeros((len(lengths), lang))
    live = np.flatnonzero(lengths)
    if not len(live):
        return out
    n, first_word = lengths[live], (np.cumsum(lengths) - lengths)[live]
    steps = -(-n // STEP)
    seq = np.repeat(np.arange(len(live)), steps)
    nth = np.arange(len(seq)) - np.repeat(np.cumsum(steps) - steps, steps)
    start = first_word[seq] + nth * STEP
    size = np.minimum(STEP, first_word[seq] + n[seq] - start)
    at = np.minimum(start[:, None] + np.arange(STEP)[None, :], len(x) - 1)
    cells = x[at]  # (steps, STEP, lang)
    valid = np.arange(STEP)[None, :] < size[:, None]
    move = np.broadcast_to(np.eye(lang, dtype=np.float32), (len(seq), lang, lang)).copy()
    for t in range(STEP):
        v = np.flatnonzero(valid[:, t])
        if not len(v):
            break
        y = (move[v].reshape(-1, lang) @ a).reshape(-1, lang, lang) * cells[v, t][:, None, :]
        move[v] = y / y.sum(axis=(1, 2), keepdims=True)
    ahead = np.full((len(seq), lang), 1.0 / lang, np.float32)
    back = np.ones((len(seq), lang), np.float32)
    for k in range(1, int(steps.max())):
        c = np.flatnonzero(nth == k)
        ahead[c] = _normed(np.einsum("ij,ijk->ik", ahead[c - 1], move[c - 1]))
    for k in range(int(steps.max()) - 1, 0, -1):
        c = np.flatnonzero(nth == k)
        back[c - 1] = _normed(np.einsum("ijk,ik->ij", move[c], back[c]))
    forward = np.zeros_like(cells)
    for t in range(STEP):
        v = np.flatnonzero(valid[:, t])
        ahead[v] = forward[v, t] = _normed((ahead[v] @ a) * cells[v, t])
    total = np.zeros((len(seq), lang))
    for t in range(STEP - 1, -1, -1):
        v = np.flatnonzero(valid[:, t])
        total[v] += _normed(forward[v, t] * back[v])
        back[v] = _normed((cells[v, t] * back[v]) @ a.T)
    np.add.at(out, live[seq], total)
    return out


class Field:
    """A fitted field: languages, feature weights, transitions."""

    def __init__(self, languages: list[str], weights: np.ndarray, transition: np.ndarray):
        self.languages, self.weights, self.transition = languages, weights, transition

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        known: dict[bytes, int] = {}
        rows, lengths = [], []
        for t in texts:
            words = split_words(t)
            ids = [known.setdefault(w, len(known)) for w in words]
            rows.append(np.array(ids, np.int64))
        vocabulary = list(known)
        lettered = np.fromiter(map(has_letter, vocabulary), bool, len(vocabulary))
        for i, ids in enumerate(rows):
            rows[i] = ids[lettered[ids]] if len(ids) else ids
            lengths.append(len(rows[i]))
        lengths = np.array(lengths, np.int64)
        if not self.languages or not lengths.sum():
            return ["und"] * len(texts), [0.0] * len(texts)
        scores = emissions(vocabulary, self.weights)
        sums = shares(scores[np.concatenate(rows)], lengths, self.transition)
        best = sums.argmax(axis=1)
        share = sums[np.arange(len(best)), best] / np.maximum(sums.sum(axis=1), 1e-300)
        return ([self.languages[b] if n else "und" for b, n in zip(best, lengths)],
                [float(min(1.0, s)) if n else 0.0 for s, n in zip(share, lengths)])


def fit(samples: list[tuple[str, list[bytes]]], seed: int = 7) -> Field:
    """Maximum likelihood by AdaGrad over (language, words) segments."""
    languages = sorted({lang for lang, _ in samples})
    label = {lang: i for i, lang in enumerate(languages)}
    k = len(languages)
    weights = np.zeros((WEIGHTS, max(k, 1)), np.float32)
    transition = np.zeros((k, k))
    if k < 2:
        return Field(languages, weights, transition)
    rng = np.random.default_rng(seed)
    by_lang = defaultdict(list)
    for lang, words in samples:
        by_lang[label[lang]].append(words)
    transition += np.eye(k)
    seen_w, seen_t = np.full_like(weights, 1e-6), np.full_like(transition, 1e-6)
    flat = [(y, w) for y, ws in sorted(by_lang.items()) for w in ws]
    for _ in range(EPOCHS):
        order = rng.permutation(len(flat))
        for a in range(0, len(order), BATCH):
            words, gold, lengths = [], [], []
            for o in order[a : a + BATCH]:
                y, w = flat[o]
                w, ys = list(w), [y] * len(w)
                if rng.random() < 0.5:
                    y2, w2 = flat[rng.integers(len(flat))]
                    half = len(w) // 2 + 1
                    w, ys = w[:half] + list(w2)[:half], ys[:half] + [y2] * len(w2[:half])
                words += w
                gold += ys
                lengths.append(len(w))
            _step(words, np.array(gold), np.array(lengths), weights, transition, seen_w, seen_t)
    return Field(languages, weights, transition)


def _step(words, gold, lengths, weights, transition, seen_w, seen_t) -> None:
    """One AdaGrad step on a batch: expected minus observed feature and transition counts."""
    k = weights.shape[1]
    idx, n = features(words)
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    e = np.add.reduceat(weights[idx], starts, axis=0) / np.sqrt(n)[:, None]
    x = np.exp(e - e.max(axis=1, keepdims=True)).astype(float)
    a = np.exp(transition)
    first = np.cumsum(lengths) - lengths
    top = int(lengths.max())
    f, b = np.zeros_like(x), np.ones_like(x)
    state = np.full((len(lengths), k), 1.0 / k)
    for t in range(top):
        v = np.flatnonzero(lengths > t)
        state[v] = f[first[v] + t] = _normed((state[v] @ a) * x[first[v] + t])
    expected_t = np.zeros_like(transition)
    for t in range(top - 1, 0, -1):
        v = np.flatnonzero(lengths > t)
        here, prev = first[v] + t, first[v] + t - 1
        right = x[here] * b[here]
        pair = f[prev][:, :, None] * a[None] * right[:, None, :]
        expected_t += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b[prev] = _normed(right @ a.T)
    marginal = _normed(f * b)
    marginal[np.arange(len(gold)), gold] -= 1
    inner = np.ones(len(gold), bool)
    inner[first] = False
    here = np.flatnonzero(inner)
    np.add.at(expected_t, (gold[here - 1], gold[here]), -1)
    g = np.repeat(marginal / np.sqrt(n)[:, None], n, axis=0)
    rows, inverse = np.unique(idx, return_inverse=True)
    grad = np.stack([np.bincount(inverse, g[:, c], len(rows)) for c in range(k)], axis=1)
    seen_w[rows] += grad**2
    weights[rows] -= (RATE * grad / np.sqrt(seen_w[rows])).astype(np.float32)
    grad_t = expected_t / max(1, len(lengths))
    seen_t += grad_t**2
    transition -= RATE * grad_t / np.sqrt(seen_t)


def sample(docs: DataFrame, lang_col: str, id_col: str, text_col: str, learn: Column,
           per_language: int = PER_LANGUAGE, segment: int = SEGMENT) -> list[tuple[str, list[bytes]]]:
    """At most ``per_language`` segments of at most ``segment`` words per language, chosen by hash."""
    rows = (docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
            .select(F.col(lang_col).cast("string").alias("_lang"), F.col(id_col).cast("string").alias("_id"),
                    F.col(text_col).alias("_text")))
    spread = F.xxhash64("_lang", "_id").alias("h")
    sizes = rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n"))  # one row per language
    part = F.pmod("h", F.lit(1 << 20)) * F.col("n") < 2 * per_language * (1 << 20)
    near = rows.withColumn("h", spread).join(F.broadcast(sizes), "_lang").where(part)
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("_lang").orderBy("h", "_id"))).where(
        F.col("r") <= per_language)

    def make():
        def cut(batch):
            out = []
            for t, h in zip(texts_of(batch, "_text"), batch.column("h").to_pylist()):
                words = [w for w in split_words(t) if has_letter(w)]
                a = (h % max(1, len(words) - segment + 1)) if len(words) > segment else 0
                out.append(words[a : a + segment])
            return {"words": out}

        return cut

    got = python_columns(best.select("_lang", "_text", "h"), make, "words array<binary>", drop=("_text",)).collect()
    got = sorted((r["_lang"], r["h"], [bytes(w) for w in r["words"]]) for r in got)
    return [(lang, words) for lang, _, words in got if words]


def identify(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns of ``keep``, ``lang_pred`` and ``score`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # WEIGHTS x languages numbers

    def make():
        model = shared.value

        def run(batch):
            pred, score = model.predict(texts_of(batch, "_text"))
            return {"lang_pred": pred, "lang_score": score}

        return run

    out = python_columns(select_as(docs, id_col, text_col, keep), make, "lang_pred string, lang_score double",
                         drop=("_text",), chars=SLICE_CHARS)
    return out.select(*named(id_col, keep), "lang_pred", F.col("lang_score").alias("score"))


def learned_field(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang") -> Field:
    """The field fitted on the sample of the rows that ``learn`` allows."""
    return fit(sample(docs, lang_col, id_col, text_col, learn))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    field = learned_field(docs, ~held_out)
    return identify(docs, field).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
