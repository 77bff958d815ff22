"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A passage of three words is the average of the embeddings of all its character n-grams; a linear softmax turns the average
into a probability, and a document is as toxic as its worst passage. Unseen spellings share n-grams with seen ones. Longer
passages dilute a toxic word: the README tells what they cost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textnum import LOWER, SPACE, U, sums

GRAMS = (3, 4, 5, 6)


def grams(data: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, ordered by word: buckets, first n-gram of each word, first word of each text.

    Words are cut at white space; an n-gram may hold one space at either end, so that starts and ends of words differ
    from their middles.
    """
    n, texts = len(data), len(at) - 1
    pad = np.full(n + texts + 1, 32, np.uint8)
    place = np.arange(n) + np.repeat(np.arange(1, texts + 1), np.diff(at))
    pad[place] = LOWER[data]
    solid = ~SPACE[pad]
    start = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
    word_at = np.searchsorted(start, at + np.arange(texts + 1) + 1)
    h = pad.astype(np.uint64)
    clean = np.ones(len(pad), bool)
    keys, where = [], []
    for k in range(2, max(GRAMS) + 1):
        if len(h) <= 1:
            break
        h = (h[:-1] * U(0x100000001B3)) ^ (pad[k - 1 :].astype(np.uint64) + U(k))
        if k >= 3:
            clean = clean[: len(h)] & solid[k - 2 : k - 2 + len(h)]
        if k in GRAMS:
            i = np.flatnonzero(clean)
            keys.append(((h[i] * U(0x9E3779B97F4A7C15)) >> U(64 - bits)).astype(np.int32))
            where.append((i + 1).astype(np.int32))
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(texts + 1, np.int64)
    keys, where = np.concatenate(keys), np.concatenate(where)
    # Only the word of an n-gram matters, so a counting order by word is enough.
    word = (np.cumsum(solid[1:] & ~solid[:-1]) - 1)[where - 1].astype(np.int32)
    order = np.argsort(word, kind="stable")
    first = np.zeros(len(start) + 1, np.int64)
    np.cumsum(np.bincount(word, minlength=len(start)), out=first[1:])
    return keys[order], first, word_at


def passages(word_sum: np.ndarray, word_n: np.ndarray, word_at: np.ndarray, window: int) -> np.ndarray:
    """For the passage that starts at each word (cut at the end of its text): average over n-grams."""
    n = len(word_sum)
    text_end = np.repeat(word_at[1:], np.diff(word_at))
    stop = np.minimum(np.arange(n) + window, text_end)
    cs, cn = np.r_[0.0, np.cumsum(word_sum)], np.r_[0, np.cumsum(word_n)]
    return (cs[stop] - cs[:-1]) / np.maximum(1, cn[stop] - cn[:-1])


class Model:
    def __init__(self, bits: int, window: int, score: np.ndarray, bias: float, prior: float):
        self.bits, self.window, self.bias, self.prior = bits, window, bias, prior
        # Binary fractions, whose sums are exact: a passage's score doesn't depend on the texts beside it.
        self.score = (np.round(score * 65536) / 65536).astype(np.float32)

    def predict(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        keys, first, word_at = grams(data, at, self.bits)
        out = np.full(len(at) - 1, self.prior)
        if len(keys):
            logit = passages(sums(self.score[keys], first), np.diff(first), word_at, self.window) + self.bias
            full = np.flatnonzero(np.diff(word_at))
            top = np.maximum.reduceat(logit, word_at[full])
            out[full] = 1 / (1 + np.exp(-np.clip(top, -30, 30)))
        return out


def gather(data: list, bits: int, limit: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """grams() of whole texts, `limit` bytes at a time, so that only its result is held in full."""
    keys, first, word_at, batch, size = [], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [], 0
    for i, text in enumerate(data):
        batch.append(text)
        size += len(text)
        if size >= limit or i == len(data) - 1:
            k, f, w = grams(np.frombuffer(b"".join(batch), np.uint8), np.r_[0, np.cumsum([len(x) for x in batch])], bits)
            keys.append(k)
            first.append(f[1:] + first[-1][-1])
            word_at.append(w[1:] + word_at[-1][-1])
            batch, size = [], 0
    return np.concatenate(keys), np.concatenate(first), np.concatenate(word_at)


def train(rows: list, bits: int = 18, dim: int = 8, window: int = 3, epochs: int = 60, rate: float = 0.25, seed: int = 7) -> Model:
    """Full-batch Adagrad on embeddings and softmax weights: first on averages over whole texts, then on worst passages."""
    if not rows:
        return Model(bits, window, np.zeros(1 << bits), -3.0, 0.05)
    data = [t.encode() for t, _ in rows]
    y = np.array([v for _, v in rows], float)
    keys, first, word_at = gather(data, bits)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.02, (1 << bits, dim))
    w, bias = rng.normal(0, 1, (dim, 2)), 0.0
    acc, acc_w, acc_b = np.full(1 << bits, 1e-9), np.full(dim, 1e-9), 1e-9
    full = np.flatnonzero(np.diff(word_at))
    if not len(full):
        return Model(bits, window, np.zeros(1 << bits), -3.0, 0.05)
    y, spans = y[full], word_at[full]
    grams_at = first[np.r_[spans, word_at[-1]]]
    per_text = np.maximum(1, np.diff(grams_at))
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    text_end = np.repeat(word_at[1:], np.diff(word_at))
    ends = np.r_[spans, word_at[-1]]
    cuts = np.unique(np.r_[np.searchsorted(first, np.arange(0, len(keys), 1 << 19)), len(first) - 1])
    parts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))  # runs of words with about 2**19 n-grams

    def per_word(s):
        return np.concatenate([sums(s[keys[first[a] : first[b]]], first[a : b + 1] - first[a]) for a, b in parts])

    for epoch in range(epochs):
        slope = w[:, 1] - w[:, 0]
        s = emb @ slope
        if epoch < 6:
            z = sums(per_word(s), ends) / per_text * 20 + bias
            mass, use, target, wt = 20 / per_text, None, y, weight
        else:
            if epoch % 6:  # the worst passages are looked up anew every sixth step
                lo, hi, take = kept
            else:
                logit = passages(per_word(s), np.diff(first), word_at, window)
                best = np.maximum.reduceat(logit, spans)
                group = np.repeat(np.arange(len(spans)), np.diff(np.r_[spans, word_at[-1]]))
                pick = np.full(len(spans), len(logit))
                hit = np.flatnonzero(logit == best[group])
                np.minimum.at(pick, group[hit], hit)
                clean = np.flatnonzero(y == 0)
                size = np.diff(np.r_[spans, word_at[-1]])
                extra = (spans[clean] + rng.integers(0, 1 << 40, len(clean)) % size[clean]).astype(np.int64)
                take = np.r_[pick, extra]
                lo, hi = first[take], first[np.minimum(take + window, text_end[take])]
                kept = lo, hi, take
            mass = 1 / np.maximum(1, hi - lo)
            n = hi - lo
            each = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            z, use = np.add.reduceat(s[keys[each]], np.cumsum(n) - n) * mass + bias, take
            target = np.r_[y, np.zeros(len(clean))]
            wt = np.r_[weight, weight[clean] * 0.5]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * wt * mass
        if use is None:
            grad, of_word = np.zeros(1 << bits), np.repeat(g, np.diff(ends))
            for a, b in parts:
                grad += np.bincount(keys[first[a] : first[b]], weights=np.repeat(of_word[a:b], np.diff(first[a : b + 1])), minlength=1 << bits)
        else:
            grad = np.bincount(keys[each], weights=np.repeat(g, n), minlength=1 << bits)
        gw, gb = grad @ emb, float((g / mass).sum())
        acc += grad * grad
        emb -= (rate * grad / np.sqrt(acc))[:, None] * slope / (slope @ slope) ** 0.5
        acc_w += gw * gw
        step = 0.1 * rate * gw / np.sqrt(acc_w)
        w[:, 1] -= step
        w[:, 0] += step
        acc_b += gb * gb
        bias -= rate * gb / acc_b**0.5
    return Model(bits, window, emb @ (w[:, 1] - w[:, 0]), bias, 0.01)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, max_bytes: int = 3_500_000, **kw) -> Model:
    """Train on at most `max_rows` labelled rows (together at most `max_bytes`) outside the held-out fold."""
    return train(common.labelled(docs, labels, "toxic", max_rows, max_bytes), **kw)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Null, empty and blank texts get a low fixed score; a null
    doc_id has a null held_out. Equal texts and repeated rows have equal scores; other columns are ignored. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits floats, whatever the input's size

    def make():
        m = shared.value

        def f(rows, data, at):
            return {"doc_id": rows.column(0), "score": pa.array(m.predict(data, at))}

        return f

    out = common.map_blocks(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, score double", make)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
