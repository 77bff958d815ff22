"""Language ID: one interpolated Kneser-Ney character model per language, kept in sorted hash arrays.

A text is folded to lower case, runs of other characters than letters become one boundary, and each language's model of
four characters gives a cross-entropy per character. The lowest one names the language; a temperature and an entropy bound,
both fitted on a calibration part of the training sample, give the score and the rejection flag. Every letter of Unicode is
itself; a letter that the sample lacks has the share that smoothing leaves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textnum import U

N = 4
DISCOUNT = 0.75
CHUNK = 1 << 18  # characters counted at a time, in whole texts
_ROLL, _SPREAD = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_fold: list = []


def fold() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and letterhood of the code points below 65536; made once per process."""
    if not _fold:
        points = [chr(i) for i in range(65536)]
        _fold.append(np.array([ord(c.lower()[0]) for c in points], np.uint32))
        _fold.append(np.array([c.isalpha() for c in points]))
    return _fold[0], _fold[1]


def letters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points, which of them are letters, and where each text starts among them."""
    lower, alpha = fold()
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    start = lead[at]
    if len(points) != lead[-1]:  # not UTF-8 as it should be: fall back to bytes
        points, start = data.astype(np.uint32), at
    small = np.minimum(points, 65535)
    is_letter = alpha[small]
    out = lower[small]
    for c in np.unique(points[points > 65535]):
        here = points == c
        is_letter[here] = chr(c).isalpha()
        out[here] = ord(chr(c).lower()[0])
    return out, is_letter, start


def characters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters, 0 for each run of other characters, and N - 1 zeros before each text; text starts."""
    points, is_letter, start = letters(data, at)
    points = np.where(is_letter, points, 0)
    keep = is_letter.copy()
    first = np.zeros(len(points) + 1, bool)
    first[start] = True
    keep[1:] |= is_letter[:-1] & ~first[1 : len(points)]
    kept = np.r_[0, np.cumsum(keep)][start]
    texts, pad = len(at) - 1, N - 1
    out = np.zeros(kept[-1] + pad * texts, np.uint32)
    out[np.arange(kept[-1]) + pad * np.repeat(np.arange(1, texts + 1), np.diff(kept))] = points[keep]
    return out, kept + pad * np.arange(texts + 1)


def grams(chars: np.ndarray) -> list[np.ndarray]:
    """For n from 1 to N: a 64-bit hash of the n characters that end at each place (the first n - 1 places have none)."""
    out = [chars.astype(np.uint64) + U(1)]
    for _ in range(N - 1):
        key = np.zeros(len(chars), np.uint64)
        key[1:] = out[-1][:-1] * _ROLL + out[0][1:]
        out.append(key)
    return [k * _SPREAD for k in out]


class Sorted:
    """A sorted array of 64-bit hashes with a directory of their highest bits."""

    def __init__(self, keys: np.ndarray):
        self.n, self.bits = len(keys), max(1, int(len(keys)).bit_length())
        self.keys = np.append(keys, ~U(0))
        self.begin = np.searchsorted(keys, np.arange(1 << self.bits, dtype=np.uint64) << U(64 - self.bits)).astype(np.int32)

    def find(self, q: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        at = self.begin[(q >> U(64 - self.bits)).astype(np.int64)]
        todo = np.flatnonzero(self.keys[at] < q)
        while len(todo):
            at[todo] += 1
            todo = todo[self.keys[at[todo]] < q[todo]]
        return np.where((self.keys[at] == q) & (at < self.n), at, -1)


class Model:
    """levels[n - 1]: (hashes, log probability, log back-off weight) of n-grams, the last two with a column per language; `unseen`: log
    probability of an unknown letter."""

    def __init__(self, langs, levels, unseen, temperature=1.0, bound=np.inf):
        self.langs, self.levels, self.unseen, self.temperature, self.bound = langs, levels, unseen, temperature, bound

    def logs(self, keys: list[np.ndarray], at: np.ndarray, n: int = N) -> np.ndarray:
        """Log probability of the character at each of these places, given the n - 1 before it, for each language."""
        if not n:
            return np.broadcast_to(self.unseen, (len(at), len(self.unseen)))
        index, logp, _ = self.levels[n - 1]
        found = index.find(keys[n - 1][at])
        out = logp[found]
        miss = np.flatnonzero(found < 0)
        if len(miss):
            out[miss] = self.logs(keys, at[miss], n - 1)
            if n > 1:
                index, _, back = self.levels[n - 2]
                context = index.find(keys[n - 2][at[miss] - 1])
                out[miss] += np.where(context[:, None] >= 0, back[context], 0)
        return out

    def entropy(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in bits per character for texts x languages; number of letters of each text."""
        chars, start = characters(data, at)
        first = start[:-1] + N - 1
        size = start[1:] - first
        real = np.ones(len(chars), bool)
        real[(start[:-1, None] + np.arange(N - 1)).reshape(-1)] = False
        value = self.logs(grams(chars), np.flatnonzero(real))
        # Whole multiples of 2**-20, so that sums are exact and a text's result doesn't depend on its neighbours.
        value = np.round(value * np.float32(1 << 20)).astype(np.int64)
        total = np.r_[np.zeros((1, value.shape[1]), np.int64), np.cumsum(value, axis=0)]
        ends = np.r_[0, np.cumsum(size)]
        out = (total[ends[1:]] - total[ends[:-1]]) / float(1 << 20)
        seen = np.r_[0, np.cumsum(chars > 0)]
        return -out / np.maximum(1, size)[:, None] / np.log(2), seen[start[1:]] - seen[start[:-1]]

    def predict(self, data: np.ndarray, at: np.ndarray):
        if not self.langs:
            n = len(at) - 1
            return np.full(n, "und"), np.zeros(n), np.ones(n, bool), np.zeros(n)
        h, n = self.entropy(data, at)
        best = h.argmin(1)
        z = np.exp(-(h - h.min(1, keepdims=True)) * self.temperature * np.sqrt(np.minimum(n, 400))[:, None])
        score = (1 / z.sum(1)) * (n > 0)
        low = h[np.arange(len(n)), best]
        return np.where(n > 0, np.array(self.langs)[best], "und"), score, (n == 0) | (low > self.bound), low


def estimate(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list, np.ndarray]:
    """Levels and `unseen` of the interpolated Kneser-Ney models of (characters, text starts) of each language."""
    langs, found = len(parts), [[] for _ in range(N)]
    for j, (chars, start) in enumerate(parts):
        cuts = np.unique(np.r_[np.searchsorted(start, np.arange(0, start[-1], CHUNK)), len(start) - 1])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # some texts at a time, so that only distinct n-grams are held
            some, first = chars[start[a] : start[b]], start[a:b] - start[a]
            place = np.arange(len(some)) - np.repeat(first, np.diff(np.r_[first, len(some)]))
            keys = grams(some)
            for n in range(1, N + 1):
                at = np.flatnonzero(place >= n - 1)
                key, one, c = np.unique(keys[n - 1][at], return_index=True, return_counts=True)
                shorter = keys[n - 2] if n > 1 else np.zeros(len(some), np.uint64)
                found[n - 1].append((np.full(len(key), j), key, shorter[np.maximum(at[one] - 1, 0)], shorter[at[one]], c))
    lists = []
    for rows in found:
        lang, key, before, after, c = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, t) for t in (np.int64, U, U, U, np.int64))
        key, one, group = np.unique(key, return_index=True, return_inverse=True)
        lists.append({"key": key, "prefix": before[one], "suffix": after[one], "index": Sorted(key)})
    count = np.stack([np.bincount(group[lang == j], c[lang == j], len(key)) for j in range(langs)], 1)
    counts = [count]
    for n in range(N - 1, 0, -1):  # continuation counts: distinct characters before each shorter n-gram
        longer = lists[n]
        suffix = lists[n - 1]["index"].find(longer["suffix"])
        counts.insert(0, np.stack([np.bincount(suffix[counts[0][:, j] > 0], minlength=len(lists[n - 1]["key"])) for j in range(langs)], 1).astype(float))
    alphabet = len(lists[0]["key"]) + 1
    total = counts[0].sum(0)
    rest = np.where(total > 0, DISCOUNT * (counts[0] > 0).sum(0) / np.maximum(total, 1), 1.0)
    p = np.maximum(counts[0] - DISCOUNT, 0) / np.maximum(total, 1) + rest / alphabet
    unseen = np.log(rest / alphabet).astype(np.float32)
    levels = []
    for n in range(2, N + 1):
        own, shorter = lists[n - 1], lists[n - 2]
        prefix, suffix = shorter["index"].find(own["prefix"]), shorter["index"].find(own["suffix"])
        c = counts[n - 1]
        total = np.stack([np.bincount(prefix, c[:, j], len(shorter["key"])) for j in range(langs)], 1)
        kinds = np.stack([np.bincount(prefix, c[:, j] > 0, len(shorter["key"])) for j in range(langs)], 1)
        rest = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        levels.append((shorter["index"], np.log(p).astype(np.float32), np.log(rest).astype(np.float32)))
        p = np.maximum(c - DISCOUNT, 0) / np.maximum(total[prefix], 1) + rest[prefix] * p[suffix]
    levels.append((lists[-1]["index"], np.log(p).astype(np.float32), None))
    return levels, unseen


def pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(x) for x in texts])].astype(np.int64)


def train(rows: list) -> Model:
    """rows: (text, lang). A fifth of them calibrates; the rest are counted."""
    langs = sorted({y for _, y in rows})
    if not langs:
        return Model([], [], np.zeros(0))
    own = [[t.encode() for t, y in rows if y == lang] for lang in langs]
    model = Model(langs, *estimate([characters(*pack([t for i, t in enumerate(texts) if i % 5] or texts)) for texts in own]))
    held = [t for texts in own for t in texts[::5]]
    truth = np.repeat(np.arange(len(langs)), [len(texts[::5]) for texts in own])
    h, n = (np.concatenate(x) for x in zip(*[model.entropy(*pack(held[i : i + 100])) for i in range(0, len(held), 100)], strict=True))
    h, n, truth = h[n > 0], n[n > 0], truth[n > 0]
    if len(truth):
        gap = (h - h.min(1, keepdims=True)) * np.sqrt(np.minimum(n, 400))[:, None]
        losses = {}
        for t in (0.25, 0.5, 1, 2, 4, 8):
            z = np.exp(-gap * t)
            losses[t] = -np.log(np.maximum(1e-9, z[np.arange(len(truth)), truth] / z.sum(1))).mean()
        model.temperature = min(losses, key=losses.get)
        model.bound = float(np.quantile(h.min(1), 0.995))
    return model


def fit(docs: DataFrame, per_lang: int = 800, max_bytes: int = 8_000_000, max_langs: int = 500) -> Model:
    """Train on at most `per_lang` rows of each language (together at most `max_bytes`) outside the held-out fold. Of more than
    `max_langs` values of lang, the most frequent are learned."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(crc % 4 != 2)
    totals = known.groupBy(F.col("lang").alias("y")).count().orderBy(F.desc("count"), "y").limit(max_langs).collect()
    if not totals:
        return train([])
    share = F.create_map(*[F.lit(x) for r in totals for x in (r.y, min(1.0, per_lang / r["count"]))])
    known = known.select(F.col("doc_id"), "text", F.col("lang").alias("y")).where(common.sample_order() < share[F.col("y")])
    return train(common.chosen(known, per_lang * len(totals), max_bytes))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, bits_per_char for every row.

    Null texts and texts without a letter are `und` with score 0. `rejected` marks texts that fit no learned language.
    A null doc_id has a null held_out; equal texts and repeated rows get equal results; other columns are ignored. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def make():
        m = shared.value

        def f(rows, data, at):
            lang, score, rejected, h = m.predict(data, at)
            return {"doc_id": rows.column(0), "lang_pred": pa.array(lang.tolist(), pa.string()), "score": pa.array(score), "rejected": pa.array(rejected), "bits_per_char": pa.array(h)}

        return f

    out = common.map_blocks(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, lang_pred string, score double, rejected boolean, bits_per_char double", make)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected", "bits_per_char")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
