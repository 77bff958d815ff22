"""Benchmark decontamination: word 3-grams seed a join of documents with test items; Smith-Waterman confirms.

Items are indexed in blocks of bounded size. One scan of the documents per block finds every 3-gram that a text shares
with an item, and the window of words round it. A window is written if its words could reach the threshold, which an
alignment of a part of them can't exceed; then it is aligned locally with its item, so edited and paraphrased copies score
too, however common they are. The scan also counts how often each 3-gram of the items occurs in the corpus: those that are
rare are seeds, and a find tells how many it holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textnum import LOWER, U, HashIndex, mix, span_hashes, spread, words

N = 3
MISMATCH = GAP = 0.4
#: Bytes of item texts in one broadcast block; a larger benchmark takes several scans.
ITEM_BYTES = 16 << 20


def grams(h: np.ndarray, n: int = N) -> np.ndarray:
    out = np.zeros(max(0, len(h) - n + 1), U)
    for j in range(n):
        out = out * U(0x9E3779B97F4A7C15) + h[j : len(out) + j]
    return mix(out + U(N - n))


def pair(item: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mix(key + mix(item.astype(U)))


class Items:
    """Word hashes of items; for n from 1 to N an index from n-grams to (item, place), of items of n words or, for N, of N words
    or more; an index of (item, word) and its count."""

    def __init__(self, rows: list):
        self.ids = [i for i, _ in rows]
        data = [(t or "").encode() for _, t in rows]
        buf, at = np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(d) for d in data])].astype(np.int64)
        low = LOWER[buf]
        start, end, first = words(low, at)
        h = span_hashes(low, start, end)
        self.words = [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.length = np.diff(first)
        self.seeds, self.lists = HashIndex(np.zeros(0, U)), {}
        for n in range(1, N + 1):
            own = np.flatnonzero(self.length >= N if n == N else self.length == n)
            g = [grams(self.words[i], n) for i in own]
            if not len(own):
                continue
            flat = np.concatenate(g)
            item = np.repeat(own, [len(x) for x in g])
            place = np.concatenate([np.arange(len(x)) for x in g])
            order = np.argsort(flat, kind="stable")
            keys, begin = np.unique(flat[order], return_index=True)
            self.lists[n] = HashIndex(keys), np.r_[begin, len(flat)], item[order], place[order]
        key, self.count = np.unique(pair(np.repeat(np.arange(len(self.words)), self.length), h), return_counts=True)
        self.kinds = HashIndex(key)

    def rarest(self, counts: tuple[np.ndarray, np.ndarray], rows: int) -> None:
        """Set the seeds: of each item the rarer half of its n-grams that occur at all, and all in fewer than a thousandth of the rows."""
        index, keys = HashIndex(counts[0]), []
        for own, begin, item, _ in self.lists.values():
            gram = np.repeat(own.keys, np.diff(begin))
            at = index.find(gram)
            item, gram, n = item[at >= 0], gram[at >= 0], counts[1][at[at >= 0]]
            order = np.lexsort((n, item))
            item, gram, n = item[order], gram[order], n[order]
            size = np.unique(item, return_counts=True)[1]
            _, place = spread(size)
            many = np.repeat(size, size)
            keys.append(pair(item, gram)[(2 * place < many) | (n < rows / 1000)])
        self.seeds = HashIndex(np.unique(np.concatenate([*keys, np.zeros(0, U)])))


def reach(items: Items, item: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For windows h[a:b]: the most words of the item that any alignment can match: no alignment scores more."""
    group, place = spread(b - a)
    at = items.kinds.find(pair(item[group], h[a[group] + place]))
    group, at = group[at >= 0], at[at >= 0]
    both, n = np.unique(group * max(1, len(items.count)) + at, return_counts=True)
    group, at = both // max(1, len(items.count)), both % max(1, len(items.count))
    return np.bincount(group, np.minimum(n, items.count[at]), len(a))


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman with linear gaps over words: best score, and where it begins and ends in the window."""
    m = len(window)
    score, origin = np.zeros(m + 1), np.arange(m + 1)
    best = (0.0, 0, 0)
    ramp = GAP * np.arange(m + 1)
    for w in item:
        diag = score[:-1] + np.where(window == w, 1.0, -MISMATCH)
        from_diag = np.where(score[:-1] > 0, origin[:-1], np.arange(m))
        up = score[1:] - GAP
        new, start = np.zeros(m + 1), np.arange(m + 1)
        new[1:] = np.maximum(np.maximum(diag, up), 0)
        start[1:] = np.where(diag >= up, from_diag, origin[1:])
        lifted = new + ramp  # a gap in the item: the best of what lies left, less its distance
        top = np.maximum.accumulate(lifted)
        at = np.maximum.accumulate(np.where(lifted >= top, np.arange(m + 1), 0))
        new, start = top - ramp, start[at]
        score, origin = new, start
        j = int(np.argmax(score))
        if score[j] > best[0]:
            best = (float(score[j]), int(origin[j]), j)
    return best


def merged(text: np.ndarray, item: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows [a, b) of one text and item that meet become one: for hits sorted by text, item and a, the first hit of each
    window, the windows' ends, and each hit's window."""
    group = np.cumsum(np.r_[False, (text[1:] != text[:-1]) | (item[1:] != item[:-1])]) if len(a) else np.zeros(0, np.int64)
    wide = int(b.max()) + 2 if len(b) else 1
    top = np.maximum.accumulate(group * wide + b)
    head = np.r_[True, group[1:] * wide + a[1:] > top[:-1]] if len(a) else np.zeros(0, bool)
    first = np.flatnonzero(head)
    last = np.r_[first[1:], len(a)] - 1 if len(a) else first
    return first, top[last] - group[last] * wide, np.cumsum(head) - 1


def windows(docs: DataFrame, shared, threshold: float) -> DataFrame:
    """A row for each stretch of a text that shares n-grams with an item and could reach the threshold: doc_id, row, tx, item (number),
    begin (word), seen (n-grams' hashes) and the words' hashes. For each block of texts also a row without an item: the items' n-grams
    in it (seen) and their counts (body). No shuffle."""

    def make():
        items = shared.value

        def f(rows, data, at):
            low = LOWER[data]
            start, end, first = words(low, at)
            h = span_hashes(low, start, end)
            text_of = np.repeat(np.arange(len(at) - 1), np.diff(first))
            out, often = [], []
            for n, (index, begin, owner, places) in items.lists.items():
                g = grams(h, n)
                hit = index.find(g)
                pos = np.flatnonzero(hit >= 0)
                pos = pos[text_of[pos] == text_of[pos + n - 1]]
                often.append(np.unique(g[pos], return_counts=True))
                group, place = spread(begin[hit[pos] + 1] - begin[hit[pos]])
                entry = begin[hit[pos]][group] + place
                pos, item = pos[group], owner[entry]
                text, lead = text_of[pos], pos - places[entry]
                slack = items.length[item] // 2
                a, b = np.maximum(first[text], lead - slack), np.minimum(first[text + 1], lead + items.length[item] + slack)
                order = np.lexsort((a, item, text))
                text, item, a, b, seen = text[order], item[order], a[order], b[order], g[pos[order]]
                one, stop, window = merged(text, item, a, b)
                good = reach(items, item[one], h, a[one], stop) >= threshold * items.length[item[one]]
                cut = np.r_[one, len(a)]
                out += [(int(text[one[w]]), int(item[one[w]]), int(a[one[w]] - first[text[one[w]]]), np.unique(seen[cut[w] : cut[w + 1]]), h[a[one[w]] : stop[w]]) for w in np.flatnonzero(good)]
            keys, n = (np.concatenate(x) for x in zip(*often, strict=True)) if often else (np.zeros(0, U), np.zeros(0, np.int64))
            pick = pa.array([*[o[0] for o in out], None], pa.int64())
            return {
                "doc_id": rows.column(0).take(pick), "row": rows.column(2).take(pick), "tx": rows.column(3).take(pick), "item": pa.array([*[o[1] for o in out], None], pa.int32()), "begin": pa.array([*[o[2] for o in out], None], pa.int64()),
                "seen": pa.array([*[o[3].tobytes() for o in out], keys.tobytes()], pa.binary()), "body": pa.array([*[o[4].tobytes() for o in out], n.astype(np.int64).tobytes()], pa.binary()),
            }

        return f

    docs = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tx"))
    return common.map_blocks(docs, "doc_id long, row long, tx long, item int, begin long, seen binary, body binary", make)


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.45) -> DataFrame:
    """(doc_id, tx, item_id, score, n_seeds, start_word, end_word): the best alignment of every row and item that reaches
    `threshold` of the score of a full copy. `tx` is the xxhash64 of the text.

    A document that shares no 3-gram with an item is not aligned with it; an item of one or two words must occur whole. A
    3-gram is a seed if it is among the rarer half of its item's, or in fewer than a thousandth of the rows; a find need not
    have one. Null and empty texts have no words, on either side. Repeated rows are reported each; null ids stay null; other
    columns are ignored. An empty benchmark gives no row.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // ITEM_BYTES))
    out = None
    for part in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        rows = sorted(own.collect(), key=lambda r: (r.item_id is not None, r.item_id or 0, r.text))  # of about ITEM_BYTES bytes
        found = _find(docs, Items(rows), threshold)
        out = found if out is None else out.unionByName(found)
    return out


def _find(docs: DataFrame, items: Items, threshold: float) -> DataFrame:
    context = docs.sparkSession.sparkContext
    found = common.materialize(windows(docs, context.broadcast(items), threshold))

    def counted(batches):
        total: dict = {}
        for x in batches:
            for keys, n in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                for k, c in zip(np.frombuffer(keys, np.int64).tolist(), np.frombuffer(n, np.int64).tolist(), strict=True):
                    total[k] = total.get(k, 0) + c
        yield pa.RecordBatch.from_pydict({"gram": pa.array(list(total), pa.int64()), "n": pa.array(list(total.values()), pa.int64())})

    often = found.where("item is null").select("seen", "body").mapInArrow(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    # At most the n-grams of ITEM_BYTES of text, so counts may go to the driver and seeds may be broadcast.
    items.rarest((often.column("gram").to_numpy().view(U), often.column("n").to_numpy()), docs.count())
    shared = context.broadcast(items)

    def run(batches):
        items = shared.value
        for x in batches:
            out = []
            for doc_id, row, tx, item, begin, seen, body in zip(*(c.to_pylist() for c in x.columns), strict=True):
                own = items.words[item]
                score, a, b = align(own, np.frombuffer(body, U))
                if score >= threshold * len(own):
                    seen = np.frombuffer(seen, U)
                    n = int((items.seeds.find(pair(np.full(len(seen), item), seen)) >= 0).sum())
                    out.append((doc_id, row, tx, items.ids[item], score / len(own), n, begin + a, begin + b))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "row", "tx", "item_id", "score", "n_seeds", "start_word", "end_word"])

    # Windows are few and unevenly spread over the scan's files: they are dealt anew.
    candidates = found.where("item is not null").repartition(F.col("row"), F.col("item"), F.col("begin"))
    scored = candidates.select("doc_id", "row", "tx", "item", "begin", "seen", "body").mapInArrow(run, "doc_id long, row long, tx long, item_id long, score double, n_seeds long, start_word long, end_word long")
    best = F.max(F.struct("score", "n_seeds", -F.col("start_word"), "end_word")).alias("x")
    scored = scored.groupBy("doc_id", "row", "tx", "item_id").agg(best)
    return scored.select("doc_id", "tx", "item_id", "x.score", "x.n_seeds", (-F.col("x")["col3"]).alias("start_word"), "x.end_word")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")).drop("tx")
