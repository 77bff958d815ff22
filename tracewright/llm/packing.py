"""Packing: BM25 retrieval over shards of documents fills each training window with lexical neighbours of its seed.

Each input partition is read in shards of bounded size. A shard's token ids go to an inverted index with BM25 weights. A
seed document opens a window; its best unused neighbours in the shard follow until the window is full; the rest of the
last one opens the next window as its seed. Documents are cut freely, so only a partition's last window can be short;
it is cut into sequences whose lengths are powers of two. No shuffle.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textnum import spread
from .tokens import Encoder

K1, B = 1.2, 0.75


class Shard:
    """An inverted index over the token ids of a shard: for each term its documents and their BM25 weights."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, vocabulary: int):
        n = len(first) - 1
        size = np.diff(first)
        doc = np.repeat(np.arange(n, dtype=np.int64), size)
        key = np.sort(ids.astype(np.int64) * n + doc)
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        tf = np.diff(np.r_[head, len(key)])
        term, self.doc = np.divmod(key[head], max(1, n))
        df = np.bincount(term, minlength=vocabulary)
        idf = np.maximum(0.0, np.log((n - df + 0.5) / (df + 0.5)))  # terms of more than half the shard weigh nothing
        norm = K1 * (1 - B + B * size / max(1.0, size.mean())) if n else np.zeros(0)
        self.weight = idf[term] * tf * (K1 + 1) / (tf + norm[self.doc])
        self.begin = np.r_[0, np.cumsum(df)]
        self.useful = idf > 0
        order = np.argsort(self.doc, kind="stable")
        self.terms = term[order].astype(np.int32)
        self.terms_at = np.r_[0, np.cumsum(np.bincount(self.doc, minlength=n))]
        self.n = n

    def query(self, doc: int) -> np.ndarray:
        """The distinct terms of a document of the shard."""
        return self.terms[self.terms_at[doc] : self.terms_at[doc + 1]]

    def scores(self, terms: np.ndarray) -> np.ndarray:
        terms = terms[self.useful[terms]]
        group, place = spread(self.begin[terms + 1] - self.begin[terms])
        at = self.begin[terms][group] + place
        return np.bincount(self.doc[at], self.weight[at], self.n)


class Packer:
    """Windows of one partition. Yields pieces (row, start, length, sequence, offset) whose sequence is complete."""

    def __init__(self, window: int, first_id: int):
        self.window, self.sequence = window, first_id
        self.open: list = []  # pieces of the open window: [doc_id, start, ids, doc_tokens]
        self.fill, self.terms = 0, None

    def place(self, out: list, doc_id, ids: np.ndarray, terms: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            take = min(self.window - self.fill, len(ids) - start)
            if not self.fill:
                self.terms = terms  # the seed of the window
            self.open.append((doc_id, start, ids[start : start + take], len(ids)))
            self.fill += take
            start += take
            if self.fill == self.window:
                self.close(out)

    def close(self, out: list) -> None:
        offset = 0
        for doc_id, start, ids, total in self.open:
            out.append((doc_id, start, ids, total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1
        self.open, self.fill = [], 0

    def shard(self, doc_ids: list, ids: np.ndarray, first: np.ndarray, vocabulary: int) -> list:
        index, out = Shard(ids, first, vocabulary), []
        unused, free = np.ones(index.n, bool), 0
        score, scored = None, None
        for _ in range(index.n):
            if self.fill:
                if scored is not self.terms:
                    score, scored = index.scores(self.terms), self.terms
                pick = int(np.argmax(np.where(unused, score, -1.0)))
            else:
                while not unused[free]:
                    free += 1
                pick = free
            unused[pick] = False
            self.place(out, doc_ids[pick], ids[first[pick] : first[pick + 1]], index.query(pick))
        return out

    def finish(self) -> list:
        """The last window, cut into sequences of 1024, 512, ... tokens as its length needs."""
        out, rest, pieces = [], self.fill, self.open
        self.open, self.fill = [], 0
        full = self.window
        for doc_id, start, ids, total in pieces:
            while len(ids):
                if not self.fill:
                    full = 1 << (rest.bit_length() - 1)
                take = min(full - self.fill, len(ids))
                self.open.append((doc_id, start, ids[:take], total))
                self.fill += take
                start, ids, rest = start + take, ids[take:], rest - take
                if self.fill == full:
                    self.close(out)
        return out


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, digest: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, and the piece's ids (array of int), or
    with `digest` their CRC-32 as ids_crc32.

    `tokenizer` is the path of a tokenizers JSON file. Null and empty texts are the end id alone. Repeated rows are packed
    each; a null doc_id stays null; other columns are ignored. Sequence ids are unique: partition id times 2**33 and on.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(common.BATCH_ROWS))

    def run(batches):
        encoder = Encoder(tokenizer)
        vocabulary = encoder.full.get_vocab_size() + end_id + 1
        packer = Packer(window, TaskContext.get().partitionId() << 33)

        def emit(pieces):
            cols = list(zip(*pieces, strict=True))
            ids = [pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in cols[2]], pa.int64())] if digest else [pa.array([x.tolist() for x in cols[2]], pa.list_(pa.int32()))]
            names = ["doc_id", "start", "length", "ids_crc32" if digest else "ids", "doc_tokens", "sequence_id", "offset"]
            number = lambda c: pa.array(c, pa.int64())
            return pa.RecordBatch.from_arrays([number(cols[0]), number(cols[1]), number([len(x) for x in cols[2]]), *ids, number(cols[3]), number(cols[4]), number(cols[5])], names)

        for rows, data, at in common.blocks(batches, "text"):
            got, first = encoder.encode(data, at)
            n = len(first) - 1
            ids = np.full(len(got) + n, end_id, np.int32)
            ids[np.arange(len(got)) + np.repeat(np.arange(n), np.diff(first))] = got
            pieces = packer.shard(rows.column(0).to_pylist(), ids, first + np.arange(n + 1), vocabulary)
            if pieces:
                yield emit(pieces)
        if pieces := packer.finish():
            yield emit(pieces)

    kind = "ids_crc32 long" if digest else "ids array<int>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, start long, length long, {kind}, doc_tokens long, sequence_id long, offset long")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digest=True)
