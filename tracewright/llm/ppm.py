"""LM scoring: prediction by partial matching over bytes, with word counts of the whole training corpus beside it.

The trie of byte contexts is counted over all training texts and kept whole: orders 0 to 5 at every byte and, at the first
byte of a word, one long context of 16 bytes, which tells what the corpus has seen before from what it has not. A byte
unseen in its longest context escapes to the next shorter one, with an absolute discount as escape estimate; bytes seen in
the longer context are excluded there. Orders below 5 count a byte once for each longer context it followed (update
exclusion). The code length of a text is the sum over its bytes and one end symbol.

Nothing that grows with the corpus is broadcast. Texts are dealt into parts of a few MB by their place in the input, which
no re-planning changes. A part's distinct words and codes go, packed, to the buckets that hold them; counts and code lengths
come back, in an order that the part can repeat, and meet the packed texts in a cogroup.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textnum import LOWER, SPACE, HashIndex, U, mix, span_hashes, spread, sums, words

ORDER = 5
LONG = 16  # bytes before the first byte of a word
DISCOUNT = 0.3
END, PAD = 0xFF, 0xFE  # bytes that never occur in UTF-8: the end symbol and what precedes a text
WORD, GRAM = 0, 1
#: Groups of words, and of contexts whose trie is built at once.
BUCKETS = 512
CODEC, TEXT_CODEC = pa.Codec("zstd", 1), pa.Codec("zstd", 6)
#: Bytes of text in a part, on average. A longer text than ALONE bytes is a part of its own.
PART_BYTES, ALONE = 8 << 20, 1 << 20
#: Of one bucket: keys counted at once, besides distinct ones; long contexts scored at once; bytes kept in memory, not in a file.
KEYS, LONGS, SPOOL = 1 << 20, 1 << 18, 8 << 20
_HELD = 1 << 32


def order(code: np.ndarray, j: int) -> np.ndarray:
    """The codes of order j (j bytes of context and the symbol) that these end in."""
    return code & U((1 << (8 * (j + 1))) - 1)


def after_space(code: np.ndarray) -> np.ndarray:
    return SPACE[((code >> U(8)) & U(0xFF)).astype(np.uint8)]


def contexts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The 6-byte code (context and symbol) of each byte and of each text's end; first code of each text; which codes
    follow white space; 40-bit hashes of the long contexts of those."""
    texts = len(at) - 1
    first = at + np.arange(texts + 1)
    flat = np.full(len(data) + texts * (LONG + 1), PAD, np.uint8)
    size = np.diff(at)
    begin = at[:-1] + np.arange(texts) * (LONG + 1) + LONG
    flat[np.arange(len(data)) + np.repeat(begin - at[:-1], size)] = LOWER[data]
    flat[begin + size] = END
    place = np.arange(len(data) + texts) + np.repeat(np.arange(1, texts + 1) * LONG, size + 1)
    code = np.zeros(max(0, len(flat) - ORDER), np.uint64)
    for j in range(ORDER + 1):
        code <<= U(8)
        code |= flat[j : j + len(code)]
    code = code[place - ORDER]
    lead = np.flatnonzero(after_space(code))
    return code, first, lead, span_hashes(flat, place[lead] - LONG, place[lead]) >> U(24)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hashes(data, start, end) >> U(1)


def long_ids(code: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of a long context, and of it with its symbol."""
    context = mix(mix(code >> U(8)) + h)
    return context, mix(context + (code & U(0xFF)) + U(1))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted and distinct; much faster than numpy's unique, which hashes."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def uses(keys: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (below 2**63), and how many uses of each are marked in `told`."""
    both = np.sort((keys << U(1)) | told.astype(U))
    keys = both >> U(1)
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat((both & U(1)).astype(np.int64), head) if len(head) else np.zeros(0, np.int64)


def tally(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    n = np.concatenate([c for _, c in parts])
    at = np.argsort(keys)
    keys, n = keys[at], n[at]
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(n, head) if len(head) else n


def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """tally() of parts that are sorted and distinct each."""
    return parts[0] if len(parts) == 1 else tally(parts)


def kinds_of(code: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Update exclusion: the codes of order j, each counted once for each of these distinct longer codes."""
    return np.unique(order(code, j), return_counts=True)


class Level:
    """Codes of one order and their counts; per context: total, kinds, and what exclusion takes from the next shorter one."""

    def __init__(self, code: np.ndarray, n: np.ndarray, shorter: Level | None, j: int):
        ctx, self.owner = np.unique(code >> U(8), return_inverse=True)
        self.n = n.astype(np.float64)
        self.index, self.ctx = HashIndex(code), HashIndex(ctx)
        self.total = np.bincount(self.owner, self.n, len(ctx))
        self.kinds = np.bincount(self.owner, minlength=len(ctx)).astype(float)
        self.taken = np.zeros(len(ctx))
        if shorter is not None:
            self.taken = np.bincount(self.owner, shorter.n[shorter.index.find(order(code, j - 1))], len(ctx))


class Trie:
    """Levels 0 to ORDER. `base`: levels shared with other tries; the rest is built on top."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], base: list[Level] = ()):
        self.levels = list(base)
        for j, (code, n) in enumerate(grams, len(self.levels)):
            self.levels.append(Level(code, n, self.levels[-1] if j else None, j))

    def log10(self, code: np.ndarray, taken: np.ndarray | float = 0.0, kinds: np.ndarray | float = 0.0) -> np.ndarray:
        """log10 of each code's probability; `taken` and `kinds`: what a longer context excludes from the highest order."""
        out = np.zeros(len(code))
        todo = np.arange(len(code))
        taken, kinds = np.zeros(len(code)) + taken, np.zeros(len(code)) + kinds
        for j in range(len(self.levels) - 1, -1, -1):
            lv = self.levels[j]
            q = order(code[todo], j)
            at = lv.index.find(q)
            hit = at >= 0
            owner = np.full(len(q), -1, np.int64)
            owner[hit] = lv.owner[at[hit]]
            miss = np.flatnonzero(~hit)
            owner[miss] = lv.ctx.find(q[miss] >> U(8))
            known = owner >= 0
            own = np.maximum(owner, 0)
            some = len(lv.total) > 0
            t = np.where(known, lv.total[own] if some else 0, 0) - taken[todo]
            d = np.where(known, lv.kinds[own] if some else 0, 0) - kinds[todo]
            room = np.maximum(t, 1e-12)
            out[todo[hit]] += np.log10((lv.n[at[hit]] - DISCOUNT) / room[hit])
            esc = ~hit & known & (d > 0)
            out[todo[esc]] += np.log10(DISCOUNT * d[esc] / room[esc])
            gone = ~hit & known
            taken[todo[gone]] = lv.taken[own[gone]]
            kinds[todo[gone]] = lv.kinds[own[gone]]
            todo = todo[~hit]
            if not len(todo):
                return out
        out[todo] -= np.log10(np.maximum(1, 255 - kinds[todo]))
        return out


def long_logs(trie: Trie, code: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For uses of long contexts (n: of each entry in training texts, perhaps 0; an entry may recur): log10 of the probability,
    and the total of the context. A context without uses has no log."""
    context, whole = long_ids(code, h)
    used = n > 0
    one, at, group = np.unique(whole[used], return_index=True, return_inverse=True)
    count = np.bincount(group, n[used], len(one))
    ctx, owner = np.unique(context[used][at], return_inverse=True)
    total, kinds = np.bincount(owner, count, len(ctx)), np.bincount(owner, minlength=len(ctx)).astype(float)
    top = trie.levels[-1]
    taken = np.bincount(owner, top.n[top.index.find(code[used][at])], len(ctx)) if len(one) else np.zeros(0)
    own, found = HashIndex(ctx).find(context), HashIndex(one).find(whole)
    out, totals = np.zeros(len(code)), np.zeros(len(code))
    hit = found >= 0
    out[hit] = np.log10((count[found[hit]] - DISCOUNT) / total[own[hit]])
    esc = np.flatnonzero(~hit & (own >= 0))
    o = own[esc]
    out[esc] = np.log10(DISCOUNT * kinds[o] / total[o]) + trie.log10(code[esc], taken[o], kinds[o])
    totals[own >= 0] = total[own[own >= 0]]
    return out, totals


def squeezed(values: np.ndarray) -> bytes:
    return CODEC.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), asbytes=True)


def loosened(packed, size: int, dtype) -> np.ndarray:
    wide = np.dtype(dtype).itemsize
    raw = np.frombuffer(CODEC.decompress(packed.as_buffer() if hasattr(packed, "as_buffer") else packed, wide * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(wide, size).T).reshape(-1).view(dtype)


def zipped(text: np.ndarray) -> bytes:
    return TEXT_CODEC.compress(text.tobytes(), asbytes=True)


def unzipped(text: bytes, size: int) -> np.ndarray:
    return np.frombuffer(TEXT_CODEC.decompress(text, size, asbytes=True), np.uint8)


def steps(codes: np.ndarray) -> np.ndarray:
    """Sorted codes as their differences, which pack better."""
    return np.diff(codes, prepend=U(0))


def bucket_of(code: np.ndarray) -> np.ndarray:
    """Contexts are dealt by their last three bytes, and by the last four where a word begins."""
    key = np.where(after_space(code), order(code >> U(8), 3), order(code >> U(8), 2) + U(1 << 40))
    return (mix(key) % U(BUCKETS)).astype(np.int64)


def blocked(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text, held_out and `part`, and about how many parts there are. A part is a run of rows of an input file,
    so every scan agrees on it however the input is split."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:  # not a plain scan of Parquet files
        docs = common.materialize(docs.select("doc_id", "text"))
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    run = max(1, rows * PART_BYTES // max(1, size))
    row = F.col("_metadata.row_index")
    part = F.xxhash64("_metadata.file_path", F.when(F.octet_length("text") > ALONE, -1 - row).otherwise(F.floor(row / F.lit(run))))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return docs.select(F.col("doc_id").cast("long"), "text", held.alias("held_out"), part.alias("part")), max(1, size // PART_BYTES)


def blob(values: list | None, n: int) -> pa.Array:
    return pa.array(values, pa.binary()) if values is not None else pa.nulls(n, pa.binary())


def by_bucket(bucket: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by bucket, and where each bucket begins in it."""
    return np.argsort(bucket.astype(np.uint16), kind="stable"), np.r_[0, np.cumsum(np.bincount(bucket, minlength=size))]


def low_counts(blocks: DataFrame) -> list:
    """Counts of orders 0 to 2, and of order 3 where a word begins: what every bucket needs. At most 2**24 codes of three
    bytes and as many of four that follow white space, whatever the size of the corpus. One scan, and a shuffle of distinct codes."""
    many = 16

    def run(batches):
        three, four = np.zeros(0, U), np.zeros(0, U)
        for rows, data, at in common.blocks(batches, "text"):
            train = ~rows.column(2).fill_null(False).to_numpy(zero_copy_only=False)
            code, code_at, _, _ = contexts(data, at)
            code = code[np.repeat(train, np.diff(code_at))]
            three = distinct(np.concatenate([three, distinct(order(code, 3))]))
            four = distinct(np.concatenate([four, distinct(order(code[after_space(code)], 4))]))
        (a, x), (b, y) = by_bucket((mix(order(three, 2)) % U(many)).astype(np.int64), many), by_bucket((mix(order(four, 3)) % U(many)).astype(np.int64), many)
        lists = [[codes[at[cut[i] : cut[i + 1]]] for i in range(many)] for codes, at, cut in ((three, a, x), (four, b, y))]
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(range(many), pa.int64()), **{k: pa.array([len(c) for c in v], pa.int64()) for k, v in zip("nm", lists, strict=True)}, **{k: blob([squeezed(steps(c)) for c in v], many) for k, v in zip(("codes", "longs"), lists, strict=True)}})

    def counted(rows: pa.Table) -> pa.Table:
        out = []
        for j, (size, codes) in ((2, ("n", "codes")), (3, ("m", "longs"))):
            longer = distinct(np.concatenate([np.cumsum(loosened(x, k, U), dtype=U) for x, k in zip(rows.column(codes), rows.column(size).to_pylist(), strict=True)]))
            code, n = kinds_of(longer, j)
            out.append(pa.table({"j": pa.array(np.full(len(code), j, np.int32)), "code": pa.array(code.view(np.int64)), "n": pa.array(n)}))
        return pa.concat_tables(out)

    got = blocks.mapInArrow(run, "bucket long, n long, m long, codes binary, longs binary").groupBy("bucket").applyInArrow(counted, "j int, code long, n long").toArrow()
    j, code, n = (got.column(i).to_numpy() for i in range(3))
    two, three = (tally([(code[j == i].view(U), n[j == i])]) for i in (2, 3))
    one = kinds_of(two[0], 1)
    return [kinds_of(one[0], 0), one, two, three]


def count(blocks: DataFrame) -> DataFrame:
    """One scan; counts are uses in training texts, perhaps 0. WORD: n distinct words (codes) of a part in one bucket. GRAM: n
    distinct codes of a part in one bucket, and m long contexts with symbols (longs): place of the code among the n, then the hash."""

    def batch(kind, part, cut, deal, **blobs):
        some = np.flatnonzero(np.diff(cut))
        n = len(some)
        whole = {"kind": pa.array(np.full(n, kind, np.int32)), "part": pa.array(np.full(n, part, np.int64)), "bucket": pa.array(some, pa.int64()), "n": pa.array(np.diff(cut)[some], pa.int64()), "m": pa.array(deal[some], pa.int64())}
        return pa.RecordBatch.from_pydict(whole | {k: blob([f(b) for b in some] if f else None, n) for k, f in ((k, blobs.get(k)) for k in ("codes", "counts", "longs", "uses"))})

    def packed(part, seen, grams, longs):
        keys, n = merged(seen)
        at, cut = by_bucket((mix(keys) % U(BUCKETS)).astype(np.int64), BUCKETS)
        yield batch(WORD, part, cut, np.zeros(BUCKETS, np.int64), codes=lambda b: squeezed(steps(keys[at[cut[b] : cut[b + 1]]])), counts=lambda b: squeezed(n[at[cut[b] : cut[b + 1]]]))
        keys, n = merged(grams)
        bucket = bucket_of(keys)
        at, cut = by_bucket(bucket, BUCKETS)
        rank = np.empty(len(keys), np.int64)
        rank[at] = np.arange(len(keys)) - np.repeat(cut[:-1], np.diff(cut))
        code, h, v = (np.concatenate(x) for x in zip(*longs, strict=True))
        where = HashIndex(keys).find(code)
        sort = np.argsort((where.astype(U) << U(40)) | h)
        where, h, v = where[sort], h[sort], v[sort]
        head = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
        where, h, v = where[head], h[head], np.add.reduceat(v, head) if len(head) else v
        to, cut2 = by_bucket(bucket[where], BUCKETS)
        own = ((rank[where].astype(U) << U(40)) | h)[to]
        v = (((v & (_HELD - 1)) << 1) | (v >= _HELD))[to]
        yield batch(GRAM, part, cut, np.diff(cut2), codes=lambda b: squeezed(steps(keys[at[cut[b] : cut[b + 1]]])), counts=lambda b: squeezed(n[at[cut[b] : cut[b + 1]]]), longs=lambda b: squeezed(own[cut2[b] : cut2[b + 1]]), uses=lambda b: squeezed(v[cut2[b] : cut2[b + 1]]))

    def run(batches):
        held: dict = {}

        def flush():
            for part, lists in sorted(held.items()):
                yield from packed(part, *lists)
            held.clear()

        size = 0
        for rows, data, at in common.blocks(batches, "text"):
            owner = rows.column(3).to_numpy()
            train = ~rows.column(2).fill_null(False).to_numpy(zero_copy_only=False)
            start, end, first = words(LOWER[data], at)
            hashes = word_hashes(LOWER[data], start, end)
            text_of = np.repeat(np.arange(len(owner)), np.diff(first))
            code, code_at, lead, h = contexts(data, at)
            code_of = np.repeat(np.arange(len(owner)), np.diff(code_at))
            parts, begin = np.unique(owner, return_index=True)
            for part in parts[np.argsort(begin)]:
                if held and part not in held:  # parts follow each other in a file: the last one's turn is over
                    yield from flush()
                    size = 0
                seen, grams, longs = held.setdefault(part, ([], [], []))
                here = owner[text_of] == part
                seen.append(uses(hashes[here], train[text_of[here]]))
                here = owner[code_of] == part
                grams.append(uses(code[here], train[code_of[here]]))
                here = lead[owner[code_of[lead]] == part]
                longs.append((code[here], h[owner[code_of[lead]] == part], np.where(train[code_of[here]], 1, _HELD)))
                size += len(seen[-1][0]) + len(grams[-1][0]) + len(here)
            if size > 8_000_000:
                yield from flush()
                size = 0
        yield from flush()

    return blocks.mapInArrow(run, "kind int, part long, bucket long, n long, m long, codes binary, counts binary, longs binary, uses binary")


_bases: dict = {}


def base_levels(name: str, low: list) -> list[Level]:
    """Levels 0 to 2, built once per worker."""
    if name not in _bases:
        _bases.clear()
        _bases[name] = Trie(low[:3]).levels
    return _bases[name]


def bucket_trie(code: np.ndarray, n: np.ndarray, asked: np.ndarray, base: list[Level], begun: tuple[np.ndarray, np.ndarray]) -> Trie:
    """The trie over one bucket's distinct codes, to be asked for the codes `asked`; `begun`: counts of order 3 where words
    begin, which span buckets."""
    four = kinds_of(code, 4)
    plain = kinds_of(four[0], 3)
    inner = ~after_space(plain[0])
    want = distinct(order(asked[after_space(asked)], 3) >> U(8))
    a, b = np.searchsorted(begun[0], want << U(8)), np.searchsorted(begun[0], (want + U(1)) << U(8))
    group, place = spread(b - a)
    some = a[group] + place
    three = tally([(plain[0][inner], plain[1][inner]), (begun[0][some], begun[1][some])])
    return Trie([three, four, (code, n)], base)


ANSWERS = "part long, kind int, bucket long, n long, m long, logs binary, told binary, longs binary"


class Spool:
    """Record batches of a group in a temporary file that goes with this object, to be read again a batch at a time."""

    def __init__(self, batches: Iterable[pa.RecordBatch]):
        self.file = tempfile.SpooledTemporaryFile(SPOOL)
        for x in batches:
            raw = pa.ipc.new_stream(buffer := pa.BufferOutputStream(), x.schema)
            raw.write_batch(x)
            raw.close()
            raw = buffer.getvalue()
            self.file.write(len(raw).to_bytes(8, "little"))
            self.file.write(raw)

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        self.file.seek(0)
        while size := self.file.read(8):
            yield from pa.ipc.open_stream(self.file.read(int.from_bytes(size, "little")))


class Dealt:
    """Long contexts with their symbols (code, hash, uses) in a temporary file, dealt by name into groups that are read one at a time."""

    def __init__(self, many: int):
        self.many, self.file, self.chunks = many, tempfile.SpooledTemporaryFile(SPOOL), []
        self.held, self.waiting, self.size = [], 0, 0

    def append(self, code: np.ndarray, h: np.ndarray, v: np.ndarray) -> None:
        self.held.append((code, h, v, np.arange(self.size, self.size + len(code))))
        self.size += len(code)
        self.waiting += len(code)
        if self.waiting > LONGS:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        columns = [np.concatenate(x) for x in zip(*self.held, strict=True)]
        group = ((long_ids(*columns[:2])[0] >> U(24)) % U(self.many)).astype(np.int64)
        at = np.argsort(group, kind="stable")
        self.chunks.append((self.file.tell(), np.r_[0, np.cumsum(np.bincount(group, minlength=self.many))]))
        self.file.write(np.stack([x[at].view(U) for x in columns], 1).tobytes())
        self.held, self.waiting = [], 0

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Code, hash, uses, and place in the order of appending."""
        self.flush()
        for i in range(self.many):
            raw = []
            for begin, cut in self.chunks:
                self.file.seek(begin + 32 * int(cut[i]))
                raw.append(self.file.read(32 * int(cut[i + 1] - cut[i])))
            code, h, v, place = np.ascontiguousarray(np.frombuffer(b"".join(raw), U).reshape(-1, 4).T)
            yield code, h, v.view(np.int64), place.view(np.int64)


def numbers(n: int) -> np.ndarray:
    """Space for n logs, in a file that goes with the array if they are many."""
    return np.empty(n, np.float32) if 4 * n <= SPOOL else np.memmap(tempfile.TemporaryFile(), np.float32, "w+", shape=n)


def tallied(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """tally() of parts that come one by one: memory follows what is distinct, not how often it recurs."""
    held, size, most = [(np.zeros(0, U), np.zeros(0, np.int64))], 0, KEYS
    for keys, n in parts:
        held.append((keys, n))
        size += len(keys)
        if size > most:
            held = [tally(held)]
            size, most = len(held[0][0]), max(KEYS, 2 * len(held[0][0]))
    return tally(held)


def of_parts(rows: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple[int, list[dict]]]:
    """Each part and its rows, which follow each other; a part cut by splits has several."""
    own, held = None, []
    for batch in rows:
        for x in zip(*(batch.column(k) for k in ("part", "n", "m", *columns)), strict=True):
            x = dict(zip(("part", "n", "m", *columns), [*(v.as_py() for v in x[:3]), *x[3:]], strict=True))
            if held and x["part"] != own:
                yield own, held
                held = []
            own = x["part"]
            held.append(x)
    if held:
        yield own, held


def codes_of(x: dict) -> np.ndarray:
    return np.cumsum(loosened(x["codes"], x["n"], U), dtype=U)


def longs_of(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a part's rows in a bucket: distinct codes; code, hash and uses of each distinct long context with its symbol."""
    codes = [codes_of(x) for x in rows]
    mine = distinct(np.concatenate(codes)) if len(rows) > 1 else codes[0]
    keys = [loosened(x["longs"], x["m"], U) for x in rows]
    place = [np.searchsorted(mine, c[(k >> U(40)).astype(np.int64)]).astype(U) for c, k in zip(codes, keys, strict=True)] if len(rows) > 1 else [keys[0] >> U(40)]
    both = np.concatenate([(a << U(40)) | (k & U((1 << 40) - 1)) for a, k in zip(place, keys, strict=True)])
    uses_of = [loosened(x["uses"], x["m"], np.int64) for x in rows]
    v = np.concatenate([((u & 1) << 32) + (u >> 1) for u in uses_of])
    both, v = tally([(both, v)]) if len(rows) > 1 else (both, v)
    return mine, mine[(both >> U(40)).astype(np.int64)], both & U((1 << 40) - 1), v


def answers(counts: DataFrame, low: list) -> DataFrame:
    """What the parts asked for, a row for each part and bucket, in the sorted order of what is distinct in it, which the part finds
    again from its texts. WORD: the uses of n words in training texts (logs); one row of a bucket tells how many of its words have any
    (m). GRAM: log10 of the probability of each of n codes, under the trie of all training texts (logs); of its m long contexts, which
    another use in the corpus tells something about (told: bits), and their logs (longs).

    A bucket grows with the corpus, so its rows are read from a file, once to count and once to answer; its long contexts are
    dealt by their names and scored some at a time. Memory holds a bucket's distinct words or codes."""
    shared = counts.sparkSession.sparkContext.broadcast(low)
    name = uuid.uuid4().hex

    def row(kind, bucket, part, n, m, **blobs):
        whole = {"part": pa.array([part], pa.int64()), "kind": pa.array([kind], pa.int32()), "bucket": pa.array([bucket], pa.int64()), "n": pa.array([n], pa.int64()), "m": pa.array([m], pa.int64())}
        return pa.RecordBatch.from_pydict(whole | {k: blob([blobs[k]] if k in blobs else None, 1) for k in ("logs", "told", "longs")})

    def known(rows: Spool, tell):
        key, c = tallied((codes_of(x), loosened(x["counts"], x["n"], np.int64)) for _, own in of_parts(rows, "codes", "counts") for x in own)
        some = int((c > 0).sum())
        for part, own in of_parts(rows, "codes"):
            mine = distinct(np.concatenate([codes_of(x) for x in own]))
            yield tell(part, len(mine), some, logs=squeezed(c[np.searchsorted(key, mine)]))
            some = 0

    def long_answers(trie: Trie, rows: Spool) -> np.ndarray:
        """The logs of the group's long contexts, in its parts' order; nan if nothing is told."""
        total = int(sum(x.column("m").to_numpy().sum() for x in rows))
        dealt, out = Dealt(1 + total // LONGS), numbers(total)
        for _, own in of_parts(rows, "codes", "longs", "uses"):
            dealt.append(*longs_of(own)[1:])
        for code, h, v, place in dealt.groups():
            long, uses_of = long_logs(trie, code, h, (v & (_HELD - 1)).astype(float))
            out[place] = np.where((uses_of > 0) & ~((v == 1) & (uses_of == 1)), long, np.nan)
        return out

    def lengths(rows: Spool, tell):
        code, c = tallied((codes_of(x), loosened(x["counts"], x["n"], np.int64)) for _, own in of_parts(rows, "codes", "counts") for x in own)
        used = c > 0
        trie = bucket_trie(code[used], c[used], code, base_levels(name, shared.value), shared.value[3])
        log = np.concatenate([trie.log10(code[i : i + LONGS]) for i in range(0, max(1, len(code)), LONGS)]).astype(np.float32)
        long, at = long_answers(trie, rows), 0
        for part, own in of_parts(rows, "codes", "longs", "uses"):
            mine, m = codes_of(own[0]), own[0]["m"]
            if len(own) > 1:
                mine, whole, _, _ = longs_of(own)
                m = len(whole)
            here = np.array(long[at : at + m])
            at += m
            told = ~np.isnan(here)
            yield tell(part, len(mine), m, logs=squeezed(log[np.searchsorted(code, mine)]), told=np.packbits(told).tobytes(), longs=squeezed(here[told]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Spool(batches)
        first = next(iter(rows))
        kind, bucket = first.column("kind")[0].as_py(), first.column("bucket")[0].as_py()
        out, size = [], 0
        for x in (known if kind == WORD else lengths)(rows, lambda *a, **b: row(kind, bucket, *a, **b)):
            out.append(x)
            size += x.nbytes
            if size > SPOOL or len(out) >= common.BATCH_ROWS:
                yield pa.concat_batches(out)
                out, size = [], 0
        if out:
            yield pa.concat_batches(out)

    dealt = counts.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "part")
    return dealt.groupBy("kind", "bucket").applyInArrow(run, ANSWERS)


class Answered:
    """The answers to one part: word counts, and logs of codes and of long contexts, by what is distinct in its texts."""

    def __init__(self, told: pa.Table, texts):
        """texts: yields (bytes, offsets) of the part's blocks."""
        seen, grams, begun = [np.zeros(0, U)], [np.zeros(0, U)], [(np.zeros(0, U), np.zeros(0, U))]
        for data, at in texts:
            start, end, _ = words(LOWER[data], at)
            seen.append(distinct(word_hashes(LOWER[data], start, end)))
            code, _, lead, h = contexts(data, at)
            grams.append(distinct(code))
            begun.append((code[lead], h))
        seen, grams = distinct(np.concatenate(seen)), distinct(np.concatenate(grams))
        self.words, self.codes = HashIndex(seen), HashIndex(grams)
        told = told.sort_by("bucket")
        word, gram = (told.filter(pc.equal(told.column("kind"), k)) for k in (WORD, GRAM))
        self.kinds = pc.sum(word.column("m")).as_py() or 0
        to = self._matched(by_bucket((mix(seen) % U(BUCKETS)).astype(np.int64), BUCKETS), word, "n")
        self.count = np.zeros(len(seen) + 1, np.int64)
        self.count[to] = self._joined(word, "logs", "n", np.int64)
        bucket = bucket_of(grams)
        to = self._matched(by_bucket(bucket, BUCKETS), gram, "n")
        self.log = np.zeros(len(grams))
        self.log[to] = self._joined(gram, "logs", "n", np.float32)
        code, h = (np.concatenate(x) for x in zip(*begun, strict=True))
        key = distinct((self.codes.find(code).astype(U) << U(40)) | h)
        place = (key >> U(40)).astype(np.int64)
        to = self._matched(by_bucket(bucket[place], BUCKETS), gram, "m")
        bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=k) for x, k in zip(gram.column("told").to_pylist(), gram.column("m").to_pylist(), strict=True)]
        some = to[np.concatenate([*bits, np.zeros(0, np.uint8)]) > 0]
        self.longs = HashIndex(long_ids(grams[place[some]], key[some] & U((1 << 40) - 1))[1])
        logs = [loosened(x, int(b.sum()), np.float32) for x, b in zip(gram.column("longs"), bits, strict=True)]
        self.long_log = np.r_[np.concatenate([*logs, np.zeros(0, np.float32)]).astype(float), 0.0]

    @staticmethod
    def _matched(dealt: tuple[np.ndarray, np.ndarray], rows: pa.Table, size: str) -> np.ndarray:
        n = np.zeros(BUCKETS, np.int64)
        n[rows.column("bucket").to_numpy()] = rows.column(size).to_numpy()
        if (np.diff(dealt[1]) != n).any():
            raise ValueError("a part's texts differ between the two scans")
        return dealt[0]

    @staticmethod
    def _joined(rows: pa.Table, column: str, size: str, dtype) -> np.ndarray:
        return np.concatenate([*[loosened(x, k, dtype) for x, k in zip(rows.column(column), rows.column(size).to_pylist(), strict=True)], np.zeros(0, dtype)])


def packed_texts(blocks: DataFrame) -> DataFrame:
    """The texts of each block and part: doc_id, held_out (2: null), sizes and the zipped text, so that they are cheap to shuffle."""

    def run(batches):
        for rows, data, at in common.blocks(batches, "text"):
            owner = rows.column(3).to_numpy()
            for part in np.unique(owner):
                here = np.flatnonzero(owner == part)
                group, place = spread(np.diff(at)[here])
                text = data if len(here) == len(owner) else data[at[here][group] + place]
                ids = rows.column(0).take(pa.array(here))
                values = [ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), rows.column(2).take(pa.array(here)).cast(pa.int8()).fill_null(2).to_numpy(), np.diff(at)[here]]
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "rows": pa.array([len(here)], pa.int64()), **{k: blob([squeezed(v)], 1) for k, v in zip(("ids", "valid", "held", "sizes"), values, strict=True)}, "text": blob([zipped(text)], 1)})

    return blocks.mapInArrow(run, "part long, rows long, ids binary, valid binary, held binary, sizes binary, text binary")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Null texts count as empty: one end token and one end symbol. Repeated rows are scored each; a null doc_id belongs to
    the training rows and has a null held_out; other columns are ignored. Without training rows every byte is uniform.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(common.BATCH_ROWS))
    blocks, parts = blocked(docs)
    told = answers(count(blocks), low_counts(blocks))
    alone = np.log10(1 - DISCOUNT)  # a long context seen once, in this very place

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        rows = texts.to_pylist()

        def opened(x):
            at = np.r_[0, np.cumsum(loosened(x["sizes"], x["rows"], np.int64))]
            return unzipped(x["text"], int(at[-1])), at

        part = Answered(told, map(opened, rows))
        log = np.log10(part.count + 0.5)
        out = []
        for x in rows:
            n = x["rows"]
            doc_id, valid, held = (loosened(x[k], n, t) for k, t in (("ids", np.int64), ("valid", bool), ("held", np.int8)))
            data, at = opened(x)
            start, end, first = words(LOWER[data], at)
            found = part.words.find(word_hashes(LOWER[data], start, end))
            code, code_at, lead, h = contexts(data, at)
            each = part.log[part.codes.find(code)]
            at_long = part.longs.find(long_ids(code[lead], h)[1])
            own = held[np.searchsorted(code_at, lead, "right") - 1] != 1
            each[lead] = np.where(at_long >= 0, part.long_log[at_long], np.where(own, alone, each[lead]))
            out.append(pa.table({
                "doc_id": pa.array(doc_id, mask=~valid), "held_out": pa.array(held == 1, mask=held == 2), "n_tokens": pa.array(np.diff(first) + 1),
                "n_known": pa.array(sums(part.count[found] > 0, first).astype(np.int64)), "word_log": pa.array(sums(log[found], first)), "score": pa.array(sums(each, code_at)), "kinds": pa.array(np.zeros(n, np.int64)),
            }))
        out = pa.concat_tables(out) if out else schema.empty_table()
        if len(out):
            out = out.set_column(6, "kinds", pa.array(np.r_[part.kinds, np.zeros(len(out) - 1, np.int64)]))
        return out

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("word_log", pa.float64()), ("score", pa.float64()), ("kinds", pa.int64())])
    wide = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = packed_texts(blocks).repartition(wide, "part")
    scored = texts.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, word_log double, score double, kinds long")
    scored = common.materialize(scored)
    # The corpus counts of tokens, ends and kinds enter a base score as one term a token, so they may come last.
    trained = F.coalesce(~F.col("held_out"), F.lit(True))
    tokens, ends, kinds = scored.agg(F.coalesce(F.sum(F.when(trained, F.col("n_tokens"))), F.lit(0)), F.count_if(trained), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    rest = float(np.log10(tokens + 0.5 * (kinds + (ends > 0) + 1)))
    base = F.col("word_log") + float(np.log10(ends + 0.5)) - F.col("n_tokens") * rest
    return scored.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))
