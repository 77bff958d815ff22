"""MinHash near-duplicates by a multi-index Hamming join, confirmed on full shingle sets.

1. Each text becomes a set of shingle hashes and a signature of K positions of 16 bits (MinHash values). Rows with equal
   sets are one class, so exact copies never meet again.
2. Signatures are split into chunks of six positions. By pigeonhole, of two signatures at distance T or less one chunk
   differs in one position at most; dropping each position in turn enumerates that error, and the rest is a key.
3. Classes that share a key meet at the key's pivot (its least class), never pair by pair. Distances obey the triangle
   inequality: a member within T of the pivot is settled, since whoever is within T of it is within 2T of the pivot and is
   tied to the pivot's cluster. Only where a member is beyond 2T, the members beyond T are cut into blocks and compared
   with each other, and a spanning forest of their near pairs is kept. So every pair within T ends up in one cluster.
4. Clusters are cut into blocks; each pair of blocks compares its full sets exactly, and yields a spanning forest of the
   confirmed links. Components of these links are the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textnum import LOWER, U, mix, shingle_sets, span_hashes, spread, words

WIDTH = 6  # positions in a chunk
BLOCK_ROWS, BLOCK_SHINGLES = 96, 1_000_000
#: Bits that tell members from other texts: 16 for each, from 2**20 to 2**28. False hits cost work only.
BITMAP = (20, 28)
#: A key with more than a share 1/HOT of all rows joins by a broadcast; HOT keys can.
HOT = 4096


def plan(similarity: float) -> tuple[int, int, int]:
    """Chunks, positions and distance threshold, so that pairs at `similarity` lie 3.2 deviations inside the threshold."""
    p = 1 - similarity
    chunks = 1
    while 2 * chunks - 1 < WIDTH * chunks * p + 3.2 * math.sqrt(WIDTH * chunks * p * (1 - p)):
        chunks += 1
    return chunks, WIDTH * chunks, 2 * chunks - 1


def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * k + 1, dtype=U))
    return x[:k] | U(1), x[k:]


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """16-bit MinHash values, texts x k."""
    a, b = _coefficients(k)
    out = np.zeros((len(sets), k), U)
    for i, s in enumerate(sets):
        if len(s):
            low = np.full(k, ~U(0))
            for at in range(0, len(s), 4096):
                low = np.minimum(low, (s[at : at + 4096, None] * a + b).min(0))
            out[i] = low
    return (mix(out) >> U(48)).astype(np.uint16)


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """64-bit keys, texts x positions: a chunk without one of its positions, and which one that is."""
    n, k = sig.shape
    x = mix(sig.astype(U) + (np.arange(k, dtype=U) << U(16)) + U(1)).reshape(n, k // WIDTH, WIDTH)
    return mix(x.sum(2, keepdims=True, dtype=U) - x + np.arange(k, dtype=U).reshape(k // WIDTH, WIDTH)).reshape(n, k)


def set_hash(s: np.ndarray) -> int:
    return int(mix(np.array([mix(s).sum(dtype=U) ^ (mix(s ^ U(0x5555555555555555)).sum(dtype=U) << U(1)) ^ U(len(s))]))[0])


def text_sets(data: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    low = LOWER[data]
    start, end, first = words(low, at)
    return shingle_sets(span_hashes(low, start, end), first, width)


def row_table(docs: DataFrame, chunks: int, width: int) -> DataFrame:
    """doc_id, tx (hash of the text), n, h (hash of the set), sig and keys for every row. One scan, no shuffle."""
    k = WIDTH * chunks

    def make():
        def f(rows, data, at):
            sets = text_sets(data, at, width)
            sig = signatures(sets, k)
            keys = chunk_keys(sig).view(np.int64)
            full = np.array([len(s) > 0 for s in sets])
            n = pa.array([len(s) for s in sets], pa.int64())
            h = pa.array(np.array([set_hash(s) for s in sets], U).view(np.int64))
            flat = pa.array(keys[full].reshape(-1))
            ends = pa.array(np.r_[0, np.cumsum(full * k)].astype(np.int32))
            return {"doc_id": rows.column(0), "tx": rows.column(2), "n": n, "h": h, "sig": pa.array([s.tobytes() for s in sig], pa.binary()), "keys": pa.ListArray.from_arrays(ends, flat)}

        return f

    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tx"))
    return common.map_blocks(docs, "doc_id long, tx long, n long, h long, sig binary, keys array<long>", make)


def meet(rows: DataFrame, of: DataFrame, key: str, total: int, most: int) -> DataFrame:
    """rows joined with of (key, c: its rows, `most` at most, ...): the rows of a hot key stay where they are, so no task gets all of
    them. Without a hot key, a plain join: a smaller plan, and nothing is broadcast."""
    limit = max(8, total // HOT)
    if most <= limit:
        return rows.join(of.drop("c"), key)
    hot = F.broadcast(of.where(F.col("c") > limit).drop("c"))
    cold = rows.join(hot.select(key), key, "left_anti").join(of.where(F.col("c") <= limit).drop("c"), key)
    return rows.join(hot, key).unionByName(cold)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for all nodes of edges (u, v): comp is the least node reachable. Alternating large and small stars.

    Each join reads tables. Plans of a whole round, where each table has several readers, and their broadcasts took more of the
    driver's memory than all rows.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = common.materialize(edges)
    marks = (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))

    def cut(df):
        df = common.materialize(df)
        common.release(df.sparkSession)
        return df

    def joined(rows, least):
        least = cut(least)
        total, most = least.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.max("c"), F.lit(0))).first()
        return least, meet(rows, least, "u", total, most)

    state = edges.agg(*marks).first()
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        _, big = joined(both.where("v > u"), both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c")))
        big = cut(big.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least, small = joined(big, big.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")))
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        edges = cut(small)
        now = edges.agg(*marks).first()
        if now == state:
            break
        state = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def hamming(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """pairs (p, h) with their distance d."""
    got = pairs.join(sigs.select(F.col("h"), F.col("sig").alias("a")), "h").join(sigs.select(F.col("h").alias("p"), F.col("sig").alias("b")), "p")

    def run(batches):
        for x in batches:
            a, b = (np.frombuffer(b"".join(x.column(i).to_pylist()), np.uint16).reshape(x.num_rows, -1) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array((a != b).sum(1).astype(np.int32))], ["p", "h", "d"])

    return got.select("p", "h", "a", "b").mapInArrow(run, "p long, h long, d int")


def dealt(rows: DataFrame, by: str, nb: str) -> DataFrame:
    """Deal the rows of each `by` into `nb` blocks, and send each row to the pairs of blocks (i, j) that hold its own; side
    tells the two blocks apart. Sorted by pair of blocks within partitions."""
    rows = rows.withColumn("b", F.pmod(F.xxhash64("h"), F.col(nb)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col(nb) - 1)))
    rows = rows.withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o"), "side": (F.col("b") > F.col("o")).cast("int")}).drop("b", "o", nb)
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    return rows.repartition(n, by, "i", "j").sortWithinPartitions(by, "i", "j", "h")


def compared(rows: DataFrame, by: str, body: str, links) -> DataFrame:
    """(u, v) from links(bodies, sides) of each pair of blocks that dealt() made."""

    def run(batches):
        key, held = None, []

        def close():
            seen = {}
            for side, h, x in held:
                seen.setdefault(h, (side, x))
            ids = list(seen)
            if len(ids) < 2:
                return None
            got = links([seen[h][1] for h in ids], np.array([seen[h][0] for h in ids]))
            return pa.RecordBatch.from_pydict({"u": pa.array([ids[x] for x, _ in got], pa.int64()), "v": pa.array([ids[y] for _, y in got], pa.int64())}) if got else None

        for x in batches:
            for *group, side, h, b in zip(*(c.to_pylist() for c in x.columns), strict=True):
                if group != key:
                    if held and (got := close()):
                        yield got
                    key, held = group, []
                held.append((side, h, b))
        if held and (got := close()):
            yield got

    return rows.select(by, "i", "j", "side", "h", body).mapInArrow(run, "u long, v long")


def clusters(classes: DataFrame, limit: int) -> DataFrame:
    """(node, comp): every pair of classes whose signatures differ in `limit` positions or fewer shares a comp."""
    keys = classes.select("h", F.explode("keys").alias("key"))
    shared = common.materialize(keys.groupBy("key").agg(F.min("h").alias("p"), F.count("*").alias("c")).where("c > 1"))
    total, most = shared.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.max("c"), F.lit(0))).first()
    stars = common.materialize(meet(keys, shared, "key", total, most).select("key", "h", "p"))
    dist = common.materialize(hamming(stars.where("h <> p").select("p", "h").distinct(), classes))
    # A class has at most as many pivots as keys: it is tied to the least of them, and so is each other one.
    tied = dist.where(f"d <= {2 * limit}").groupBy("h").agg(F.min("p").alias("u"), F.collect_set("p").alias("ps"))
    others = tied.select("u", F.explode("ps").alias("v")).where("u <> v").distinct()
    ties = tied.select("u", F.col("h").alias("v")).union(others)
    rest = stars.join(dist, ["p", "h"])
    open_keys = rest.where(f"d > {2 * limit}").select("key").distinct()
    rest = common.materialize(rest.where(f"d > {limit}").join(open_keys, "key", "left_semi").select("key", "h"))
    blocks = rest.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("nb"), F.count("*").alias("c")).where("c > 1").drop("c")
    rows = dealt(rest.join(blocks, "key").join(classes.select("h", "sig"), "h"), "key", "nb")
    near = compared(rows, "key", "sig", lambda bodies, sides: _near(bodies, sides, limit))
    common.release(classes.sparkSession)
    return components(ties.union(near))


def _forest(ok: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs marked in the symmetric matrix `ok`. If both sides occur, links within a side are
    known from that side's own block, and only links that join what they leave apart are returned."""
    label = np.arange(len(ok))
    out = []

    def join(marks, told):
        for x, row in enumerate(marks):
            y = np.flatnonzero(row)
            y = y[label[y] != label[x]]
            while len(y):
                if told:
                    out.append((x, int(y[0])))
                label[label == label[y[0]]] = label[x]
                y = y[label[y] != label[x]]

    if side.any() and not side.all():
        same = side[:, None] == side[None, :]
        join(ok & same, False)
        ok = ok & ~same
    join(ok, True)
    return out


def _near(bodies: list[bytes], side: np.ndarray, limit: int) -> list[tuple[int, int]]:
    sig = np.frombuffer(b"".join(bodies), np.uint16).reshape(len(bodies), -1)
    d = np.stack([(sig != s).sum(1) for s in sig])
    return _forest(d <= limit, side)


def _links(sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with den * intersection >= num * union."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    col = np.cumsum(new) - 1
    often = np.bincount(col) > 1
    keep = often[col]
    row, col = row[keep], (np.cumsum(often) - 1)[col[keep]]
    common_n = np.zeros((n, n), np.float32)
    step = max(1, 4_000_000 // n)
    for a in range(0, int(often.sum()), step):
        i, j = np.searchsorted(col, [a, a + step])
        m = np.zeros((n, step), np.float32)
        m[row[i:j], col[i:j] - a] = 1
        common_n += m @ m.T
    inter = common_n.astype(np.int64)
    return _forest(den * inter >= num * (size[:, None] + size[None, :] - inter), side)


def confirmed(docs: DataFrame, members: DataFrame, num: int, den: int, width: int) -> DataFrame:
    """Links (u, v) between classes of one cluster: a spanning forest of all pairs confirmed on full sets.

    members: h, comp, doc_id and tx of one row of the class, n. Only texts of members are shingled again.
    """
    tx = F.xxhash64(F.coalesce("text", F.lit("")))
    blocks = members.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("nb"))
    members = members.join(blocks, "comp").withColumnsRenamed({"doc_id": "rep", "tx": "rep_tx"})
    # A bitmap of bounded size tells the scan which texts can be members; only their sets are shuffled.
    bits = min(max((16 * members.count()).bit_length(), BITMAP[0]), BITMAP[1])
    place = lambda i, t: F.pmod(F.xxhash64(i, t), F.lit(1 << bits))
    words_set = members.select(place("rep", "rep_tx").alias("x")).groupBy(F.shiftright("x", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(x & 31 AS int))")).alias("b")).toArrow()
    bitmap = np.zeros(1 << (bits - 5), np.uint32)
    bitmap[words_set.column("w").to_numpy()] = words_set.column("b").to_numpy().astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def make():
        bits = shared.value

        def f(rows, data, at):
            x = rows.column(3).to_numpy()
            pick = np.flatnonzero((bits[x >> 5] >> (x & 31).astype(np.uint32)) & 1)
            group, place = spread(np.diff(at)[pick])
            sets = text_sets(data[at[pick][group] + place], np.r_[0, np.cumsum(np.diff(at)[pick])], width)
            return {"doc_id": rows.column(0).take(pa.array(pick)), "tx": rows.column(2).take(pa.array(pick)), "body": pa.array([s.tobytes() for s in sets], pa.binary())}

        return f

    texts = docs.select(F.col("doc_id").cast("long"), "text", tx.alias("tx")).withColumn("x", place("doc_id", "tx"))
    sets = common.map_blocks(texts, "doc_id long, tx long, body binary", make)
    sets = sets.hint("merge").join(members, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("tx") == F.col("rep_tx"))).select("h", "comp", "nb", "body")
    return compared(dealt(sets, "comp", "nb"), "comp", "body", lambda bodies, sides: _links([np.frombuffer(x, U) for x in bodies], sides, num, den))


def neighbours(docs: DataFrame, num: int = 85, den: int = 100, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: documents linked when den * intersection >= num * union.

    Null, empty and blank texts have no shingle and no link. A text of fewer words than `width` has one shingle. Repeated
    rows and equal texts are one class. Null doc_ids take part; a component's id is its least doc_id that isn't null, and
    `kept` is doc_id = component_id. Of a component whose ids are all null, with a null id, one text is kept. Other columns are
    ignored.
    """
    return classified(docs, num, den, width).drop("tx")


def classified(docs: DataFrame, num: int, den: int, width: int = 5) -> DataFrame:
    """neighbours() with `tx`, the xxhash64 of the text."""
    chunks, _, limit = plan(num / den)
    rows = common.materialize(row_table(docs, chunks, width))
    classes = rows.where("n > 0").groupBy("h").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "tx")).alias("rep"), F.max("n").alias("n"), F.max("sig").alias("sig"), F.max("keys").alias("keys"))
    classes = common.materialize(classes.select("h", "rep.doc_id", "rep.tx", "n", "sig", "keys"))
    near = clusters(classes.select("h", "sig", "keys"), limit)
    members = common.materialize(classes.select("h", "doc_id", "tx", "n").join(near.withColumnRenamed("node", "h"), "h"))
    common.release(docs.sparkSession)
    links = components(confirmed(docs, members, num, den, width))
    linked = classes.select("h", "doc_id", "tx").join(links.withColumnRenamed("node", "h"), "h", "left").withColumn("comp", F.coalesce("comp", "h"))
    # The least id that isn't null; if all are null, one text stands for its component.
    least = linked.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.min("tx").alias("first"))
    named = linked.join(least, "comp").select("h", "component_id", "first")
    out = rows.select("doc_id", "tx", "n", "h").join(named, "h", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    stands = F.col("n").eqNullSafe(0) | F.col("component_id").isNotNull() | (F.col("tx") == F.col("first"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), (F.col("doc_id").eqNullSafe(own) & stands).alias("kept"), "tx")


def op3_neardup(spark, sf_dir: str) -> DataFrame:
    return neighbours(common.table(spark, sf_dir, "documents"))


def op3_sql(num: int = 85, den: int = 100) -> str:
    """The contract in plain SQL, for small tables: all pairs that share a shingle, then reachability."""
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    sh AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(list_slice(ws, i, i + 4), ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    e AS MATERIALIZED (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE {den} * c >= {num} * (u.n + v.n - c)),
    r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b),
    c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
    SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id"""
