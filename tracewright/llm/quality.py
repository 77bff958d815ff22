"""Quality: a byte-level convolutional network in numpy.

Every byte is embedded; learned filters slide over the whole text; their responses are max-pooled over chunks that
overlap by half; a dense layer turns each chunk's pooled responses into a defect logit, and the largest one over all
chunks is combined into one probability. A text is processed in pieces, so memory doesn't grow with its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH, STRIDE = 8, 2
HALF = 128  # bytes in half a chunk: chunks of 256 start at every 128th byte
OVER = WIDTH // STRIDE - 1  # windows of a half that run over its end


class Net:
    """emb: 257 x dim (256 is padding); filters: (WIDTH * dim) x n; two dense layers on the pooled responses."""

    def __init__(self, seed: int = 3, dim: int = 8, filters: int = 32, hidden: int = 16):
        r = np.random.default_rng(seed)
        self.p = {
            "emb": r.normal(0, 0.5, (257, dim)),
            "conv": r.normal(0, (2 / (WIDTH * dim)) ** 0.5, (WIDTH * dim, filters)),
            "cb": np.zeros(filters),
            "w1": r.normal(0, (2 / filters) ** 0.5, (filters, hidden)),
            "b1": np.zeros(hidden),
            "w2": r.normal(0, hidden**-0.5, hidden),
            "b2": np.full(1, -1.0),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def halves(self, codes: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Padded codes (whole halves and WIDTH more) to the largest response of each filter in each half. Windows that run over
        the end of a text's last half see the next text, so they don't count."""
        p, n = self.p, (len(codes) - WIDTH) // HALF
        e = p["emb"][codes].reshape(-1)
        dim = p["emb"].shape[1]
        view = np.lib.stride_tricks.as_strided(e, (n * HALF // STRIDE, WIDTH * dim), (STRIDE * dim * 4, 4))
        out = (np.ascontiguousarray(view) @ p["conv"]).reshape(n, HALF // STRIDE, -1)
        out[last, -OVER:] = -np.inf
        return out.max(1)

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = self.p
        a = np.maximum(pooled + p["cb"], 0)
        h = np.maximum(a @ p["w1"] + p["b1"], 0)
        return h @ p["w2"] + p["b2"], h, a

    def frozen(self) -> Net:
        """Weights rounded to binary fractions short enough for every sum to be exact (filters: products are multiples of
        2**-12 that sum to less than 2**12; head: in double precision). A result then depends neither on the order of a sum
        nor on the texts beside it."""
        out = Net.__new__(Net)
        kinds = {"emb": (5, np.float32), "conv": (7, np.float32), "cb": (12, np.float32)}
        out.p = {}
        for k, v in self.p.items():
            bits, kind = kinds.get(k, (10, np.float64))
            out.p[k] = (np.round(v.astype(np.float64) * 2**bits) / 2**bits).astype(kind)
        return out


def layout(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded to whole halves, one after another, and the first half of each (one more than texts)."""
    size = np.diff(at)
    n = np.maximum(1, -(-size // HALF))
    first = np.r_[0, np.cumsum(n)]
    codes = np.full(first[-1] * HALF + WIDTH, 256, np.int16)
    codes[np.arange(len(data)) + np.repeat(first[:-1] * HALF - at[:-1], size)] = data
    return codes, first


def chunks(half: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Pool each half with the next one of its text."""
    out = half.copy()
    if len(half) > 1:
        inner = np.ones(len(half) - 1, bool)
        inner[first[1:-1] - 1] = False
        out[:-1][inner] = np.maximum(half[:-1][inner], half[1:][inner])
    return out


def logits(net: Net, data: np.ndarray, at: np.ndarray, piece: int = 1024) -> np.ndarray:
    """Defect logit of each text's every chunk, and the first chunk of each text."""
    codes, first = layout(data, at)
    last = np.zeros(first[-1], bool)
    last[first[1:] - 1] = True
    half = np.concatenate([net.halves(codes[i * HALF : min(first[-1], i + piece) * HALF + WIDTH], last[i : i + piece]) for i in range(0, first[-1], piece)])
    return net.head(chunks(half, first))[0], first


def predict(net: Net, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Probability that a text is of quality 1."""
    if len(at) < 2:
        return np.zeros(0)
    z, first = logits(net, data, at)
    worst = np.maximum.reduceat(z, first[:-1])
    return 1 / (1 + np.exp(np.clip(worst.astype(float), -30, 30)))


def train(rows: list, epochs: int = 8, batch: int = 64, steps: int = 480, rate: float = 0.004, seed: int = 5) -> Net:
    """Adam on each text's worst chunk and on one random chunk of each good text; `steps` is the same at every size."""
    net = Net()
    rows = [(t.encode(), y) for t, y in rows if t]
    if not rows:
        return net.frozen()
    data = np.frombuffer(b"".join(t for t, _ in rows), np.uint8)
    at = np.r_[0, np.cumsum([len(t) for t, _ in rows])]
    bad = np.array([1 - y for _, y in rows], np.float32)
    codes, first = layout(data, at)
    count = np.diff(first)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    pools = [np.flatnonzero(bad == 1), np.flatnonzero(bad == 0)]
    if not all(len(x) for x in pools):
        net.p["b2"][:] = -4.0 if len(pools[1]) else 4.0
        return net.frozen()
    worst = None
    dim = net.p["emb"].shape[1]
    for step in range(steps):
        if step % (steps // epochs) == 0:
            z = np.concatenate([logits(net, data[at[a] : at[min(a + 200, len(rows))]], at[a : a + 201] - at[a])[0] for a in range(0, len(rows), 200)])
            top = np.maximum.reduceat(z, first[:-1])
            group = np.repeat(np.arange(len(rows)), count)
            worst = np.full(len(rows), len(z))
            hit = np.flatnonzero(z >= top[group])
            np.minimum.at(worst, group[hit], hit)
        b = rng.choice(pools[0], batch // 2)
        g = rng.choice(pools[1], batch // 2)
        some = (first[g] + rng.integers(0, 1 << 40, len(g)) % count[g]).astype(np.int64)
        any_bad = (first[b] + rng.integers(0, 1 << 40, len(b)) % count[b]).astype(np.int64)
        chunk = np.r_[any_bad if step < steps // epochs else worst[b], worst[g], some]
        y = np.r_[np.ones(len(b)), np.zeros(2 * len(g))].astype(np.float32)
        owner = np.searchsorted(first, chunk, "right") - 1
        second = np.minimum(chunk + 1, first[owner + 1] - 1)
        idx = np.stack([chunk, second], 1)[:, :, None] * HALF + np.arange(HALF + WIDTH)
        c = codes[idx]  # chunks x 2 x (HALF + WIDTH)
        e = net.p["emb"][c].reshape(len(chunk) * 2, -1)
        n = HALF // STRIDE
        view = np.lib.stride_tricks.as_strided(e, (len(chunk) * 2, n, WIDTH * dim), (e.strides[0], STRIDE * dim * 4, 4))
        x = np.ascontiguousarray(view).reshape(len(chunk), 2 * n, WIDTH * dim)
        resp = x @ net.p["conv"]
        end = first[owner + 1] - 1
        resp[chunk == end, n - OVER : n] = -np.inf
        resp[second == end, 2 * n - OVER :] = -np.inf
        arg = resp.argmax(1)
        pooled = np.take_along_axis(resp, arg[:, None], 1)[:, 0]
        z, h, a = net.head(pooled)
        gz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        gh = gz[:, None] * net.p["w2"] * (h > 0)
        ga = gh @ net.p["w1"].T * (a > 0)
        f = ga.shape[1]
        picked = x[np.arange(len(chunk))[:, None], arg]  # chunks x filters x inputs
        ge = (ga[:, :, None] * net.p["conv"].T[None]).reshape(len(chunk), f, WIDTH, dim)
        byte_at = (arg // n)[:, :, None] * (HALF + WIDTH) + (arg % n)[:, :, None] * STRIDE + np.arange(WIDTH)
        which = np.take_along_axis(c.reshape(len(chunk), -1), byte_at.reshape(len(chunk), -1), 1).reshape(-1)
        flat = ge.reshape(-1, dim)
        grads = {
            "emb": np.stack([np.bincount(which, flat[:, d], 257) for d in range(dim)], 1),
            "conv": np.einsum("cf,cfi->if", ga, picked, optimize=True),
            "cb": ga.sum(0), "w1": a.T @ gh, "b1": gh.sum(0), "w2": h.T @ gz, "b2": gz.sum(keepdims=True),
        }
        lr = rate * min(1, 1.5 * (1 - step / steps) + 0.05)
        for k, gk in grads.items():
            gk = gk.astype(np.float32)
            m[k] += 0.1 * (gk - m[k])
            v[k] += 0.01 * (gk * gk - v[k])
            net.p[k] -= lr * (m[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(v[k] / (1 - 0.99 ** (step + 1))) + 1e-7)
    return net.frozen()


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, max_bytes: int = 6_000_000) -> Net:
    """Train on at most `max_rows` labelled rows (together at most `max_bytes`) outside the held-out fold."""
    return train(common.labelled(docs, labels, "quality", max_rows, max_bytes))


def score(docs: DataFrame, net: Net, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Null and empty texts count as one empty chunk; a null doc_id has
    a null held_out. A score depends on the text alone, so equal texts and repeated rows have equal scores; other columns are
    ignored. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand weights

    def make():
        model = shared.value
        return lambda rows, data, at: {"doc_id": rows.column(0), "score": pa.array(predict(model, data, at))}

    out = common.map_blocks(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, score double", make)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
