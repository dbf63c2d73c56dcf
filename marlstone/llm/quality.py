"""Operator 3: a quality classifier by attention-based multiple-instance learning."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import map_rows
from marlstone.llm.shingles import word_hashes

WORDS_A_PASSAGE = 64
#: Byte classes of the encoding: letters by case, digits, spaces, line ends, marks, non-ASCII.
_MARKS = b".,;:!?'\"-()|%$#&*+=/<>@_"
_CLASS = np.full(256, 7, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9]], _CLASS[[10, 13]], _CLASS[0:9], _CLASS[128:] = 3, 4, 5, 6
for _i, _c in enumerate(_MARKS):
    _CLASS[_c] = 8 + _i
_CLASSES = 8 + len(_MARKS)
_COARSE = np.arange(_CLASSES, dtype=np.int64)
_COARSE[8:14], _COARSE[14:] = 8, 9
_PAIRS = 10
DIMENSIONS = _CLASSES + _PAIRS * _PAIRS + 4


def encode(text: str | None) -> np.ndarray:
    """A row of features for each passage of ``WORDS_A_PASSAGE`` words of the whole text.

    Shares of byte classes and of pairs of classes, the passage's size, mean word length, and the
    share of words that do not repeat in it. A text without words is one passage of zeros.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    first = ~space & np.concatenate(([True], space[:-1])) if raw.size else space
    words = int(first.sum())
    if not words:
        return np.zeros((1, DIMENSIONS), np.float32)
    word = np.maximum(np.cumsum(first) - 1, 0)
    at = word // WORDS_A_PASSAGE
    n = int(at[-1]) + 1
    kind = _CLASS[raw].astype(np.int64)
    size = np.bincount(at, minlength=n).astype(np.float64)
    ones = np.bincount(at * _CLASSES + kind, minlength=n * _CLASSES).reshape(n, _CLASSES) / size[:, None]
    coarse = _COARSE[kind]
    pair = coarse[:-1] * _PAIRS + coarse[1:]
    twos = np.bincount(at[1:] * _PAIRS**2 + pair, minlength=n * _PAIRS**2).reshape(n, _PAIRS**2) / size[:, None]
    hashes = word_hashes(text)
    owner = np.arange(hashes.size) // WORDS_A_PASSAGE
    order = np.lexsort((hashes, owner))
    fresh = np.ones(hashes.size, bool)
    fresh[1:] = (np.diff(hashes[order].view(np.int64)) != 0) | (np.diff(owner) != 0)
    count = np.bincount(owner, minlength=n)
    distinct = np.bincount(owner, weights=fresh, minlength=n)
    rest = np.stack([np.log1p(size) / 8, np.minimum(size / count / 16, 4), distinct / count, np.full(n, min(math.log1p(n) / 6, 2))], axis=1)
    return np.concatenate([ones, twos, rest], axis=1).astype(np.float32)


@dataclass(frozen=True)
class AttentionModel:
    """Passages x -> h = tanh(xW + b); weights softmax(w . tanh(hV) * sigmoid(hU)) over a document; score of their sum."""

    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([0, *(len(b) for b in bags)])
        x = ((np.concatenate(bags) - self.mean) / self.scale).clip(-8, 8)
        return _forward(self.parts, x, starts)["p"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _forward(m: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    seg = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    h = np.tanh(x @ m["W"] + m["b"])
    t, g = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    s = (t * g) @ m["w"]
    e = np.exp(s - np.maximum.reduceat(s, starts[:-1])[seg])
    a = e / np.add.reduceat(e, starts[:-1])[seg]
    z = np.add.reduceat(a[:, None] * h, starts[:-1])
    return {"seg": seg, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ m["c"] + m["d"])}


def _gradients(m: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(m, x, starts)
    seg, h, t, g, a = f["seg"], f["h"], f["t"], f["g"], f["a"]
    dl = (f["p"] - y) / len(y)
    dz = (dl[:, None] * m["c"])[seg]
    da = (h * dz).sum(axis=1)
    ds = a * (da - np.add.reduceat(a * da, starts[:-1])[seg])
    dt, dg = ds[:, None] * m["w"] * g * (1 - t * t), ds[:, None] * m["w"] * t * g * (1 - g)
    dh = (a[:, None] * dz + dt @ m["V"].T + dg @ m["U"].T) * (1 - h * h)
    return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": f["z"].T @ dl, "d": dl.sum()}


def train(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, attention: int = 12, epochs: int = 15, steps: int = 400, batch: int = 128, rate: float = 0.01, decay: float = 1e-3, seed: int = 11) -> AttentionModel:
    """Adam on the log loss of document labels; the seed fixes start and order, so reruns agree.

    Few documents are gone over more often than ``epochs`` times, until ``steps`` batches are done.
    """
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    bags = [((b - mean) / scale).clip(-8, 8) for b in bags]
    d = mean.size
    m = {"W": rng.normal(0, 1 / math.sqrt(d), (d, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, 0.3, (hidden, attention)), "U": rng.normal(0, 0.3, (hidden, attention)), "w": rng.normal(0, 0.3, attention), "c": np.zeros(hidden), "d": np.array(math.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3)))}
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    per_epoch = -(-len(bags) // batch)
    epochs = max(epochs, -(-steps // per_epoch))
    step, total = 0, epochs * per_epoch
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(bags), batch):
            chosen = order[i : i + batch]
            starts = np.cumsum([0, *(len(bags[j]) for j in chosen)])
            grads = _gradients(m, np.concatenate([bags[j] for j in chosen]), starts, labels[chosen])
            step += 1
            for k, v in grads.items():
                if k in ("W", "V", "U"):
                    v = v + decay * m[k]
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                m[k] = m[k] - rate * (1 - step / (total + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return AttentionModel(mean, scale, m)


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = 4000, **options) -> AttentionModel | None:
    """A model from a bounded sample of labelled rows: about ``max_docs`` of them, by a hash of the id.

    Whole texts are encoded on the executors, as in scoring; the driver gets their passages. Ids with contradicting labels, null ids, texts or labels teach nothing. Without
    any label the model is None.
    """
    one = labels.select(F.col("doc_id").alias("i"), F.col(label_col).alias("y")).filter("i is not null and y is not null")
    one = one.groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("y1")).filter("y = y1").select("i", "y")
    n = one.count()
    if not n:
        return None
    spread = 1 << 30
    part = min(spread, math.ceil(spread * max_docs / n))
    chosen = one.filter(F.pmod(F.xxhash64("i"), F.lit(spread)) < part)
    texts = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter("i is not null and t is not null")
    known = texts.join(chosen, "i").select("i", "t", F.col("y").cast("double").alias("y")).distinct()

    def run(ids: list, values: list, ys: list) -> list:
        import xxhash

        return [ids, [xxhash.xxh3_128_digest(t.encode("utf-8", "replace")) for t in values], ys, [encode(t).astype(np.float32).tobytes() for t in values]]

    rows = map_rows(known, ["i", "t", "y"], run, f"i {df.schema[id_col].dataType.simpleString()}, h binary, y double, bag binary").collect()
    if not rows:
        return None
    rows = sorted(rows, key=lambda r: (r["i"], bytes(r["h"])))
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, DIMENSIONS).astype(np.float64) for r in rows]
    return train(bags, np.array([r["y"] for r in rows]), **options)


def score(df: DataFrame, model: AttentionModel | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted`` for every row, from its whole text and nothing else.

    Null and empty texts score as one passage without words. Without a model every row scores 0.5.
    Null ids and repeated rows pass through; other columns are not read.
    """

    def run(ids: list, texts: list) -> list:
        bags = [encode(t) for t in texts]
        p = model.scores(bags) if model else np.full(len(bags), 0.5)
        return [ids, p, (p >= threshold).astype(np.int32)]

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df, [id_col, text_col], run, f"doc_id {kind}, score double, predicted int")


def keep_good(df: DataFrame, model: AttentionModel | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``df`` whose text scores at least ``threshold``, judged in place, without a join."""
    from collections.abc import Iterator

    import pyarrow as pa

    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * 16e6 / max(batch.nbytes, 1)))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                bags = [encode(t) for t in part.column(at).to_pylist()]
                if model and bags:
                    part = part.filter(pa.array(model.scores(bags) >= threshold))
                yield part

    return df.mapInArrow(run, df.schema)
