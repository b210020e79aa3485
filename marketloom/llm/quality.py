"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of WORDS words. Each passage is encoded by one hidden layer over the frequencies
of adjacent character classes and how far its words repeat; gated attention weighs the encodings; the weighted
sum gives the document's score. Only documents have labels; the passages' weights are learned from these.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import longs_again, longs_as_text

WORDS, HIDDEN, GATE = 50, 16, 8
#: The model is fitted on so many labelled documents of each class at most, those of least hash.
SAMPLE_PER_CLASS, EPOCHS, BATCH, SEED = 2000, 25, 64, 7
#: Of those, in the order of their hashes, so many that their passages are no more than this (50 MB of features), and one at least.
SAMPLE_PASSAGES = 200_000
K = 11  # character classes
FEATURES = K * K + 4
_SPACE, _LINE = 4, 5


def _class_of(ch: str) -> int:
    """Lower, upper, other letter, digit, space, line end, full stop, comma, exclamation, other punctuation, symbol."""
    if ch == "\n":
        return _LINE
    tests = (str.islower, str.isupper, str.isalpha, str.isdigit, str.isspace)
    for i, is_it in enumerate(tests):
        if is_it(ch):
            return i
    return {".": 6, ",": 7, "!": 8}.get(ch, 9 if ch in ";:?'\"()-" else 10)


_CLASSES = np.array([_class_of(chr(c)) for c in range(1 << 16)], np.int64)


def passages(text: str | None) -> np.ndarray:
    """A row of features for each passage of the whole text; null and empty texts are one passage of zeros."""
    words = (text or "").split()
    if not words:
        return np.zeros((1, FEATURES), np.float32)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _CLASSES[np.minimum(code, 0xFFFF)]
    white = (c == _SPACE) | (c == _LINE)
    first = ~white
    first[1:] &= white[:-1]
    n = -(-len(words) // WORDS)
    at = np.minimum(np.maximum(np.cumsum(first) - 1, 0) // WORDS, n - 1)
    counts = np.bincount(at[1:] * (K * K) + c[:-1] * K + c[1:], minlength=n * K * K).reshape(n, K * K)
    out = np.zeros((n, FEATURES), np.float32)
    out[:, : K * K] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    size = np.bincount(at, minlength=n)
    for i in range(n):
        own = words[i * WORDS : (i + 1) * WORDS]
        often = Counter(own)
        out[i, K * K :] = len(often) / len(own), np.log1p(size[i] / len(own)) / 3, len(own) / WORDS, max(often.values()) / len(own)
    return out


@dataclass
class MilModel:
    """score = sigmoid(c . z + d), z = sum of a_i h_i, h = tanh(W x + b), a = softmax(w . (tanh(V h) * sigmoid(U h)))."""

    params: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float = 0.5

    def score(self, bag: np.ndarray) -> float:
        if not self.params:
            return self.constant
        return float(_forward(self.params, bag, np.zeros(len(bag), int), 1)[0][0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(p: dict, x: np.ndarray, bag: np.ndarray, n: int) -> tuple:
    h = np.tanh((x - p["mean"]) / p["dev"] @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = np.exp(np.clip((t * g) @ p["w"], -30, 30))
    a = e / np.bincount(bag, e, n)[bag]
    z = np.stack([np.bincount(bag, a * h[:, k], n) for k in range(h.shape[1])], 1)
    return _sigmoid(z @ p["c"] + p["d"]), h, t, g, a, z


def train(bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS) -> MilModel:
    """Adam on the weighted log loss, by hand-written gradients. One class or no bags give a constant score."""
    if len(set(labels.tolist())) < 2:
        return MilModel(constant=float(labels[0]) if len(labels) else 0.5)
    rng = np.random.default_rng(SEED)
    every = np.concatenate(bags)
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    p = {"mean": every.mean(0), "dev": every.std(0) + 0.05, "W": init(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "w": init(GATE), "c": init(HIDDEN), "d": np.zeros(1)}
    learned = [k for k in p if k not in ("mean", "dev")]
    m = {k: np.zeros_like(p[k]) for k in learned}
    v = {k: np.zeros_like(p[k]) for k in learned}
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), BATCH):
            own = order[lo : lo + BATCH]
            x = np.concatenate([bags[i] for i in own])
            bag = np.repeat(np.arange(len(own)), [len(bags[i]) for i in own])
            s, h, t, g, a, z = _forward(p, x, bag, len(own))
            ds = (s - labels[own]) * weights[own] / weights[own].sum()
            dz = ds[:, None] * p["c"]
            da = np.einsum("ij,ij->i", dz[bag], h)
            de = a * (da - np.bincount(bag, a * da, len(own))[bag])
            dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
            dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
            xs = (x - p["mean"]) / p["dev"]
            grad = {"W": xs.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ ds, "d": np.array([ds.sum()])}
            step += 1
            for k in learned:
                gk = grad[k] + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return MilModel(p)


def fit(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> MilModel:
    """Learns from labelled documents whose held_out is false; a bounded sample of each class, weighted to the class's share.

    Ids with both labels and null ids teach nothing; repeated rows are passages of their own; very long documents count
    with all their passages, within SAMPLE_PASSAGES; no labels or one class give a constant score.
    """
    d = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"), (held_out if held_out is not None else F.lit(False)).alias("out"))
    d = d.where("id IS NOT NULL AND y IN (0, 1) AND NOT out").groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("_z")).where("y = _z").drop("_z")
    share = {r["y"]: r["count"] for r in d.groupBy("y").count().collect()}  # two rows
    picked = [d.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PER_CLASS) for y in (0, 1)]
    some = picked[0].unionByName(picked[1]).select("id", "y")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(F.broadcast(some), "id")  # 2 * SAMPLE_PER_CLASS labels at most
    # Sizes first, one text for each id (that of least digest), so that what the driver gets is bounded whatever the texts.
    rows = rows.withColumn("h", F.xxhash64("id", "t"))
    size = F.coalesce(F.size(F.split("t", r"\s+")), F.lit(0)) / WORDS + 1
    sizes = rows.groupBy("y", "id").agg(F.min(F.struct("h", size.alias("n"))).alias("x")).select("y", "x.*")  # 2 * SAMPLE_PER_CLASS rows at most
    before = Window.partitionBy("y").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0.0)))
    some = sizes.where((F.col("at") == 0) | (F.col("at") + F.col("n") <= SAMPLE_PASSAGES / 2)).select("h")
    rows = rows.join(F.broadcast(some), "h", "left_semi").dropDuplicates(["h"]).select("id", "y", "t")

    def features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"], "x": [passages(t).astype("<f2").tobytes() for t in pdf["t"]]})

    got = rows.mapInPandas(features, "id long, y int, x binary").toPandas().sort_values(["id", "x"])
    y = got["y"].to_numpy(float)
    bags = [np.frombuffer(x, "<f2").reshape(-1, FEATURES).astype(np.float32) for x in got["x"]]
    weights = np.array([share[int(k)] / max(1, (y == k).sum()) for k in y]) if len(y) else y
    return train(bags, y, weights)


def score(docs: DataFrame, model: MilModel, keep: list[Column | str], text: str = "text", out: str = "score") -> DataFrame:
    """The kept columns and the score (0 to 1, in column out) of every document, repeated rows included.

    Null and empty texts are one passage of zeros; very long ones are scored whole; no rows give no rows; a kept column
    of the name `out` is replaced by the score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(*keep, F.col(text).alias("__text"))
    names = [c for c in d.columns[:-1] if c != out]
    d, big = longs_as_text(d, names)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pdf[names].assign(**{out: [shared.value.score(passages(t)) for t in pdf["__text"]]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields if f.name in names)
    return longs_again(d.mapInPandas(run, f"{schema}, `{out}` double"), big)
