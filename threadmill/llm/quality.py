"""Quality by random-indexing word vectors and a small network.

Every word slot has a sparse random index vector; a slot's word vector is the
sum of the index vectors of its neighbours over the whole corpus. Documents
pool the vectors of their words, and a two-layer network in numpy turns them
into probabilities that are calibrated by a temperature.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, give_back, held_out, labelled_sample, per_batch, steps, utf8

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Rows of the summed table that one task adds up at most.
FAN_IN = 256
#: Slots in one row of the summed table.
BLOCK = 256
#: Entries of a worker's token cache.
CACHE = 120_000
TOKENS_AT_ONCE = 400_000


@dataclass
class Settings:
    #: Word slots (a hash deals words to them), dimensions, non-zero entries of an index vector, words on each side.
    slots: int = 16_384
    dims: int = 64
    entries: int = 4
    window: int = 2
    #: Labelled rows that the network is fitted on at most, about: a hash of doc_id picks them.
    examples: int = 20_000
    hidden: int = 32
    epochs: int = 80
    #: Rows of one step; fewer where there would be under ``steps`` steps an epoch.
    batch: int = 256
    steps: int = 16
    rate: float = 3e-3
    decay: float = 1e-3
    smoothing: float = 1e-3
    seed: int = 7


class Slots(dict):
    """Slot of each token; two marks are added for capitals and for a word said again."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n
        self.upper, self.again = 0, 1

    def __missing__(self, token: str) -> int:
        slot = 2 + xxhash.xxh32_intdigest(token.encode()) % (self.n - 2)
        if len(self) < CACHE:
            self[token] = slot
        return slot

    def of(self, text: bytes) -> np.ndarray:
        tokens = TOKEN.findall(text.decode())
        out = np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens))
        if not len(out):
            return out
        upper = np.fromiter(map(str.isupper, tokens), bool, len(tokens))
        upper &= np.fromiter(map(len, tokens), np.int64, len(tokens)) > 1
        again = np.zeros(len(out), bool)
        again[1:] = out[1:] == out[:-1]
        return np.concatenate([out, np.full(upper.sum(), self.upper, np.int32), np.full(again.sum(), self.again, np.int32)])


_slots: dict[int, Slots] = {}


def _worker_slots(n: int) -> Slots:
    return _slots.setdefault(n, Slots(n))


def index_vectors(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each slot's index vector, by a fixed rule."""
    rng = np.random.default_rng(s.seed)
    places = rng.integers(0, s.dims, (s.slots, s.entries))
    return places, rng.choice([-1, 1], (s.slots, s.entries))


def context_sums(slots: list[np.ndarray], s: Settings, places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """For each slot: its neighbours' index vectors summed, and in the last column its count."""
    out = np.zeros((s.slots, s.dims + 1), np.int64)
    gap = np.full(s.window, -1, np.int32)  # no window runs over the end of a text
    flat = np.concatenate([x for one in slots for x in (one, gap)])
    out[:, -1] = np.bincount(flat[flat >= 0], minlength=s.slots)
    for o in range(1, s.window + 1):
        a, b = flat[:-o], flat[o:]
        inside = (a >= 0) & (b >= 0)
        a, b = a[inside], b[inside]
        for word, other in ((a, b), (b, a)):
            base = word.astype(np.int64) * s.dims
            for e in range(s.entries):
                sums = np.bincount(base + places[other, e], weights=signs[other, e], minlength=s.slots * s.dims)
                out[:, :-1] += sums.reshape(s.slots, s.dims).astype(np.int64)
    return out


def word_vectors(docs: DataFrame, s: Settings) -> np.ndarray:
    """Unit word vectors over all texts, scaled so that frequent words weigh less; one row a slot.

    The table of sums has a fixed size. Tasks send theirs in rows of ``BLOCK``
    slots, which are added up at most ``FAN_IN`` at a time, level by level.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _worker_slots(s.slots)
        places, signs = index_vectors(s)
        total = np.zeros((s.slots, s.dims + 1), np.int64)
        held: list[np.ndarray] = []
        for batch in steps(batches):
            for text in utf8(batch.column(0)):
                held.append(known.of(text))
            if sum(map(len, held)) >= TOKENS_AT_ONCE:
                total += context_sums(held, s, places, signs)
                held.clear()
        if held:
            total += context_sums(held, s, places, signs)
        blocks = [k for k in range(0, s.slots, BLOCK) if total[k : k + BLOCK, -1].any()]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k // BLOCK for k in blocks], pa.int32()),
                pa.array([task] * len(blocks), pa.int64()),
                pa.array([total[k : k + BLOCK].tobytes() for k in blocks], pa.binary()),
            ],
            names=["block", "task", "sums"],
        )
        del total, held
        give_back()

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros_like(np.frombuffer(rows["sums"].iloc[0], np.int64))
        for x in rows["sums"]:
            sums = sums + np.frombuffer(x, np.int64)
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "task": [rows["task"].iloc[0] // FAN_IN], "sums": [sums.tobytes()]})

    schema = "block int, task long, sums binary"
    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    for _ in range(3):  # FAN_IN ** 3 tasks and more
        sums = sums.groupBy("block", F.expr(f"task div {FAN_IN}").alias("part")).applyInPandas(lambda rows: add(rows), schema)
    total = np.zeros((s.slots, s.dims + 1))
    for r in sums.collect():
        got = np.frombuffer(r["sums"], np.int64).reshape(-1, s.dims + 1)
        total[r["block"] * BLOCK : r["block"] * BLOCK + len(got)] = got
    counts = total[:, -1]
    share = counts / max(1.0, counts.sum())
    vectors = total[:, :-1]
    # the slot's own index vector keeps slots apart whose company is alike
    places, signs = index_vectors(s)
    own = np.zeros((s.slots, s.dims))
    np.add.at(own, (np.arange(s.slots)[:, None], places), signs)
    unit = lambda m: m / np.maximum(np.sqrt((m**2).sum(axis=1, keepdims=True)), 1e-9)
    common = (share[:, None] * vectors).sum(axis=0) / max(1e-9, np.sqrt((share**2).sum()))
    direction = common / max(1e-9, float(np.sqrt((common**2).sum())))
    vectors = unit(vectors - np.outer(vectors @ direction, direction))
    return (unit(vectors + unit(own)) * (s.smoothing / (s.smoothing + share))[:, None]).astype(np.float32)


@dataclass
class Network:
    vectors: np.ndarray
    settings: Settings
    middle: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float

    def features(self, texts: list[bytes]) -> np.ndarray:
        return pooled(texts, self.vectors, self.settings)

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(0, (x - self.middle) / self.scale @ self.first + self.first_bias)
        return hidden @ self.second + self.second_bias

    def chances(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.features(texts)) / self.temperature, -30, 30)))


def pooled(texts: list[bytes], vectors: np.ndarray, s: Settings) -> np.ndarray:
    """Mean word vector, its length, the spread of slots, and the log of the length, for each text."""
    known = _worker_slots(s.slots)
    out = np.zeros((len(texts), s.dims + 3))
    for i, text in enumerate(texts):
        slots = known.of(text)
        if not len(slots):
            continue
        total = np.zeros(s.dims)
        for k in range(0, len(slots), 8192):
            total += vectors[slots[k : k + 8192]].sum(axis=0, dtype=np.float64)
        mean = total / len(slots)
        out[i, : s.dims] = mean
        out[i, s.dims :] = np.log(1e-4 + np.sqrt((mean**2).sum())), len(np.unique(slots)) / len(slots) ** 0.75, np.log1p(len(slots))
    return out


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Network:
    """Word vectors from all of ``docs``, the network from a bounded sample of labelled rows.

    A fifth of the sample is set aside for the temperature. With one label
    alone, or none, every score is the share of label 1 (one half without any).
    """
    s = settings or Settings()
    spark = docs.sparkSession
    vectors = word_vectors(docs, s)
    sample = cut(labelled_sample(docs, labels, "quality", s.examples))
    sent = spark.sparkContext.broadcast(vectors)

    def make():
        vectors = sent.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = pooled(utf8(batch.column(2)), vectors, s)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

        return step

    # bounded by ``examples``
    rows = per_batch(sample.select("doc_id", F.col("label").cast("int").alias("label"), "text"), make, "doc_id long, label int, x array<double>").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    width = s.dims + 3
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), width)
    y = rows["label"].to_numpy(float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    constant = Network(
        vectors, s, np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0
    )
    if len(set(y.tolist())) < 2:
        return constant
    aside = np.array([xxhash.xxh32_intdigest(str(d)) % 5 == 0 for d in rows["doc_id"]])
    if len(set(y[~aside].tolist())) < 2:
        aside[:] = False
    return train(vectors, s, x, y, aside)


def train(vectors: np.ndarray, s: Settings, x: np.ndarray, y: np.ndarray, aside: np.ndarray) -> Network:
    rng = np.random.default_rng(s.seed)
    fitted_x, fitted_y = x[~aside], y[~aside]
    middle, scale = fitted_x.mean(axis=0), fitted_x.std(axis=0) + 1e-6
    data = (fitted_x - middle) / scale
    n, width = data.shape
    weights = [
        rng.normal(0, np.sqrt(2 / width), (width, s.hidden)),
        np.zeros(s.hidden),
        rng.normal(0, np.sqrt(1 / s.hidden), s.hidden),
        np.zeros(1),
    ]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    tick = 0
    size = min(s.batch, max(8, n // s.steps))
    for epoch in range(s.epochs):
        rate = s.rate * 0.5 * (1 + np.cos(np.pi * epoch / s.epochs))
        order = rng.permutation(n)
        for k in range(0, n, size):
            rows = order[k : k + size]
            a, t = data[rows], fitted_y[rows]
            before = a @ weights[0] + weights[1]
            hidden = np.maximum(0, before)
            p = 1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -30, 30)))
            error = (p - t) / len(rows)
            back = np.outer(error, weights[2]) * (before > 0)
            slopes = [a.T @ back + s.decay * weights[0], back.sum(axis=0), hidden.T @ error + s.decay * weights[2], error.sum(keepdims=True)]
            tick += 1
            for w, (m, v), g in zip(weights, moments, slopes, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**tick)) / (np.sqrt(v / (1 - 0.999**tick)) + 1e-8)
    net = Network(vectors, s, middle, scale, weights[0], weights[1], weights[2], float(weights[3][0]), 1.0)
    if len(set(y[aside].tolist())) == 2:
        net.temperature = temperature(net.logits(x[aside]), y[aside])
    return net


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on rows set aside; a bounded search."""
    def loss(t: float) -> float:
        z = np.clip(logits / t, -30, 30)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    return float(min(np.geomspace(0.25, 8, 61), key=loss))


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(spark: SparkSession, docs: DataFrame, net: Network) -> DataFrame:
    """Scores of whole texts: one row for each row of ``docs``; null and empty texts are scored as empty ones."""
    sent = spark.sparkContext.broadcast(net)

    def make():
        known = sent.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = known.chances(utf8(batch.column(2)))
            columns = [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_batch(rows.select("doc_id", held_out().alias("held_out"), "text"), make, SCHEMA)


def keep(docs: DataFrame, net: Network, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    place = docs.columns.index("text")

    def make():
        known = sent.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(known.chances(utf8(batch.column(place))) >= threshold))

        return step

    return per_batch(docs, make, docs.schema)
