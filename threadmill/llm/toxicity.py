"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

All terms of a text span the vector space; terms that tell the labels apart
weigh more. Labelled examples are kept in an inverted index whose posting blocks
know their largest weight for each term. Each document walks the blocks in order
of their upper bounds and stops when no block left can reach the k-th best
cosine, so the neighbours are exact. Their votes are weighted by nearness and
calibrated on the examples themselves.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, give_back, held_out, labelled_sample, per_batch, steps, utf8
from .parts import distinct

WORD = re.compile(r"[^\W\d_]+")
#: Words count whole and by their first letters, so that rare forms of a known stem tell, too.
STEM = 5
#: Examples in one block of the index.
BLOCK = 512
#: Terms that at least one in so many examples has are kept as whole rows.
COMMON = 16
#: Weight of the share of label 1 in a vote, where an equal text has 20; texts whose common terms are met together, and those that walk together.
PRIOR, TOGETHER, WALK = 1.0, 256, 8
#: Bytes of texts whose terms are counted together, and words that a task remembers.
COUNTED, WORDS = 1 << 20, 60_000
UNKNOWN = -2
#: Which of the first 256 characters are letters.
LETTER = np.array([bool(WORD.match(chr(k))) for k in range(256)])
#: Bins of votes in the calibration.
BINS = 50
#: Telling terms that are named as evidence at most.
NAMED = 20


class Codes(dict):
    """Numbers of terms: those of an index, and beyond them one for each other term that a task meets."""

    def __init__(self, terms: dict[str, int]):
        super().__init__(terms)
        self.terms = terms
        #: The number of a term's beginning, -1 where it is no longer, UNKNOWN until it is met as a word.
        self.stem = array("i", [UNKNOWN]) * len(terms)

    def __missing__(self, term: str) -> int:
        number = self[term] = len(self)
        self.stem.append(UNKNOWN)
        return number

    def counts(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text its terms' numbers, in order, and how often each occurs."""
        low = 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size + len(texts[high]) <= COUNTED):
                size += len(texts[high])
                high += 1
            yield from self._together(texts[low:high])
            low = high
            if len(self) > len(self.terms) + WORDS:
                self.clear()
                self.update(self.terms)
                self.stem = array("i", [UNKNOWN]) * len(self.terms)

    def _words(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words, most of them once; for each word of the texts its place among them, and its text."""
        short, other, owners = [], [], []
        for k, text in enumerate(texts):
            text = text.decode().lower()
            try:
                short.append(text.encode("latin-1"))
            except UnicodeEncodeError:  # letters beyond the first 256 characters
                found = WORD.findall(text)
                other += found
                owners.append(np.full(len(found), k))
                short.append(b"")
        joined = b" ".join([b"", *short, bytes(8)])
        inside = LETTER[np.frombuffer(joined, np.uint8)]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        first, place = distinct(joined, starts, ends - starts)
        words = [joined[a:b].decode("latin-1") for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        owner = np.searchsorted(np.cumsum([1, *(len(x) + 1 for x in short[:-1])]), starts, side="right") - 1
        place = np.concatenate([place, np.arange(len(words), len(words) + len(other))])
        return words + other, place, np.concatenate([owner, *owners])

    def _together(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        words, place, owner = self._words(texts)
        own = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        for k in np.flatnonzero(np.frombuffer(self.stem, np.int32)[own] == UNKNOWN).tolist() if words else []:
            # beginnings are marked with a star, so they are no words
            self.stem[own[k]] = self[words[k][:STEM] + "*"] if len(words[k]) > STEM else -1
        stem = np.frombuffer(self.stem, np.int32)[own] if words else own
        span = len(self)
        own, stem = own[place], stem[place]
        longer = stem >= 0
        keys, times = np.unique(np.concatenate([owner * span + own, owner[longer] * span + stem[longer]]), return_counts=True)
        ends = np.searchsorted(keys, np.arange(len(texts) + 1) * span)
        for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            yield (keys[a:b] - k * span).astype(np.int32), times[a:b].astype(np.int32)


@dataclass
class Settings:
    #: Labelled rows that are learnt from at most, about: a hash of doc_id picks them.
    examples: int = 2048
    #: A term's likelihood-ratio statistic between the labels from which on it weighs more, and by how much.
    chance: float = 12.0
    telling: float = 6.0
    neighbours: int = 15
    threshold: float = 0.7


@dataclass
class Index:
    """Inverted index over unit vectors, in blocks of examples."""

    terms: dict[str, int]
    #: Weight of a term that occurs once.
    idf: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    #: For each term and block the largest weight.
    peaks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    #: Postings of rarer terms: for each term and block where they start, the example of each and its weight.
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    places: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    #: The row of each common term in ``rows``, or -1, and their weights in all examples.
    common: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    rows: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    @property
    def block_count(self) -> int:
        return -(-len(self.labels) // BLOCK)

    def vector(self, terms: np.ndarray, times: np.ndarray, unseen: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a unit vector: (1 + log tf) idf; ``unseen`` is the squared weight of terms outside the index."""
        w = (1 + np.log(times)) * self.idf[terms]
        return terms, w / math.sqrt((w**2).sum() + unseen) if len(w) else w

    def fill(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Postings of all examples in turn; their weights are kept as 32-bit floats and added up as 64-bit ones."""
        terms = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        weights = np.concatenate([w for _, w in vectors]).astype(np.float32) if vectors else np.zeros(0, np.float32)
        place = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        blocks = self.block_count
        often = np.flatnonzero(np.bincount(terms, minlength=len(self.terms)) * COMMON > len(vectors))
        self.common = np.full(len(self.terms), -1, np.int64)
        self.common[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), len(vectors)), np.float32)
        self.peaks = np.zeros((len(self.terms), blocks), np.float32)
        np.maximum.at(self.peaks, (terms, place // BLOCK), weights)
        row = self.common[terms]
        self.rows[row[row >= 0], place[row >= 0]] = weights[row >= 0]
        terms, place, weights = terms[row < 0], place[row < 0], weights[row < 0]
        order = np.lexsort((place, terms))
        self.places, self.values = place[order].astype(np.int32), weights[order]
        sizes = np.bincount(terms.astype(np.int64) * blocks + place // BLOCK, minlength=len(self.terms) * blocks)
        self.starts = np.append(0, np.cumsum(sizes)).astype(np.int32)

    def bases(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What common terms add to the cosine of each vector with each example."""
        asked = np.zeros((len(vectors), len(self.rows)))
        for i, (terms, weights) in enumerate(vectors):
            row = self.common[terms]
            asked[i, row[row >= 0]] = weights[row >= 0]
        return asked @ self.rows.astype(np.float64)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and cosines of the k nearest examples with a cosine above zero, ties to the lower row; and the blocks walked."""
        vectors = [(terms, weights)]
        return self.walk(vectors, self.bases(vectors), k, [skip])[0]

    def walk(self, vectors: list[tuple[np.ndarray, np.ndarray]], base: np.ndarray, k: int, skip: list[int]) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """``nearest`` of some vectors at once.

        Each takes its blocks by falling bounds: the first, the next three, then
        four times as many as before; a round leaves out blocks that cannot
        reach its k-th best cosine so far.
        """
        count, n, blocks = len(vectors), len(self.labels), self.block_count
        owner = np.repeat(np.arange(count), [len(t) for t, _ in vectors])
        terms, weights = (np.concatenate([v[i] for v in vectors]) for i in (0, 1))
        rare = self.common[terms] < 0
        owner, terms, weights = owner[rare], terms[rare].astype(np.int64), weights[rare]
        # the best of a block's common part, and all that its rarer terms can add
        bounds = np.maximum.reduceat(base, np.arange(0, n, BLOCK), axis=1)
        added = weights[:, None] * self.peaks[terms]
        for b in range(blocks):
            bounds[:, b] += np.bincount(owner, added[:, b], minlength=count)
        turn = np.empty_like(bounds, np.int64)
        np.put_along_axis(turn, np.argsort(-bounds, axis=1, kind="stable"), np.arange(blocks)[None, :], axis=1)
        scores = np.full((count, n), -np.inf)
        floor, walked = np.zeros(count), np.zeros(count, np.int64)
        own = [(i, x) for i, x in enumerate(skip) if x >= 0]
        low, high = 0, 1
        while low < blocks:
            # at equal bounds a lower row may still be waiting, so only a smaller bound leaves a block out
            want = (turn >= low) & (turn < high) & (bounds > 0) & (bounds >= floor[:, None] - 1e-12)
            if not want.any():
                break
            walked += want.sum(axis=1)
            entry, block = np.nonzero(want[owner])
            cell = terms[entry] * blocks + block
            start, size = self.starts[cell].astype(np.int64), (self.starts[cell + 1] - self.starts[cell]).astype(np.int64)
            picks = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
            at = np.repeat(owner[entry] * n, size) + self.places[picks]
            got = np.bincount(at, weights=self.values[picks] * np.repeat(weights[entry], size), minlength=count * n).reshape(count, n)
            scores = np.where(np.repeat(want, BLOCK, axis=1)[:, :n], base + got, scores)
            for i, x in own:
                scores[i, x] = -np.inf
            if n > k:
                floor = np.maximum(0.0, np.partition(scores, n - k, axis=1)[:, n - k])
            low, high = high, 4 * high
        out = []
        for one, least, blocks in zip(scores, floor.tolist(), walked.tolist(), strict=True):
            rows = np.flatnonzero(one > max(0.0, least - 1e-9))
            best = rows[np.lexsort((rows, -np.round(one[rows], 12)))[:k]]
            out.append((best, one[best], blocks))
        return out


@dataclass
class Model:
    index: Index
    settings: Settings
    #: Calibration: votes at the knots and the chances there; and the chance without any neighbour.
    knots: np.ndarray
    chances: np.ndarray
    silent: float
    share: float = 0.5
    #: Squared weight of a term that no example has: no cosine meets it, but it makes its text longer.
    unseen: float = 0.0
    #: Terms that tell the labels apart.
    telling: frozenset[int] = frozenset()

    def codes(self) -> Codes:
        """What counts terms for this model; a task has one of its own."""
        return Codes(self.index.terms)

    def counts(self, texts: list[bytes], codes: Codes) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """Of each text its terms in the index, in order, how often each occurs, and the squared weight of all others."""
        out = []
        for terms, times in codes.counts(texts):
            known = int(np.searchsorted(terms, len(self.index.terms)))
            out.append((terms[:known], times[:known], float(((1 + np.log(times[known:])) ** 2).sum()) * self.unseen))
        return out

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], own: list[int] | None = None) -> list[tuple[float, np.ndarray, np.ndarray] | None]:
        """Vote, rows and cosines of the neighbours of each vector; None without any. Example ``own`` has no vote.

        Far neighbours leave the vote near the share of label 1.
        """
        out = []
        for low in range(0, len(vectors), TOGETHER):
            some = vectors[low : low + TOGETHER]
            base = self.index.bases(some)
            skip = [-1] * len(some) if own is None else own[low : low + TOGETHER]
            found = [x for k in range(0, len(some), WALK) for x in self.index.walk(some[k : k + WALK], base[k : k + WALK], self.settings.neighbours, skip[k : k + WALK])]
            for rows, cosines, _ in found:
                near = 1 / (0.05 + np.sqrt(np.maximum(0, 2 - 2 * cosines)))  # the distance of unit vectors
                vote = (near @ self.index.labels[rows] + PRIOR * self.share) / (near.sum() + PRIOR)
                out.append((float(vote), rows, cosines) if len(rows) else None)
        return out

    def scores(self, texts: list[bytes], codes: Codes) -> list[tuple[float, list[int], list[float], list[str]]]:
        """Of each text the chance of label 1, the neighbours' ids and cosines, and the telling terms found."""
        counts = self.counts(texts, codes)
        if not len(self.index.labels):
            return [(self.silent, [], [], [])] * len(texts)
        out = []
        for (found, *_), voted in zip(counts, self.votes([self.index.vector(*c) for c in counts]), strict=True):
            told = sorted(self.telling.intersection(found.tolist()), key=lambda t: (-self.index.idf[t], t))[:NAMED]
            evidence = [self.names[t] for t in told]
            if voted is None:
                out.append((self.silent, [], [], evidence))
                continue
            chance = float(np.interp(voted[0], self.knots, self.chances))
            out.append((chance, self.index.ids[voted[1]].tolist(), np.round(np.minimum(voted[2], 1.0), 9).tolist(), evidence))
        return out

    @property
    def names(self) -> dict[int, str]:
        if not hasattr(self, "_names"):
            self._names = {i: t for t, i in self.index.terms.items() if i in self.telling}
        return self._names


def _tally(rows: DataFrame) -> DataFrame:
    """term, bad and good: how many rows of each label hold a term; rows are added up in their batch first."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            bad, good = Counter(), Counter()
            for label, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                terms = set(WORD.findall(text.decode().lower()))
                terms |= {w[:STEM] + "*" for w in terms if len(w) > STEM}
                (bad if label else good).update(terms)
            terms = list(bad | good)
            columns = [pa.array(terms, pa.string()), *[pa.array([c[t] for t in terms], pa.int64()) for c in (bad, good)]]
            return pa.RecordBatch.from_arrays(columns, names=["term", "bad", "good"])

        return step

    return per_batch(rows, make, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _frequencies(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """term and n: how many of ``docs`` hold each of these terms, by number; a task sends what it has added up."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        codes, total = Codes(known), np.zeros(len(known), np.int64)
        for batch in steps(batches):
            for found, _ in codes.counts(utf8(batch.column(0))):
                total[found[: np.searchsorted(found, len(known))]] += 1
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["term", "n"])
        del codes, known
        give_back()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Learn from labelled rows; document frequencies count all of ``docs``.

    Rows with null or other labels are left out; several labels of one id count
    as their largest. Without examples of both labels every score is the share
    of label 1 (one half without any).
    """
    s = settings or Settings()
    spark = docs.sparkSession
    sample = cut(labelled_sample(docs, labels, "toxic", s.examples))
    totals = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    all_rows = bad + good
    share = bad / all_rows if all_rows else 0.5
    b, g = F.col("bad"), F.col("good")
    # likelihood ratio against terms that fall on labels by chance
    part = lambda n, rate: F.when(n > 0, n * F.log(n / ((b + g) * rate))).otherwise(0.0)
    gain = 2 * (part(b, max(share, 1e-9)) + part(g, max(1 - share, 1e-9)))
    # the terms of a bounded sample
    seen = _tally(sample.select("label", "text")).select("term", gain.alias("gain")).toPandas().sort_values("term")
    terms = {t: i for i, t in enumerate(seen["term"])}

    # document frequencies of these terms over the whole table
    number = docs.count()
    frequency = np.ones(len(terms))
    if terms:
        counted = _frequencies(docs, terms).toPandas()
        frequency[counted["term"]] = counted["n"]
    over = np.sqrt(np.maximum(0, seen["gain"].to_numpy(float) - s.chance))
    weight = (np.log((1 + number) / (1 + frequency)) + 1) * (1 + s.telling * over)

    index = Index(terms, weight, np.zeros(0, np.int64), np.zeros(0, np.int64))
    model = Model(index, s, np.array([0.0, 1.0]), np.array([0.0, 1.0]), (bad + 0.5) / (all_rows + 1), share)
    if not terms:
        return model
    model.telling = frozenset(np.flatnonzero(over > 0).tolist())
    model.unseen = (math.log((1 + number) / 2) + 1) ** 2
    sent = spark.sparkContext.broadcast(model)

    def examples():
        known = sent.value
        codes = known.codes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            # every term of an example is in the index
            rows = known.counts(utf8(batch.column(2)), codes)
            lists = [pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["doc_id", "label", "t", "n"])

        return step

    # bounded: at most ``examples`` rows
    rows = sample.select("doc_id", F.col("label").cast("int").alias("label"), "text")
    found = per_batch(rows, examples, "doc_id long, label int, t array<int>, n array<int>").toArrow().sort_by("doc_id").combine_chunks()
    sent.destroy()
    ids, labels = (found[c].to_numpy() for c in ("doc_id", "label"))
    held = found["n"].combine_chunks()
    ends = np.cumsum([0, *pa.compute.list_value_length(held).to_pylist()])
    all_terms, times = found["t"].combine_chunks().flatten().to_numpy(), held.flatten().to_numpy()
    vectors = [index.vector(all_terms[a:b], times[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    told = [i for i, (t, _) in enumerate(vectors) if len(t)]
    silent = labels[[i for i, (t, _) in enumerate(vectors) if not len(t)]]
    if len(silent):
        model.silent = float((silent.sum() + 0.5) / (len(silent) + 1))
    # rows of one strongest term share blocks, which keeps the bounds of the others low
    told.sort(key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]), int(ids[i])))
    index.labels, index.ids = labels[told].astype(np.int64), ids[told]
    vectors = [vectors[i] for i in told]
    index.fill(vectors)
    vectors = [(t, w.astype(np.float32)) for t, w in vectors]
    sent = spark.sparkContext.broadcast((model, vectors))

    def judged():
        known, vectors = sent.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            # each example is judged without itself
            own = batch.column(0).to_pylist()
            voted = known.votes([vectors[row] for row in own], own)
            voted = [(v[0], int(known.index.labels[row])) for row, v in zip(own, voted, strict=True) if v is not None]
            columns = [pa.array([v for v, _ in voted], pa.float64()), pa.array([m for _, m in voted], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["vote", "mark"])

        return step

    rows = per_batch(spark.range(len(told)), judged, "vote double, mark long").collect()
    sent.destroy()
    model.knots, model.chances = calibrate(np.array([r["vote"] for r in rows]), np.array([r["mark"] for r in rows]))
    return model


def calibrate(votes: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of label 1 as a non-decreasing function of the vote: pooled adjacent violators over bins."""
    if not len(votes):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    pools: list[list[float]] = []
    place = np.minimum((votes * BINS).astype(int), BINS - 1)
    for k in range(BINS):
        if (here := place == k).any():
            pools.append([votes[here].sum(), marks[here].sum(), here.sum()])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    # the ends are anchored, so that votes beyond the outer pools still differ
    knots, chances = [p[0] / p[2] for p in pools], [(p[1] + 0.25) / (p[2] + 0.5) for p in pools]
    return np.array([0.0, *knots, 1.0]), np.array([0.0, *chances, 1.0])


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, neighbours array<long>, cosines array<double>, evidence array<string>"


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """Score whole texts: one row for each row of ``docs``, whatever its doc_id.

    Null and empty texts, and others without any term of an example, get the
    share of label 1 among such examples, or among all. ``neighbours`` and
    ``cosines`` are the labelled rows that voted, nearest first, and
    ``evidence`` the strongest telling terms.
    """
    sent = spark.sparkContext.broadcast(model)

    def make():
        known = sent.value
        codes, threshold = known.codes(), known.settings.threshold

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = known.scores(utf8(batch.column(2)), codes)
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array([r[0] for r in rows], pa.float64()),
                pa.array([int(r[0] >= threshold) for r in rows], pa.int32()),
                pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                pa.array([r[2] for r in rows], pa.list_(pa.float64())),
                pa.array([r[3] for r in rows], pa.list_(pa.string())),
            ]
            return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_batch(rows.select("doc_id", held_out().alias("held_out"), "text"), make, SCHEMA)


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic; columns as they were."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def make():
        known = sent.value
        codes, threshold = known.codes(), known.settings.threshold

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            good = [r[0] < threshold for r in known.scores(utf8(batch.column(place)), codes)]
            return batch.filter(pa.array(good))

        return step

    return per_batch(docs, make, docs.schema)
