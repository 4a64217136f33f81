"""How the sources of a language differ in their words, by mergeable radix tries.

Each partition counts its terms and holds them as byte tries in preorder, with
counters of documents and of occurrences by source at every leaf. Tries travel
in pages and are cut at prefixes, so that each range of prefixes meets in one
task and is merged there; leaves of terms in too few documents fall away. A
walk over the merged tries, in the order of UTF-8 bytes, then streams what each
pair of sources differs by and each source's most telling terms.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, steps, utf8

# Shares are counted in these parts, after adding so many to each count.
PARTS, ADDED = 1_000_000_000, 2

#: Bytes of a prefix that ranges are told apart by, and pages that the ranges are chosen by.
PREFIX, SAMPLED = 64, 50_000

_LETTERS = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


@dataclass(frozen=True)
class Settings:
    #: Documents of its language that a term must be in.
    least: int = 10
    #: Ranks of terms that are reported.
    top: int = 10
    #: Counters that a task holds before its tries go out. What follows bounds memory, too, and changes no result.
    held: int = 400_000
    #: Leaves of a page, and of a range of prefixes.
    page: int = 4096
    range: int = 100_000
    #: Cells of a block of shares, and of the sums that a task holds before they go out.
    cells: int = 1 << 19
    sums: int = 1 << 22
    #: So many groups are sent to every task at most; more are joined by a shuffle, each language in so many parts.
    sent_groups: int = 100_000
    salts: int = 64


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, made lower case, and of bytes beyond ASCII."""
    return text.translate(_LETTERS).split()


def _packed(arrays: Iterable[np.ndarray]) -> bytes:
    """Arrays of numbers from zero on, each in as few bytes as its largest one needs."""
    out = []
    for a in arrays:
        a = a.astype(np.min_scalar_type(int(a.max(initial=0))))
        out += [struct.pack("<BQ", a.itemsize, len(a)), a.tobytes()]
    return b"".join(out)


def _unpacked(data: bytes, at: int = 0) -> Iterator[np.ndarray]:
    while at < len(data):
        size, n = struct.unpack_from("<BQ", data, at)
        yield np.frombuffer(data, f"<u{size}", n, at + 9)
        at += 9 + size * n


class Trie:
    """A byte radix trie in preorder, its leaves in the order of their bytes.

    A leaf is written as the number of bytes of its path that the leaf before it
    has as well, and its own bytes after them: inner nodes are where paths part.
    It counts documents, and has a counter (source, occurrences) for each source.
    """

    def __init__(self, paths: list[bytes], documents: np.ndarray, fan: np.ndarray, sources: np.ndarray, counts: np.ndarray):
        self.paths, self.documents = paths, documents
        self.ends = np.concatenate([[0], np.cumsum(fan)]).astype(np.int64)
        self.sources, self.counts = sources, counts

    def __len__(self) -> int:
        return len(self.paths)

    @staticmethod
    def of(paths: list[bytes], documents: np.ndarray, leaves: np.ndarray, sources: np.ndarray, counts: np.ndarray) -> "Trie":
        """From sorted paths and counters in any order."""
        order = np.argsort(leaves, kind="stable")
        return Trie(paths, documents, np.bincount(leaves, minlength=len(paths)), sources[order], counts[order])

    def cut(self, low: int, high: int) -> "Trie":
        """The leaves from ``low`` to before ``high``."""
        a, b = self.ends[low], self.ends[high]
        return Trie(self.paths[low:high], self.documents[low:high], np.diff(self.ends[low : high + 1]), self.sources[a:b], self.counts[a:b])

    def page(self, names: list[str]) -> tuple[list[str], list[int], bytes]:
        """The names of its sources, their occurrences, and the trie as bytes."""
        used, own = np.unique(self.sources, return_inverse=True)
        sums = np.zeros(len(used), np.int64)
        np.add.at(sums, own, self.counts.astype(np.int64))
        shared, before = [], b""
        for path in self.paths:
            n, most = 0, min(len(path), len(before))
            while n < most and path[n] == before[n]:
                n += 1
            shared.append(n)
            before = path
        rest = [p[n:] for p, n in zip(self.paths, shared, strict=True)]
        lengths = np.fromiter(map(len, rest), np.int64, len(rest))
        data = _packed((np.array(shared, np.int64), lengths, self.documents, np.diff(self.ends), own, self.counts, np.frombuffer(b"".join(rest), np.uint8)))
        return [names[k] for k in used.tolist()], sums.tolist(), data

    @staticmethod
    def read(data: bytes) -> "Trie":
        shared, lengths, documents, fan, sources, counts, rest = _unpacked(data)
        rest, paths, path, at = rest.tobytes(), [], b"", 0
        for n, size in zip(shared.tolist(), lengths.tolist(), strict=True):
            path = path[:n] + rest[at : at + size]
            at += size
            paths.append(path)
        return Trie(paths, documents.astype(np.int64), fan, sources.astype(np.int64), counts.astype(np.int64))


def merge(tries: Iterable[tuple[list[str], Trie]], least: int) -> tuple[list[str], Trie]:
    """One trie of several, each with the names of its sources, without the leaves of fewer documents than ``least``."""
    leaf_of: dict[bytes, int] = {}
    name_of: dict[str, int] = {}
    leaves, documents, at, sources, counts = [], [], [], [], []
    for names, trie in tries:
        own = np.array([name_of.setdefault(n, len(name_of)) for n in names], np.int64)
        slots = np.fromiter((leaf_of.setdefault(p, len(leaf_of)) for p in trie.paths), np.int64, len(trie))
        leaves.append(slots)
        documents.append(trie.documents)
        at.append(np.repeat(slots, np.diff(trie.ends)))
        sources.append(own[trie.sources] if len(own) else trie.sources)
        counts.append(trie.counts)
    total = np.zeros(len(leaf_of), np.int64)
    for slots, n in zip(leaves, documents, strict=True):
        total[slots] += n  # a trie has each path once
    kept = sorted(p for p, k in leaf_of.items() if total[k] >= least)
    place = np.full(len(leaf_of), -1, np.int64)
    slots = np.fromiter((leaf_of[p] for p in kept), np.int64, len(kept))
    place[slots] = np.arange(len(kept))
    at, sources, counts = (np.concatenate(x) for x in (at, sources, counts))
    at = place[at]
    # counters of one leaf and source are added up
    cell, own = np.unique(at[at >= 0] * len(name_of) + sources[at >= 0], return_inverse=True)
    sums = np.zeros(len(cell), np.int64)
    np.add.at(sums, own, counts[at >= 0])
    width = max(1, len(name_of))
    return list(name_of), Trie(kept, total[slots], np.bincount(cell // width, minlength=len(kept)), cell % width, sums)


PAGES = "lang string, low binary, high binary, n long, names array<string>, sums array<long>, leaves binary"
_KINDS = (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary())
_NAMES = [x.split()[0] for x in PAGES.split(", ")]


def _pages(lang: str, names: list[str], trie: Trie, leaves: int) -> Iterator[tuple]:
    for low in range(0, len(trie), leaves):
        part = trie.cut(low, min(len(trie), low + leaves))
        yield lang, part.paths[0], part.paths[-1], len(part), *part.page(names)


def _batch(rows: list[tuple], kinds: tuple = _KINDS, names: list[str] = _NAMES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _counted(docs: DataFrame, s: Settings) -> DataFrame:
    """Pages of the tries of each partition; one without leaves names the sources of its language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        documents: dict[str, Counter] = defaultdict(Counter)

        def settle() -> Iterator[pa.RecordBatch]:
            for lang, by_source in counts.items():
                names, paths = list(by_source), sorted(documents[lang])
                place = dict(zip(paths, range(len(paths)), strict=True))
                leaves = np.fromiter((place[t] for c in by_source.values() for t in c), np.int64)
                values = np.fromiter((v for c in by_source.values() for v in c.values()), np.int64)
                sources = np.repeat(np.arange(len(names)), [len(c) for c in by_source.values()])
                held = np.fromiter((documents[lang][p] for p in paths), np.int64, len(paths))
                yield _batch([(lang, None, None, 0, names, [0] * len(names), b"")])
                for page in _pages(lang, names, Trie.of(paths, held, leaves, sources, values), s.page):
                    yield _batch([page])
            counts.clear()
            documents.clear()

        for batch in steps(batches):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                found = terms(text)
                counts[lang][source].update(found)
                documents[lang].update(set(found))
            if sum(len(c) for by_source in counts.values() for c in by_source.values()) > s.held:
                yield from settle()
        yield from settle()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(text("lang"), text("source"), text("text")).mapInArrow(run, PAGES)


def _bounds(pages: DataFrame, leaves_each: int) -> dict[str, list[bytes]]:
    """Prefixes at which each language is cut into ranges of about so many leaves; they decide who merges what, not the result."""
    full = pages.where("n > 0")
    leaves = full.agg(F.sum("n")).first()[0] or 0
    shuffled = F.xxhash64("lang", "low", "high", "n")
    lows = full.select("lang", F.substring("low", 1, PREFIX).alias("low"), shuffled.alias("h")).orderBy("h").limit(SAMPLED).collect()
    lows = sorted((r["lang"], bytes(r["low"])) for r in lows)
    each = max(1.0, len(lows) * leaves_each / max(1, leaves))
    out: dict[str, list[bytes]] = defaultdict(list)
    for k in range(1, int(len(lows) / each) + 1):
        lang, low = lows[min(len(lows) - 1, int(k * each))]
        if not out[lang] or out[lang][-1] < low:
            out[lang].append(low)
    return dict(out)


def _merged(pages: DataFrame, s: Settings) -> DataFrame:
    """Pages of merged tries, with the leaves of enough documents alone."""
    bounds = _bounds(pages, s.range)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, low, high, n, names, sums, leaves in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                edges = bounds.get(lang, [])
                first, last = bisect_right(edges, low), bisect_right(edges, high)
                if first == last:
                    rows.append((lang, low, high, n, names, sums, leaves, first))
                    continue
                trie = Trie.read(leaves)
                cuts = [0, *(bisect_left(trie.paths, e) for e in edges[first:last]), n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows += [(*page, first + k) for page in _pages(lang, names, trie.cut(a, b), s.page)] if a < b else []
            yield _batch(rows, (*_KINDS, pa.int32()), [*_NAMES, "range"])

    def meet(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        names, trie = merge(((n.as_py(), Trie.read(d.as_py())) for n, d in zip(table.column("names"), table.column("leaves"), strict=True)), s.least)
        rows = list(_pages(lang, names, trie, s.page))
        return pa.Table.from_batches([_batch(rows)] if rows else [], schema=pa.schema(list(zip(_NAMES, _KINDS, strict=True))))

    ranged = pages.where("n > 0").mapInArrow(split, f"{PAGES}, range int")
    return ranged.groupBy("lang", "range").applyInArrow(meet, PAGES)


def share(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(PARTS * counts / total), three digits at a time, so that no product is too large."""
    quotient, rest = np.zeros_like(counts), counts
    for _ in range(3):
        rest = rest * 1000
        quotient, rest = quotient * 1000 + rest // total, rest % total
    return quotient + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


FOUND = "part string, lang string, source string, item string, value long"


class _Language:
    """What a task has found in the leaves of one language."""

    def __init__(self, v: int, sources: list[str], sums: list[int], top: int, cells: int):
        self.each = max(1, cells // len(sources))
        self.sources, self.place, self.top = sources, {s: k for k, s in enumerate(sources)}, top
        n = np.array(sums, np.int64)
        self.totals = n + ADDED * v
        self.whole = int(n.sum()) + ADDED * v
        self.none = share(np.full(len(n), ADDED, np.int64), self.totals)
        #: By source: what its leaves add to its pairs beyond sources that lack both, and of that where the other source lacks the term.
        self.sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.best: dict[int, list[tuple[int, bytes]]] = {}

    def take(self, names: list[str], trie: Trie) -> None:
        own = np.array([self.place[n] for n in names], np.int64)[trie.sources]
        leaf = np.repeat(np.arange(len(trie)), np.diff(trie.ends))
        for low in range(0, len(trie), self.each):
            high = min(len(trie), low + self.each)
            a, b = trie.ends[low], trie.ends[high]
            rows, source, counts = leaf[a:b] - low, own[a:b], trie.counts[a:b]
            shares = np.repeat(self.none[None, :], high - low, axis=0)
            shares[rows, source] = share(counts + ADDED, self.totals[source])
            there = np.zeros(shares.shape, bool)
            there[rows, source] = True
            of_all = np.zeros(high - low, np.int64)
            np.add.at(of_all, rows, counts)
            q = share(of_all + ADDED, np.full(high - low, self.whole, np.int64))
            for s in np.unique(source).tolist():
                mine = np.flatnonzero(there[:, s])
                p = shares[mine, s]
                more = apart(p[:, None], shares[mine]) - apart(self.none[s], self.none)[None, :]
                if s not in self.sums:
                    self.sums[s] = np.zeros(len(self.sources), np.int64), np.zeros(len(self.sources), np.int64)
                self.sums[s][0][:] += more.sum(axis=0)
                self.sums[s][1][:] += np.where(there[mine], 0, more).sum(axis=0)
                over = np.flatnonzero(p > q[mine])
                value = apart(p[over], q[mine[over]])
                # leaves come in order, so a stable sort leaves ties in it
                best = np.argsort(-value, kind="stable")[: self.top]
                new = [(-int(value[k]), trie.paths[low + int(mine[over[k]])]) for k in best]
                self.best[s] = nsmallest(self.top, self.best.get(s, []) + new)

    def cells(self) -> int:
        return 2 * len(self.sums) * len(self.sources)

    def pairs(self, lang: str) -> Iterator[pa.RecordBatch]:
        names = np.array(self.sources, object)
        for s, (whole, alone) in self.sums.items():
            later, earlier = np.arange(s + 1, len(names)), np.arange(s)
            # a pair is named by its smaller source, whose row holds leaves of both
            for first, second, value in ((np.full(len(later), s), later, whole[later]), (earlier, np.full(len(earlier), s), alone[earlier])):
                some = np.flatnonzero(value)
                if len(some):
                    n = len(some)
                    yield _found(["pair"] * n, [lang] * n, names[first[some]].tolist(), names[second[some]].tolist(), value[some])
        self.sums.clear()

    def telling(self, lang: str) -> Iterator[pa.RecordBatch]:
        for s, best in self.best.items():
            if n := len(best):
                items = pa.array([t for _, t in best], pa.binary()).cast(pa.string())
                yield _found(["term"] * n, [lang] * n, [self.sources[s]] * n, items, np.array([-v for v, _ in best], np.int64))


def _found(*columns) -> pa.RecordBatch:
    kinds = (pa.string(),) * 4 + (pa.int64(),)
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in FOUND.split(", ")])


def _walked(kept: DataFrame, totals: DataFrame, groups: int, s: Settings) -> DataFrame:
    """Partial sums of pairs and a task's most telling terms, from (lang, names, leaves) and each language's totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, _Language] = {}
        for batch in batches:
            for k, lang in enumerate(batch.column(0).to_pylist()):
                if lang not in langs:
                    langs[lang] = _Language(*(batch.column(c)[k].as_py() for c in (3, 4, 5)), s.top, s.cells)
                langs[lang].take(batch.column(1)[k].as_py(), Trie.read(batch.column(2)[k].as_py()))
                if sum(x.cells() for x in langs.values()) > s.sums:
                    for name, found in langs.items():
                        yield from found.pairs(name)
        for name, found in langs.items():
            yield from found.pairs(name)
            yield from found.telling(name)

    pages = kept.select("lang", "names", "leaves")
    if groups <= s.sent_groups:
        joined = pages.join(F.broadcast(totals), "lang")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(s.salts - 1))).alias("salt")
        salted = pages.withColumn("salt", F.pmod(F.xxhash64("leaves"), F.lit(s.salts)).cast("int"))
        joined = salted.join(totals.select("*", salts), ["lang", "salt"])
    return joined.select("lang", "names", "leaves", "v", "sources", "ns").mapInArrow(run, FOUND)


def audit(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """lang, source, part, item, value and rank: how far sources lie apart, and each one's most telling terms.

    Part ``pair`` has each other source of the language, part ``term`` the terms
    that a source has more of than its language, ``top`` of them at most. Ranks
    count from 1 within source and part, larger values first, ties by the bytes
    of the item. ``docs`` needs text, lang and source; other columns are left
    out, whatever their names. Null and empty values are the same; repeated rows
    count each; a source without terms is paired with the others of its
    language, and a language with a single source has terms alone. Texts of any
    length count whole. No rows give no rows.
    """
    s = settings or Settings()
    pages = cut(_counted(docs, s))
    kept = cut(_merged(pages, s))
    groups = pages.where("n = 0").select("lang", F.explode("names").alias("source")).distinct()
    occurred = kept.select("lang", F.explode(F.arrays_zip("names", "sums")).alias("x")).groupBy("lang", F.col("x.names").alias("source")).agg(F.sum("x.sums").alias("n"))
    sizes = kept.groupBy("lang").agg(F.sum("n").alias("v"))
    found = groups.join(occurred, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    # a row for each source, which the pairs outnumber
    listed = found.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("x"))
    totals = cut(listed.join(sizes, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.col("x.source").alias("sources"), F.col("x.n").alias("ns")))
    count = totals.agg(F.sum(F.size("sources"))).first()[0] or 0
    walked = cut(_walked(kept, totals, count, s))
    # what each pair would differ by if both lacked every term
    one = totals.select("lang", "v", F.posexplode("sources").alias("k", "source"), "sources", "ns")
    two = one.select("lang", "v", "k", "source", F.col("ns")[F.col("k")].alias("n"), F.posexplode(F.arrays_zip("sources", "ns")).alias("j", "x")).where("j > k")
    p, q = (F.expr(f"IF(v = 0, 0L, 1L + {PARTS * ADDED}L div ({n} + {ADDED}L * v))") for n in ("n", "x.ns"))
    based = two.select("lang", "source", F.col("x.sources").alias("item"), "v", p.alias("p"), q.alias("q"))
    based = based.select("lang", "source", "item", F.expr("IF(v = 0, 0L, v * ((p - q) * (p - q) div (p + q)))").alias("value"))
    sums = based.unionByName(walked.where("part = 'pair'").drop("part")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = sums.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    every = pairs.unionByName(walked.where("part = 'term'").select("lang", "source", "part", "item", "value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = every.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= s.top))


#: DuckDB SQL of ``audit`` over documents.
AUDIT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents),
t AS (SELECT k, lang, source, translate(unnest(found), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
w AS (SELECT lang, term, count(*)::HUGEINT AS c FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS c FROM t JOIN w ON t.lang = w.lang AND t.term = w.term GROUP BY t.lang, t.source, t.term),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM w GROUP BY lang),
n AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM o GROUP BY lang, source),
p AS (SELECT g.lang, g.source, w.term, coalesce(o.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(o.c, 0) + 2)) // (coalesce(n.n, 0) + 2 * v.v) AS p,
  1 + (1000000000::HUGEINT * (w.c + 2)) // (v.n + 2 * v.v) AS q FROM g JOIN w ON g.lang = w.lang JOIN v ON v.lang = g.lang
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = w.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM e)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
