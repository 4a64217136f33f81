"""Packing of token streams into fixed windows by multiway differencing.

Each partition tokenises its documents, gives every full window of a long
document a sequence of its own, and balances what remains over near-equal
windows with the Karmarkar-Karp method: partial partitions are merged two at
a time, the widest first, largest sums against smallest. The number of windows
rises whenever the fullest one would exceed the capacity. No row leaves its
partition, so there is no shuffle and a lost task is simply run again.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, steps, utf8
from .merges import PairTable
from .parts import Parts

#: Parts that a worker remembers.
CACHE_PARTS = 100_000
#: Documents that are encoded together.
STEP_ROWS = 512
#: The first letter beyond those whose normal form is plain.
PLAIN = "\u0250"
#: Windows of one balanced batch: it closes between these, where the fill suits.
MIN_WINDOWS, MAX_WINDOWS = 96, 128

_encoders: dict[str, "WordEncoder"] = {}


def _borders() -> tuple[np.ndarray, np.ndarray]:
    """Where the tokenizer's splitter always cuts between two bytes of lower-case text, and which bytes are white space.

    Letters go together, digits alone, and other marks of ASCII together.
    Bytes beyond ASCII and apostrophes may belong to either side, so nothing is
    cut there but before digits.
    """
    byte = np.arange(256)
    white = np.isin(byte, [*b" \t\n\v\f\r"])
    digit = (byte >= 48) & (byte <= 57)
    letter = (byte >= 97) & (byte <= 122)
    loose = (byte >= 128) | (byte == 39)
    mark = ~(white | digit | letter | loose)
    one, two = (lambda m: m[:, None]), (lambda m: m[None, :])
    cut = one(white) != two(white)
    cut |= two(digit) & ~one(white)
    cut |= one(digit) & ~two(byte >= 128)
    cut |= one(letter) & two(mark) | one(mark) & two(letter)
    return cut.ravel(), white


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    The tokenizer's splitter never joins characters over ASCII white space, so
    a text's ids are those of its parts in turn, and equal parts are encoded once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        first, second = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        # a merged pair drops no characters: only its right part carries the end of the word
        result = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.pairs = PairTable(first, second, np.arange(len(pairs)), result)
        letters = self._byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int32)
        self.last = np.array([vocab[x + suffix] for x in letters], np.int32)
        self.parts = Parts(*_borders(), self._learn, CACHE_PARTS)

    def _byte_letters(self) -> list[str]:
        """The letter that stands for each byte in the vocabulary: itself if printable, else the next free one."""
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        other = iter(range(0x100, 0x200))
        return [chr(b) if b in plain else chr(next(other)) for b in range(256)]

    def _splits(self, part: bytes) -> list[bytes]:
        """The tokenizer's splits of a part with characters beyond ASCII or apostrophes; the common shape needs no call."""
        text = part.decode()
        if text.isalpha() and max(text) < PLAIN and len(lower := text.lower()) == len(text):
            return [lower.encode()]
        text = self.tokenizer.normalizer.normalize_str(text)
        return [text[slice(*span)].encode() for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """Ids of parts that are new."""
        splits = [[p] if p.isascii() and b"'" not in p else self._splits(p) for p in new]
        flat = list(chain.from_iterable(splits))
        lengths = np.fromiter(map(len, flat), np.int64, len(flat))
        spelled = np.frombuffer(b"".join(flat), np.uint8)
        symbols = self.inner[spelled]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[spelled[ends]]
        ids = self.pairs.segment(symbols, lengths)
        if len(flat) == len(new):
            return ids
        each = iter(ids)
        return [b"".join(islice(each, len(s))) for s in splits]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text; one that may hold a control string goes through the tokenizer whole."""
        whole = {i for i, t in enumerate(texts) if b"<|" in t}
        # lower case first, as the tokenizer does
        out = self.parts.encode([b"" if i in whole else t.lower() for i, t in enumerate(texts)])
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(texts[i].decode(), add_special_tokens=False).ids, np.uint32)
        return out


def encoder(path: str) -> WordEncoder:
    """The worker's encoder; workers are reused, so its cache outlives a task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Partition ``sizes`` into ``windows`` lists of positions with near-equal sums."""
    n = len(sizes)
    if windows <= 1:
        return [list(range(n))]
    left, right = np.full(2 * n, -1, np.int64), np.full(2 * n, -1, np.int64)
    free = n  # nodes below n are items, others are unions
    heap: list[tuple[int, int]] = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def take() -> tuple[np.ndarray, np.ndarray]:
        _, k = heapq.heappop(heap)
        if k in parts:
            return parts.pop(k)
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[0], nodes[0] = sizes[k], k
        return sums, nodes

    made = n
    while len(heap) > 1:
        sums, a = take()
        other, b = take()
        sums, b = sums + other[::-1], b[::-1]
        nodes = np.where(a >= 0, a, b)
        both = np.flatnonzero((a >= 0) & (b >= 0))
        if len(both):
            fresh = slice(free, free + len(both))
            left[fresh], right[fresh] = a[both], b[both]
            nodes[both] = np.arange(free, free + len(both))
            free += len(both)
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        parts[made] = sums, nodes[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), made))
        made += 1
    _, nodes = take()
    out = []
    for node in nodes.tolist():
        items, stack = [], [node]
        while stack:
            k = stack.pop()
            if k >= n:
                stack += (int(left[k]), int(right[k]))
            elif k >= 0:
                items.append(k)
        out.append(sorted(items))
    return out


def balance(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; their number rises until all hold."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        out = [w for w in difference(sizes, windows) if w]
        if all(sum(sizes[i] for i in w) <= capacity for w in out):
            return out
        windows += 1


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
)


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 1,
    longest: int = 512,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of token sequences: one row a piece, with its place in document and sequence.

    ``docs`` needs doc_id and text; other columns are left out, whatever their
    names. A null text is an empty one, and every document ends with
    ``end_id``, so an empty one still makes a piece of one id. Repeated rows are
    packed each on its own. A document of any length is cut: whole windows stand
    alone, the rest goes in pieces of at most ``longest`` ids. No rows give no
    rows. ``sequence_id`` holds the partition in its upper bits. With
    ``with_ids`` false the column ids is null.
    """
    if not 0 < longest <= capacity:
        raise ValueError("longest must lie between 1 and capacity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        pending: list[tuple] = []
        held = 0

        def emit(batch: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*(r[:7] for r in batch), strict=True))
            arrays = [pa.array(c, pa.int64()) for c in columns]
            if with_ids:
                ids = np.frombuffer(b"".join(r[7] for r in batch), "<u4").astype(np.int32)
                ends = np.cumsum([0, *(r[2] for r in batch)]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)))
            else:
                arrays.append(pa.nulls(len(batch), pa.list_(pa.int32())))
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def settle() -> None:
            nonlocal sequence, held
            for window in balance([p[2] for p in pending], capacity):
                offset = 0
                for i in window:
                    doc, start, length, total, ids = pending[i]
                    rows.append((doc, start, length, zlib.crc32(ids), total, sequence, offset, ids))
                    offset += length
                sequence += 1
            pending.clear()
            held = 0

        for batch in steps(batches, STEP_ROWS):
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.encode(utf8(batch.column(1))), strict=True):
                ids = ids.tobytes() + end
                total = len(ids) // 4
                start = 0
                while total - start >= capacity:
                    piece = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc, start, capacity, zlib.crc32(piece), total, sequence, 0, piece))
                    sequence += 1
                    start += capacity
                while start < total:
                    length = min(longest, total - start)
                    pending.append((doc, start, length, total, ids[4 * start : 4 * (start + length)]))
                    held += length
                    start += length
                # close where rounding up leaves a little slack, so that one attempt is enough
                if held >= MIN_WINDOWS * capacity and (
                    0.2 <= held / capacity % 1 <= 0.5 or held >= MAX_WINDOWS * capacity
                ):
                    settle()
            if len(rows) >= 4096:
                yield emit(rows)
                rows.clear()
        if pending:
            settle()
        if rows:
            yield emit(rows)
        rows.clear()
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, SCHEMA
    )
