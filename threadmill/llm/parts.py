"""Texts cut into parts that no merge crosses, each distinct part encoded once.

Cutting, finding equal parts and putting the ids together are numpy steps over
all texts at once; Python sees each distinct part of a step alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Longest part whose bytes are hashed in numpy.
CHUNKED = 256
#: By how many bytes of a chunk count: its mask.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


def _chunks(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; ``raw`` ends with eight bytes that no part has."""
    return np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))


def distinct(joined: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One part for each distinct one, and for every part the number of the distinct one that equals it."""
    chunks = _chunks(np.frombuffer(joined, np.uint8))
    keys = lengths.astype(np.uint64) * MIX
    long = np.flatnonzero(lengths > CHUNKED)
    text = lambda k: joined[starts[k] : starts[k] + lengths[k]]
    for k in long.tolist():
        keys[k] = hash(text(k)) & (1 << 64) - 1
    rows, at = np.flatnonzero(lengths <= CHUNKED), 0
    while len(rows):
        left = lengths[rows] - at
        part = keys[rows] ^ chunks[starts[rows] + at] & MASKS[np.minimum(left, 8)]
        part *= MIX
        keys[rows] = part ^ part >> np.uint64(29)
        rows, at = rows[left > 8], at + 8
    _, first, number = np.unique(keys, return_index=True, return_inverse=True)
    # equal keys mean equal parts but by the rarest chance, which is looked for
    other = first[number]
    same = lengths == lengths[other]
    same[long] = [text(k) == text(other[k]) for k in long.tolist()]
    rows, at = np.flatnonzero(lengths <= CHUNKED), 0
    while len(rows):
        left = lengths[rows] - at
        mask = MASKS[np.minimum(left, 8)]
        same[rows] &= chunks[starts[rows] + at] & mask == chunks[starts[other[rows]] + at] & mask
        rows, at = rows[left > 8], at + 8
        rows = rows[same[rows]]
    if same.all():
        return first, number
    return np.arange(len(starts)), np.arange(len(starts))


class Parts:
    """Encodes texts part by part, with a bounded memory of parts.

    ``borders`` says for two neighbouring bytes (the first times 256 plus the
    second) whether a part ends between them; parts that start with a byte of
    ``left_out`` have no ids. ``learn`` gives the ids of new parts as
    little-endian unsigned 32-bit integers.
    """

    def __init__(self, borders: np.ndarray, left_out: np.ndarray, learn: Callable[[list[bytes]], list[bytes]], size: int, longest: int = 48):
        self.borders, self.left_out, self.learn, self.size, self.longest = borders, left_out, learn, size, longest
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        joined = b"".join([*texts, bytes(8)])
        raw = np.frombuffer(joined, np.uint8)[:-8]
        bounds = np.cumsum([0, *map(len, texts)])
        new = np.zeros(len(raw) + 1, bool)
        new[1:-1] = self.borders[raw[:-1].astype(np.uint16) << 8 | raw[1:]] if len(raw) else False
        new[bounds] = True
        starts = np.flatnonzero(new)
        starts, ends = starts[:-1], starts[1:]
        counted = ~self.left_out[raw[starts]]
        starts, ends = starts[counted], ends[counted]
        if not len(starts):
            return [np.zeros(0, np.uint32)] * len(texts)
        rows, number = distinct(joined, starts, ends - starts)
        ids = self._ids([joined[a:b] for a, b in zip(starts[rows].tolist(), ends[rows].tolist(), strict=True)])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        each = sizes[number]
        upto = np.cumsum(each)
        out = flat[np.repeat((np.cumsum(sizes) - sizes)[number] - (upto - each), each) + np.arange(upto[-1])]
        cuts = np.append(0, upto)[np.searchsorted(starts, bounds)]
        return [out[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        if len(self.known) > self.size:
            self.known.clear()
        ids = list(map(self.known.get, parts))
        fresh = [k for k, x in enumerate(ids) if x is None]
        if fresh:
            new = [parts[k] for k in fresh]
            for k, part, found in zip(fresh, new, self.learn(new), strict=True):
                ids[k] = found
                if len(part) <= self.longest:
                    self.known[part] = found
        return ids
