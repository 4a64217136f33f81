"""Byte-pair merging of many words at once, in numpy.

A word is a column of symbol ids. In every round each column merges its
leftmost pair of lowest rank, which is the order the greedy method takes, so
the result is the one a merge loop over single words gives.
"""

from __future__ import annotations

import numpy as np

#: Widths of the matrices that words are dealt into.
WIDTHS = (4, 6, 8, 10, 12, 14, 20, 32, 64)
#: Symbols of one matrix at most, but for a single long word.
CELLS = 250_000
NONE = np.iinfo(np.int32).max
#: Odd factor that spreads the keys of pairs over the table.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Ranks of symbol pairs and the symbols they become; pairs of equal rank go leftmost first."""

    def __init__(self, first: np.ndarray, second: np.ndarray, rank: np.ndarray, result: np.ndarray):
        # the largest symbol stands for all that are in no pair
        self.base = int(max(first.max(initial=0), second.max(initial=0))) + 2
        keys = first.astype(np.int64) * self.base + second
        bits = max(4, (8 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int64)
        self.ranks, self.results = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        self.top = int(rank.max(initial=0))
        waiting = np.arange(len(keys))
        at = self._slot(keys)
        while len(waiting):  # each free slot takes one of the keys that want it, the others go one slot on
            free = waiting[self.slots[at[waiting]] < 0]
            self.slots[at[free]] = keys[free]
            waiting = waiting[self.slots[at[waiting]] != keys[waiting]]
            at[waiting] = at[waiting] + 1 & self.mask
        self.ranks[at], self.results[at] = rank, result

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * SPREAD >> self.shift).view(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each pair of two flat arrays stands in the table, and whether it does."""
        other = self.base - 1
        keys = np.minimum(first, other).astype(np.int64) * self.base + np.minimum(second, other)
        at = self._slot(keys)
        got = self.slots[at]
        found = got == keys
        going = np.flatnonzero(~found & (got >= 0))
        while len(going):
            at[going] = at[going] + 1 & self.mask
            got = self.slots[at[going]]
            hit = got == keys[going]
            found[going[hit]] = True
            going = going[~hit & (got >= 0)]
        return at, found

    def segment(self, flat: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The merged symbols of each word as little-endian unsigned 32-bit integers.

        ``flat`` holds the symbols of all words in turn, ``lengths`` their numbers.
        """
        out: list[bytes] = [b""] * len(lengths)
        starts = np.cumsum(lengths) - lengths
        low = 0
        for width in (*WIDTHS, int(lengths.max(initial=0))):
            rows = np.flatnonzero((lengths > low) & (lengths <= width))
            low = max(low, width)
            for some in np.array_split(rows, -(-len(rows) * width // CELLS)) if len(rows) else []:
                self._fill(out, flat, starts[some], some, lengths[some], width)
        return out

    def _fill(self, out: list[bytes], flat: np.ndarray, starts: np.ndarray, rows: np.ndarray, lengths: np.ndarray, width: int) -> None:
        n, bits = len(rows), (width + 1).bit_length()
        # a key is a rank with its place below it, so the least one names the leftmost pair of lowest rank
        kind = np.int32 if (self.top + 1) << bits < NONE else np.int64
        none = np.iinfo(kind).max
        # a row above and one below stand for the ends of the word; merged-away symbols are NONE, too
        symbols = np.full((width + 2, n), NONE, np.int32)
        places = np.arange(width)[:, None]
        inside = places < lengths
        symbols[1:-1][inside] = flat[(starts + places)[inside]]
        before, after = (np.repeat(np.arange(width + 2, dtype=np.int32)[:, None] + k, n, axis=1) for k in (-1, 1))
        keys = np.full((width + 2, n), none, kind)

        def ranked(first: np.ndarray, second: np.ndarray, place: np.ndarray) -> np.ndarray:
            at, found = self.find(first, second)
            return np.where(found, self.ranks[at].astype(kind) << bits | place, none)

        keys[1:-2] = ranked(symbols[1:-2].ravel(), symbols[2:-1].ravel(), np.repeat(np.arange(1, width, dtype=kind), n)).reshape(width - 1, n)
        final, place = symbols, np.arange(n)
        while True:
            best = keys.min(axis=0)
            live = np.flatnonzero(best < none)
            if not len(live):
                break
            if len(live) < len(best) // 2:
                if symbols is not final:
                    final[:, place] = symbols
                place = place[live]
                symbols, keys, before, after = (np.take(m, live, axis=1) for m in (symbols, keys, before, after))
                best, live = best[live], np.arange(len(live))
            step = symbols.shape[1]
            s, k, b, a = (m.reshape(-1) for m in (symbols, keys, before, after))
            where = (best[live] & (1 << bits) - 1).astype(np.int64)
            one = where * step + live
            two = a[one] * step + live
            at, _ = self.find(s[one], s[two])
            merged = self.results[at]
            s[one], s[two], k[two] = merged, NONE, none
            last = a[two]
            a[one] = last
            last = last * step + live
            b[last] = where
            k[one] = ranked(merged, s[last], where.astype(kind))
            prior = b[one].astype(np.int64)
            first = prior * step + live
            k[first] = ranked(s[first], merged, prior.astype(kind))
        if symbols is not final:
            final[:, place] = symbols
        final = final.T
        kept = final < NONE
        data = final[kept].astype("<u4").tobytes()
        start = 0
        for i, size in zip(rows.tolist(), (4 * kept.sum(axis=1)).tolist(), strict=True):
            out[i] = data[start : start + size]
            start += size
