"""Fill-in-middle transformation by overlapping-chunk decomposition.

A text's units are its runs of ASCII letters and its other characters one by
one. Whether a unit starts at a byte depends on that byte and the one before
it, so texts are cut into chunks that overlap by one byte, and each chunk's
starts are counted without a look at the others. Prefix sums over the chunks
tell how many units a text has and which chunk holds each of its two cuts; only
those chunks are scanned a second time. No row leaves its partition, so there
is no shuffle and a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_batch, utf8

# What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_BYTE = np.arange(256)
_LETTER = (_BYTE >= 65) & (_BYTE <= 90) | (_BYTE >= 97) & (_BYTE <= 122)
_INNER = (_BYTE >= 128) & (_BYTE < 192)


@dataclass(frozen=True)
class Settings:
    #: Stands before the decimal id in what decides a document's cuts and form.
    salt: str = "1:"
    #: Of 100 documents so many are transformed, and of 100 of those so many get the suffix first.
    transformed: int = 90
    suffix_first: int = 20
    #: Bytes of a chunk, and of the chunks whose starts are found at once.
    chunk: int = 1 << 14
    stride: int = 1 << 20


def starts(data: np.ndarray, before: int) -> np.ndarray:
    """Where a unit starts in the UTF-8 bytes; ``before`` bytes at the front belong to the chunk before."""
    letter = _LETTER[data]
    found = ~_INNER[data]
    found[1:] &= ~(letter[1:] & letter[:-1])
    return found[before:]


class Units:
    """Numbers of units of the texts that lie one after another in ``data``, and the places of single ones."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, chunk: int, stride: int):
        self.data, self.offsets = data, offsets
        sizes = np.diff(offsets)
        pieces = -(-sizes // chunk)
        self.head = np.cumsum(pieces) - pieces
        owner = np.repeat(np.arange(len(sizes)), pieces)
        inside = np.arange(len(owner)) - self.head[owner]
        self.low = offsets[:-1][owner] + inside * chunk
        self.high = np.minimum(self.low + chunk, offsets[1:][owner])
        self.first = inside == 0
        counts = np.zeros(len(owner), np.int64)
        at = 0
        while at < len(owner):
            to = max(at + 1, int(np.searchsorted(self.high, self.low[at] + stride, "right")))
            low = self.low[at]
            found = self._scan(low, self.high[to - 1], False)
            found[self.low[at:to][self.first[at:to]] - low] = True
            counts[at:to] = np.add.reduceat(found, self.low[at:to] - low, dtype=np.int64)
            at = to
        self.total = np.concatenate([[0], np.cumsum(counts)])
        #: Units before each text, and of it.
        self.base = self.total[self.head]
        self.count = self.total[self.head + pieces] - self.base
        self._known: tuple[int, np.ndarray] = (-1, np.zeros(0, np.int64))

    def _scan(self, low: int, high: int, first: bool) -> np.ndarray:
        before = 0 if first or low == 0 else 1
        return starts(self.data[low - before : high], before)

    def place(self, text: int, rank: int) -> int:
        """The byte in its text where unit ``rank`` (from 0) starts; the text's end beyond the last."""
        if rank >= self.count[text]:
            return int(self.offsets[text + 1] - self.offsets[text])
        wanted = int(self.base[text]) + rank
        owner = int(np.searchsorted(self.total, wanted, "right")) - 1
        if self._known[0] != owner:
            found = self._scan(self.low[owner], self.high[owner], bool(self.first[owner]))
            self._known = owner, self.low[owner] + np.flatnonzero(found)
        return int(self._known[1][wanted - self.total[owner]] - self.offsets[text])


def numbers(salt: str, doc_id: int | None) -> list[int]:
    """Four numbers that an id decides; a missing id counts as no digits."""
    digest = hashlib.sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))


def transform(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, number of units, form, characters of prefix and middle, and the transformed text of each row.

    The form is ``plain`` (the text itself, no counts), ``psm`` (prefix, suffix,
    middle) or ``spm`` (suffix, prefix, middle). ``docs`` needs doc_id and text;
    other columns are left out, whatever their names. A null text is an empty
    one; empty texts and those that hold a mark stay plain. Repeated rows are
    transformed each on its own, alike if id and text are. Texts of any length
    are cut whole. No rows give no rows.
    """
    s = settings or Settings()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = utf8(batch.column(1))
            offsets = np.cumsum([0, *map(len, texts)])
            units = Units(np.frombuffer(b"".join(texts), np.uint8), offsets, s.chunk, s.stride)
            rows = []
            for k, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), texts, strict=True)):
                one, two, three, four = numbers(s.salt, doc)
                n = int(units.count[k])
                if not text or three % 100 >= s.transformed or any(m in text for m in MARKS):
                    rows.append((doc, n, "plain", None, None, text))
                    continue
                ranks = sorted((one % (n + 1), two % (n + 1)))
                a, b = (units.place(k, r) for r in ranks)
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                if four % 100 < s.suffix_first:
                    form, out = "spm", (MARKS[1], suffix, MARKS[0], prefix, MARKS[2], middle)
                else:
                    form, out = "psm", (MARKS[0], prefix, MARKS[1], suffix, MARKS[2], middle)
                rows.append((doc, n, form, len(prefix.decode()), len(middle.decode()), b"".join(out)))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=False)] + [pa.array(columns[5], pa.binary()).cast(pa.string())]
            return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCHEMA.split(", ")])

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_batch(rows, make, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that a transformed one was made from.

    The text holds no mark and no mark begins inside another, so the first of
    each is the one that was put there.
    """
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    body = F.substring(head, 4, 1 << 30)
    one, two = (lambda m: F.substring_index(body, m, 1)), (lambda m: F.substring_index(body, m, -1))
    psm = F.concat(one(SUFFIX), middle, two(SUFFIX))
    spm = F.concat(two(PREFIX), middle, one(PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


#: DuckDB SQL of the query's digests over documents.
FIM_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, [('0x' || h[8 * k + 1 : 8 * k + 8])::BIGINT FOR k IN range(4)] AS r FROM d),
c AS (SELECT *, len(units)::BIGINT AS n, least(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS a, greatest(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 90 THEN 'plain'
  WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
