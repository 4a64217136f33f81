"""SentencePiece encoding and decoding that keeps byte offsets.

Normalisation takes the longest prefix that the model's compiled character map
knows, at every place, and records for every byte it writes the byte of the
source it came from. Pieces are found by byte-pair merging on the normalised
text and are projected through that record to spans of the original bytes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, utf8
from .merges import PairTable
from .parts import Parts

SPACE = "▁"
_SPACE = SPACE.encode()
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: A byte that no UTF-8 text holds, for the mark of a space.
_SHORT = b"\xff"
#: Parts that a worker remembers.
CACHE_PARTS = 200_000


class CharacterMap:
    """The compiled character map: a double array of prefixes, then the replacements.

    The blob starts with the size of the array in bytes; the array's units are
    32-bit integers, and replacements end with a zero byte.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]
        #: First bytes of what is mapped.
        self.leads = [bytes([b]) for b in range(1, 256) if self._starts(b)]

    def _starts(self, byte: int) -> bool:
        if not self.units:
            return False
        node = (self.units[0] >> 10) << ((self.units[0] & 512) >> 6) ^ byte
        return node < len(self.units) and self.units[node] & 0x800000FF == byte

    def longest(self, text: bytes, start: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix at ``start`` and what replaces it."""
        units = self.units
        if not units:
            return None

        def below(unit: int) -> int:  # where a unit's children start
            return (unit >> 10) << ((unit & 512) >> 6)

        node, found = below(units[0]), None
        for at in range(start, len(text)):
            byte = text[at]
            node ^= byte
            if node >= len(units) or units[node] & 0x800000FF != byte:
                break
            unit = units[node]
            node ^= below(unit)
            if unit & 256:
                value = units[node] & 0x7FFFFFFF
                found = at + 1 - start, self.texts[value : self.texts.index(b"\0", value)]
        return found


class PieceCodec:
    """Encoder and decoder of one BPE model."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        if spec.trainer_spec.model_type != 2:
            raise ValueError("only BPE models are read")
        if not spec.trainer_spec.byte_fallback:
            raise ValueError("only models with byte fallback are read")
        if any(p.type == USER for p in spec.pieces) or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("user-defined symbols and space suffixes are not read")
        norm = spec.normalizer_spec
        self.dummy, self.strip, self.escape = norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces
        self.map = CharacterMap(norm.precompiled_charsmap)
        self.pieces = [p.piece for p in spec.pieces]
        self.types = [p.type for p in spec.pieces]
        self.vocab = {p.piece: i for i, p in enumerate(spec.pieces) if p.type in (NORMAL, UNUSED)}
        self.unknown = self.types.index(UNKNOWN)
        self.end = next((i for i, p in enumerate(spec.pieces) if p.type == CONTROL and p.piece == "</s>"), None)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.value = {i: b for b, i in self.bytes.items()}
        self.sizes = np.array([1 if t == BYTE else len(p.encode()) for p, t in zip(self.pieces, self.types, strict=True)], np.int64)
        self.surface = np.array([self._said(i) for i in range(len(self.pieces))], object)
        #: Ids that need a look at their neighbours; bytes of ASCII always stand for themselves.
        self.odd = np.array([t in (UNKNOWN, CONTROL) or t == BYTE and self.value[i] >= 0x80 for i, t in enumerate(self.types)])
        self._pair_table(spec)
        self.parts = Parts(self._borders(), np.zeros(256, bool), self._learn, CACHE_PARTS)

    def _said(self, i: int) -> str:
        if self.types[i] == BYTE:
            return chr(self.value[i])
        return {UNKNOWN: " ⁇ ", CONTROL: ""}.get(self.types[i], self.pieces[i].replace(SPACE, " "))

    def _pair_table(self, spec) -> None:
        """Symbols are pieces or single characters; equal scores count as one rank, the leftmost pair first."""
        known = len(self.pieces)
        # a character that is no piece has a symbol of its own beyond the pieces
        self.symbols = known + np.arange(0x110000, dtype=np.int32)
        for p, i in self.vocab.items():
            if len(p) == 1:
                self.symbols[ord(p)] = i

        def symbol(part: str) -> int | None:
            return int(self.symbols[ord(part)]) if len(part) == 1 else self.vocab.get(part)

        first, second, scores, result = [], [], [], []
        for piece, i in self.vocab.items():
            for at in range(1, len(piece)):
                a, b = symbol(piece[:at]), symbol(piece[at:])
                if a is not None and b is not None:
                    first.append(a), second.append(b), scores.append(-spec.pieces[i].score), result.append(i)
        rank_of = {s: k for k, s in enumerate(sorted(set(scores)))}
        ranks = np.array([rank_of[s] for s in scores], np.int64)
        self.pairs = PairTable(np.array(first, np.int64), np.array(second, np.int64), ranks, np.array(result, np.int32))

    # Normalisation

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and for the end the source byte it stands for."""
        if self.strip or any(lead in text for lead in self.map.leads):
            return self._walk(text)
        # no prefix of the text is mapped anywhere: it stands for itself, and one array records all of it
        source = np.arange(len(text) + 1, dtype=np.int32)
        raw = np.frombuffer(text, np.uint8)
        if not text.isascii():
            source[:-1][raw & 0xC0 == 0x80] = 0
            np.maximum.accumulate(source, out=source)  # every byte of a character stands for its first
        if self.escape:
            source = np.repeat(source, np.append(np.where(raw == 32, len(_SPACE), 1), 1))
        space = _SPACE if self.escape else b" "
        plain = text.replace(b" ", space)
        if self.dummy and text:
            return space + plain, np.concatenate([np.zeros(len(space), np.int32), source])
        return plain, source

    def _walk(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Takes the longest mapped prefix at every place, or else one character."""
        space = _SPACE if self.escape else b" "
        parts: list[bytes] = []
        origin: list[int] = []

        def put(piece: bytes, at: int) -> None:
            parts.append(piece)
            origin.extend([at] * len(piece))

        at = 0
        units = []
        while at < len(text):
            found = self.map.longest(text, at)
            if found is None:
                lead = text[at]
                length = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                found = length, text[at : at + length]
            units.append((at, found[1]))
            at += found[0]
        first = 0
        if self.strip:
            while first < len(units) and units[first][1] in (b" ", b""):
                first += 1
        if self.dummy and first < len(units):
            put(space, units[first][0])
        after_space = self.strip
        for at, piece in units[first:]:
            if self.strip and after_space:
                piece = piece.lstrip(b" ")
            if piece:
                put(piece.replace(b" ", space), at)
                after_space = self.strip and piece.endswith(b" ")
        joined = b"".join(parts)
        end = len(text)
        if self.strip:
            while joined.endswith(space):
                end = origin[len(joined) - len(space)]
                joined = joined[: -len(space)]
                del origin[len(joined) :]
        return joined, np.array([*origin, end], np.int32)

    # Merging

    def _merge(self, text: str, lengths: np.ndarray) -> list[bytes]:
        """Ids of words as little-endian 32-bit integers; unknown characters fall back to bytes.

        ``text`` holds the words one after the other, ``lengths`` their numbers of characters.
        """
        known = len(self.pieces)
        merged = self.pairs.segment(self.symbols[np.frombuffer(text.encode("utf-32-le"), "<u4")], lengths)
        flat = np.frombuffer(b"".join(merged), "<u4")
        odd = np.flatnonzero(flat >= known)
        ends = np.cumsum(np.fromiter(map(len, merged), np.int64, len(merged))) // 4
        for row in np.unique(np.searchsorted(ends, odd, "right")).tolist():
            each = [[s] if s < known else [self.bytes[b] for b in chr(s - known).encode()] for s in np.frombuffer(merged[row], "<u4").tolist()]
            merged[row] = np.array([s for e in each for s in e], "<u4").tobytes()
        return merged

    def _learn(self, parts: list[bytes]) -> list[bytes]:
        """Ids of parts that are new."""
        texts = [p.replace(_SHORT, _SPACE).decode() for p in parts]
        return self._merge("".join(texts), np.fromiter(map(len, texts), np.int64, len(texts)))

    def _borders(self) -> np.ndarray:
        """Between which neighbouring bytes nothing is merged, as no piece has their characters side by side."""
        joined = {pair for p in self.vocab for pair in zip(p, p[1:], strict=False)}
        cut = np.zeros((256, 256), bool)
        names = [(b, chr(b)) for b in range(128)] + [(_SHORT[0], SPACE)]
        for a, x in names:
            for b, y in names:
                cut[a, b] = (x, y) not in joined
        if not any(y == SPACE and x != SPACE for x, y in joined):
            cut[128 : _SHORT[0], _SHORT[0]] = True
        return cut.ravel()

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids, and the start and end byte of each in the source; a space that was added has no bytes."""
        normal = [self.normalise(t) for t in texts]
        out = []
        for (_, origin), ids in zip(normal, self.parts.encode([plain.replace(_SPACE, _SHORT) for plain, _ in normal]), strict=True):
            ids = ids.astype(np.int32)
            at = origin[np.concatenate([[0], np.cumsum(self.sizes[ids])])]
            out.append((ids, at[:-1], at[1:]))
        return out

    # Decoding

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: control ids say nothing, runs of byte ids are read as UTF-8, bad bytes become U+FFFD."""
        parts = self.surface[ids].tolist()
        first = 0
        if (odd := np.flatnonzero(self.odd[ids])).size:
            listed = ids[odd].tolist()
            first = next((k for k, i in enumerate(ids.tolist()) if self.types[i] != CONTROL), len(parts))
            run = bytearray()
            for k, (at, i) in enumerate(zip(odd.tolist(), listed, strict=True)):
                if self.types[i] != BYTE:
                    continue  # its surface stands
                run.append(self.value[i])
                parts[at] = ""
                if k + 1 == len(odd) or odd[k + 1] != at + 1 or self.types[listed[k + 1]] != BYTE:
                    parts[at] = _read(bytes(run))
                    run.clear()
        if first < len(parts) and (self.dummy or self.strip) and self.types[ids[first]] in (NORMAL, UNUSED):
            parts[first] = parts[first].removeprefix(" ")
        return "".join(parts)


def _read(run: bytes) -> str:
    """UTF-8 with one replacement character for each byte that doesn't fit."""
    out, at = [], 0
    while at < len(run):
        lead = run[at]
        size = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 1
        try:
            out.append(run[at : at + size].decode())
            at += size
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=4)
def codec(path: str) -> PieceCodec:
    """The worker's codec; workers are reused, so its cache outlives a task."""
    with open(path, "rb") as f:
        return PieceCodec(f.read())


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*values, np.zeros(0)]).astype(kind.to_pandas_dtype())))


CODED = "doc_id long, ids array<int>, span_start array<int>, span_end array<int>"


def _coded(known: PieceCodec, texts: list[bytes], add_end: bool) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Ids, starts and ends of each text, with the end id."""
    rows = known.encode(texts)
    if not add_end:
        return tuple([r[k] for r in rows] for k in range(3))
    sizes = [len(t) for t in texts]
    return [np.append(r[0], known.end) for r in rows], *([np.append(r[k], n) for r, n in zip(rows, sizes, strict=True)] for k in (1, 2))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, model: str, add_end: bool = True) -> DataFrame:
    """doc_id, ids, and the arrays span_start and span_end of original byte offsets.

    Needs doc_id and text; other columns are left out, whatever their names. A
    null text is an empty one, whose ids are the end id alone; the end id spans
    no bytes. Repeated rows are encoded each on its own; no rows give no rows.
    Texts of any length are encoded whole.
    """

    def make():
        known = codec(model)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = _coded(known, utf8(batch.column(1)), add_end)
            return pa.RecordBatch.from_arrays([batch.column(0), *[_lists(x, pa.int32()) for x in lists]], names=["doc_id", "ids", "span_start", "span_end"])

        return step

    return per_batch(_named(docs), make, CODED)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and their text; null ids give an empty text. Other columns are left out."""

    def make():
        known = codec(model)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column(1)
            flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *[len(x) if x.is_valid else 0 for x in ids]])
            texts = [known.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

        return step

    return per_batch(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), make, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, model: str, add_end: bool = True) -> DataFrame:
    """What ``encode`` gives, and in the column text what ``decode`` makes of the ids.

    Both in one pass, so that a task needs one worker with one codec.
    """

    def make():
        known = codec(model)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = _coded(known, utf8(batch.column(1)), add_end)
            texts = pa.array([known.decode(ids) for ids in lists[0]], pa.string())
            columns = [batch.column(0), *[_lists(x, pa.int32()) for x in lists], texts]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "span_start", "span_end", "text"])

        return step

    return per_batch(_named(docs), make, f"{CODED}, text string")
