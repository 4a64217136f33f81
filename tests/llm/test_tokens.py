"""Packing and piece coding against the libraries and by exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from threadmill.llm import packing, pieces
from threadmill.llm.queries import tokenizer_path

pytest.importorskip("tokenizers")
pytest.importorskip("sentencepiece")

ODD = [
    "",
    "   ",
    " a  b ",
    "▁x ▁▁ y",
    "a\x00b\x1cc d\x85e",
    "日本語。テスト 👩‍👩‍👧",
    "é́ Á İstanbul ﬁ ǅ Σίσυφος ΟΔΟΣ",
    "<|endoftext|> <|ENDOFTEXT|> <s></s><unk> <0x41>",
    "don't I'LL 123,456. x., the%%% OF!!",
    "x" * 3000 + " ab" * 5,
    "\U0010ffff�",
]


def encoder():
    return packing.WordEncoder(tokenizer_path("word_bpe_49k.json"))


def test_words_equal_the_tokenizer():
    e = encoder()
    got = [np.frombuffer(x, "<u4").tolist() for x in e.encode([t.encode() for t in ODD])]
    assert got == [x.ids for x in e.tokenizer.encode_batch(ODD, add_special_tokens=False)]


@pytest.mark.parametrize("windows", [1, 2, 7])
def test_differencing_places_each_item_once(windows):
    rng = random.Random(windows)
    sizes = [rng.randint(1, 512) for _ in range(100)]
    parts = packing.difference(sizes, windows)
    assert sorted(i for p in parts for i in p) == list(range(100))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) - min(sums) <= 8


def test_windows_rise_until_all_hold():
    assert len(packing.balance([6, 6, 6], 10)) == 3
    assert all(sum([5, 5, 5, 5][i] for i in w) <= 10 for w in packing.balance([5, 5, 5, 5], 10))
    assert packing.balance([], 10) == []


def test_pack_holds_every_id_once(spark):
    texts = [*ODD, "word " * 5000, None, None]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (0, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string").repartition(3)
    got = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), capacity=128, longest=32).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 128
    for _, p in got.sort_values("offset").groupby("sequence_id"):
        assert p.offset.tolist() == (p.length.cumsum() - p.length).tolist()
    for i, t in enumerate(texts):
        want = [*encoder().tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        p = got[got.doc_id == i].sort_values("start")
        if i:  # row 0 is there twice
            assert [x for ids in p.ids for x in ids] == want
            assert p.start.tolist() == (p.length.cumsum() - p.length).tolist()
            assert set(p.doc_tokens) == {len(want)}
        assert all(c == zlib.crc32(np.array(ids, "<u4").tobytes()) for c, ids in zip(p.ids_crc32, p.ids))
    assert len(got[got.doc_id == 0]) == 2
    assert packing.pack(docs.limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = pieces.codec(path)
    coded = codec.encode([t.encode() for t in ODD])
    assert [x.tolist() for x, _, _ in coded] == library.encode(ODD)
    assert [codec.decode(x) for x, _, _ in coded] == [library.decode(x.tolist()) for x, _, _ in coded]
    for t, (found, start, end) in zip(ODD, coded):
        want = library.encode(t, return_type="proto").pieces
        assert list(zip(found.tolist(), start.tolist(), end.tolist())) == [(p.id, p.begin, p.end) for p in want]
    docs = spark.createDataFrame([*enumerate(ODD), (99, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pieces.decode(pieces.encode(docs, path), path).collect()}
    assert rows[99]["ids"] == [2] and rows[99]["text"] == ""
    assert all(rows[i]["text"] == library.decode(library.encode(t)) for i, t in enumerate(ODD))
    extra = docs.withColumn("ids", docs.doc_id).withColumn("span_end", docs.text)
    for r in pieces.round_trip(extra, path).collect():
        size = len((ODD[r["doc_id"]] if r["doc_id"] < 99 else "").encode())
        assert (r["ids"], r["text"]) == (rows[r["doc_id"]]["ids"], rows[r["doc_id"]]["text"])
        assert len(r["ids"]) == len(r["span_start"]) == len(r["span_end"])
        assert sum(r["span_end"]) - sum(r["span_start"]) == size == r["span_end"][-1]
    assert pieces.round_trip(docs.limit(0), path).count() == 0


def test_spans_of_whole_texts_equal_the_library(data):
    import pyarrow.parquet as pq
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library, codec = sentencepiece.SentencePieceProcessor(model_file=path), pieces.codec(path)
    texts = [t or "" for t in pq.read_table(f"{data}/documents.parquet")["text"].to_pylist()]
    for t, (ids, start, end) in zip(texts, codec.encode([t.encode() for t in texts])):
        want = library.encode(t, return_type="proto").pieces
        assert list(zip(ids.tolist(), start.tolist(), end.tolist())) == [(p.id, p.begin, p.end) for p in want]


def test_bytes_that_are_no_text():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library, codec = sentencepiece.SentencePieceProcessor(model_file=path), pieces.codec(path)
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.choice([rng.randint(3, 258), rng.randint(3, 258), rng.randint(259, 31999), rng.randint(0, 2)]) for _ in range(rng.randint(1, 9))]
        assert codec.decode(np.array(ids)) == library.decode(ids), ids


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "nfkc"])
@pytest.mark.parametrize("strip", [True, False])
def test_character_maps(rule, strip):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    made = sentencepiece.SentencePieceNormalizer(rule_name=rule, remove_extra_whitespaces=strip, add_dummy_prefix=True, escape_whitespaces=True)
    spec = proto.ModelProto()
    spec.ParseFromString(made.serialized_model_proto())
    codec = object.__new__(pieces.PieceCodec)
    codec.dummy, codec.strip, codec.escape, codec.map = True, strip, True, pieces.CharacterMap(spec.normalizer_spec.precompiled_charsmap)
    for t in ["plain é", "ＡＢＣ　ﬁ ①  x ", "  ㌔ é É ß ẛ̣ ", "a​b  c\x01 ", "", "　　", "Ｈｅｌｌｏ！ ½ ﷺ"]:
        plain, origin = codec.normalise(t.encode())
        assert plain.decode() == made.normalize(t)
        assert len(origin) == len(plain) + 1 and (np.diff(origin) >= 0).all()


def test_query_digests(spark, data):
    from threadmill.llm.queries import queries
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = queries()["op6_pieces"](spark, data).toPandas().set_index("doc_id")
    for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_eos=True)
        mine = got.loc[r["doc_id"]]
        assert mine.n_tokens == len(ids) and mine.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert mine.spanned_bytes == len((r["text"] or "").encode())
        assert mine.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_packed_query(spark, data):
    """The registered query's rows, against the tokenizer itself."""
    from threadmill.llm.queries import queries

    got = queries()["op4_packing"](spark, data).toPandas().sort_values(["doc_id", "start"])
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    tokenizer = encoder().tokenizer
    ids = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for k, t in texts.items()}
    assert set(got.doc_id) == set(texts)
    for doc, pieces in got.groupby("doc_id"):
        assert pieces.start.tolist() == (pieces.length.cumsum() - pieces.length).tolist()
        assert set(pieces.doc_tokens) == {pieces.length.sum()} == {len(ids[doc])}
        for p in pieces.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[doc][p.start : p.start + p.length], "<u4").tobytes())
    for _, pieces in got.sort_values("offset").groupby("sequence_id"):
        assert pieces.offset.tolist() == (pieces.length.cumsum() - pieces.length).tolist() and pieces.length.sum() <= 2048
    fill = got.groupby("sequence_id").length.sum()
    assert got.length.sum() / sum(2048 if n & (n - 1) else n for n in fill.tolist()) > 0.97


def test_packing_encodes_in_little_memory():
    """A worker that lives on beside others holds tens of megabytes for a step, whatever the batch."""
    import tracemalloc

    import pyarrow as pa

    from threadmill.llm.common import steps, utf8

    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(500)) for _ in range(2048)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    tokens = packing.WordEncoder(tokenizer_path("word_bpe_49k.json"))
    tracemalloc.start()
    try:
        for some in steps([batch], packing.STEP_ROWS):
            tokens.encode(utf8(some.column(0)))
        assert tracemalloc.get_traced_memory()[1] < 150e6
    finally:
        tracemalloc.stop()
