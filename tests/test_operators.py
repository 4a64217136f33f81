"""Cases derived by hand."""

import pytest

from threadmill.functions import text
from threadmill.operators import external, images, incremental, stability, throttle, triggers
from threadmill.plans import fixtures
from threadmill.sources import documents, messages
from pyspark.sql import functions as F

# Texts with whether they are a call and a reply.
TEXTS = [
    ("позови архитектора", True, False),
    ("Архитектору", True, False),
    ("вархитекторе", False, False),
    ("АРХИТЕКТОР", True, False),
    ("_архитектор", False, False),
    ("Я архитектор", True, True),
    ("[Я Архитектор] текст", True, True),
    ("привет\nЯ архитектор", True, True),
    ("привет\rЯ архитектор", True, False),
    ("привет Я архитектор", True, False),
    ("Я АРХИТЕКТОР", True, False),
    ("\xa0Я архитектор", True, True),
    ("Я архитекторы", True, True),
    ("это я архитектор", True, False),
    ("[ я  архитектор ]", True, True),
    ("нет", False, False),
]


def talk(spark, rows):
    return spark.createDataFrame(rows, messages.SCHEMA)


def test_patterns(spark):
    p = triggers.Patterns()
    frame = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(TEXTS)], "i int, text string")
    got = frame.select("i", p.is_call(F.col("text")).alias("c"), p.is_reply(F.col("text")).alias("r")).orderBy("i").collect()
    assert [(r["c"], r["r"]) for r in got] == [(c, r) for _, c, r in TEXTS]


def test_reply_goes_first_and_only_users_count(spark):
    rows = [("a", 0, "user", "Я архитектор"), ("a", 1, "assistant", "архитектор"), ("a", 2, "user", "\t\n\xa0"), ("a", 3, "user", None)]
    got = triggers.classify(talk(spark, rows), triggers.Patterns()).collect()
    assert [(r["index"], r["type"]) for r in got] == [(0, triggers.REPLY)]


def test_event_defaults_and_states(spark):
    rows = [("a", 0, "user", "архитектор"), ("b", 0, "user", "архитектор")]
    states = spark.createDataFrame([("a", "", ""), ("b", "P", "T")], "url string, project string, title string")
    got = {r["chat_url"]: r for r in triggers.events(talk(spark, rows), triggers.Patterns(), "main", states).collect()}
    assert (got["a"]["project"], got["b"]["project"], got["b"]["chat_title"]) == ("main", "P", "T")
    note = triggers.notices(triggers.events(talk(spark, rows), triggers.Patterns())).first()
    assert "untitled" in note["text"] and note["payload"].startswith("chat_id=&text=%F0%9F%94%94")


def test_blank(spark):
    rows = [(" \t\n",), ("\xa0",), ("",), (None,), (" x ",)]
    got = spark.createDataFrame(rows, "t string").select(text.is_blank(F.col("t")).alias("b"), text.strip(F.col("t")).alias("s")).collect()
    assert [r["b"] for r in got] == [True, True, True, True, False]
    assert got[4]["s"] == "x"


def test_tail_of_zero_is_all_but_listing_of_zero_is_none(spark):
    rows = talk(spark, [("a", i, "user", str(i)) for i in range(4)])
    assert messages.tail(rows, 0).count() == 4 and messages.tail(rows, -1).count() == 4
    assert messages.last(rows, 0).count() == 0
    assert sorted(r["index"] for r in messages.tail(rows, 2).collect()) == [2, 3]


def test_marks_that_fall_and_reads_that_lose(spark):
    rows = talk(spark, [("up", i, "user", "") for i in range(9)] + [("down", i, "user", "") for i in range(3)])
    states = spark.createDataFrame([("up", 1), ("down", 7)], "chat_url string, last_seen_count long")
    assert sorted(r["index"] for r in incremental.monotone(rows, states).collect()) == list(range(1, 9))
    assert sorted(r["index"] for r in incremental.bounded(rows, states).collect()) == [4, 5, 6, 7, 8]
    assert {r[0]: r[1] for r in incremental.marks(rows, states).collect()} == {"up": 9, "down": 7}
    assert {r[0]: r[1] for r in incremental.marks(rows, states, falling=True).collect()} == {"up": 9, "down": 3}
    assert incremental.first_met(rows, states).count() == 0


def test_sent_text_counts_once_and_long_ones(spark):
    long = "x" * 501
    said = talk(spark, [("a", 0, "user", "hi"), ("a", 1, "user", "hi"), ("a", 2, "user", long), ("a", 3, "assistant", "hi")])
    sent = spark.createDataFrame([("a", "hi"), ("a", long)], "chat_url string, text string")
    got = lambda compat: {r["index"]: r["external"] for r in external.mark_external(said, sent, compat).collect()}
    assert got(False) == {0: False, 1: True, 2: False, 3: False}
    assert got(True)[2] is True


def test_stability(spark):
    got = {r["key"]: (r["status"], r["response"], r["poll_no"]) for r in stability.outcomes(fixtures.rows(spark, fixtures.POLLS)).collect()}
    assert got == {
        "still": ("complete", "abc", 3),
        "pause": ("complete", "abc", 4),
        "grow": ("complete", "ab", 4),
        "empty": ("timeout_empty", "", 4),
        "old": ("timeout_partial", "part", 2),
        "both": ("complete", "z", 3),
    }


def test_throttle(spark):
    checks = spark.createDataFrame([("a", float(t)) for t in (0, 6, 12, 18, 24)] + [("a", None), (None, 1.0)], "chat_url string, ts double")
    assert [r["ts"] for r in throttle.accepted(checks).orderBy("ts").collect()] == [0.0, 12.0, 24.0]


@pytest.mark.parametrize(("i", "j", "src", "error"), [(0, 0, "one.png", None), (0, 1, "bg.png", None), (0, 2, None, "no_such_image"), (0, -1, None, "negative_index")])
def test_pick(spark, i, j, src, error):
    base = fixtures.rows(spark, fixtures.IMAGES).where("chat_url = 'a'")
    img = F.array(F.struct("src", F.lit("").alias("alt"), "width"))
    rows = images.with_images(base.select("chat_url", "index", "role", img.alias("imgs"), F.array("style").alias("bg_styles")))
    got = images.pick(rows, i, j).first()
    assert (got["src"], got["error"]) == (src, error)


def test_states_are_merged(spark):
    known = spark.createDataFrame([("u1", "old", "", 9, 0.0), ("u9", "kept", "", 1, 0.0)], "url string, title string, project string, last_seen_count long, last_checked_at double")
    got = {r["url"]: r for r in documents.chat_states(fixtures.rows(spark, fixtures.STATES_JSON), known=known).collect()}
    assert got["u1"]["title"] == "T" and got["u9"]["title"] == "kept" and got["u3"]["last_seen_count"] == 0
    again = documents.states_document(documents.chat_states(fixtures.rows(spark, fixtures.STATES_JSON)))
    assert documents.chat_states(again).count() == 3


def test_malformed_lines_are_skipped(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"chat_url": "a", "index": 0, "role": "", "text": "x"}\n{"chat_url": 7, "index": "no\n')
    got = messages.from_json_lines(spark, str(tmp_path)).collect()
    assert [(r["chat_url"], r["role"]) for r in got] == [("a", "unknown")]


def test_empty_tables(spark):
    none = talk(spark, [])
    states = spark.createDataFrame([], "chat_url string, last_seen_count long")
    assert messages.counts(none).count() == 0
    assert incremental.bounded(none, states).count() == 0
    assert triggers.events(none, triggers.Patterns()).count() == 0


def test_missing_roles_and_texts_stay(spark):
    from threadmill.operators import external

    said = spark.createDataFrame([("a", 0, None, "x"), ("a", 1, "user", None), ("a", 2, "user", None)], "chat_url string, index long, role string, text string")
    sent = spark.createDataFrame([("a", None)], "chat_url string, text string")
    got = {r["index"]: r["external"] for r in external.mark_external(said, sent).collect()}
    assert got == {0: False, 1: False, 2: True}


def test_throttle_walks_long_chats(spark):
    import random

    from threadmill.operators import throttle

    rng = random.Random(2)
    rows = [(c, rng.choice([rng.uniform(0, 5000), float(rng.randrange(0, 5000, 5))])) for c in "ab" for _ in range(3000)]
    want = []
    for chat in "ab":
        last = float("-inf")
        for ts in sorted(t for c, t in rows if c == chat):
            if ts - last >= 10.0:
                want.append((chat, ts))
                last = ts
    got = throttle.accepted(spark.createDataFrame([*rows, (None, 1.0), ("a", None)], "chat_url string, ts double"))
    assert sorted(tuple(r) for r in got.collect()) == want
    assert throttle.accepted(spark.createDataFrame([], "chat_url string, ts double")).count() == 0
