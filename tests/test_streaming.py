"""Two runs over one checkpoint: the second gives what is new alone."""

import json

from threadmill.operators import stability, triggers
from threadmill.plans import fixtures
from threadmill.streaming import monitor


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    keys = ("chat_url", "index", "role", "text")
    (folder / name).write_text("".join(json.dumps(dict(zip(keys, r, strict=True))) + "\n" for r in rows))


def test_triggers_once(spark, tmp_path):
    folder = tmp_path / "in"

    def run():
        stream = monitor.trigger_stream(monitor.landed(spark, str(folder)), triggers.Patterns(), "p")
        monitor.run_once(monitor.append_json(stream, str(tmp_path / "out"), str(tmp_path / "check")))
        return sorted((r["chat_url"], r["message_index"]) for r in spark.read.json(str(tmp_path / "out")).collect())

    land(folder, "1.json", [("a", 0, "user", "архитектор"), ("a", 1, "user", "нет"), ("a", 0, "user", "архитектор")])
    assert run() == [("a", 0)]
    land(folder, "2.json", [("a", 0, "user", "архитектор"), ("b", 3, "user", "Я архитектор")])
    assert run() == [("a", 0), ("b", 3)]


def test_marks_are_kept(spark, tmp_path):
    folder = tmp_path / "in"

    def run(tail, name):
        stream = monitor.new_messages(monitor.landed(spark, str(folder)), tail, first=None)
        monitor.run_once(monitor.append_json(stream, str(tmp_path / name), str(tmp_path / f"{name}-check")))
        return sorted(r["index"] for r in spark.read.schema("chat_url string, index long").json(str(tmp_path / name)).collect())

    land(folder, "1.json", [("a", i, "user", "x") for i in range(2)])
    assert run(None, "all") == [0, 1] and run(3, "some") == [0, 1]
    land(folder, "2.json", [("a", i, "user", "x") for i in range(8)])
    assert run(None, "all") == list(range(8)) and run(3, "some") == [0, 1, 5, 6, 7]


def test_first_sight_reads_the_last_messages(spark, tmp_path):
    land(tmp_path / "in", "1.json", [("a", i, "user", "x") for i in range(9)] + [("b", 0, "user", "y")])
    stream = monitor.new_messages(monitor.landed(spark, str(tmp_path / "in")))
    monitor.run_once(monitor.append_json(stream, str(tmp_path / "out"), str(tmp_path / "check")))
    got = spark.read.schema("chat_url string, index long").json(str(tmp_path / "out")).collect()
    assert sorted((r["chat_url"], r["index"]) for r in got) == [("a", i) for i in range(4, 9)] + [("b", 0)]


def test_a_sent_text_is_used_once_over_batches(spark, tmp_path):
    sent = spark.createDataFrame([("a", "mine")], "chat_url string, text string")
    out, types = str(tmp_path / "out"), []
    for k in range(3):
        land(tmp_path / "in", f"{k}.json", [("a", k, "user", "mine"), ("a", k, "user", "mine")] if k < 2 else [("a", k, None, "mine")])
        stream = monitor.new_messages(monitor.landed(spark, str(tmp_path / "in")))
        monitor.run_once(monitor.watch(stream, sent, out, str(tmp_path / "check")))
        types.append([(r["type"], r["new_count"]) for r in monitor.drain(spark, out, k - 1)[0].collect()])
    assert types == [[("new_messages", 1)], [("external_message", 1)], [("new_messages", 1)]]


def test_snapshots_are_read_back(spark, tmp_path):
    from threadmill.sources import documents

    schema = "url string, title string, project string, last_seen_count long, last_checked_at double"
    old = spark.createDataFrame([("a", "A", "", 1, 0.0), ("b", "B", "p", 2, 1.5)], schema)
    monitor.snapshot(old, str(tmp_path / "s"), 1)
    monitor.snapshot(old.where("url = 'a'").withColumn("last_seen_count", old.last_seen_count + 8), str(tmp_path / "s"), 2)
    assert [tuple(r) for r in monitor.latest(spark, str(tmp_path / "s"), schema).collect()] == [("a", "A", "", 9, 0.0)]
    # as one document, and merged with what was known
    read = documents.chat_states(documents.states_document(monitor.latest(spark, str(tmp_path / "s"), schema)), known=old)
    assert sorted((r["url"], r["last_seen_count"]) for r in read.collect()) == [("a", 9), ("b", 2)]


def test_start_and_stop(spark, tmp_path):
    land(tmp_path / "in", "1.json", [("a", 0, "user", "x")])
    assert (monitor.pause(), monitor.pause(False), monitor.pause(False, 5, 2)) == (3, 6, 5)
    query = monitor.keep_running(monitor.append_json(monitor.landed(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")), active_seconds=1)
    query.processAllAvailable()
    assert monitor.stop(query) == "stopped" and monitor.stop(query) == "not_running"
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_a_silent_key_times_out(spark, tmp_path):
    kind = "key string, poll_no long, elapsed_ms long, generating boolean, assistant_count long, pre_count long, text string"
    spark.createDataFrame([("k", 1, 100, False, 2, 1, "half")], kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    writer = monitor.append_json(monitor.stable_responses(stream, longest=600), str(tmp_path / "out"), str(tmp_path / "check"))
    query = writer.trigger(processingTime="200 milliseconds").start()
    try:
        import time

        for _ in range(60):
            time.sleep(0.5)
            if (tmp_path / "out").exists() and spark.read.schema(monitor.STABLE).json(str(tmp_path / "out")).count():
                break
    finally:
        query.stop()
    assert [tuple(r) for r in spark.read.schema(monitor.STABLE).json(str(tmp_path / "out")).collect()] == [("k", "timeout_partial", "half", 1)]


def test_watch_and_drain(spark, tmp_path):
    folder = tmp_path / "in"
    sent = spark.createDataFrame([("a", "mine")], "chat_url string, text string")
    out = str(tmp_path / "out")

    def run():
        stream = monitor.new_messages(monitor.landed(spark, str(folder)))
        monitor.run_once(monitor.watch(stream, sent, out, str(tmp_path / "check")))

    land(folder, "1.json", [("a", 0, "user", "mine"), ("a", 1, "assistant", "yes")])
    run()
    events, last = monitor.drain(spark, out)
    assert [(r["type"], r["new_count"]) for r in events.collect()] == [("new_messages", 2)]
    land(folder, "2.json", [("a", 2, "user", "not mine")])
    run()
    events, last = monitor.drain(spark, out, last)
    assert [(r["type"], r["total_count"]) for r in events.collect()] == [("external_message", 3)]
    assert monitor.drain(spark, out, last)[0].count() == 0


def test_stability_stream_equals_batch(spark, tmp_path):
    polls = fixtures.rows(spark, fixtures.POLLS)
    for half in (0, 1):
        polls.where(f"(poll_no > 2) = {bool(half)}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(polls.schema).parquet(str(tmp_path / "in"))
        monitor.run_once(monitor.append_json(monitor.stable_responses(stream, clock=False), str(tmp_path / "out"), str(tmp_path / "check")))
    got = {(r["key"], r["status"], r["response"], r["poll_no"]) for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got == {tuple(r[c] for c in ("key", "status", "response", "poll_no")) for r in stability.outcomes(polls).collect()}
