"""Keyed state: live sends, restarts from marks, bounded memory, status of a running query."""

import json

import pytest
from pyspark.sql import functions as F

from threadmill.operators import incremental, triggers
from threadmill.sources import messages
from threadmill.streaming import counts, monitor, runs, state

SENT = "chat_url string, text string"


def land(folder, name, rows, keys=("chat_url", "index", "role", "text")):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(dict(zip(keys, r, strict=True))) + "\n" for r in rows))


def events_of(spark, folder, after=-1):
    found, last = monitor.drain(spark, str(folder), after)
    return sorted((r["chat_url"], r["type"], [m["index"] for m in r["messages"]], r["total_count"]) for r in found.collect()), last


# Live sends


def watch(spark, tmp_path, compat=False):
    sent = spark.readStream.schema(SENT).json(str(tmp_path / "sent"))
    monitor.run_once(monitor.watch(monitor.landed(spark, str(tmp_path / "seen")), sent, str(tmp_path / "out"), str(tmp_path / "check"), compat))


def test_a_text_sent_after_the_start_accounts_for_one_message(spark, tmp_path):
    (tmp_path / "sent").mkdir()
    land(tmp_path / "seen", "1.json", [("a", 0, "user", "mine"), ("a", 1, "assistant", "yes")])
    watch(spark, tmp_path)
    got, last = events_of(spark, tmp_path / "out")
    assert got == [("a", "external_message", [0, 1], 2)]
    # sent later, seen later still: once
    land(tmp_path / "sent", "1.json", [("a", "mine"), ("b", "mine")], ("chat_url", "text"))
    watch(spark, tmp_path)
    assert events_of(spark, tmp_path / "out", last)[0] == []
    land(tmp_path / "seen", "2.json", [("a", 2, "user", "mine")])
    watch(spark, tmp_path)
    got, last = events_of(spark, tmp_path / "out", last)
    assert got == [("a", "new_messages", [2], 3)]
    land(tmp_path / "seen", "3.json", [("a", 3, "user", "mine"), ("b", 0, "user", "other")])
    watch(spark, tmp_path)
    got, last = events_of(spark, tmp_path / "out", last)
    assert got == [("a", "external_message", [3], 4), ("b", "external_message", [0], 1)]
    assert [tuple(r)[0::2] for r in state.live_sent(spark, str(tmp_path / "check")).collect()] == [("b", 1)]
    assert sorted(map(tuple, state.live_marks(spark, str(tmp_path / "check"), "mark").collect())) == [("a", 4), ("b", 1)]


def test_sent_and_seen_in_one_batch(spark, tmp_path):
    long = "x" * 600
    land(tmp_path / "sent", "1.json", [("a", "mine"), ("a", "mine"), ("a", long), ("a", None)], ("chat_url", "text"))
    land(tmp_path / "seen", "1.json", [("a", 0, "user", "mine"), ("a", 0, "user", "mine"), ("a", 1, "user", "mine"), ("a", 2, "user", long), ("a", 3, "user", None), ("a", 4, None, "zzz")])
    watch(spark, tmp_path)
    got, last = events_of(spark, tmp_path / "out")
    assert got == [("a", "new_messages", [0, 1, 2, 3, 4], 5)]
    assert state.live_sent(spark, str(tmp_path / "check")).count() == 0
    # what is below the mark is not new, whatever it says
    land(tmp_path / "seen", "2.json", [("a", 1, "user", "edited")])
    watch(spark, tmp_path)
    assert events_of(spark, tmp_path / "out", last)[0] == []


def test_compat_cuts_what_is_seen_before_it_is_hashed(spark, tmp_path):
    land(tmp_path / "sent", "1.json", [("a", "x" * 501), ("b", "x" * 500)], ("chat_url", "text"))
    land(tmp_path / "seen", "1.json", [("a", 0, "user", "x" * 501), ("b", 0, "user", "x" * 501)])
    watch(spark, tmp_path, compat=True)
    assert [e[:2] for e in events_of(spark, tmp_path / "out")[0]] == [("a", "external_message"), ("b", "new_messages")]


# Restart from stored marks


def test_a_new_checkpoint_begins_with_marks(spark, tmp_path):
    land(tmp_path / "in", "1.json", [("a", i, "user", "x") for i in range(20)] + [("b", i, "user", "y") for i in range(20)] + [("c", i, "user", "z") for i in range(4)] + [("d", i, "user", "z") for i in range(9)])
    marks = spark.createDataFrame([("a", 7), ("a", 3), ("b", 0), ("c", 9), (None, 1), ("gone", 4), ("e", None)], "chat_url string, last_seen_count long")

    def run(name, **more):
        stream = state.resumed_messages(monitor.landed(spark, str(tmp_path / "in")), marks, **more)
        monitor.run_once(monitor.append_json(stream, str(tmp_path / name), str(tmp_path / f"{name}-check")))
        got = {}
        for r in monitor.read_json(spark, str(tmp_path / name), "chat_url string, index long").collect():
            got.setdefault(r["chat_url"], []).append(r["index"])
        return {k: sorted(v) for k, v in got.items()}

    # exactly from the mark to the count; a mark of zero is none, and a higher one than the count stays
    assert run("out") == {"a": list(range(7, 20)), "b": list(range(15, 20)), "d": list(range(4, 9))}
    saved = sorted(map(tuple, state.live_marks(spark, str(tmp_path / "out-check")).collect()))
    assert saved == [("a", 20), ("b", 20), ("c", 9), ("d", 9), ("gone", 4)]
    land(tmp_path / "in", "2.json", [("a", 20, "user", "new"), ("c", 8, "user", "z"), ("c", 9, "user", "z"), ("gone", 4, "user", "back")])
    assert run("out") == {"a": list(range(7, 21)), "b": list(range(15, 20)), "c": [9], "d": list(range(4, 9)), "gone": [4]}
    # a snapshot of a live query starts another one
    path = monitor.snapshot(state.live_marks(spark, str(tmp_path / "out-check")), str(tmp_path / "snap"), 1)
    marks = spark.read.schema("chat_url string, last_seen_count long").json(path)
    land(tmp_path / "in", "3.json", [("b", 20, "user", "only this")])
    assert run("again") == {"b": [20]}
    assert run("tail", tail=2) == {"b": [20]}


# Bounded memory of keys


def keyed(spark, tmp_path, cap, buckets=1, **more):
    schema = "chat_url string, message_index long, key string"
    rows = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    out = state.recent_once(rows, cap, buckets, **more)
    monitor.run_once(monitor.append_json(out, str(tmp_path / "out"), str(tmp_path / "check")))
    return sorted(r["key"] for r in monitor.read_json(spark, str(tmp_path / "out"), schema).collect())


def land_keys(tmp_path, name, numbers):
    land(tmp_path / "in", name, [("a", i, f"k{i:04}") for i in numbers], ("chat_url", "message_index", "key"))


def test_keys_stay_at_the_cap_and_the_newest_are_kept(spark, tmp_path):
    def kept():
        return sorted(r["key"] for r in state.live_keys(spark, str(tmp_path / "check")).collect())

    for k in range(2):  # ten caps in all
        land_keys(tmp_path, f"{k}.json", range(150 * k, 150 * k + 150))
        assert len(keyed(spark, tmp_path, 30)) == 150 * k + 150
        assert kept() == [f"k{i:04}" for i in range(150 * k + 120, 150 * k + 150)]
    # kept ones are no longer new, others are again; the oldest makes room, and a sight refreshes a key
    land_keys(tmp_path, "again.json", [5, 275])
    assert len(keyed(spark, tmp_path, 30)) == 301
    assert kept() == ["k0005"] + [f"k{i:04}" for i in range(271, 300)]
    land_keys(tmp_path, "more.json", range(1000, 1028))
    keyed(spark, tmp_path, 30)
    assert kept() == ["k0005", "k0275"] + [f"k{i:04}" for i in range(1000, 1028)]


def test_keys_in_buckets_and_known_ones(spark, tmp_path):
    land_keys(tmp_path, "1.json", range(200))
    known = spark.createDataFrame([(f"k{i:04}", float(i)) for i in range(10)] + [(None, 1.0)], "key string, first_seen double")
    assert keyed(spark, tmp_path, 40, 4, known=known) == [f"k{i:04}" for i in range(10, 200)]
    held = state.live_keys(spark, str(tmp_path / "check"))
    assert held.count() <= 40 and held.where(F.col("key") < "k0010").count() <= 10
    with pytest.raises(ValueError):
        state.recent_once(known, 2, 3)


def test_keys_expire(spark, tmp_path):
    """By the clock, so the query runs on: one that waits for a clock never comes to an end by itself."""
    import time

    schema = "chat_url string, message_index long, key string"
    land_keys(tmp_path, "1.json", [1, 2])
    rows = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    out = monitor.append_json(state.recent_once(rows, 10, ttl_seconds=3), str(tmp_path / "out"), str(tmp_path / "check"))
    query = out.trigger(processingTime="200 milliseconds").start()

    def got():
        return sorted(r["key"] for r in monitor.read_json(spark, str(tmp_path / "out"), schema).collect())

    try:
        wait(lambda: got() == ["k0001", "k0002"])
        time.sleep(4)
        land_keys(tmp_path, "2.json", [1])
        wait(lambda: got() == ["k0001", "k0001", "k0002"])
    finally:
        query.stop()


def test_throttle_over_batches(spark, tmp_path):
    from threadmill.operators import throttle

    checks = [("a", t) for t in (0.0, 6.0, 12.0, 18.0, 24.0, 24.0)] + [("b", t) for t in (0.0, 9.999, 10.0)] + [(None, 1.0)]
    for k, part in enumerate((checks[:3] + checks[6:8], checks[3:6] + checks[8:])):
        land(tmp_path / "in", f"{k}.json", part, ("chat_url", "ts"))
        stream = spark.readStream.schema("chat_url string, ts double").json(str(tmp_path / "in"))
        monitor.run_once(monitor.append_json(state.accepted(stream), str(tmp_path / "out"), str(tmp_path / "check")))
    got = sorted(map(tuple, monitor.read_json(spark, str(tmp_path / "out"), "chat_url string, ts double").collect()))
    assert got == [("a", 0.0), ("a", 12.0), ("a", 24.0), ("b", 0.0), ("b", 10.0)]
    assert got == sorted(map(tuple, throttle.accepted(spark.createDataFrame(checks, "chat_url string, ts double")).collect()))


def test_triggers_of_new_messages_over_two_kinds_of_state(spark, tmp_path):
    """Marks feed triggers, and both are read from the checkpoint."""
    land(tmp_path / "in", "1.json", [("a", i, "user", "архитектор") for i in range(8)])
    marks = spark.createDataFrame([("a", 6)], "chat_url string, last_seen_count long")
    stream = state.resumed_messages(monitor.landed(spark, str(tmp_path / "in")), marks)
    found = monitor.trigger_stream(stream, triggers.Patterns(), "p")
    monitor.run_once(monitor.logged(found, str(tmp_path / "out"), str(tmp_path / "check")))
    got = monitor.read_json(spark, str(tmp_path / "out"), "message_index long, key string").collect()
    assert sorted(r["message_index"] for r in got) == [6, 7]
    ids = {r["operatorName"]: r["operatorId"] for r in spark.read.format("state-metadata").load(str(tmp_path / "check")).select("operatorId", "operatorName").collect()}
    assert len(ids) in (1, 2)
    found = [sorted(r["key"] for r in state.live_keys(spark, str(tmp_path / "check"), k).collect()) for k in range(2) if k_holds(spark, tmp_path, k)]
    assert found == [sorted(r["key"] for r in got)]


def k_holds(spark, tmp_path, k):
    try:
        state.live_keys(spark, str(tmp_path / "check"), k).schema
        return True
    except Exception:
        return False


# Runs and status


def test_a_start_clears_queue_and_counters_but_not_what_was_handled(spark, tmp_path):
    looks = runs.Looks()
    spark.streams.addListener(looks)
    try:
        out, check = str(tmp_path / "out"), str(tmp_path / "check")

        def begin(running=None):
            found = monitor.trigger_stream(monitor.landed(spark, str(tmp_path / "in")), triggers.Patterns(), "p")
            return runs.start(found, out, check, looks, active="a", running=running, seconds=0.2)

        land(tmp_path / "in", "1.json", [("a", 0, "user", "архитектор"), ("a", 1, "user", "нет"), ("b", 0, "user", "Я архитектор")])
        said, one = begin()
        assert said == "started" and begin(one) == ("already_running", one)
        one.query.processAllAvailable()
        wait(lambda: looks.count(one.query.runId).triggers == 2)
        keys = state.live_keys(spark, check)
        row = runs.full(spark, one, keys.select(F.substring_index("key", ":", 1).alias("chat_url")), keys).first()
        assert (row["running"], row["mode"], row["trigger_count"], row["pending_events"], row["processed_dedup_keys"], row["tracked_chats"], row["active_chat_url"]) == (True, "project_recent", 2, 2, 2, 2, "a")
        assert row["scan_count"] >= 1 and row["uptime_sec"] >= 0 and row["last_error"] is None and row["last_sync_at"] >= row["started_at"]
        told = runs.stop(one)
        assert (told["status"], told["total_triggers"]) == ("stopped", 2) and runs.stop(one)["status"] == "not_running"
        wait(lambda: not looks.count(one.query.runId).running)

        said, two = begin(one)
        assert said == "started" and two.epoch == one.epoch + 1
        row = runs.current(spark, two).first()
        assert row["trigger_count"] == 0 and two.queue(spark)[0].count() == 0 and one.queue(spark)[0].count() == 2
        # known keys stay known, new ones are counted for this start alone
        land(tmp_path / "in", "2.json", [("a", 0, "user", "архитектор"), ("c", 5, "user", "архитектор")])
        two.query.processAllAvailable()
        wait(lambda: looks.count(two.query.runId).triggers == 1)
        events, last = two.queue(spark)
        assert [(r["chat_url"], r["message_index"]) for r in events.collect()] == [("c", 5)] and two.queue(spark, last)[0].count() == 0
        runs.stop(two)
        assert [(r["epoch"], r["mode"]) for r in runs.epochs(spark, out).orderBy("epoch").collect()] == [(0, "project_recent"), (1, "project_recent")]
        with pytest.raises(ValueError):
            runs.start(monitor.landed(spark, str(tmp_path / "in")), out, check, looks, mode="none")
    finally:
        spark.streams.removeListener(looks)


def test_status_counts_more_keys_than_a_capped_memory_holds(spark, tmp_path):
    """The registered query against its SQL, with more triggers than the cap."""
    import duckdb

    from threadmill.plans import queries as plans

    n = triggers.CAP + 700
    rows = spark.range(n).select((F.col("id") % 900).alias("conv_id"), F.floor(F.col("id") / 900).alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("see the "), F.col("id")).alias("text"))
    path = str(tmp_path / "conversations.parquet")
    rows.write.parquet(path)
    got = [tuple(r) for r in plans.queries()["stream_status"](spark, str(tmp_path)).collect()]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert got == db.execute(plans.oracle_sql()["stream_status"]).fetchall() and got[0][2:6] == (n, n, n, 900)


def test_keys_that_are_all_kept(spark, tmp_path):
    schema = "chat_url string, message_index long, key string"
    known = spark.createDataFrame([("k0003",), (None,)], "key string")
    for name, keys in (("1.json", [1, 2, 3, 1]), ("2.json", [4, 1, 2, 5])):
        land_keys(tmp_path, name, keys)
        found = state.once(spark.readStream.schema(schema).json(str(tmp_path / "in")), known)
        monitor.run_once(monitor.append_json(found, str(tmp_path / "out"), str(tmp_path / "check")))
    got = sorted(r["key"] for r in monitor.read_json(spark, str(tmp_path / "out"), schema).collect())
    assert got == ["k0001", "k0002", "k0004", "k0005"] == sorted(r["key"] for r in state.live_once(spark, str(tmp_path / "check")).collect())
    with pytest.raises(ValueError):
        monitor.trigger_stream(monitor.landed(spark, str(tmp_path / "in")), triggers.Patterns(), cap=None, ttl_seconds=1)


def test_an_error_is_reported(spark, tmp_path):
    looks = runs.Looks()
    spark.streams.addListener(looks)
    try:
        land(tmp_path / "in", "1.json", [("a", 0, "user", "x")])
        broken = monitor.landed(spark, str(tmp_path / "in")).withColumn("text", F.raise_error(F.lit("lost page")).cast("string"))
        _, run = runs.start(broken, str(tmp_path / "out"), str(tmp_path / "check"), looks, seconds=0.2)
        wait(lambda: not run.query.isActive)
        wait(lambda: looks.count(run.query.runId).last_error is not None)
        row = runs.current(spark, run).first()
        assert not row["running"] and "lost page" in row["last_error"] and row["last_error_at"] is not None
    finally:
        spark.streams.removeListener(looks)


def wait(until, seconds=60):
    import time

    end = time.time() + seconds
    while not until() and time.time() < end:
        time.sleep(0.2)
    assert until()


# Taking events


def test_consumers_lose_nothing(spark, tmp_path):
    folder = str(tmp_path / "events")
    assert monitor.drain(spark, folder)[0].count() == 0 and monitor.drain(spark, folder)[1] == -1
    (tmp_path / "events").mkdir()
    one, two = (monitor.Consumer(spark, folder, str(tmp_path / n), "n long") for n in ("one", "two"))
    assert one.take() is None and one.taken().count() == 0

    def arrive(number):
        spark.createDataFrame([(10 * number,), (10 * number + 1,)], "n long").write.json(f"{folder}/batch={number}")

    arrive(0)
    assert one.take() == 0
    arrive(1)
    # written, then lost before the cursor moves: no one sees it, and it is taken again with what came since
    assert one.write() == 1 and sorted(r["n"] for r in one.taken().collect()) == [0, 1]
    arrive(2)
    one = monitor.Consumer(spark, folder, str(tmp_path / "one"), "n long")
    assert one.take() == 2 and one.take() is None and two.take() == 2
    for consumer in (one, two):
        assert sorted(r["n"] for r in consumer.taken().collect()) == [0, 1, 10, 11, 20, 21]


# Counts that are kept up, and messages in buckets


def test_counts_are_kept_up(spark, tmp_path):
    said = []
    for k in range(7):
        new = [("abc"[j % 3], 10 * k + j, "assistant" if j % 2 else "user", "x") for j in range(k + 1)]
        said += new
        land(tmp_path / "in", f"{k}.json", new)
        writer = counts.maintain(monitor.landed(spark, str(tmp_path / "in")), str(tmp_path / "counts"), str(tmp_path / "check"), every=3)
        monitor.run_once(writer)
        wanted = messages.counts(spark.createDataFrame(said, messages.SCHEMA))
        assert sorted(map(tuple, counts.maintained(spark, str(tmp_path / "counts")).collect())) == sorted(map(tuple, wanted.collect()))
    assert sorted(p.name for p in (tmp_path / "counts" / "whole=true").iterdir()) == ["batch=2", "batch=5"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kept_counts_spare_a_scan(spark, data, tmp_path):
    said = messages.load(spark, data)
    messages.counts(said).write.parquet(str(tmp_path / "known"))
    known = spark.read.parquet(str(tmp_path / "known"))
    states = messages.counts(said).selectExpr("chat_url", "greatest(message_count - 3, 0) AS last_seen_count").where("chat_url % 4 > 0")
    states.write.parquet(str(tmp_path / "states"))
    states = spark.read.parquet(str(tmp_path / "states"))
    for read in (incremental.monotone, incremental.bounded, incremental.first_met, incremental.missed, incremental.marks):
        with_known, without = read(said, states, known=known), read(said, states)
        assert plan(with_known).count("conversations.parquet") < plan(without).count("conversations.parquet")
        assert sorted(map(tuple, with_known.collect())) == sorted(map(tuple, without.collect()))


def test_messages_in_buckets_need_no_shuffle(spark, data):
    name = "landed_messages"
    try:
        said = messages.load(spark, data)
        table = messages.land(said, name, buckets=4)
        assert sorted(map(repr, table.collect())) == sorted(map(repr, said.collect()))
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        states = spark.createDataFrame([("1", 2), ("3", 1)], "chat_url string, last_seen_count long")
        for wanted, got in ((messages.tail(said, 3), messages.tail(table, 3)), (incremental.missed(said, states), incremental.missed(table, F.broadcast(states))), (messages.counts(said), messages.counts(table))):
            text = plan(got)
            assert "Exchange hashpartitioning" not in text and "hashpartitioning" in plan(wanted)
            assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.select(got.columns).collect()))
        assert "GreaterThanOrEqual(index" in plan(messages.between(table, 1, 4))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sql(f"DROP TABLE IF EXISTS {name}")
