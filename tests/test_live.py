"""Streams whose lists change, removals, pacing, edits, monitoring, bounded history; the embedding hook."""

import glob
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.catalog import streams
from rivulet.operators import changes, enrich, greedy, horizon, words
from rivulet.schema import PROFILE, Options
from rivulet.session import scratch, settle
from rivulet.sources.lists import read_profiles, write_profiles
from rivulet.sources.sinks import exists, read_batches, read_one, write_batch
from rivulet.sources.topics import read_folder, write_folder, write_nowhere
from rivulet.streaming.changes import _order
from rivulet.streaming.control import STATE, blocklist_stream, changed, gather_stream, removal_stream, switch_of
from rivulet.streaming.delivery import deliver_stream
from rivulet.streaming.greedy import KEPT, WINDOW, History, curate_stream
from rivulet.streaming.monitor import Monitor, query_health, read_monitor
from rivulet.streaming.pacing import Pacer, paced_stream


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


# --- history horizon

def naive_greedy(sets, span):
    """Serial pass: a set is dropped when it overlaps a kept one among the last ``span``."""
    kept = []
    for i, s in enumerate(sets):
        clash = any(k for j, k in enumerate(kept) if i - j <= span and k and (
            len(s & sets[j]) / max(8, min(len(s), len(sets[j]))) > 0.7 or s == sets[j]))
        kept.append(not clash)
    return kept


@pytest.mark.parametrize("span,stretch", [(1, 4), (5, 7), (20, 1000), (1000, 50)])
def test_horizon_equals_a_serial_pass(spark, span, stretch):
    r = random.Random(span)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [r.sample(vocabulary, 10) for _ in range(6)]
    texts = [" ".join(r.sample(b, 10) if r.random() < 0.6 else [*b[:9], r.choice(vocabulary)]) if (b := r.choice(base)) and r.random() < 0.8
             else " ".join(r.sample(vocabulary, 9)) for _ in range(150)]
    rows = spark.createDataFrame([(i, i * 3 + 5, t) for i, t in enumerate(texts)], "id long, seq long, text string")
    numbered = settle(horizon.arrivals(rows))
    assert [x.seq for x in numbered.orderBy("id").collect()] == list(range(1, 151))
    out = horizon.suppress_within(numbered, [words.overlap_tier(numbered)], span, heads=4, span=stretch)
    got = {x.id: x.kept for x in out.collect()}
    assert [got[i] for i in range(150)] == naive_greedy([set(t.split()) for t in texts], span)
    assert 0 < sum(got.values()) < 150


def test_without_a_bound_the_same_as_all_history(spark):
    rows = spark.createDataFrame([(i, i, f"alpha beta gamma delta epsilon zeta eta theta iota word{i % 3}") for i in range(40)], "id long, seq long, text string")
    tier = words.overlap_tier(rows)
    near = {r.id: (r.kept, r.matched_id) for r in horizon.suppress_within(rows, [tier], 10_000).collect()}
    assert near == {r.id: (r.kept, r.matched_id) for r in greedy.suppress(rows.select("id", "seq"), [tier]).collect()}
    # A message that is sent again and again is kept once in every eleven arrivals.
    assert [i for i, (k, _) in sorted({r.id: (r.kept, 0) for r in horizon.suppress_within(rows, [tier], 10, span=3).collect()}.items()) if k] == [0, 11, 22, 33]


def test_a_batch_reads_its_window_only_and_a_replay_writes_the_same(spark, tmp_path):
    src, out, check = (str(tmp_path / p) for p in ("in", "out", "check"))
    schema = "seq long, chat_id long, text string"
    for k in range(6):
        put(spark, [(k * 10 + i, 1, f"text number {k} {i} " + "x" * i) for i in range(10)], schema, src)
        stream = read_folder(spark, src, spark.createDataFrame([], schema).schema, 1)
        run(curate_stream(stream, out, check, Options(max_latest_messages=15)))
    history = History(out, 15)
    upto, batches = history.before(spark, 6)
    assert upto == 60 and [b for b, _ in batches] == [4, 5]  # arrivals 46 to 60
    assert [r.arrival for r in history.rows(spark, 6).orderBy("arrival").collect()][0] > 45
    # Older folders are not needed: the next batch runs without them.
    before = {r.seq: r.arrival for r in read_batches(spark, f"{out}/kept", KEPT).collect()}
    assert before == {s: s + 1 for s in before} and max(before) == 59
    rows = settle(spark.createDataFrame([(60 + i, 1, f"new {i} " + "y" * 30) for i in range(3)], schema))
    for _ in range(2):
        numbered, verdict = history.decide(rows, 6, lambda t: [words.overlap_tier(t)])
        history.close(numbered, numbered.join(verdict.where("kept").select("seq"), "seq", "left_semi"), 6)
        last = read_one(spark, f"{out}/window", WINDOW, 6).first()
        assert last.upto == 63 and [tuple(b) for b in last.batches] == [(4, 50), (5, 60), (6, 63)]
        assert sorted(r.arrival for r in read_one(spark, f"{out}/kept", KEPT, 6).collect()) == [61, 62, 63][: verdict.where("kept").count()]


# --- control plane

def test_lists_change_between_batches(spark, tmp_path):
    inbox, typed, out, check = (str(tmp_path / p) for p in ("in", "typed", "out", "check"))
    message, command = "seq long, ts timestamp, chat_id long, text string", "seq long, text string"

    def at(s):
        return spark.sql(f"SELECT timestamp_seconds({s}) AS t").first().t

    batches = [
        ([(1, at(100_000), 7, "hello")], [(1, "follow 7"), (2, "add_regex_item (?i)buy"), (3, "nonsense")]),
        ([(2, at(100_060), 7, "hello"), (3, at(100_060), 8, "hello"), (4, at(100_061), 7, "BUY it")], [(4, "unfollow 7"), (5, "follow 8"), (6, "switch remove_to_ignore off")]),
        ([(5, at(100_120), 7, "hello"), (6, at(100_000), 8, "on time"), (7, at(99_000), 8, "late"), (8, at(90_000), 8, "stale"), (9, None, 8, "no time")], [(7, "Follow abc")]),
    ]
    for k, (messages, commands) in enumerate(batches):
        put(spark, messages, message, inbox)
        put(spark, commands, command, typed)
        streams = [read_folder(spark, p, spark.createDataFrame([], s).schema, 1) for p, s in ((inbox, message), (typed, command))]
        run(gather_stream(*streams, out, check, Options(stale_hours=1), "10 minutes"))
    chosen = {r.seq for r in spark.read.parquet(f"{out}/selected").collect()}
    aside = {r.seq: r.reason for r in spark.read.parquet(f"{out}/aside").collect()}
    assert chosen == {2, 6, 9} and aside == {1: "unfollowed", 3: "unfollowed", 4: "ad", 5: "unfollowed", 7: "late", 8: "stale"}
    lists = read_one(spark, f"{out}/lists", STATE, 2)
    assert {(r.kind, r.name) for r in lists.collect()} == {("follow", "8"), ("follow", "abc"), ("pattern", "(?i)buy"), ("switch", "remove_to_ignore"), ("clock", "")}
    assert switch_of(lists) == 0
    none = spark.createDataFrame([], STATE)
    flipped = changed(none, spark.createDataFrame([(1, "switch remove_to_ignore"), (2, "switch remove_to_ignore"), (3, "SWITCH remove_to_ignore")], command))
    assert switch_of(flipped) == 0 and switch_of(changed(flipped, spark.createDataFrame([], command))) == 0


# --- removals

def test_removals_late_repeated_and_guarded(spark, tmp_path):
    pub, gone, lists = (str(tmp_path / p) for p in ("pub", "gone", "lists"))
    published, deleted = "new_id long, id long, t long, text string", "deleted_id long, t long"
    day = 86_400
    put(spark, [(1, 11, 10 * day, "a\nb"), (2, 12, 10 * day, "kept too long"), (3, 13, 10 * day, ""), (4, 14, 40 * day, "later")], published, pub)
    put(spark, [(1, 11 * day), (1, 11 * day + 5), (2, 30 * day), (3, 11 * day), (99, 11 * day), (4, 41 * day)], deleted, gone)

    def joined():
        streams = [read_folder(spark, p, spark.createDataFrame([], s).schema, 1).withColumn("ts", F.timestamp_seconds("t")) for p, s in ((pub, published), (gone, deleted))]
        return removal_stream(streams[0], streams[1], "7 days", "1 hour")

    on = str(tmp_path / "on")
    run(blocklist_stream(joined(), on, str(tmp_path / "c1")))
    # The first deletion counts, message 2 was deleted after 20 days, 3 has no text, 99 was never published.
    assert {(r.new_id, r.id, r.text) for r in spark.read.parquet(on).collect()} == {(1, 11, "a b"), (4, 14, "later")}
    put(spark, [(5, 15, 41 * day, "new")], published, pub)
    put(spark, [(5, 42 * day), (1, 12 * day)], deleted, gone)  # the second one is far behind: its message has left the state
    run(blocklist_stream(joined(), on, str(tmp_path / "c1")))
    assert sorted(r.new_id for r in spark.read.parquet(on).collect()) == [1, 4, 5]
    off = str(tmp_path / "off")
    write_batch(spark.createDataFrame([("switch", "remove_to_ignore", 0)], STATE), lists, 0)
    run(blocklist_stream(joined(), off, str(tmp_path / "c2"), lists))
    assert spark.read.parquet(off).count() == 0
    # A batch that is replayed keeps the switch it began with.
    assert read_one(spark, f"{off}-switch", STATE, 0).first().value == 0


# --- pacing

def test_records_leave_one_by_one_and_wait_over_a_restart(spark, tmp_path):
    src, out, check = (str(tmp_path / p) for p in ("in", "out", "check"))
    schema = "target string, seq long, t long, body string"

    def step(rows):
        put(spark, rows, schema, src)
        records = read_folder(spark, src, spark.createDataFrame([], schema).schema, 1).withColumn("ready_at", F.timestamp_seconds("t")).drop("t")
        run(paced_stream(records, 4.0).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", check))
        if not glob.glob(f"{out}/*.parquet"):
            return {}
        return {r.seq: (r.target, r.s) for r in spark.read.parquet(out).select("seq", "target", F.unix_seconds("send_at").alias("s")).collect()}

    # Three for one target at once: they leave at 100, 104 and 108; time has come to 100.
    got = step([("a", 1, 100, "x"), ("a", 2, 100, "y"), ("a", 3, 100, "z"), ("b", 4, 100, "w")])
    assert got == {1: ("a", 100), 4: ("b", 100)}
    got = step([("b", 5, 105, "v")])
    assert got == {1: ("a", 100), 2: ("a", 104), 4: ("b", 100), 5: ("b", 105)}
    got = step([("c", 6, 200, "u")])
    assert got[3] == ("a", 108) and len(got) == 6
    with pytest.raises(ValueError):
        Pacer(0.0001)


# --- edits

def test_changes_of_published_records(spark):
    rows = [(1, 1, 1, "new", "a"), (2, 1, 1, "edit", "a"), (3, 1, 1, "edit", "b"), (4, 1, 1, "remove", None), (5, 1, 1, "edit", "c"), (6, 1, 1, "remove", None),
            (7, 1, 2, "remove", None), (8, 1, 2, "new", "x"), (9, 2, 1, "edit", None), (10, 2, 1, "edit", "y"), (11, 2, 1, "edit", None)]
    feed = changes.change_feed(spark.createDataFrame(rows, "seq long, chat_id long, id long, kind string, text string"))
    assert [(r.seq, r.op, r.version, r.text) for r in feed.orderBy("seq").collect()] == [
        (1, "insert", 1, "a"), (3, "update", 2, "b"), (4, "retract", 3, None), (9, "insert", 1, None), (10, "update", 2, "y"), (11, "update", 3, None)]
    assert [(r.chat_id, r.id, r.text) for r in changes.current(feed).collect()] == [(2, 1, None)]
    assert feed.select("key").distinct().count() == 2


# --- monitoring

def test_progress_and_failures_become_rows(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "monitor")
    put(spark, [(1, "2"), (2, "3")], "k long, v string", src)
    put(spark, [(3, "no number")], "k long, v string", src)
    monitor = Monitor(spark, out)
    spark.streams.addListener(monitor)
    try:
        rows = read_folder(spark, src, spark.createDataFrame([], "k long, v string").schema, 1)
        good = rows.writeStream.format("noop").queryName("good").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
        good.awaitTermination()
        bad = rows.select(F.col("v").cast("long")).writeStream.format("noop").queryName("bad").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
        with pytest.raises(Exception):
            bad.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(monitor)
    monitor.flush()
    monitor.flush()  # nothing is written twice
    health = {r.name: r for r in query_health(read_monitor(spark, out)).collect()}
    assert (health["good"].batches, health["good"].rows, health["good"].end, health["good"].error) == (2, 3, "ended", None)
    assert health["good"].waiting == 0 and health["good"].longest_ms >= 0
    assert health["bad"].end == "failed" and "no number" in health["bad"].error and health["bad"].rows == 2


# --- embedding hook

def test_the_model_is_loaded_once_per_worker_and_sees_each_text_once(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        with open(os.path.join(folder, f"load-{os.getpid()}"), "a") as f:
            f.write("x")

        def predict(texts):
            with open(os.path.join(folder, f"seen-{os.getpid()}"), "a") as f:
                f.write(f"{len(texts)}\n")
            return np.array([[len(t), t.count("a")] for t in texts], dtype=float)
        return predict

    rows = spark.createDataFrame([(i, None if i % 10 == 9 else f"a{'b' * (i % 7)}") for i in range(300)], "id long, text string").repartition(6)
    for _ in range(2):
        got = {r.id: r.vec for r in enrich.embed(rows, load, batch=3).collect()}
    assert got[9] is None and got[0] == [1.0, 1.0] and got[6] == [7.0, 1.0] and len(got) == 300
    loads = {p: os.path.getsize(p) for p in glob.glob(f"{folder}/load-*")}
    # One load for each worker and each call of the hook.
    assert loads and all(n <= 2 for n in loads.values())
    assert sum(int(x) for p in glob.glob(f"{folder}/seen-*") for x in open(p)) == 2 * 7


# --- topics, delivery, lists, intermediate tables

def test_records_go_through_a_topic_and_are_delivered_once(spark, tmp_path):
    src, topic, out, c1, c2 = (str(tmp_path / p) for p in ("in", "topic", "out", "c1", "c2"))
    schema = "key string, partition int, message string, target_channel string"
    body = spark.createDataFrame([], "message string, target_channel string").schema
    sent = []

    def step(rows, at, broken=()):
        put(spark, rows, schema, src)
        run(write_folder(read_folder(spark, src, spark.createDataFrame([], schema).schema), topic, c1))
        kind = spark.createDataFrame([], "key string, partition int, value string").schema
        put(spark, list(broken), kind, f"{src}-other")  # another writer of the topic
        records = read_folder(spark, topic, kind).unionByName(read_folder(spark, f"{src}-other", kind))
        stamp = F.when(F.col("key") == "old", at - 90_000).otherwise(at)
        records = records.withColumn("timestamp", F.timestamp_seconds(stamp)).withColumn("topic", F.lit("published"))
        run(deliver_stream(records, body, lambda df: sent.extend((r.key, r.message) for r in df.collect()), out, c2, Options(stale_hours=1)))

    step([("a", 1, "one", "main"), ("b", 2, "two", None), ("old", 0, "late", "main")], 1_000_000, [("x", 0, "{oops")])
    step([("a", 1, "one", "main"), ("c", 1, "three", "main")], 1_000_100)
    assert sorted(sent) == [("a", "one"), ("b", "two"), ("c", "three")]
    receipts = {r.key: r.outcome for r in spark.read.parquet(f"{out}/receipts").collect()}
    assert receipts == {"a": "sent", "b": "sent", "c": "sent", "old": "stale", "x": "dead_letter"}
    assert [(r.key, r.value) for r in spark.read.parquet(f"{out}/dead_letters").collect()] == [("x", "{oops")]
    kept = spark.read.parquet(topic)
    assert {(r.key, r.partition) for r in kept.collect()} == {("a", 1), ("b", 2), ("old", 0), ("c", 1)}
    run(write_nowhere(read_folder(spark, src, spark.createDataFrame([], schema).schema), str(tmp_path / "c3")))


def test_the_newest_finished_snapshot_of_profiles_is_read(spark, tmp_path):
    path = str(tmp_path / "profiles")
    assert read_profiles(spark, path).count() == 0

    def profile(title):
        return spark.createDataFrame([("1", ["sig"], None, None, title, None, None)], PROFILE)

    for version in (2, 10):
        write_profiles(profile(f"v{version}"), path, version)
    (tmp_path / "profiles" / "version=11").mkdir()  # its writer has not finished
    assert read_profiles(spark, path).first().title == "v10" and read_profiles(spark, path, 2).first().title == "v2"
    assert read_profiles(spark, path, 5).count() == 0


def test_tables_of_a_scope_go_when_it_ends(spark):
    with scratch(spark):
        outer = settle(spark.range(3))
        with scratch(spark):
            inner = settle(spark.range(4))
            assert inner.count() == 4
        assert outer.count() == 3 and not exists(spark, inner.inputFiles()[0])
        files = outer.inputFiles()
    assert not any(exists(spark, f) for f in files)
    assert settle(spark.range(5)).count() == 5  # outside of a scope a table stays


# --- size of the streams' work

def test_waiting_records_are_few_entries_of_state(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, [("a", i, 100, "x") for i in range(1500)], "target string, seq long, at long, body string", src)

    def step():
        records = spark.readStream.schema("target string, seq long, at long, body string").parquet(src).select(
            "target", "seq", F.timestamp_seconds("at").alias("ready_at"), "body")
        query = paced_stream(records, 1.0).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(
            availableNow=True).start()
        query.awaitTermination()
        return sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"])

    assert step() < 20
    put(spark, [("b", 2000, 1000, "y")], "target string, seq long, at long, body string", src)
    step()
    sent = lambda: [(r.seq, r.s) for r in spark.read.parquet(out).where("target = 'a'").select("seq", F.unix_seconds("send_at").alias("s")).orderBy("seq").collect()]
    assert sent() == [(i, 100 + i) for i in range(901)]
    put(spark, [("b", 2001, 5000, "y")], "target string, seq long, at long, body string", src)
    step()
    assert sent() == [(i, 100 + i) for i in range(1500)]


def test_parts_are_written_by_the_tasks_that_read_them(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("seq")).repartition(4)
    streams._arrive(rows, [0], 2, str(tmp_path / "in"))
    assert len(glob.glob(f"{tmp_path}/in/*.parquet")) > 1
    assert spark.read.parquet(str(tmp_path / "in")).agg(F.count("seq"), F.max("seq")).first()[:] == (500, 499)


def test_signatures_are_learned_over_bounded_batches(spark, monkeypatch, tmp_path):
    folder = str(tmp_path)
    put(spark, [(i if i < 198 else None, f"src{i % 3}", f"{'Flash: ' if i % 5 else ''}text {i}") for i in range(200)], "doc_id long, source string, text string", f"{folder}/documents.parquet")
    whole = sorted(map(tuple, streams.stream_signatures(spark, folder).collect()), key=str)
    monkeypatch.setattr(streams, "BATCH", 90)
    assert sorted(map(tuple, streams.stream_signatures(spark, folder).collect()), key=str) == whole and len(whole) == 200


def test_events_without_a_number_come_last():
    found = sorted([(None, 1), (3, 2), (float("nan"), 3), (1, 4)], key=_order)
    assert [x[1] for x in found] == [4, 2, 1, 3]
