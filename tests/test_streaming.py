import random

from pyspark.sql import functions as F

from rivulet.operators import greedy, stems
from rivulet.operators.signatures import strip_signatures
from rivulet.sources.sinks import read_batches
from rivulet.sources.topics import read_folder
from rivulet.streaming.albums import first_seen_stream, fold_album_stream, newest_rows, presence_stream, upsert_writer
from rivulet.streaming.greedy import DECISION, KEPT, curate_stream, text_tiers
from rivulet.plans.curate import Dims
from rivulet.streaming.pipeline import DECISION as OUTCOME
from rivulet.streaming.pipeline import pipeline_stream
from rivulet.streaming.signatures import strip_signature_stream


def messages(seed=5, n=36):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(["red", "blue", "green", "tall", "old", "new"]) + str(rng.randint(0, 9)) for _ in range(10)) for _ in range(5)]
    return [(i, rng.randint(1, 2), rng.choice(base) + (" " + rng.choice(["x", "y"]) if rng.random() < 0.5 else "")) for i in range(n)]


def write_part(spark, rows, path, schema="seq long, chat_id long, text string"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    rows = messages()
    src, out, offsets = (str(tmp_path / p) for p in ("in", "out", "offsets"))
    schema = spark.createDataFrame([], "seq long, chat_id long, text string").schema
    for part in (rows[:12], rows[12:24]):
        write_part(spark, part, src)
        run(curate_stream(read_folder(spark, src, schema, 1), out, offsets))
    write_part(spark, rows[24:], src)
    run(curate_stream(read_folder(spark, src, schema, 1), out, offsets))
    got = {r.seq: (r.kept, r.tier, r.matched_id) for r in read_batches(spark, f"{out}/decisions", DECISION).collect()}
    frame = spark.createDataFrame(rows, "seq long, chat_id long, text string").withColumn("id", F.col("seq"))
    batch = greedy.suppress(stems.keyed_rows(frame), text_tiers(frame)).collect()
    assert got == {r.id: (r.kept, r.tier, r.matched_id) for r in batch}
    kept = {r.seq for r in read_batches(spark, f"{out}/kept", KEPT).collect()}
    assert kept == {s for s, (k, _, _) in got.items() if k} and len(kept) < len(rows)


def test_signature_state_lives_across_batches(spark, tmp_path):
    rows = [(i, 1 + i % 2, f"Chan{i % 2}: text {i}") for i in range(16)]
    src, out, offsets = (str(tmp_path / p) for p in ("in", "out", "offsets"))
    schema = spark.createDataFrame([], "seq long, chat_id long, text string").schema
    for part in (rows[:5], rows[5:9], rows[9:]):
        write_part(spark, part, src)
        stripped = strip_signature_stream(read_folder(spark, src, schema, 1))
        run(stripped.writeStream.format("parquet").option("path", out).option("checkpointLocation", offsets))
    got = {r.seq: (r.text, r.learned) for r in spark.read.parquet(out).collect()}
    frame = spark.createDataFrame(rows, "seq long, chat_id long, text string")
    assert got == {r.seq: (r.text, r.learned) for r in strip_signatures(frame).collect()}
    assert any(learned for _, learned in got.values())


def test_albums_close_and_repeats_drop(spark, tmp_path):
    rows = [(0, 1, 7, 0, "m", None, "a"), (5, 1, 7, 1, "", "f", "b"), (4000, 1, 8, 0, "n", None, "c"), (9000, 1, 9, 0, "z", None, "d")]
    schema = "t long, chat_id long, grouped_id long, pos long, message string, forward string, caption string"
    src = str(tmp_path / "in")
    write_part(spark, rows, src, schema)
    stream = read_folder(spark, src, spark.createDataFrame([], schema).schema)
    stream = stream.withColumn("ts", F.timestamp_seconds("t"))
    run(fold_album_stream(stream, "1 minute", "1 minute").writeStream.format("memory").queryName("albums")
        .option("checkpointLocation", str(tmp_path / "c1")))
    got = {r.grouped_id: r for r in spark.table("albums").collect()}
    assert set(got) == {7, 8}  # the last album is still open
    assert (got[7].message, got[7].forward, got[7].n_files) == ("m", "f", 2)
    run(first_seen_stream(stream, ["chat_id"]).writeStream.format("memory").queryName("firsts")
        .option("checkpointLocation", str(tmp_path / "c2")))
    assert spark.table("firsts").count() == 1


def test_album_state_goes_down_and_changes_are_upserted(spark, tmp_path):
    schema = "t long, chat_id long, grouped_id long, pos long, message string, forward string"
    src, out, check = (str(tmp_path / p) for p in ("in", "out", "check"))
    sizes = []
    for part in ([(i * 10_000 // 400, 1, i, 0, "m", None) for i in range(400)], [(500_000, 1, 9999, 0, "m", None)], [(500_001, 1, 9999, 1, "m", None)]):
        write_part(spark, part, src, schema)
        stream = read_folder(spark, src, spark.createDataFrame([], schema).schema).withColumn("ts", F.timestamp_seconds("t"))
        query = (fold_album_stream(stream, "1 minute", "1 minute").writeStream.outputMode("append").format("parquet").option("path", out)
                 .option("checkpointLocation", check).trigger(availableNow=True).start())
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert sizes[-1] <= 2 < sizes[0] and spark.read.parquet(out).count() == 400
    events = str(tmp_path / "events")
    table, offsets = str(tmp_path / "table"), str(tmp_path / "offsets")
    for k, part in enumerate([[("a", "up", 1), ("b", "up", 1)], [("a", "down", 2)]]):
        write_part(spark, part, events, "service string, status string, seq long")
        rows = read_folder(spark, events, spark.createDataFrame([], "service string, status string, seq long").schema)
        run(upsert_writer(presence_stream(rows.withColumn("ts", F.timestamp_seconds("seq"))), table, offsets))
    changes = spark.read.option("basePath", table).parquet(table)
    assert changes.where("batch > 0 and service = 'b'").count() == 0
    assert {r.service: r.status for r in newest_rows(changes, ["service"]).collect()} == {"a": "down", "b": "up"}


def test_the_whole_pipeline_over_a_restart(spark, tmp_path):
    schema = "seq long, chat_id long, chat_title string, text string, is_forward boolean, _corrupt string"
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(0, 1, "A", "Flash: one https://t.me/x", False, None), (1, 1, "A", "BUY this", False, None), (2, 1, "A", "Flash: two", True, None),
            (3, 9, "Z", "not followed", False, None), (4, 1, "A", "Flash: three", False, None), (5, 1, "A", None, False, "{oops"),
            (6, 1, "A", "blocked\nline", False, None), (7, 2, "B", words, False, None), (8, 1, "A", "Flash: four", False, None), (9, 2, "B", words + " more", False, None)]
    src, out, offsets = (str(tmp_path / p) for p in ("in", "out", "offsets"))
    dims = Dims(patterns=spark.createDataFrame([("(?i)buy",)], "pattern string"), blocklist=spark.createDataFrame([("blocked line",)], "text string"))
    channels = spark.createDataFrame([(1,), (2,)], "chat_id long")
    for part in (rows[:5], rows[5:8], rows[8:]):
        write_part(spark, part, src, schema)
        stream = read_folder(spark, src, spark.createDataFrame([], schema).schema, 1)
        run(pipeline_stream(stream, out, offsets, dims, channels=channels))
    got = {r.seq: r for r in read_batches(spark, f"{out}/decisions", OUTCOME).collect()}
    assert {k: r.outcome for k, r in got.items()} == {
        0: "sent", 1: "ad", 2: "sent", 4: "sent", 5: "dead_letter", 6: "ad", 7: "sent", 8: "sent", 9: "duplicate"}
    assert got[0].text == "Flash: one " and got[8].text == "four" and got[9].matched_id == 7 and got[2].target_channel == "control"
    assert spark.read.parquet(f"{out}/dead_letters").count() == 1
    sent = spark.read.parquet(f"{out}/outbox").collect()
    assert len({r.key for r in sent}) == len(sent) == 5 and {r.message for r in sent} >= {"A:\nfour", f"B:\n{words}"}
    assert all(r.timestamp is not None and r.silent is None for r in sent)
