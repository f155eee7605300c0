"""Streams against the batch versions of the same logic."""

import json
import os

import pytest
from pyspark.sql import functions as F

from relaywright.operators.core import latest
from relaywright.operators.folds import LIFECYCLE_SCHEMA, RELEASE_SCHEMA, lifecycle_step, ordered_fold, release_step
from relaywright.plans.stateful import lane_rows
from relaywright.streaming import ingest
from relaywright.streaming.stateful import ROCKSDB, lifecycle_stream, release_stream


@pytest.fixture
def folder(tmp_path):
    rows = [{"event_id": i, "message_id": i % 7, "partner_id": f"p{i % 3}", "stage_name": "POLICY", "outcome": "SUCCEEDED", "completed_at": 1_700_000_000_000 + i * 60_000} for i in range(60)]
    rows += rows[:10]
    src = tmp_path / "in"
    src.mkdir()
    for k in range(4):
        lines = [json.dumps(r) for r in rows[k::4]] + ["{broken"]
        (src / f"{k}.json").write_text("\n".join(lines))
    return tmp_path


def test_decode_and_write_once(spark, folder):
    records = ingest.decoded(ingest.json_files(spark, str(folder / "in"), per_trigger=1))
    ingest.write_once(records, str(folder / "out"), str(folder / "cp")).awaitTermination()
    out = spark.read.parquet(str(folder / "out"))
    assert out.count() == 70 and out.select("event_id").distinct().count() == 60
    # nothing new: a second run adds nothing
    ingest.write_once(ingest.decoded(ingest.json_files(spark, str(folder / "in"), 1)), str(folder / "out"), str(folder / "cp")).awaitTermination()
    assert spark.read.parquet(str(folder / "out")).count() == 70


def test_claims_and_counts(spark, folder):
    records = ingest.decoded(ingest.json_files(spark, str(folder / "in"), per_trigger=2)).filter("NOT corrupt")
    q = ingest.first_claims(records, ["event_id"], "30 days").writeStream.format("memory").queryName("claims").option("checkpointLocation", str(folder / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("claims").count() == 60
    q = ingest.hourly_counts(records).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(folder / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 70


def test_record_time_is_the_fallback(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"event_id": 1, "completed_at": 0}\n{"event_id": 2, "completed_at": 1000}\n{"event_id": 3}')
    at = 1_600_000_000
    os.utime(tmp_path / "in" / "a.json", (at, at))
    ingest.write_once(ingest.decoded(ingest.json_files(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.event_id: r.s for r in spark.read.parquet(str(tmp_path / "out")).select("event_id", F.unix_seconds("occurred_at").alias("s")).collect()}
    assert got == {1: at, 2: 1, 3: at}


def test_kafka_options():
    options = ingest.kafka_options("a:9092,b:9092", ["incoming.messages", "stage.completed", "message.lifecycle"], "analytics", 5_000)
    assert options["subscribe"] == "incoming.messages,stage.completed,message.lifecycle" and options["maxOffsetsPerTrigger"] == "5000"
    assert options["kafka.group.id"] == "analytics" and options["startingOffsets"] == "earliest" and not any("commit" in k for k in options)
    assert "maxOffsetsPerTrigger" not in ingest.kafka_options("a", ["t"], "g")


def test_pdu_sink(spark, tmp_path):
    pdu = {"operator_id": "o1", "protocol": "SMPP", "direction": "OUT", "pdu_type": "SUBMIT_SM", "sequence_number": 7, "message_id": "m1", "segment_id": 1, "occurred_at": 1_700_000_000_000}
    lines = [pdu, pdu | {"message_id": "m2"}, pdu | {"pdu_type": "DELIVER_SM", "message_id": None, "smsc_message_id": "s1"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([*map(json.dumps, lines), "{broken"]))
    ingest.write_once(ingest.decoded_pdus(ingest.json_files(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.count() == 3 and stored.filter("message_id = '' AND stage_execution_id = ''").count() == 1
    # on reading, equal keys collapse, whatever their message
    assert latest(stored, list(ingest.PDU_KEY), [F.desc("ingested_at"), F.desc("message_id")]).count() == 2


def restarted(spark, folder, build, batches):
    """The stream run to its end after each new file, by a new query on the same checkpoint each time."""

    def sink(rows, number):
        rows.write.mode("overwrite").parquet(str(folder / "out" / f"n{number}"))

    for k, rows in enumerate(batches):
        rows.coalesce(1).write.parquet(str(folder / "in" / f"k={k}"))
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in" / "k=*"))
        build(stream).writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start().awaitTermination()
    return sorted((tuple(r) for r in spark.read.parquet(str(folder / "out" / "n*")).collect()), key=repr)


def test_lifecycle_goes_on_after_a_restart(spark, tmp_path):
    """Verdicts depend on what was applied before the restart; each is put out once."""
    spark.conf.set(*ROCKSDB)
    statuses = ["SUBMITTED", "DELIVERED", "DELIVERY_UNRESOLVED", "LATE_DELIVERY_CONFIRMED"]
    rows = [(i % 5, 100 + i, statuses[(i // 5 + i % 5) % 4], 1_700_000_000 + i) for i in range(90)]
    schema = "message_id long, event_id long, status string, ts long"
    batches = [spark.createDataFrame(rows[k * 30 : (k + 1) * 30], schema) for k in range(3)]
    got = restarted(spark, tmp_path, lifecycle_stream, batches)
    once = ordered_fold(spark.createDataFrame(rows, schema), ["message_id"], ["ts", "event_id"], lifecycle_step, LIFECYCLE_SCHEMA)
    assert got == sorted((tuple(r) for r in once.collect()), key=repr)


def test_lanes_go_on_after_a_restart(spark, sf_dir, tmp_path):
    """What is held and the tokens of the lanes outlive the query; the batch fold agrees."""
    spark.conf.set(*ROCKSDB)
    rows = lane_rows(spark, sf_dir).filter("t < 1704400000000").cache()
    edges = [0, 1_704_150_000_000, 1_704_300_000_000, 2 * 10**12]
    batches = [rows.filter((F.col("t") >= a) & (F.col("t") < b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    got = restarted(spark, tmp_path, lambda s: release_stream(s, 3.0, 0.001), batches)
    once = ordered_fold(rows, ["stage"], ["t", "later", "item", "scope"], release_step(3.0, 0.001), RELEASE_SCHEMA)
    assert got == sorted((tuple(r) for r in once.collect()), key=repr) and len(got) > 50


def test_lifecycle_stream_equals_fold(spark, tmp_path):
    spark.conf.set(*ROCKSDB)
    statuses = ["DELIVERY_UNRESOLVED", "SUBMITTED", "DELIVERED", "FAILED"]
    rows = [(i % 5, 100 + i, statuses[(i // 5 + i % 5) % 4], 1_700_000_000 + i) for i in range(80)]
    rows += rows[10:15]
    schema = "message_id long, event_id long, status string, ts long"
    for k in range(5):
        spark.createDataFrame(rows[k * 17 : (k + 1) * 17], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(*[str(tmp_path / "in" / "k=*")])
    q = lifecycle_stream(stream).writeStream.format("memory").queryName("verdicts").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    once = ordered_fold(spark.createDataFrame(rows, schema), ["message_id"], ["ts", "event_id"], lifecycle_step, LIFECYCLE_SCHEMA)
    total = lambda df: sorted((r.message_id, r.verdict == "VALID") for r in df.collect())
    got = spark.table("verdicts")
    assert got.count() == 85
    assert total(got.filter("verdict = 'VALID'")) == total(once.filter("verdict = 'VALID'"))
