"""Streams in and out: normalised records, bounded micro-batches, idempotent sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RECORD = "event_id long, message_id long, partner_id string, stage_name string, outcome string, completed_at long"


def kafka_options(servers: str, topics: list[str], group: str, per_trigger: int | None = None) -> dict[str, str]:
    """Several topics as one group; offsets are the checkpoint's and never committed to the broker; at most `per_trigger` records a batch."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "kafka.group.id": group, "startingOffsets": "earliest", "failOnDataLoss": "true"}
    return options | ({"maxOffsetsPerTrigger": str(per_trigger)} if per_trigger else {})


def kafka(spark: SparkSession, servers: str, topics: list[str], group: str, per_trigger: int | None = None) -> DataFrame:
    """value (text), timestamp (the broker's) and topic of each record."""
    records = spark.readStream.format("kafka").options(**kafka_options(servers, topics, group, per_trigger)).load()
    return records.select(F.col("value").cast("string").alias("value"), "timestamp", "topic")


def json_files(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Lines of a folder of files, each with its file's time; at most `per_trigger` files a batch, which is the backpressure."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", per_trigger).load(path)
    return lines.select("value", F.col("_metadata.file_modification_time").alias("timestamp"))


def _parsed(raw: DataFrame, schema: str) -> DataFrame:
    return raw.withColumn("j", F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})).withColumn("corrupt", F.col("j._corrupt_record").isNotNull())


def _or_empty(*names: str) -> list:
    return [F.coalesce(F.col(f"j.{c}"), F.lit("")).alias(c) for c in names]


def decoded(raw: DataFrame) -> DataFrame:
    """Records, with the time of the record where their own is missing or not after the epoch, which a retried batch gives again; what can't be decoded has `corrupt` set."""
    own = F.timestamp_millis(F.col("j.completed_at"))
    at = F.when(F.coalesce(F.col("j.completed_at"), F.lit(0)) <= 0, F.col("timestamp")).otherwise(own)
    return _parsed(raw, RECORD).select("j.event_id", "j.message_id", *_or_empty("partner_id", "stage_name", "outcome"), at.alias("occurred_at"), "corrupt")


#: Exchanges with operators, as they are logged.
PDU = "operator_id string, protocol string, direction string, pdu_type string, sequence_number int, message_id string, stage_execution_id string, smsc_message_id string, segment_id int, status string, occurred_at long"
PDU_KEY = ("occurred_at", "operator_id", "sequence_number", "pdu_type")


def decoded_pdus(raw: DataFrame) -> DataFrame:
    """PDU records; texts that are missing are empty, numbers 0."""
    numbers = [F.coalesce(F.col(f"j.{c}"), F.lit(0)).alias(c) for c in ("sequence_number", "segment_id")]
    texts = _or_empty("operator_id", "protocol", "direction", "pdu_type", "message_id", "stage_execution_id", "smsc_message_id", "status")
    at = F.when(F.coalesce(F.col("j.occurred_at"), F.lit(0)) <= 0, F.col("timestamp")).otherwise(F.timestamp_millis(F.col("j.occurred_at")))
    return _parsed(raw, PDU).select(*texts, *numbers, at.alias("occurred_at"), F.col("timestamp").alias("ingested_at"), "corrupt")


def write_once(records: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends each batch under its number and overwrites that on a retry, so a batch that runs twice is stored once."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.filter("NOT corrupt").drop("corrupt").write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = records.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def first_claims(records: DataFrame, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    """The first record of each key within the watermark."""
    return records.withWatermark("occurred_at", lateness).dropDuplicatesWithinWatermark(keys)


def hourly_counts(records: DataFrame, lateness: str = "48 hours") -> DataFrame:
    """Counts by hour, partner, stage and outcome; redelivered records count again, as in the stored view."""
    rows = records.withWatermark("occurred_at", lateness).groupBy(F.window("occurred_at", "1 hour").alias("w"), "partner_id", "stage_name", "outcome").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("hour"), "partner_id", "stage_name", "outcome", "n")
