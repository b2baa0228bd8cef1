"""JSON messages: reading, checking and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import KEY_FIELDS, MESSAGES, REQUIRED_FIELDS


def message_time(col: Column) -> Column:
    """Event time of a text that is epoch milliseconds or ISO time; null if neither."""
    millis = col.try_cast("long")
    return F.when(millis.isNotNull(), F.timestamp_millis(millis)).otherwise(col.try_cast("timestamp"))


def parse_messages(raw: DataFrame, kind: str) -> DataFrame:
    """Columns of the message kind from a ``value`` column of JSON text, plus ``ts``."""
    parsed = raw.select(F.from_json(F.col("value").cast("string"), MESSAGES[kind]).alias("m")).select("m.*")
    return parsed.withColumn("ts", message_time(F.col("timestamp")))


def read_kafka_stream(
    spark: SparkSession, servers: str, topics: list[str], kind: str, max_offsets: int | None = None
) -> DataFrame:
    """Messages of one or more topics from the earliest offset. Needs Spark's Kafka connector on the class path."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", "earliest")
    )
    if max_offsets is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return parse_messages(reader.load(), kind)


def read_events_stream(spark: SparkSession, path: str, kind: str = "product_event", max_files: int | None = None) -> DataFrame:
    """Messages from JSON-lines files that appear in a folder."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parse_messages(reader.load(path), kind)


def _complete(kind: str) -> Column:
    ok = F.lit(True)
    for field in REQUIRED_FIELDS[kind]:
        ok &= F.col(field).isNotNull()
    return ok


def validate_messages(df: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(messages with every required field, the rejected rest)."""
    return df.where(_complete(kind)), df.where(~_complete(kind))


def to_messages(df: DataFrame, kind: str, now: Column | None = None) -> DataFrame:
    """(key, value): key of the kind's id fields, value the row as JSON with an epoch-ms ``timestamp``."""
    millis = F.unix_millis(F.current_timestamp() if now is None else now)
    if "timestamp" in df.columns:
        stamped = df.withColumn("timestamp", F.coalesce("timestamp", millis))
    else:
        stamped = df.withColumn("timestamp", millis)
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in KEY_FIELDS[kind]])
    return stamped.select(key.alias("key"), F.to_json(F.struct(*stamped.columns)).alias("value"))


def write_messages(stream: DataFrame, kind: str, checkpoint: str, path: str | None = None, servers: str | None = None, topic: str | None = None):
    """Start a query that sends messages to a topic, or to JSON files when ``path`` is given."""
    out = to_messages(stream, kind)
    if path is not None:
        writer = out.select("value").writeStream.format("text").option("path", path)
    else:
        writer = out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    return writer.option("checkpointLocation", checkpoint).outputMode("append")


def feedback_messages(events: DataFrame) -> DataFrame:
    """Feedback rows: user, item, kind, time, context, and rating or metadata where present."""
    have = set(events.columns)

    def optional(name, kind):
        return (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)

    return events.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("item_id").cast("string").alias("item_id"),
        "event_type",
        (F.col("timestamp") if "timestamp" in have else F.current_timestamp()).alias("timestamp"),
        optional("context", "map<string,string>"),
        optional("rating", "double"),
        optional("metadata", "map<string,string>"),
    ).where(F.col("user_id").isNotNull() & F.col("item_id").isNotNull() & F.col("event_type").isNotNull())


def feedback_event_log(stream: DataFrame, path: str, checkpoint: str, every: str = "60 seconds"):
    """Writer that appends feedback to JSON files once per interval."""
    return (
        feedback_messages(stream)
        .writeStream.format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .outputMode("append")
    )
