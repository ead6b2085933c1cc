"""Event streams in and out: a Kafka topic, or JSON files where no broker is at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.operators.decode import to_wire
from callscope.schemas import EVENT_TOPIC


def read_topic(
    spark: SparkSession, servers: str, topic: str = EVENT_TOPIC, **options: str
) -> DataFrame:
    """The event topic from its earliest record.  Progress lives in the query's checkpoint.

    Needs the spark-sql-kafka package on the cluster.
    """
    records = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .options(**options)
        .load()
    )
    return records.select(
        F.col("value").cast("string").alias("payload"),
        F.struct("timestamp", "partition", "offset").alias("arrival"),
    )


def read_json_files(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder that grows by files of one JSON document per line."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(path)
    return lines.select(
        F.col("value").alias("payload"),
        F.struct(
            F.col("_metadata.file_modification_time").alias("timestamp"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
        ).alias("arrival"),
    )


def publish_to_topic(
    events: DataFrame, servers: str, checkpoint: str, topic: str = EVENT_TOPIC
):
    """Stream events to a topic as JSON keyed by event id, acknowledged by the leader."""
    return (
        to_wire(events)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.acks", "1")
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .start()
    )


def publish_to_files(events: DataFrame, path: str, checkpoint: str):
    """The same documents as text files, one per line."""
    return (
        to_wire(events)
        .select("value")
        .writeStream.format("text")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def to_console(events: DataFrame, rows: int = 20):
    """Print each batch, for a look at a running stream."""
    return (
        events.writeStream.format("console")
        .option("numRows", rows)
        .option("truncate", "false")
        .start()
    )
