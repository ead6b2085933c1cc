"""Conversations and messages as stored tables, kept by merge, append, cascade and set-null.

Both tables are bucketed by conversation, so a change rewrites the buckets of the conversations that it names, in both.
Changes come in batches; a batch that has been applied is skipped, table by table, so a job that dies between two
tables finishes the rest when the batch is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.operators.conversations import append_messages, apply_updates, create_missing, detach_deleted
from callscope.schemas import CONVERSATION_SCHEMA, MESSAGE_SCHEMA
from callscope.sources.bucketed import BUCKETS, BucketedTable
from callscope.sources.tables import Warehouse

KEY = "conversation_id"
Batch = tuple[str, int]


class ConversationStore:
    """The tables `conversations` and `messages` under one root folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        root = root.rstrip("/")
        self.spark = spark
        self.conversation_table = BucketedTable(spark, f"{root}/conversations", CONVERSATION_SCHEMA, KEY, buckets)
        self.message_table = BucketedTable(spark, f"{root}/messages", MESSAGE_SCHEMA, KEY, buckets)

    # Reads

    def conversations(self, ids: DataFrame | None = None) -> DataFrame:
        """All conversations, or only the buckets of some ids."""
        return self._read(self.conversation_table, ids)

    def messages(self, ids: DataFrame | None = None) -> DataFrame:
        return self._read(self.message_table, ids)

    @staticmethod
    def _read(table: BucketedTable, ids: DataFrame | None) -> DataFrame:
        if ids is None:
            return table.read()
        return table.read(table.touched(ids)).join(ids.select(KEY).distinct(), KEY, "left_semi")

    # Changes

    def create(self, ids: DataFrame, at: Column, batch: Batch | None = None) -> None:
        """Add an empty conversation for every id that is not there yet."""
        named = ids.select(KEY).where(F.col(KEY).isNotNull()).distinct()
        table = self.conversation_table
        table.rewrite(table.touched(named), lambda old: create_missing(old, named, at), batch)

    def put(self, conversations: DataFrame, batch: Batch | None = None) -> None:
        """Add conversations; one that is there already is replaced."""
        table = self.conversation_table
        new = conversations.select(*CONVERSATION_SCHEMA.names)
        table.rewrite(table.touched(new), lambda old: old.join(new.select(KEY), KEY, "left_anti").select(*CONVERSATION_SCHEMA.names).unionByName(new), batch)

    def append(self, messages: DataFrame, batch: Batch | None = None) -> None:
        """Append messages; a missing status means completed."""
        empty = self.spark.createDataFrame([], MESSAGE_SCHEMA)
        self.message_table.append(append_messages(empty, messages), batch)

    def update(self, updates: DataFrame, batch: Batch | None = None) -> None:
        """Merge keyed changes (conversation_id, changed_at, title, status, touch), the latest value wins."""
        table = self.conversation_table
        table.rewrite(table.touched(updates), lambda old: apply_updates(old, updates).select(*CONVERSATION_SCHEMA.names), batch)

    def delete(self, deleted: DataFrame, warehouse: Warehouse | None = None, batch: Batch | None = None) -> None:
        """Delete conversations: their messages go with them, and log rows lose their id.

        Rows that refer to a conversation change first and the conversation goes last, so after a crash the
        conversation is still there to be deleted again.
        """
        gone = deleted.select(KEY).where(F.col(KEY).isNotNull()).distinct()
        if warehouse is not None:
            detach_stored(warehouse, gone)
        self.message_table.delete(gone, batch)
        self.conversation_table.delete(gone, batch)


def detach_stored(warehouse: Warehouse, gone: DataFrame) -> int:
    """Take deleted conversations' ids off the stored log; the number of folders rewritten.

    The folders (date and batch) that name one of them are found by the id column alone, and only they are
    rewritten, each as a whole, so that a repeat after a crash finds what is left to do.
    """
    place = ["ingest_date", "batch"]
    named = warehouse.logs().select(*place, KEY).where(F.col(KEY).isNotNull())
    folders = [tuple(r) for r in named.join(gone, KEY, "left_semi").select(*place).distinct().collect()]
    if folders:
        wanted = warehouse.spark.createDataFrame(folders, "ingest_date date, batch string")
        rows = warehouse.logs().join(F.broadcast(wanted), place, "left_semi")
        warehouse.replace_folders("inference_logs", detach_deleted(rows, gone), "ingest_date")
    return len(folders)
