"""An index of the log's event ids, so that finding repeats never reads the log.

Ids lie in a fixed number of buckets by their hash; the ids of late batches lie in fresh pieces until there are many.
A batch reads the fresh pieces and the buckets that its own ids fall into, and nothing but ids.  The index
covers the whole log, however old an id is.

A batch that runs again must not meet its own ids.  They lie in a piece with the batch's label, which the batch's look-up
leaves out and its next try replaces; a batch's ids are folded into the buckets only when a later one is added, and that is
after its offsets are committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.schemas import struct_of
from callscope.sources.bucketed import BucketedTable, Manifest

ID_SCHEMA = struct_of("event_id string")
ID_BUCKETS = 256


class IdIndex:
    """Event ids under one folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = ID_BUCKETS):
        self.spark = spark
        self.table = BucketedTable(spark, root, ID_SCHEMA, "event_id", buckets)

    def exists(self) -> bool:
        return bool(self.table.versions())

    def build(self, logs: DataFrame) -> Manifest:
        """Take in the ids of a stored log that has no index yet."""
        return self.table.rewrite(range(self.table.size), lambda old: logs.select("event_id").distinct())

    def candidates(self, ids: DataFrame, batch: str = "") -> DataFrame:
        """The index's rows in the buckets of the ids, without those that the batch itself has left."""
        held = self.table.manifest()
        own = self.table.labelled(batch, held) if batch else []
        if not held.pieces() - set(own):  # nothing to look up, so the ids need not be read
            return self.table.read([], Manifest())
        return self.table.read(self.table.touched(ids), held, own)

    def among(self, ids: DataFrame, batch: str = "") -> DataFrame:
        """Those of the ids (event_id) that another batch has stored.

        The index is cut down to the ids asked for, so that what is small is sent to what is large.
        """
        wanted = ids.select("event_id").where("event_id is not null").distinct()
        return self.candidates(wanted, batch).join(wanted, "event_id", "left_semi").distinct()

    def add(self, ids: DataFrame, batch: str) -> Manifest:
        """Add the ids that a batch has stored, in place of those of its earlier tries."""
        return self.table.append(ids.select("event_id"), label=batch)
