from __future__ import annotations

import pyarrow as pa
import pytest
from helpers import DOCS, prose

from callscope.llm import batches, packing, stages

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("stage", [stages.quality, stages.language, stages.near_duplicates, stages.pack])
def test_texts_reach_workers_in_bounded_batches(spark, sf, stage):
    def sizes(found):
        for batch in found:
            yield pa.RecordBatch.from_pydict({"bytes": [sum(len(x) for x in batch.column("text").to_pylist())], "rows": [batch.num_rows]})

    rows = [(i, f"n{i} {prose(i, 2500)}", "en", "a", 0, "k", "s", 1) for i in range(300)]
    rows.append((300, "long " * (batches.BATCH_BYTES // 4), "en", "a", 0, "k", "s", 1))
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    spark.conf.unset(LIMIT)
    stage(spark, docs, sf)
    got = docs.mapInArrow(sizes, "bytes long, rows long").collect()
    assert sum(r["bytes"] for r in got) == sum(len(r[1]) for r in rows) > 2 * batches.BATCH_BYTES
    longest = max(len(r[1]) for r in rows)
    assert all(r["bytes"] <= batches.BATCH_BYTES + longest for r in got) and len(got) > 1


def test_a_smaller_limit_stays(spark):
    spark.conf.set(LIMIT, "64k")
    try:
        batches.small_batches(spark)
        assert spark.conf.get(LIMIT) in ("64k", "65536b")
    finally:
        spark.conf.unset(LIMIT)


def test_other_operators_do_not_hold_the_word_table():
    own = packing.word_tokens()
    assert list(batches.task(list, packing.VOCABULARY)(iter("ab"))) == ["a", "b"]
    assert packing.word_tokens() is own
    batches.task(list, None)(iter(()))
    assert not batches._tables
