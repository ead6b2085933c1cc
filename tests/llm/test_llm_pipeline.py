from __future__ import annotations

from collections import Counter

import pytest
from compare import compare, duck
from helpers import empty_documents, odd_documents

import corpus_pipeline
from callscope.llm import langid, mixing, neardup, packing, quality
from callscope.llm.queries import ORACLES, QUERIES, trusted_ids


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twins(spark, sf, name):
    assert compare(spark, duck(sf), name, QUERIES[name], ORACLES[name], sf) is None


def test_pipeline_applies_every_decision(spark, sf):
    """Against the operators' own verdicts, taken one after the other on collected rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for verdict in (
        lambda d: quality.quality_rules(d, trusted_ids(spark, sf)).where("kept"),
        lambda d: langid.fuse(*[langid.with_likelihoods(d, langid.train(d), "text", ["doc_id", "lang", "source"]).selectExpr("*", "lang _declared", "cast(null as string) _suffix", "source _host")] * 2).where("kept"),
        lambda d: neardup.near_duplicates(d).where("kept"),
    ):
        ids = {r["doc_id"] for r in verdict(docs).select("doc_id").collect()}
        rows = [r for r in docs.collect() if r["doc_id"] in ids]
        assert 0 < len(rows) <= docs.count()
        docs = spark.createDataFrame(rows, docs.schema)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, mixing.sizes(docs)).collect()}
    pieces = {}
    for r in packing.pack(docs).collect():
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["ids_crc32"]))
    want = Counter((i, p, c) for i, own in pieces.items() for p, c in own for _ in range(copies[i]))
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got) == want
    assert columns == docs.columns


def test_stages_on_odd_and_empty_tables(spark, sf):
    for docs in (odd_documents(spark), empty_documents(spark)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == columns, name
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).where("piece = 0").count() == docs.count()
    deduped = corpus_pipeline.STAGES[2][1](spark, odd_documents(spark), sf)
    assert sorted(str(r["doc_id"]) for r in deduped.collect()) == sorted(map(str, (1, 5, 6, 7, 8, 10, None, 11, 12, 13)))
