"""The pipeline's stages: documents in, documents out, each by one operator.

A stage works on all rows that its predecessor kept and returns the columns of its input; the
last one returns pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm import langid, mixing, neardup, packing
from callscope.llm import quality as rules
from callscope.llm.queries import trusted_ids
from callscope.llm.scratch import Scratch
from callscope.session import scratch_dir


def guarded(docs: DataFrame):
    """The documents with columns named by place, so that no operator's own column can clash; the new
    name of each column; and what turns a result back."""
    names = {name: f"_c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names, lambda rows: rows.select(*(F.col(new).alias(old) for old, new in names.items()))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    plain, names, back = guarded(docs)
    trusted = trusted_ids(spark, sf_dir).withColumnRenamed("doc_id", names["doc_id"])
    return back(rules.quality_rules(plain, trusted, names["text"], names["doc_id"], keep=tuple(plain.columns)).where("kept"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; the declared language and the source are the other evidence."""
    plain, names, back = guarded(docs)
    lang, source, text = names["lang"], names["source"], names["text"]
    model = langid.train(plain, text, lang)
    evidence = {"_declared": langid.language_code(lang), "_suffix": F.lit(None).cast("string"), "_host": F.col(source)}
    path = scratch_dir(spark, "language-votes")
    langid.with_likelihoods(plain, model, text, [lang, source]).withColumns(evidence).drop(lang, source).write.parquet(path)
    rows = langid.with_likelihoods(plain, model, text, plain.columns).withColumns(evidence)
    return back(langid.fuse(rows, spark.read.parquet(path)).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; repeated rows of a kept document go, rows without an id stay.

    Documents meet the ids that go, not those that stay: these are few, so they are sent to the
    documents where they are small, and texts are not moved then.
    """
    scratch = Scratch(spark, "near-copies")
    found = neardup.near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.count_if("kept").alias("_rows"))
    other = scratch.keep(found.where("_rows <> 1"))
    out = docs.join(other.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    repeated = other.where("_rows > 1").select("doc_id")
    if not repeated.isEmpty():
        out = out.union(docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns))
    return out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the number of copies that brings their sources to the targets."""
    plain, names, back = guarded(docs)
    return back(mixing.emit(mixing.mix(plain, mixing.sizes(docs).withColumnRenamed("source", names["source"]), source=names["source"], doc_id=names["doc_id"])))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences that the documents are packed into."""
    return packing.pack(docs)
