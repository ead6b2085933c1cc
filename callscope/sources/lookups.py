"""Model registry and price table."""

from __future__ import annotations

from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.schemas import PRICE_SCHEMA, REGISTRY_JSON_SCHEMA


def _packaged(name: str) -> str:
    return resources.files("callscope").joinpath("data", name).read_text(encoding="utf-8")


def _local(spark: SparkSession, **columns) -> DataFrame:
    """A literal table.  Made from Arrow it has a known size, so that Spark decides for itself,
    before anything is shuffled, that joining it means broadcasting it."""
    return spark.createDataFrame(pa.table({name: list(cells) for name, cells in columns.items()}))


def load_registry(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Nested provider config to one row per (provider, model), in file order.

    Without a path the packaged config is used.
    """
    if path:
        doc = spark.read.schema(REGISTRY_JSON_SCHEMA).json(path, multiLine=True)
    else:
        text = _local(spark, text=[_packaged("registry.json")])
        doc = text.select(F.from_json("text", REGISTRY_JSON_SCHEMA).alias("d")).select("d.*")
    providers = doc.select(F.posexplode("providers").alias("provider_pos", "p"))
    models = providers.select(
        "provider_pos", F.col("p.id").alias("provider"), F.posexplode("p.models").alias("pos", "m")
    )
    return models.select(
        "provider_pos",
        "pos",
        "provider",
        F.col("m.id").alias("model"),
        F.col("m.name").alias("model_name"),
        F.col("m.context_window").alias("context_window"),
        F.col("m.max_tokens_default").alias("max_tokens_default"),
        F.col("m.supports_streaming").alias("supports_streaming"),
    )


def load_prices(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Price table: model, USD per million input and output tokens."""
    if path:
        return spark.read.schema(PRICE_SCHEMA).csv(path, header=True)
    header, *lines = [line.split(",") for line in _packaged("prices.csv").split()]
    text = _local(spark, **dict(zip(header, zip(*lines))))
    return text.select(*[F.col(f.name).cast(f.dataType) for f in PRICE_SCHEMA.fields])


def unpriced_models(registry: DataFrame, prices: DataFrame) -> DataFrame:
    """Registry models the price table does not know."""
    return registry.join(prices, "model", "left_anti").select("provider", "model")
