"""Inference-call analytics on PySpark: ingest, governance, rollups and dashboard metrics."""

__version__ = "0.1.0"
