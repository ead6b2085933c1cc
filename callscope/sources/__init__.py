"""Readers, reference data and sinks."""
