"""Identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HYPHENATED = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_CANONICAL = f"^{_HYPHENATED}$"
_OTHER_SPELLING = rf"^(?:[0-9a-f]{{32}}|\{{{_HYPHENATED}\}}|urn:uuid:{_HYPHENATED})$"


def dashed(hex32: Column) -> Column:
    """32 hex digits in the 8-4-4-4-12 form."""
    parts = [F.substring(hex32, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(parts[0], *[piece for part in parts[1:] for piece in (F.lit("-"), part)])


def canonical_uuid(text: Column) -> Column:
    """Lower-case dashed form of any accepted spelling, null for anything else."""
    lowered = F.lower(text)
    digits = F.regexp_replace(lowered, r"^urn:uuid:|[{}-]", "")
    return F.when(F.rlike(lowered, F.lit(_CANONICAL)), lowered).when(
        F.rlike(lowered, F.lit(_OTHER_SPELLING)), dashed(digits)
    )


def payload_uuid(payload: Column) -> Column:
    """An id that depends on the payload alone, so a retried read gives the same id."""
    return dashed(F.substring(F.sha2(payload, 256), 1, 32))
