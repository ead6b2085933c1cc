"""Personal-data redaction as nested regular-expression replacements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label and pattern, applied in this order on the already redacted text.
PII_PATTERNS = (
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("PHONE", r"\b(?:\+?\d{1,3}[\s-]?)?\(?\d{3,4}\)?[\s-]?\d{3,4}[\s-]?\d{3,4}\b"),
    ("CARD", r"\b(?:\d[ -]?){13,19}\b"),
    ("AADHAAR", r"\b\d{4}\s?\d{4}\s?\d{4}\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
)

# Every pattern above needs one of these; text without them skips the chain.
_CANDIDATE = r"(?U)[@\d]"


def redact(
    text: Column,
    patterns: Sequence[tuple[str, str]] = PII_PATTERNS,
    candidate: str | None = None,
) -> Column:
    """Replace every match by `<LABEL_REDACTED>`.

    `(?U)` makes `\\b`, `\\d` and `\\s` Unicode-aware.  A caller with own patterns may name a
    `candidate` pattern that any match must contain; the built-in set has one.
    """
    out = text
    for label, pattern in patterns:
        out = F.regexp_replace(out, f"(?U){pattern}", f"<{label}_REDACTED>")
    if candidate is None and tuple(patterns) == PII_PATTERNS:
        candidate = _CANDIDATE
    if candidate is None:
        return out
    return F.when(F.rlike(text, F.lit(candidate)), out).otherwise(text)


def was_redacted(original: Column, redacted: Column) -> Column:
    """A replacement always changes the text, so inequality is detection."""
    return F.coalesce(original != redacted, F.lit(False))
