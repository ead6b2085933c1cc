"""Previews, titles and token estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callscope.schemas import CHARS_PER_TOKEN, PREVIEW_CHARS, TITLE_CHARS


def preview(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    return F.substring(text, 1, chars)


def title(text: Column, chars: int = TITLE_CHARS) -> Column:
    """The first characters, with an ellipsis where something was cut."""
    cut = F.substring(text, 1, chars)
    return F.concat(cut, F.when(F.length(text) > chars, F.lit("…")).otherwise(F.lit("")))


def estimated_tokens(total_chars: Column, chars_per_token: int = CHARS_PER_TOKEN) -> Column:
    """Token estimate of a character total: sum the lengths first, then divide and floor."""
    return F.floor(total_chars / F.lit(chars_per_token)).cast("long")
