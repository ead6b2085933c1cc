"""Token pricing in exact decimals."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_cost(
    tokens_in: Column, tokens_out: Column, input_rate: Column, output_rate: Column
) -> Column:
    """USD for a call, rates per million tokens, half-even at eight places.

    A missing count costs nothing; a missing rate gives null.  Counts are 32 bits wide, so the
    result always fits.
    """

    def part(tokens: Column, rate: Column) -> Column:
        count = F.coalesce(tokens, F.lit(0)).cast("decimal(10,0)")
        return count * rate.cast("decimal(9,3)")

    total = part(tokens_in, input_rate) + part(tokens_out, output_rate)
    return F.bround(total * F.lit(Decimal("0.000001")), 8).cast("decimal(20,8)")
