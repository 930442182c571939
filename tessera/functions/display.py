"""Display values: fixed digits by the exact binary value of a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import literals as L

#: Splits a double's 53 bits into two halves whose products are exact.
SPLIT = float(2 ** 27 + 1)


def _halves(x: Column) -> tuple[Column, Column]:
    high = x * SPLIT - (x * SPLIT - x)
    return high, x - high


def to_fixed(x: Column, digits: int) -> Column:
    """A double with a fixed number of digits, as text, as a web page shows it.

    The exact binary value decides: 1.005 (a little below it in binary) has
    ``1.00``, where Spark's ``round`` and ``format_string`` work on the shortest
    decimal and give 1.01.  Exact halves go away from zero, a negative number
    that rounds to zero keeps its sign.  NULL, ``NaN`` and ``Infinity`` stay.
    From 2^52 / 10^digits on Spark's ``format_string`` is used.
    """
    scale = float(10 ** digits)
    size = F.abs(x.cast("double"))
    high, low = _halves(size)
    scale_high = scale * SPLIT - (scale * SPLIT - scale)
    scale_low = scale - scale_high
    product = size * scale
    # what the product lost, exactly
    error = ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low
    whole = F.floor(product)
    units = whole + F.when((product - whole - 0.5) + error >= 0, 1).otherwise(0)
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    base = F.floor(units / F.lit(10 ** digits)) if digits else units
    text = base.cast("string")
    if digits:
        text = F.concat(text, F.lit("."), F.lpad((units % F.lit(10 ** digits)).cast("string"), digits, "0"))
    return (F.when(x.isNull(), None).when(F.isnan(x), F.lit("NaN"))
            .when(size == float("inf"), F.concat(sign, F.lit("Infinity")))
            .when(product >= float(2 ** 52), F.format_string(f"%.{digits}f", x))
            .otherwise(F.concat(sign, text)))


def shown_contrast(contrast: Column) -> Column:
    """The contrast as charts show it: not below the least one."""
    return F.when(contrast.isNotNull(), F.greatest(contrast, F.lit(L.LEAST_SHOWN_CONTRAST)))
