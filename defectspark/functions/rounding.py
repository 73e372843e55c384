"""The three rounding rules that decide counts and pixel positions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up_product(n: Column, fraction: float) -> Column:
    """Decimal ``n * fraction`` rounded half up (stratum test counts)."""
    exact = Decimal(str(fraction))
    return F.round(n.cast("decimal(20,0)") * F.lit(exact), 0).cast("long")


def floor_half_up(value: Column) -> Column:
    """``floor(value + 0.5)`` in double arithmetic (second split)."""
    return F.floor(value + F.lit(0.5)).cast("long")


def half_even(value: Column) -> Column:
    """Nearest integer, ties to the even neighbour (pixel positions)."""
    return F.bround(value, 0).cast("long")


def fixed_text(value: Column, digits: int) -> Column:
    """Number with ``digits`` decimals, ties to the even digit; null stays null."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", F.bround(value, digits)))


def lenient_fixed_text(value: Column, digits: int = 4, missing: str = "N/A") -> Column:
    """Text number with fixed decimals, or ``missing`` when it does not parse."""
    number = F.trim(value).try_cast("double")
    return F.coalesce(fixed_text(number, digits), F.lit(missing))


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(value, high))
