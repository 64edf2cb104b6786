"""Rates and shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct(num: Column, den: Column, scale: int = 1) -> Column:
    """``num / den`` in percent, half to even on the decimal value, 0 where there is nothing to divide by.

    Rounding of the binary value differs where the decimal one is a tie: one in
    2000 is 0.0 here and 0.1 there.
    """
    share = F.try_divide(num.cast("double"), den.cast("double")) * 100
    return F.coalesce(F.bround(share, scale), F.lit(0.0))


def whole_pct(num: Column, den: Column) -> Column:
    """``num / den`` in whole percent, half up."""
    share = F.try_divide(num.cast("double"), den.cast("double")) * 100
    return F.coalesce(F.floor(share + 0.5), F.lit(0).cast("long"))
