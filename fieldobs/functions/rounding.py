"""The two rounding rules of the data model.

Both first settle the value to ten decimals: a mean then gives the same digit
whatever order its partial sums were merged in. A value too large to settle gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def settle(x: Column) -> Column:
    return x.try_cast("decimal(30,10)").cast("double")


def js_round(x: Column, digits: int) -> Column:
    """Half toward positive infinity: -0.25 at one digit is -0.2."""
    scale = F.lit(float(10**digits))
    return F.floor(settle(x) * scale + F.lit(0.5)) / scale


def pg_round(x: Column, digits: int) -> Column:
    """Half away from zero: -0.25 at one digit is -0.3."""
    return F.round(x.try_cast("decimal(30,10)"), digits).cast("double")
