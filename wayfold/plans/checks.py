"""How results are rounded so that two engines can be compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 6
#: Added before rounding, so that values halfway between two results don't fall either way.
SHIFT = 3.7e-8


def r(c: Column | str) -> Column:
    """Rounded double without a negative zero."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double") + SHIFT, DIGITS) + F.lit(0.0)


def sql(c: str) -> str:
    return f"(round(({c})::DOUBLE + {SHIFT}::DOUBLE, {DIGITS}) + 0.0)"
