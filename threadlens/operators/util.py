"""Small plan helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Row bound under which a side table is broadcast. The bound is checked
# against a known row count (a dictionary, a class list, a parameter K),
# never assumed; for larger sides Spark chooses the join from their sizes.
BROADCAST_MAX_ROWS = 10_000


def broadcast_if_bounded(df: DataFrame, n_rows: int, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    return F.broadcast(df) if n_rows <= max_rows else df


def safe_div(num: Column, den: Column, zero: float | None = 0.0) -> Column:
    """num / den, or ``zero`` when the denominator is 0 (ANSI-safe)."""
    return F.when(den == 0, F.lit(zero).cast("double")).otherwise(
        num.cast("double") / den.cast("double"))


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
