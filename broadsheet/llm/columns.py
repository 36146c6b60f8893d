"""Column names and join sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side of a join is broadcast up to so many narrow rows, some tens of megabytes; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has in any capitalisation."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def is_small(df: DataFrame) -> bool:
    """Whether ``df`` is counted to have few enough rows to be broadcast."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def small_side(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to be small; else as it is, for Spark to shuffle."""
    return F.broadcast(df) if is_small(df) else df
