"""Help for plans with costly columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, column: str) -> DataFrame:
    """Fix a costly column before rows are filtered by it.

    A filter is pushed down through the projection which works a column out, even
    through an exchange, and then the column is worked out twice.  It is not pushed
    through a generator, so the column takes the way through one: one row in, one
    row out.
    """
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.explode_outer(F.array(column)).alias(column))
