"""Helpers that shape a plan without changing its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame) -> DataFrame:
    """The same rows, with derived columns as values: what follows doesn't repeat their expressions at each use.

    Else many predicates over derived columns make one method that is too large for the
    JVM's compiler (8,000 bytes), and the whole scan is interpreted. Filters on columns
    of a source need no such stop, and are pushed to it.
    """
    return df.select(F.inline(F.array(F.struct(*(F.col(c) for c in df.columns)))))
