"""Telling equal rows apart, whatever files they come in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numbered(df: DataFrame, name: str = "copy") -> DataFrame:
    """``df`` with the number of each row among those equal to it, from 0: counted, so that neither order nor files
    matter, and a row that occurs very often is not sorted."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("times_")).select(*df.columns, F.explode(F.expr("sequence(0L, times_ - 1)")).alias(name))
