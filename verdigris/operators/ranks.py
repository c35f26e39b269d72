"""Ranks and running positions over a whole table, without sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.plans.scratch import materialise

def _prefix(counts: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """``counts(*by, value, n)`` of distinct values plus ``before``, the n of all lesser values of the same ``by``.

    The values are cut into ranges of about equal length at bounds taken from a sample, so that a far value makes no range
    long, and written once; sums run within a range, and over the totals of the ranges, one a partition and ``by``.
    """
    rows = materialise(counts.repartitionByRange(*by, value).withColumn("part_", F.spark_partition_id()), "ranges")
    over = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "part_").agg(F.sum("n").alias("held_")).select(*by, "part_", F.coalesce(F.sum("held_").over(over), F.lit(0)).alias("base_"))
    inside = Window.partitionBy(*by, "part_").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(totals), [*by, "part_"]) if not by else rows.join(totals, [*by, "part_"])
    return rows.select(*by, value, "n", (F.col("base_") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before"))


def average_rank(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """``df`` with the 1-based rank of ``value``, ties sharing the mean of theirs, within ``by`` or over all rows; rows
    with a null value go. The distinct values are ranked, not the rows, and the ranks joined back."""
    rows = df.where(F.col(value).isNotNull())
    ranks = _prefix(rows.groupBy(*by, value).agg(F.count("*").alias("n")), value, by)
    ranks = ranks.select(*by, value, (F.col("before") + (F.col("n") + 1) / 2).alias(name))
    return rows.join(ranks, [*by, value])


def ordinal(df: DataFrame, major: str, minor: Sequence[str], name: str = "ord") -> DataFrame:
    """``df`` with each row's 0-based position in the order of ``major`` (a number), then ``minor``."""
    before = _prefix(df.groupBy(major).agg(F.count("*").alias("n")), major, ()).select(major, "before")
    inside = Window.partitionBy(major).orderBy(*minor)
    return df.join(before, major).withColumn(name, F.col("before") + F.row_number().over(inside) - 1).drop("before")


def positions(df: DataFrame, order: Sequence[str], name: str = "ord") -> DataFrame:
    """``df`` with each row's 0-based position in the order of any columns, over all partitions: rows are range-partitioned
    and written once; positions are those within a partition plus the sizes of the partitions before it."""
    rows = df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id())
    rows = materialise(rows, "ranges")
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sizes = rows.groupBy("part_").agg(F.count("*").alias("n_")).select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"))
    inside = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    return rows.join(F.broadcast(sizes), "part_").withColumn(name, F.col("base_") + inside - 1).drop("part_", "base_")


def spearman(df: DataFrame, left: str, right: str, by: Sequence[str] = ()) -> DataFrame:
    """The rank correlation of two columns within ``by``; 0 where a column is constant."""
    # renamed first, so that no column of the table can clash with a rank
    rows = df.select(*by, F.col(left).alias("left_"), F.col(right).alias("right_"))
    both = average_rank(average_rank(rows, "left_", by, "x_"), "right_", by, "y_")
    constant = (F.min("x_") == F.max("x_")) | (F.min("y_") == F.max("y_"))
    r = F.try_divide(F.covar_pop("x_", "y_"), F.stddev_pop("x_") * F.stddev_pop("y_"))
    return both.groupBy(*by).agg(F.when(constant, F.lit(0.0)).otherwise(r).alias("spearman"))
