"""Problem 5: the N best items of every group, by partition lower bounds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int = 3, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """The first ``n`` items of each group by score downward, then item upward in byte order.

    An item's score is its highest one in the group; rows with a null group, item or score, a NaN score, or a
    score outside ``[lo, hi]`` do not count. Repeated rows count once, equal scores are settled by the item,
    groups with fewer than ``n`` items give what they have, an empty table gives no row, and other columns of
    ``df``, whatever their names, are ignored. Out come ``group, item, score, rank``.

    One pass keeps, in every input partition, each group's local n best items and the score of the n-th: as n
    different items reach it, it is a lower bound for the group's final n-th best. The highest bound of a
    group is joined back, rows under it go, and only the survivors are ranked. So at most n rows a group and
    partition are shuffled, however many millions of rows the group has.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.select(F.col(group).cast("string").alias("g"), F.col(item).cast("string").alias("i"), F.col(score).cast("double").alias("s"))
    rows = rows.where("g is not null and i is not null and s is not null and not isnan(s)")
    if lo is not None:
        rows = rows.where(F.col("s") >= lo)
    if hi is not None:
        rows = rows.where(F.col("s") <= hi)

    def best(x: pd.DataFrame) -> pd.DataFrame:
        # Python compares strings by code point, which is UTF-8 byte order
        x = x.sort_values(["g", "s", "i"], ascending=[True, False, True], kind="stable").drop_duplicates(["g", "i"])
        return x[x.groupby("g", sort=False).cumcount() < n]

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        size = last = 0
        for x in batches:
            kept.append(best(x))
            size += len(kept[-1])
            if size > 2 * last + 50_000:  # merged when it has doubled: the work stays in proportion to the input
                kept = [best(pd.concat(kept))]
                size = last = len(kept[0])
        if kept:
            x = best(pd.concat(kept))
            x["bound"] = x["s"].where(x.groupby("g", sort=False).cumcount() == n - 1)
            for at in range(0, len(x), 50_000):
                yield x.iloc[at : at + 50_000]

    near = rows.mapInPandas(local, "g string, i string, s double, bound double")
    # the window joins each group's highest bound to its rows within the one exchange that ranking needs anyway
    left = near.withColumn("least", F.max("bound").over(Window.partitionBy("g"))).where("least is null or s >= least")
    left = left.groupBy("g", "i").agg(F.max("s").alias("s"))
    w = Window.partitionBy("g").orderBy(F.desc("s"), F.asc("i"))
    ranked = left.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= n)
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")
