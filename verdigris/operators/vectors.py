"""Vector features on arrays of floats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def pair_features(a: Column, b: Column) -> Column:
    """both vectors, their absolute difference and their product, one array."""
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: x * y))


def masked_mean(values: Column, mask: Column) -> Column:
    """the mean of the values whose mask is true, 0 if none is."""
    kept = F.filter(F.zip_with(values, mask, lambda v, m: F.when(m, v.cast("double"))), lambda x: x.isNotNull())
    return F.coalesce(F.try_divide(F.aggregate(kept, F.lit(0.0), lambda s, x: s + x), F.size(kept)), F.lit(0.0))


def top_mean(values: Column, k: int) -> Column:
    """the mean of the k largest values."""
    top = F.slice(F.sort_array(values, asc=False), 1, k)
    return F.coalesce(F.try_divide(F.aggregate(top, F.lit(0.0), lambda s, x: s + x.cast("double")), F.size(top)), F.lit(0.0))


def late_interaction(pairs: DataFrame, k: int = 5) -> DataFrame:
    """for each pair of token sequences, each token's best match on the other side: their highest, mean and mean
    of the k highest, both ways. ``pairs`` has ``pair_id, left, right``, arrays of vectors; everything stays
    within the row."""
    best = lambda xs, ys: F.transform(xs, lambda x: F.array_max(F.transform(ys, lambda y: dot(x, y))))
    rows = pairs.withColumns({"lr": best(F.col("left"), F.col("right")), "rl": best(F.col("right"), F.col("left"))})
    mean = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda s, x: s + x) / F.size(c)
    return rows.select("pair_id", *(x for c in ("lr", "rl") for x in (F.array_max(c).alias(f"{c}_max"), mean(c).alias(f"{c}_mean"), top_mean(F.col(c), k).alias(f"{c}_top"))))
