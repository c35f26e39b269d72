"""Problem 2: a sample whose categories have given shares."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.plans.scratch import keep, materialise, scratch

MAX_TARGETS = 100_000  # target cells are configuration; more than this is refused, as quotas are set on the driver
BINS = 4096


def _quotas(cells: list[dict], total: int) -> None:
    """Give every cell its quota: its share of ``total``, at least its minimum, ``total`` in all.

    Cells whose minimum exceeds their share are fixed at it, those first whose minimum is largest for their share; the
    others divide the rest in proportion, by largest remainder.
    """
    for c in cells:
        c["quota"] = c["min_count"]
    free = sorted((c for c in cells if c["target_share"] > 0), key=lambda c: (-c["min_count"] / c["target_share"], c["key"]))
    rest, share = total - sum(c["min_count"] for c in cells if c["target_share"] <= 0), math.fsum(c["target_share"] for c in free)
    fixed = 0
    while fixed < len(free) and free[fixed]["target_share"] * max(0, rest) < free[fixed]["min_count"] * share:
        rest, share = rest - free[fixed]["min_count"], share - free[fixed]["target_share"]
        fixed += 1
    free, rest = free[fixed:], max(0, rest)
    if free:
        share = math.fsum(c["target_share"] for c in free)
        exact = [c["target_share"] / share * rest for c in free]
        for c, x in zip(free, exact):
            c["quota"] = int(x)
        short = rest - sum(c["quota"] for c in free)
        order = sorted(range(len(free)), key=lambda k: (int(exact[k]) - exact[k], free[k]["key"]))
        for k in order[:short]:
            free[k]["quota"] += 1


def _cut(rows: DataFrame, names: list[str], plan: DataFrame) -> DataFrame:
    """Of each cell's rows the ``take`` with the least ``u`` among those under ``p``: a histogram finds the bin in which they
    are complete, and only that bin is ranked."""
    near = rows.join(F.broadcast(plan), names).where("u < p").withColumn("bin", F.floor(F.col("u") / F.col("p") * BINS).cast("int"))
    counts = near.groupBy(*names, "bin").agg(F.count("*").alias("n"), F.first("take").alias("take"))
    w = Window.partitionBy(*names).orderBy("bin")
    cut = counts.withColumn("upto", F.sum("n").over(w)).withColumn("before", F.col("upto") - F.col("n")).where("before < take")
    near = near.drop("take").join(cut.select(*names, "bin", "take", "upto", "before"), [*names, "bin"])
    whole = near.where("upto <= take").select("id", *names)
    edge = near.where("upto > take").withColumn("r", F.row_number().over(Window.partitionBy(*names, "bin").orderBy("u", "id")))
    return whole.unionByName(edge.where("before + r <= take").select("id", *names))


def sample_to_targets(df: DataFrame, targets: DataFrame, id_col: str, categories: list[str], fraction: float = 0.2, oversample: float = 1.1, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Draw ``fraction`` of the distinct ids of ``df`` with the shares of ``targets``; returns (sample, report).

    ``targets`` has the category columns, ``target_share`` and ``min_count``. Category values are trimmed and
    lower-cased on both sides; repeated rows of an id count once, and an id that stands in several categories
    takes the smallest of them. Rows with a null id do not count; ids with a null category count in the size
    of the sample but are in no cell. Empty tables give an empty sample and a report of deficits.

    Every id has a fixed uniform number. An id is accepted independently with its cell's probability, the
    ratio of quota to observed times ``oversample`` plus four standard deviations, so that a cell hardly ever
    comes out short; a histogram of the accepted numbers then finds the bin in which the quota is reached,
    and only that bin is ranked. So a cell with a third of all rows is cut exactly without gathering it, and
    should a cell's accepted rows fall short, all its rows are used. Cells with fewer ids than their quota
    give all they have.

    sample: the id, the category columns. report: one row a cell with ``available, wanted`` (the greater of
    ``min_count`` and ``target_share`` times the size), ``quota, drawn, deficit, share`` and ``short``.
    """
    with scratch(df.sparkSession):
        return _sample_to_targets(df, targets, id_col, categories, fraction, oversample, seed)


def _sample_to_targets(df: DataFrame, targets: DataFrame, id_col: str, categories: list[str], fraction: float, oversample: float, seed: int) -> tuple[DataFrame, DataFrame]:
    spark = df.sparkSession
    norm = [F.lower(F.trim(F.col(c).cast("string"))).alias(f"c{k}") for k, c in enumerate(categories)]
    names = [f"c{k}" for k in range(len(categories))]
    rows = df.select(F.col(id_col).alias("id"), *norm).where("id is not null")
    full = F.when(F.forall(F.array(*names), lambda x: x.isNotNull()), F.struct(*names))
    rows = rows.groupBy("id").agg(F.min(full).alias("c")).select("id", "c.*").withColumn("u", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52))
    rows = materialise(rows, "cells")
    goal = targets.select(*norm, F.col("target_share").cast("double"), F.coalesce(F.col("min_count").cast("long"), F.lit(0)).alias("min_count"))
    goal = goal.where(" and ".join(f"{c} is not null" for c in names)).groupBy(*names).agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max("min_count").alias("min_count"))
    total = rows.count()
    size = total // round(1 / fraction) if abs(1 / fraction - round(1 / fraction)) < 1e-9 else int(total * fraction)
    found = goal.join(rows.groupBy(*names).agg(F.count("*").alias("available")), names, "left")
    got = found.limit(MAX_TARGETS + 1).collect()
    if len(got) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target cells")
    cells = [x.asDict() | {"available": x.available or 0, "key": tuple(x[c] for c in names)} for x in got]
    _quotas(cells, size)
    for c in cells:
        c["take"] = min(c["quota"], c["available"])
        mean = c["take"] * oversample + 4 * c["take"] ** 0.5 + 4
        c["p"] = 1.0 if c["take"] == c["available"] else min(1.0, mean / c["available"])
    kinds = ", ".join(f"{c} string" for c in names)
    plan = spark.createDataFrame([tuple(c[x] for x in (*names, "take", "p")) for c in cells], f"{kinds}, take long, p double")
    sample = materialise(_cut(rows, names, plan), "sample")
    drawn = {tuple(x[c] for c in names): x["n"] for x in sample.groupBy(*names).agg(F.count("*").alias("n")).limit(MAX_TARGETS).collect()}
    retry = [c for c in cells if drawn.get(c["key"], 0) < c["take"]]
    if retry:  # a cell where chance gave too few: the same cut, over all its rows
        again = spark.createDataFrame([tuple(c[x] for x in (*names, "take")) + (1.0,) for c in retry], f"{kinds}, take long, p double")
        sample = sample.join(F.broadcast(again.select(*names)), names, "left_anti").select("id", *names).unionByName(_cut(rows, names, again))
        sample = materialise(sample, "sample")
        drawn |= {c["key"]: c["take"] for c in retry}
    out = []
    for c in cells:
        want, n = max(float(c["min_count"]), c["target_share"] * size), drawn.get(c["key"], 0)
        out.append((*c["key"], c["target_share"], c["min_count"], size, c["available"], want, c["quota"], n, c["quota"] - n, n / size if size else 0.0, c["available"] < want))
    kinds = ", ".join(f"`{c}` string" for c in categories)
    report = spark.createDataFrame(out, f"{kinds}, target_share double, min_count long, size long, available long, wanted double, quota long, drawn long, deficit long, share double, short boolean")
    sample = keep(sample)
    return sample.select(F.col("id").alias(id_col), *(F.col(n).alias(c) for n, c in zip(names, categories))), report
