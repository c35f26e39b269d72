"""Problem 7: mixing sources to target weights, by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.copies import numbered
from verdigris.plans.scratch import keep, materialise, scratch

MAX_SOURCES = 10_000  # sources with a weight are configuration


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` without replacement are among the ``good``, for numbers of any size.

    Beyond what numpy takes, the law's own weights are summed around its mode; where its deviation exceeds 100,000, so that
    the steps cannot be told apart, the rounded normal law stands in.
    """
    total = good + bad
    if total < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    least, most = max(0, draws - bad), min(draws, good)
    share = good / total
    deviation = math.sqrt(draws * share * (1 - share) * ((total - draws) / (total - 1)))
    if deviation > 100_000:
        return min(most, max(least, round(rng.normal(draws * share, deviation))))
    lo, hi = (min(most, max(least, math.floor(draws * share + k * (12 * deviation + 5)))) for k in (-1, 1))
    k = np.arange(lo, hi, dtype=np.float64)
    steps = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))
    weights = np.concatenate([[0.0], np.cumsum(steps)])
    law = np.cumsum(np.exp(weights - weights.max()))
    return lo + int(np.searchsorted(law, rng.random() * law[-1], "right"))


def shard_quotas(shard: int, shards: int, blocks: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """How many blocks of each source a shard gets, and which is its first.

    The tree's root holds all blocks; a node splits its shards in halves and draws the left half's blocks from
    its own by a multivariate hypergeometric law, source by source, so that every shard is a fair sample of the whole and the
    quotas add up exactly, whatever their size. A node's draw depends on the seed and its place alone: any shard finds its
    own path in O(log shards), without the others.
    """
    lo, hi, own, first = 0, shards, blocks.astype(np.int64), np.zeros(len(blocks), np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rest = int(own.sum())
        wanted = rest * (mid - lo) // (hi - lo)
        rng, left = np.random.default_rng([seed, lo, hi]), np.zeros_like(own)
        for k, n in enumerate(own.tolist()):
            if not wanted:
                break
            left[k] = hypergeometric(rng, n, rest - n, wanted)
            rest, wanted = rest - n, wanted - int(left[k])
        if shard < mid:
            hi, own = mid, left
        else:
            lo, own, first = mid, own - left, first + left
    return own, first


def mix_sources(df: DataFrame, id_col: str, source: str, size_col: str, weights: DataFrame, total: int | str | None = None, block: int = 16_384, shard_size: int = 4_000_000, rows_a_bin: int = 20_000, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Combine the records of all sources with the shares of ``weights``; returns (mixture, report).

    ``weights`` has ``source, target_share, max_repeats``; source names are trimmed and lower-cased on both
    sides. ``total`` is the size wanted, or "all" for that of all usable records of the weighted sources; by default
    the largest at which every source that has records can give its share within its repeats: there the scarcest source
    sets the size for all. Where a total asks more of a source than its repeats allow, it gives what it may, the
    others' quotas stay, and the report shows the share reached. Shares are taken among the sources that have records.
    Records with a null id or source, a source without a weight or a size that is null or not positive are not
    used; repeated rows are records of their own; empty tables give an empty mixture. In what order or files the rows come
    does not matter.

    A source's records stand in a random order, anew for each repeat, and are used whole from its start until
    its quota is reached (passing it by less than one record). Positions in that order are running sums of
    sizes, found from the totals of hash bins of about ``rows_a_bin`` rows and sums within a bin, so that no
    source, however large, is gathered in one task. Runs of ``block`` are a source's blocks; permuted, they
    are dealt to output shards of about ``shard_size`` by :func:`shard_quotas`, and shuffled within the shard.

    mixture: ``shard, position, source, item_id, repeat, size``. report: per source ``target_share, available,
    max_repeats, quota, used, actual_share, repeats, reached, unused``: ``unused`` is the share of what a source has
    that is in no record of the mixture.
    """
    with scratch(df.sparkSession):
        return _mix_sources(df, id_col, source, size_col, weights, total, block, shard_size, rows_a_bin, seed)


def _mix_sources(df: DataFrame, id_col: str, source: str, size_col: str, weights: DataFrame, total: int | str | None, block: int, shard_size: int, rows_a_bin: int, seed: int) -> tuple[DataFrame, DataFrame]:
    spark = df.sparkSession
    name = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    rows = df.select(F.col(id_col).alias("item_id"), name(source).alias("source"), F.col(size_col).cast("long").alias("size"))
    rows = rows.where("item_id is not null and source is not null and size > 0")
    rows = materialise(numbered(rows), "sizes")
    goal = weights.select(name("source").alias("source"), F.col("target_share").cast("double").alias("share"), F.coalesce(F.col("max_repeats").cast("long"), F.lit(1)).alias("most"))
    goal = goal.where("source is not null").groupBy("source").agg(F.sum(F.coalesce("share", F.lit(0.0))).alias("share"), F.max("most").alias("most"))
    got = goal.join(rows.groupBy("source").agg(F.sum("size").alias("held"), F.count("*").alias("n")), "source", "left").orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(got) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    use = [r for r in got if r.held and r.share > 0 and r.most > 0]
    whole = sum(r.share for r in use)
    if isinstance(total, str):
        if total != "all":
            raise ValueError('total must be a number or "all"')
        total = sum(r.held for r in use)
    size = total if total is not None else min((math.floor(r.most * r.held * whole / r.share) for r in use), default=0)
    quota = {r.source: min(math.floor(size * r.share / whole + 0.5), r.most * r.held) for r in use}
    use = [r for r in use if quota[r.source] > 0]
    plan = [(k, r.source, r.held, quota[r.source], -(-quota[r.source] // r.held), max(1, r.n // rows_a_bin)) for k, r in enumerate(use)]
    blocks = np.array([-(-p[3] // block) for p in plan], np.int64)
    facts = F.broadcast(spark.createDataFrame(plan, "sid int, source string, held long, quota long, rounds long, bins long"))
    draw = rows.join(facts, "source").withColumn("repeat", F.explode(F.expr("sequence(0L, rounds - 1)")))
    draw = draw.withColumn("key", F.pmod(F.xxhash64("item_id", "size", "copy", "repeat", F.lit(seed)), F.lit(1 << 52))).withColumn("bin", F.floor(F.col("key") / F.lit(float(1 << 52)) * F.col("bins")))
    totals = draw.groupBy("sid", "repeat", "bin").agg(F.sum("size").alias("here"))
    ahead = Window.partitionBy("sid", "repeat").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("sid", "repeat", "bin", F.coalesce(F.sum("here").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("sid", "repeat", "bin").orderBy("key", "item_id", "size", "copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = draw.join(totals, ["sid", "repeat", "bin"]).withColumn("start", F.col("repeat") * F.col("held") + F.col("before"))
    placed = placed.where("start < quota").withColumn("start", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))).where("start < quota")
    # block numbers permuted: k -> (k * step + 1) mod blocks, with a step prime to the number of blocks
    steps = []
    for n in blocks.tolist():
        step = int(n * 0.6180339887) or 1
        while math.gcd(step, n) > 1:
            step += 1
        steps.append(step)
    perm = F.broadcast(spark.createDataFrame([(k, int(n), s) for k, (n, s) in enumerate(zip(blocks.tolist(), steps))], "sid int, blocks long, step long"))
    placed = placed.join(perm, "sid").withColumn("slot", F.pmod(F.floor(F.col("start") / block) * F.col("step") + 1, F.col("blocks")))
    shards = max(1, round(sum(quota.values()) / shard_size))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for shard in x["id"].tolist():
                own, first = shard_quotas(shard, shards, blocks, seed)
                yield pd.DataFrame({"shard": np.full(int(own.sum()), shard, np.int64), "sid": np.repeat(np.arange(len(own), dtype=np.int32), own), "slot": np.concatenate([np.arange(a, a + n) for a, n in zip(first.tolist(), own.tolist())] or [np.zeros(0)]).astype(np.int64)})

    dealt = spark.range(shards).mapInPandas(deal, "shard long, sid int, slot long")
    order = Window.partitionBy("shard").orderBy(F.xxhash64("key", F.lit(seed + 1)), "sid", "item_id", "size", "copy", "repeat")
    mixture = placed.join(dealt, ["sid", "slot"]).withColumn("position", F.row_number().over(order) - 1)
    mixture = keep(materialise(mixture.select("shard", "position", "source", "item_id", F.col("repeat").cast("int").alias("repeat"), "size"), "mixture"))
    sums = mixture.groupBy("source").agg(F.sum("size").alias("used"), F.sum(F.when(F.col("repeat") == 0, F.col("size"))).alias("once")).collect()
    used, once = {r.source: r.used for r in sums}, {r.source: r.once for r in sums}
    made = sum(used.values())
    out = [(r.source, r.share, r.held or 0, r.most, quota.get(r.source, 0), used.get(r.source, 0), used.get(r.source, 0) / made if made else 0.0, used.get(r.source, 0) / r.held if r.held else 0.0, bool(r.held) and quota.get(r.source, 0) >= math.floor(size * r.share / (whole or 1)), 1 - once.get(r.source, 0) / r.held if r.held else 0.0) for r in got]
    report = spark.createDataFrame(out, "source string, target_share double, available long, max_repeats long, quota long, used long, actual_share double, repeats double, reached boolean, unused double")
    return mixture, report
