"""Problem 4: all similar pairs of sets, by recursive chosen-path splitting."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.sets import distinct_sets
from verdigris.plans.scratch import keep, materialise, scratch


def _u(*cols: Column | str) -> Column:
    """A fixed uniform number in [0, 1) of the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / float(1 << 52)


def parity_sketch(items: Column) -> Column:
    """64 bits, each the parity of the items that fall on it: two sets differ in at least as many items as bits."""
    return F.aggregate(items, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))))


def trees_for(recall: float, boost: float) -> int:
    """How many trees find a pair with probability ``recall``.

    A pair shares at least ``boost`` child nodes a level on average, by independent choices. So a tree loses it at most as
    often as a branching process with Poisson offspring dies out, however deep the tree is.
    """
    if not (0 < recall < 1 and boost > 1):
        raise ValueError("recall must be in (0, 1) and boost above 1")
    lost = 0.0
    for _ in range(10_000):
        lost = math.exp(boost * (lost - 1))
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


class _Join:
    """Pairs of rows ``(rid, n, sketch)`` that meet under a key and may be similar enough."""

    def __init__(self, threshold: float):
        self.threshold, self.spread = threshold, (1 - threshold) / (1 + threshold)

    def __call__(self, left: DataFrame, right: DataFrame, keys: list[str], also: Column | None = None) -> DataFrame:
        """``left`` and ``right`` hold the same rows; with ``also`` in place of the order of ids, they need not."""
        y = right.select(*(F.col(k).alias(f"{k}_") for k in keys), *(F.col(c).alias(f"{c}_") for c in right.columns if c not in keys))
        both, least = F.col("n") + F.col("n_"), F.least("n", "n_")
        on = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"{k}_") for k in keys))
        on &= (F.col("rid") < F.col("rid_")) if also is None else also
        on &= least >= self.threshold * (both - least) - 1e-9
        on &= F.bit_count(F.col("sketch").bitwiseXOR(F.col("sketch_"))) <= self.spread * both + 1e-9
        return left.join(y, on).select(F.least("rid", "rid_").alias("p"), F.greatest("rid", "rid_").alias("q"))


def similar_sets(df: DataFrame, id_col: str, items: str, threshold: float = 0.6, recall: float = 0.999, boost: float = 1.5, node_size: int = 64, shrink: float = 0.9, block: int = 2000, max_depth: int = 30, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """Every two ids whose item sets have a Jaccard similarity of at least ``threshold``.

    ``items`` is an array of hashes (:func:`verdigris.llm.sets.item_set`). Returns ``members(id, cls)``, where a
    class is a set that occurs, and ``pairs(a, b, common, jaccard)`` of different classes, ``a < b``; ids of one
    class are alike and not paired here. Empty and null sets are in no class. An empty table gives empty results.

    A tree's root holds all sets. A node's sets are branched on the items which the node's random function picks: at depth
    d, a set of n items picks each of those not in its path with probability ``boost / (threshold * n - d)``, so that a
    qualifying pair shares at least ``boost`` children on average at every depth, nested sets included, and the number of
    trees follows from ``recall`` (:func:`trees_for`). Nodes of at most ``node_size`` sets are compared within.

    A larger node branches on as long as that pays: the pairs in its children must be fewer than ``shrink`` times its
    own. So pairs fall from level to level, and with them the rows. Where they would not (many near copies of
    one set, or sets with a common part), or beyond ``max_depth``, the node is joined as it is, exactly: by the prefixes of
    its sets, rarest items first, which any qualifying pair shares in an item; or, where the prefixes meet more often than
    there are pairs, by comparing all its pairs in blocks. No node is cut, capped or left out. Two sets that have met so in
    one node are not compared in another one. Pairs that the items of a path alone make similar are taken wherever they
    are. Pairs found are verified exactly.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    with scratch(df.sparkSession):
        members, classes = distinct_sets(df.where(F.size(items) > 0), id_col, items)
        members = keep(materialise(members, "members"))
        classes = materialise(classes.withColumn("rid", F.monotonically_increasing_id()).withColumn("sketch", parity_sketch(F.col("items"))), "sets")
        near = _Join(threshold)
        found: list[DataFrame] = []
        dense: list[DataFrame] = []
        cols = ["rid", "n", "sketch", "node"]
        trees = F.array(*(F.xxhash64(F.lit(k), F.lit(seed)) for k in range(trees_for(recall, boost))))
        level = classes.select("rid", "n", "sketch", F.explode(trees).alias("node"), F.lit(classes.count()).alias("here"), F.array().cast("array<bigint>").alias("path"))
        for depth in range(max_depth + 1):
            held = level.join(classes.select("rid", "items"), "rid").withColumn("rest", F.array_except("items", "path")).drop("items")
            if depth:
                found.append(_by_path(level, depth * (1 + threshold) / threshold))
            if depth == max_depth:
                dense.append(_stuck(held, depth, threshold, near, found))
                break
            room = F.col("n") * threshold - depth
            chance = F.when(room <= boost, 1.0).otherwise(boost / room)
            kids = held.withColumn("chance", chance).withColumn("item", F.explode(F.filter("rest", lambda x: _u(F.col("node"), x, F.lit(seed)) < F.col("chance"))))
            kids = kids.select("rid", "n", "sketch", F.col("node").alias("parent"), F.col("here").alias("held"), F.xxhash64("node", "item", F.lit(seed)).alias("node"), F.array_append("path", F.col("item")).alias("path"))
            sizes = materialise(kids.groupBy("parent", "node").agg(F.count("*").alias("here"), F.first("held").alias("held")).where("here > 1"), "sizes")
            after = F.sum(F.col("here") * (F.col("here") - 1).cast("double"))
            stuck = sizes.groupBy("parent").agg(after.alias("after"), F.first("held").alias("held")).where((F.col("held") > node_size) & (F.col("after") >= shrink * F.col("held") * (F.col("held") - 1)))
            stuck = stuck.select(F.col("parent").alias("node"))
            kept = sizes.select("parent", "node", "here")
            if not stuck.isEmpty():
                stuck = materialise(stuck, "stuck")
                dense.append(_stuck(held.join(stuck, "node", "left_semi"), depth, threshold, near, found))
                kept = kept.join(stuck.withColumnRenamed("node", "parent"), "parent", "left_anti")
            down = materialise(kids.drop("held", "parent").join(kept.drop("parent"), "node"), "nodes")
            small = down.where(F.col("here") <= node_size)
            found.append(near(small.select(cols), small.select(cols), ["node"]))
            level = down.where(F.col("here") > node_size)
            if level.isEmpty():
                break
        found += _all_pairs(dense, near, block)
        pairs = materialise(reduce(DataFrame.union, found).distinct(), "pairs")
        one = classes.select(F.col("rid").alias("p"), F.col("cls").alias("x"), F.col("items").alias("left"))
        two = classes.select(F.col("rid").alias("q"), F.col("cls").alias("y"), F.col("items").alias("right"))
        exact = pairs.join(one, "p").join(two, "q").withColumn("common", F.size(F.array_intersect("left", "right")))
        total = F.size("left") + F.size("right") - F.col("common")
        # the bound in whole numbers: a similarity of exactly the threshold must not fall to rounding
        scale = 10 ** max(1, min(9, len(repr(threshold).split(".")[-1])))
        exact = exact.where(F.col("common") * scale >= math.floor(threshold * scale + 0.5) * total)
        exact = exact.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "common", (F.col("common") / total).alias("jaccard"))
        return members, keep(materialise(exact, "similar"))


def _by_path(level: DataFrame, most: float) -> DataFrame:
    """Pairs of one node with at most ``most`` items together, which its path makes similar: joined by size, so that only
    these pairs are made."""
    left = level.select("rid", "n", "node").where(2 * F.col("n") <= most + 1e-9)
    left = left.withColumn("m", F.explode(F.sequence("n", F.floor(F.lit(most) - F.col("n") + 1e-9).cast("int"))))
    right = level.select(F.col("rid").alias("r"), F.col("n").alias("m"), "node").where(F.col("m") <= most)
    return left.join(right, ["node", "m"]).where("n < m or rid < r").select(F.least("rid", "r").alias("p"), F.greatest("rid", "r").alias("q"))


def _stuck(rows: DataFrame, depth: int, threshold: float, near: _Join, found: list[DataFrame]) -> DataFrame:
    """Join large nodes exactly that branching would not shrink; returns the rows of those to be compared whole.

    Two sets that their path alone does not make similar share an item beyond it, and one of the ``rest - need + 1`` first
    in any common order, ``need`` being how many items beyond the path a partner must share at least.
    """
    need = F.ceil(F.col("n") * threshold - 1e-9) - depth
    rows = rows.withColumn("length", F.least(F.size("rest"), F.size("rest") - need + 1))
    each = rows.select("node", "here", "rid", "n", "sketch", "length", F.explode("rest").alias("item"))
    often = each.groupBy("node", "item").agg(F.count("*").alias("often"))
    order = Window.partitionBy("node", "rid").orderBy("often", "item")
    prefix = each.join(often.where("often > 1"), ["node", "item"], "left").withColumn("often", F.coalesce("often", F.lit(1)))
    prefix = materialise(prefix.withColumn("k", F.row_number().over(order)).where("k <= length").drop("k", "length"), "prefixes")
    meet = prefix.groupBy("node", "item").agg(F.count("*").alias("c"), F.first("here").alias("here")).groupBy("node").agg(F.sum(F.col("c") * (F.col("c") - 1).cast("double")).alias("meet"), F.first("here").alias("here"))
    dense = materialise(meet.where("meet >= here * (here - 1.0D)").select("node"), "dense")
    sparse = prefix.where("often > 1").join(dense, "node", "left_anti").select("rid", "n", "sketch", "node", "item")
    found.append(near(sparse, sparse, ["node", "item"]).distinct())
    return rows.join(dense, "node", "left_semi").select("rid", "n", "sketch", "node", "here")


def _all_pairs(dense: list[DataFrame], near: _Join, block: int) -> list[DataFrame]:
    """All pairs of each dense node, in blocks of about ``block`` sets. A set's home is the largest of its dense nodes;
    two sets of one home are compared there alone."""
    if not dense:
        return []
    rows = materialise(reduce(DataFrame.union, dense), "dense")
    home = rows.groupBy("rid").agg(F.max(F.struct("here", "node")).alias("h")).select("rid", F.col("h.node").alias("home"))
    rows = rows.join(home, "rid").withColumn("blocks", F.ceil(F.col("here") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    rows = materialise(rows.drop("here"), "blocks")
    left = rows.withColumn("other", F.explode(F.expr("sequence(own, blocks - 1)"))).drop("blocks")
    right = rows.withColumnRenamed("own", "other").withColumn("own", F.explode(F.expr("sequence(0, other)"))).drop("blocks")
    order = (F.col("own") < F.col("other")) | (F.col("rid") < F.col("rid_"))
    return [near(left, right, ["node", "own", "other"], order & ((F.col("home") != F.col("home_")) | (F.col("home") == F.col("node"))))]
