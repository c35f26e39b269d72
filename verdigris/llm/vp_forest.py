"""Problem 1: groups of near-duplicate records, by vantage-point trees over Hamming fingerprints."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.sets import set_key
from verdigris.plans.components import connected_components
from verdigris.plans.scratch import keep, materialise, scratch

SAMPLE = 2048  # sets about whose fingerprints shape and first trees are chosen by; more where deeper trees need them
MOST_SAMPLED = 1 << 18  # bounds what the driver gets to a few MB a block: trees of up to 16 levels
REACHES = (0, 1, 2, 3, 5, 8, 12)  # radii in a block that are weighed against each other
ASK = 1500  # comparisons that one more shard asked is worth: it is sent, sorted and read


def _hashes(flat: np.ndarray, factor: int) -> np.ndarray:
    x = flat.view(np.uint64) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def fingerprints(flat: np.ndarray, sizes: np.ndarray, blocks: int) -> np.ndarray:
    """[sets, blocks]: each item is dealt to a block, which keeps the parities of its items on 64 bits."""
    out, x = np.zeros(len(sizes) * blocks, np.uint64), flat.view(np.uint64)
    at = np.repeat(np.arange(len(sizes)) * blocks, sizes) + ((x >> np.uint64(40)) % np.uint64(blocks)).astype(np.int64)
    np.bitwise_xor.at(out, at, np.uint64(1) << ((x >> np.uint64(20)) & np.uint64(63)))
    return out.reshape(len(sizes), blocks)


def sketches(flat: np.ndarray, sizes: np.ndarray, wide: int) -> np.ndarray:
    """[sets, wide]: parities of all items on 64 * wide other bits, for the check of a candidate."""
    out, x = np.zeros(len(sizes) * wide, np.uint64), flat.view(np.uint64)
    at = np.repeat(np.arange(len(sizes)) * wide, sizes) + ((x >> np.uint64(6)) % np.uint64(wide)).astype(np.int64)
    np.bitwise_xor.at(out, at, np.uint64(1) << (x & np.uint64(63)))
    return out.reshape(len(sizes), wide)


def contents(flat: np.ndarray, sizes: np.ndarray, cells: int) -> np.ndarray:
    """[sets, cells]: each item is dealt to a cell, which keeps a hash of its whole content; 0 for an empty one."""
    out, x = np.zeros(len(sizes) * cells, np.uint64), _hashes(flat, 0x9E3779B97F4A7C15)
    at = np.repeat(np.arange(len(sizes)) * cells, sizes) + (_hashes(flat, 0xC2B2AE3D27D4EB4F) % np.uint64(cells)).astype(np.int64)
    np.bitwise_xor.at(out, at, x)
    return out.reshape(len(sizes), cells)


class Forest:
    """``blocks`` trees, one for each block of the fingerprint.

    The items are dealt by hash over ``blocks`` blocks, and each block keeps the parities of its items on 64
    bits. An item in one of two sets and not in the other changes at most one bit of one block. So the
    Hamming distance summed over the blocks is at most the number of items in which the sets differ, and if
    that is r at most, some block differs in r // blocks bits at most: a ball of that radius around a set's
    block fingerprint, searched in that block's tree, cannot miss the other set.
    """

    def __init__(self, prints: np.ndarray, sizes: np.ndarray, depth: int, threshold: float, seed: int = 3):
        self.blocks, self.depth, self.threshold = prints.shape[1], depth, threshold
        self.spread = (1 - threshold) / (1 + threshold)
        nodes, rng = (1 << depth) - 1, np.random.default_rng(seed)
        near = int(np.median(self.reach(sizes))) if len(sizes) else 0
        self.vantage, self.radius = np.zeros((self.blocks, nodes), np.uint64), np.zeros((self.blocks, nodes), np.int64)
        for b in range(self.blocks):
            points, order, cuts = prints[:, b], np.arange(len(prints)), [0, len(prints)]
            for level in range(depth):  # a level's nodes lie one after the other in order
                ends = [0]
                for k in range(1 << level):
                    node, own = (1 << level) - 1 + k, order[cuts[k] : cuts[k + 1]]
                    v, r = self._best(points[own] if len(own) else points, near, rng)
                    self.vantage[b, node], self.radius[b, node] = v, r
                    out = np.bitwise_count(points[own] ^ v) > r
                    order[cuts[k] : cuts[k + 1]] = np.concatenate([own[~out], own[out]])
                    ends += [cuts[k] + int((~out).sum()), cuts[k + 1]]
                cuts = ends

    @staticmethod
    def _best(points: np.ndarray, near: int, rng: np.random.Generator, tries: int = 12) -> tuple[np.uint64, int]:
        """The vantage point and radius, of some tried, with the fewest comparisons to be expected: on either
        side, its points times the asking balls of radius ``near`` that reach it."""
        if not len(points):
            return np.uint64(0), 32
        best = None
        for v in points[rng.integers(len(points), size=tries)]:
            upto = np.cumsum(np.bincount(np.bitwise_count(points ^ v), minlength=65 + 2 * near)).astype(float)
            cuts = np.arange(65)
            inside, beyond, short = upto[cuts], upto[cuts + near], upto[np.maximum(cuts - near, -1)] * (cuts >= near)
            cost = inside * beyond + (len(points) - inside) * (len(points) - short)
            c = int(np.argmin(cost))
            if best is None or cost[c] < best[0]:
                best = cost[c], v, c
        return best[1], best[2]

    @classmethod
    def of(cls, state: dict) -> Forest:
        forest = cls.__new__(cls)
        vars(forest).update(state)
        return forest

    def reach(self, n: np.ndarray) -> np.ndarray:
        """The radius in one block for partners at least as large as a set of n items."""
        most = np.floor(n / self.threshold + 1e-9)
        return np.floor(self.spread * (n + most) + 1e-9).astype(np.int64) // self.blocks

    def home(self, prints: np.ndarray, b: int) -> np.ndarray:
        node = np.zeros(len(prints), np.int64)
        for _ in range(self.depth):
            d = np.bitwise_count(prints ^ self.vantage[b, node]).astype(np.int64)
            node = 2 * node + 1 + (d > self.radius[b, node])
        return node - ((1 << self.depth) - 1)

    def levels(self, prints: np.ndarray, reach: np.ndarray, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, node), level by level, of all nodes that a row's ball may touch: a branch goes if the triangle inequality
        puts all of it outside the ball."""
        row, node = np.arange(len(prints)), np.zeros(len(prints), np.int64)
        yield row, node
        for _ in range(self.depth):
            d = np.bitwise_count(prints[row] ^ self.vantage[b, node]).astype(np.int64)
            inner, outer = d - reach[row] <= self.radius[b, node], d + reach[row] > self.radius[b, node]
            row, node = np.concatenate([row[inner], row[outer]]), np.concatenate([2 * node[inner] + 1, 2 * node[outer] + 2])
            yield row, node

    def shards(self, prints: np.ndarray, reach: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves that a row's ball may touch."""
        *_, (row, node) = self.levels(prints, reach, b)
        return row, node - ((1 << self.depth) - 1)

    def costs(self, prints: np.ndarray, sizes: np.ndarray, total: int) -> list[float]:
        """What a set's search costs, in comparisons, with trees of 0, 1, ... levels, by the sample's own balls."""
        out, reach = [0.0] * (self.depth + 1), self.reach(sizes)
        for b in range(self.blocks):
            at = np.zeros(len(prints), np.int64)
            for level, (_, node) in enumerate(self.levels(prints[:, b], reach, b)):
                held = np.bincount(at, minlength=(2 << level) - 1)
                out[level] += (ASK * len(node) + held[node].sum() * total / len(prints)) / len(prints)
                if level < self.depth:
                    d = np.bitwise_count(prints[:, b] ^ self.vantage[b, at]).astype(np.int64)
                    at = 2 * at + 1 + (d > self.radius[b, at])
        return out


def _arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column of numbers as (all values, sizes)."""
    at = column.offsets.to_numpy(zero_copy_only=False)
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], np.diff(at).astype(np.int64)


def _lists(rows: np.ndarray) -> pa.Array:
    at = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.ascontiguousarray(rows).ravel().view(np.int64)))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 4000) -> Iterator[pa.RecordBatch]:
    for x in batches:
        for at in range(0, x.num_rows, rows):
            yield x.slice(at, rows)


def _sampled(classes: DataFrame, field: int, total: int, wanted: int, choices: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sizes and fingerprints, for each number of blocks in ``choices``, of about ``wanted`` sets; no set itself comes to the driver."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _slices(batches):
            flat, sizes = _arrays(x["items"])
            yield pa.RecordBatch.from_arrays([pa.array(sizes), *(_lists(fingerprints(flat, sizes, b)) for b in choices)], ["n", *(f"b{b}" for b in choices)])

    own = classes.where((F.col("field") == field) & (F.pmod(F.xxhash64("cls"), F.lit(max(1, total // wanted))) == 0)).select("items")
    got = own.mapInArrow(read, ", ".join(["n long", *(f"b{b} array<long>" for b in choices)])).toArrow()
    n = got["n"].to_numpy()
    return n, [got[f"b{b}"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(n), b) if len(n) else np.zeros((0, b), np.uint64) for b in choices]


def _plan(classes: DataFrame, field: int, total: int, mean: float, threshold: float, leaf_size: int, reach: int | None) -> dict:
    """The shape and the trees for a field's sets: of the numbers of blocks that some radii lead to, and of the depths, the
    pair whose search costs least by the sample."""
    widest = math.floor((1 - threshold) / (1 + threshold) * (mean + mean / threshold))
    choices = sorted({max(1, widest // (r + 1) + 1) for r in (REACHES if reach is None else (reach,)) if widest // (r + 1) < 64})
    deepest = max(0, math.ceil(math.log2(max(total, 1) / leaf_size)))
    n, prints = _sampled(classes, field, total, SAMPLE, choices)
    least, blocks, depth = None, choices[0], 0
    for b, p in zip(choices, prints):
        trial = Forest(p, n, min(deepest, int(math.log2(max(len(n), 8))) - 2), threshold)
        costs = trial.costs(p, n, total) if len(n) else [0.0]
        k = int(np.argmin(costs)) if reach is None else len(costs) - 1
        k = deepest if k == len(costs) - 1 else k  # costs still falling where the sample ends: as deep as the leaf size asks
        if least is None or min(costs) < least:
            least, blocks, depth = min(costs), b, k
    depth = min(depth, int(math.log2(MOST_SAMPLED)) - 2)
    own = prints[choices.index(blocks)]
    if 4 << depth > SAMPLE and total > len(n):
        n, (own,) = _sampled(classes, field, total, 4 << depth, [blocks])
    wide, cells = max(1, min(16, round(2 * mean / 64 + 0.4))), max(4, min(32, math.ceil(mean / 5)))
    return {"forest": vars(Forest(own, n, depth, threshold)), "wide": wide, "cells": cells, "slots": blocks << depth}


def _search(keyed: DataFrame, threshold: float, leaf_size: int, reach: int | None, spanning: bool) -> DataFrame:
    """Pairs ``p, r, a, b, left_head, right_head`` of similar classes, from ``keyed(field, cls, id, items)``."""
    spark = keyed.sparkSession
    classes = keyed.groupBy("field", "cls").agg(F.first("items").alias("items"), F.min("id").alias("head"))
    classes = materialise(classes.withColumn("n", F.size("items")).withColumn("rid", F.monotonically_increasing_id()), "sets")
    facts = classes.groupBy("field").agg(F.count("*").alias("total"), F.avg("n").alias("mean")).orderBy("field").collect()
    plans, first = {}, 0
    for r in facts:
        plans[r.field] = _plan(classes, r.field, r.total, r.mean, threshold, leaf_size, reach) | {"first": first}
        first += plans[r.field]["slots"]
    wide = max((p["wide"] for p in plans.values()), default=1)
    shared = spark.sparkContext.broadcast(plans)
    words = [f"w{k}" for k in range(wide)]
    spread = (1 - threshold) / (1 + threshold)

    def each_field(x: pa.RecordBatch) -> Iterator[tuple[dict, Forest, pa.RecordBatch]]:
        fields = x["field"].to_numpy()
        for k in np.unique(fields):
            plan = shared.value[int(k)]
            yield plan, Forest.of(plan["forest"]), x.filter(pa.array(fields == k))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _slices(batches):
            for plan, f, x in each_field(whole):
                flat, sizes = _arrays(x["items"])
                prints, sketch = fingerprints(flat, sizes, f.blocks), np.zeros((len(sizes), wide), np.uint64)
                sketch[:, : plan["wide"]] = sketches(flat, sizes, plan["wide"])
                slots = np.stack([f.home(prints[:, b], b) + plan["first"] + (b << f.depth) for b in range(f.blocks)], 1)
                cols = [x["field"], x["rid"], x["n"], _lists(contents(flat, sizes, plan["cells"])), _lists(prints), _lists(slots), *(pa.array(np.ascontiguousarray(sketch[:, k]).view(np.int64)) for k in range(wide))]
                yield pa.RecordBatch.from_arrays(cols, ["field", "rid", "n", "cells", "prints", "slots", *words])

    schema = "field int, rid long, n int, cells array<long>, prints array<long>, slots array<long>, " + ", ".join(f"{w} long" for w in words)
    rows = materialise(classes.select("field", "rid", "n", "items").mapInArrow(described, schema), "prints")

    def verified(pairs: DataFrame) -> DataFrame:
        one = classes.select(F.col("rid").alias("p"), F.col("cls").alias("x"), F.col("head").alias("left_head"), F.col("items").alias("left"))
        two = classes.select(F.col("rid").alias("r"), F.col("cls").alias("y"), F.col("head").alias("right_head"), F.col("items").alias("right"))
        both = pairs.join(one, "p").join(two, "r").withColumn("common", F.size(F.array_intersect("left", "right")))
        scale = 10 ** max(1, min(9, len(repr(threshold).split(".")[-1])))
        whole = F.col("common") * scale >= math.floor(threshold * scale + 0.5) * (F.size("left") + F.size("right") - F.col("common"))
        return both.where(whole).select("p", "r", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "left_head", "right_head")

    star = None
    rows = rows.withColumn("grp", F.col("rid"))
    if spanning:
        star = materialise(verified(_stars(rows, words, spread)), "star")
        up = star.groupBy(F.col("r").alias("rid")).agg(F.min("p").alias("up"))
        top = up.select(F.col("rid").alias("up"), F.col("up").alias("top"))
        label = up.join(top, "up", "left").select("rid", F.coalesce("top", "up").alias("label"))
        rows = rows.join(label, "rid", "left").withColumn("grp", F.coalesce("label", "rid")).drop("label")
        rows = materialise(rows, "labelled")
    held = rows.select(F.explode(F.arrays_zip("slots", "prints")).alias("x"), "rid", "n", "grp", *words).select(F.col("x.slots").cast("int").alias("slot"), "rid", "n", F.col("x.prints").alias("fp"), "grp", *words)
    # a leaf of many like fingerprints is cut into parts of bounded size, and asked part by part
    parts = rows.select(F.explode("slots").alias("slot")).select(F.col("slot").cast("int").alias("slot")).groupBy("slot").agg(F.ceil(F.count("*") / (4 * leaf_size)).cast("int").alias("parts")).where("parts > 1")
    parts = materialise(parts, "parts")

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["slot", "rid", "n", "fp", "grp", *words]
        for whole in _slices(batches):
            for plan, f, x in each_field(whole):
                prints = _arrays(x["prints"])[0].view(np.uint64).reshape(x.num_rows, f.blocks)
                reach = f.reach(x["n"].to_numpy())
                for b in range(f.blocks):
                    row, leaf = f.shards(prints[:, b], reach, b)
                    y = x.select(["rid", "n", "grp", *words]).take(pa.array(row))
                    cols = [pa.array((leaf + plan["first"] + (b << f.depth)).astype(np.int32)), y["rid"], y["n"], pa.array(prints[row, b].view(np.int64)), y["grp"], *(y[w] for w in words)]
                    yield pa.RecordBatch.from_arrays(cols, names)

    asks = rows.select("field", "rid", "n", "grp", "prints", *words).mapInArrow(asking, "slot int, rid long, n int, fp long, grp long, " + ", ".join(f"{w} long" for w in words))
    if not parts.isEmpty():
        held = held.join(parts, "slot", "left").withColumn("part", F.pmod(F.xxhash64("rid"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        asks = asks.join(parts, "slot", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    else:
        held, asks = held.withColumn("part", F.lit(0)), asks.withColumn("part", F.lit(0))
    both = held.withColumn("asks", F.lit(False)).unionByName(asks.withColumn("asks", F.lit(True)))
    blocks_of = sorted((p["first"], p["forest"]["blocks"]) for p in plans.values())

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, shard = None, []
        for x in batches:
            slot, part, asking_ = x["slot"].to_numpy(), x["part"].to_numpy(), x["asks"].to_numpy()
            rid, n, fp, grp = x["rid"].to_numpy(), x["n"].to_numpy(), x["fp"].to_numpy().view(np.uint64), x["grp"].to_numpy()
            wide_ = np.stack([x[w].to_numpy().view(np.uint64) for w in words], 1)
            cuts = np.flatnonzero((slot[1:] != slot[:-1]) | (part[1:] != part[:-1]) | (asking_[1:] != asking_[:-1])) + 1
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(x))):
                if (slot[lo], part[lo]) != key:
                    key, shard = (slot[lo], part[lo]), []
                    blocks = next(b for first, b in reversed(blocks_of) if first <= slot[lo])
                if not asking_[lo]:
                    shard.append((rid[lo:hi], n[lo:hi], fp[lo:hi], wide_[lo:hi], grp[lo:hi]))
                    continue
                if len(shard) > 1:
                    shard = [tuple(map(np.concatenate, zip(*shard)))]
                if not shard:
                    continue
                sr, sn, sf, sw, sg = shard[0]
                for at in range(lo, hi, 64):  # both sides are sorted by size, and a partner's is bounded
                    q = slice(at, min(at + 64, hi))
                    first, last = np.searchsorted(sn, n[q][0], "left"), np.searchsorted(sn, n[q][-1] / threshold + 1e-9, "right")
                    if first == last:
                        continue
                    most = np.minimum((spread * (n[q] + n[q] / threshold) + 1e-9) // blocks, 64).astype(np.uint8)
                    i, j = np.nonzero(np.bitwise_count(fp[q][:, None] ^ sf[None, first:last]) <= most[:, None])
                    i, j = i + at, j + first
                    room = spread * (n[i] + sn[j]) + 1e-9
                    ok = (n[i] < sn[j]) | ((n[i] == sn[j]) & (rid[i] < sr[j]))
                    if spanning:
                        ok &= grp[i] != sg[j]
                    ok &= np.bitwise_count(fp[i] ^ sf[j]) * float(blocks) <= room
                    i, j, room = i[ok], j[ok], room[ok]
                    ok = np.bitwise_count(wide_[i] ^ sw[j]).sum(1) <= room
                    if ok.any():
                        found.append((rid[i[ok]], sr[j[ok]]))
            if found:
                p, r = map(np.concatenate, zip(*found))
                yield pd.DataFrame({"p": p, "r": r})

    pairs = both.repartition("slot", "part").sortWithinPartitions("slot", "part", "asks", "n").mapInPandas(compare, "p long, r long").distinct()
    found = verified(materialise(pairs, "pairs"))
    return found.union(star) if star is not None else found


def _stars(rows: DataFrame, words: list[str], spread: float) -> DataFrame:
    """Candidates ``(p, r)`` that may link each set to the first of those with the same content in one of its cells. Many
    near copies so have a few heads in common and cost a row or two each, not a row for each pair."""
    each = rows.select("field", "rid", F.posexplode("cells").alias("cell", "key")).where("key <> 0")
    heads = each.groupBy("field", "cell", "key").agg(F.min("rid").alias("p"), F.count("*").alias("like")).where("like > 1").drop("like")
    pairs = each.join(heads, ["field", "cell", "key"]).where("rid <> p").select("p", F.col("rid").alias("r")).distinct()
    one = rows.select(F.col("rid").alias("p"), F.col("n").alias("n_"), *(F.col(w).alias(f"{w}_") for w in words))
    both = pairs.join(rows.select(F.col("rid").alias("r"), "n", *words), "r").join(one, "p")
    apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}_"))) for w in words), F.lit(0))
    return both.where(apart <= spread * (F.col("n") + F.col("n_")) + 1e-9).select("p", "r")


def _keyed(df: DataFrame, id_col: str, fields: dict[str, int]) -> DataFrame:
    """``field, id, items, cls``: a row for each field of a row that holds items enough."""
    each = F.array(*(F.struct(F.lit(k).alias("field"), F.lit(max(1, least)).alias("least"), F.col(name).alias("items")) for k, (name, least) in enumerate(fields.items())))
    rows = df.select(F.col(id_col).alias("id"), F.explode(each).alias("x")).where("id is not null and size(x.items) >= x.least")
    return rows.select("id", "x.field", "x.items").withColumn("cls", set_key(F.col("items")))


def near_duplicate_pairs(df: DataFrame, id_col: str, items: str, threshold: float = 0.7, min_items: int = 1, leaf_size: int = 4096, reach: int | None = None, spanning: bool = False) -> tuple[DataFrame, DataFrame]:
    """All different item sets with a Jaccard similarity of at least ``threshold``: exact, none is missed.

    With ``spanning``, pairs enough to connect what all pairs connect: sets that agree in a part of their items are first
    linked to one of them, where they are similar, and the search then leaves out pairs of sets that are linked to the same one. A
    great cluster of copies with small edits so costs a star of links and not all its pairs.

    ``items`` is an array of hashes; sets with fewer than ``min_items`` do not count, nor do null and empty
    ones, nor rows with a null id. Returns ``members(id, cls)`` and ``pairs(a, b)`` of classes, each pair once. The number of
    blocks and the depth of the trees are those whose search costs least by a sample's fingerprints, or follow from ``reach``, a
    ball's radius in a block for a set of mean size, and ``leaf_size``. The sample grows with the depth. Of
    two sets the smaller asks, as its radius is the smaller one. Each leaf is a shard: its fingerprints and the balls
    that may touch it come together in order of size and are compared as arrays, a bounded part at a time.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    with scratch(df.sparkSession):
        keyed = _keyed(df, id_col, {items: min_items})
        members = keep(materialise(keyed.select("id", "cls").distinct(), "members"))
        return members, keep(materialise(_search(keyed, threshold, leaf_size, reach, spanning).select("a", "b").distinct(), "similar"))


def near_duplicate_groups(df: DataFrame, id_col: str, fields: dict[str, int], threshold: float = 0.7) -> DataFrame:
    """Which group each id is in: ``id, grp``, for ids linked to at least one other.

    ``fields`` names array columns of hashes, each with the least set size for which it counts. Two ids are
    linked if a field's sets are similar enough or equal; groups are all that is linked directly or through
    others, named by their smallest id. Repeated rows of an id count once; an id with several contents is linked by
    each of them. Nulls, empty sets and empty tables give no row; other columns do not matter. All fields are searched in one
    pass, each with trees of its own.
    """
    with scratch(df.sparkSession):
        keyed = _keyed(df, id_col, fields)
        pairs = materialise(_search(keyed, threshold, 4096, None, True).select(F.col("left_head").alias("a"), F.col("right_head").alias("b")), "links")
        members = keyed.select("id", "field", "cls").distinct()
        copies = members.join(members.groupBy("field", "cls").agg(F.min("id").alias("head")), ["field", "cls"]).where("id <> head")
        groups = connected_components(copies.select(F.col("id").alias("a"), F.col("head").alias("b")).union(pairs))
        return keep(materialise(groups.select(F.col("node").alias("id"), F.col("component").alias("grp")), "groups"))
