"""Problem 6: filling containers of fixed capacity, by sum-of-squares online packing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.copies import numbered
from verdigris.plans.scratch import materialise

MAX_KINDS = 1000  # container kinds are configuration
MAX_CAPACITY = 1 << 20


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Place items of 1 to ``capacity`` in the given order; returns each item's container and offset.

    The level array counts the open containers of each fill. An item goes where the sum of the squared counts of
    partly filled containers becomes least, a new container being one choice; of equal choices the fullest
    container that fits is taken. Closed (full) containers leave the array.
    """
    counts, open_at = np.zeros(capacity + 1), [[] for _ in range(capacity)]
    box, offset, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for k, s in enumerate(sizes.tolist()):
        best, level = (counts[s] + 0.5 if s < capacity else -0.5), 0
        if capacity > s:
            here = counts[1 : capacity - s + 1]
            change = counts[s + 1 : capacity + 1] - here + 1
            change[-1] -= 0.5  # it becomes full and leaves
            change[here == 0] = math.inf
            last = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[last] <= best:
                level = last + 1
        if level:
            bin_id = open_at[level].pop()
            counts[level] -= 1
        else:
            bin_id, made = made, made + 1
        box[k], offset[k] = bin_id, level
        if level + s < capacity:
            open_at[level + s].append(bin_id)
            counts[level + s] += 1
    return box, offset


def pack(df: DataFrame, id_col: str, size_col: str, kinds: DataFrame, shard_size: int = 4_000_000, seed: int = 1) -> DataFrame:
    """Fill containers of each ``capacity_tokens`` of ``kinds(pack_kind, capacity_tokens)`` with all items of ``df``.

    Out come ``pack_kind, capacity, shard, container, item_id, piece, from_size, size, offset``; a container is
    named by kind, shard and number. An item is split only if it exceeds the capacity: into full containers and
    a rest, which is placed like any item. Items with a null id or a null, zero or negative size need no room
    and are not placed; repeated rows are items of their own; kinds with a null or non-positive capacity are
    left out; empty tables give no row. Other columns do not matter, nor does in what order or files the rows come.

    Items are dealt by hash over shards of about ``shard_size`` (or 200 containers, if that is more), each packed
    online in hash order by itself. What sharding costs is a shard's last open containers, well under a percent.
    """
    items = df.select(F.col(id_col).alias("item_id"), F.col(size_col).cast("long").alias("size")).where("item_id is not null and size > 0")
    items = materialise(numbered(items).withColumn("key", F.xxhash64("item_id", "size", "copy", F.lit(seed))), "items")
    config = kinds.select(F.col("pack_kind").cast("string"), F.col("capacity_tokens").cast("int").alias("capacity")).where("capacity > 0").distinct().orderBy("pack_kind", "capacity").limit(MAX_KINDS + 1).collect()
    if len(config) > MAX_KINDS or any(r.capacity > MAX_CAPACITY for r in config):
        raise ValueError(f"at most {MAX_KINDS} kinds, of a capacity of at most {MAX_CAPACITY}")
    total = items.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    plan = [(r.pack_kind, r.capacity, max(1, round(total / max(shard_size, 200 * r.capacity)))) for r in config]
    spread = F.broadcast(df.sparkSession.createDataFrame(plan, "pack_kind string, capacity int, shards int"))
    dealt = items.crossJoin(spread).withColumn("shard", F.pmod("key", F.col("shards")).cast("int"))

    def place(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["key", "item_id", "size", "copy"], kind="stable")
        capacity, size = int(x["capacity"].iloc[0]), x["size"].to_numpy()
        full, rest = size // capacity, size % capacity
        some = rest > 0
        box, offset = sum_of_squares(rest[some], capacity)
        made = int(box.max()) + 1 if len(box) else 0
        row = np.concatenate([np.flatnonzero(some), np.repeat(np.arange(len(x)), full)])
        order = np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full)  # the full pieces of an item
        out = x.iloc[row][["pack_kind", "capacity", "shard", "item_id"]].reset_index(drop=True)
        out["container"] = np.concatenate([box, made + np.arange(int(full.sum()))])
        out["piece"] = np.concatenate([full[some], order])
        out["from_size"] = out["piece"] * capacity
        out["size"] = np.concatenate([rest[some], np.full(int(full.sum()), capacity)])
        out["offset"] = np.concatenate([offset, np.zeros(int(full.sum()), np.int64)])
        return out

    kind = dict(items.dtypes)["item_id"]
    schema = f"pack_kind string, capacity int, shard int, item_id {kind}, container long, piece long, from_size long, size long, offset long"
    return dealt.drop("shards").groupBy("pack_kind", "capacity", "shard").applyInPandas(place, schema)


def pack_report(packed: DataFrame) -> DataFrame:
    """Per kind: containers, items split, what is filled and the share of room left over."""
    boxes = packed.groupBy("pack_kind", "capacity", "shard", "container").agg(F.sum("size").alias("filled"))
    boxes = boxes.groupBy("pack_kind", "capacity").agg(F.count("*").alias("containers"), F.sum("filled").alias("filled"), F.max("filled").alias("fullest"))
    split = packed.where("piece > 0").groupBy("pack_kind", "capacity").agg(F.countDistinct("item_id").alias("split_items"))
    room = F.col("containers") * F.col("capacity")
    return boxes.join(split, ["pack_kind", "capacity"], "left").select("pack_kind", "capacity", "containers", "filled", "fullest", F.coalesce("split_items", F.lit(0)).alias("split_items"), ((room - F.col("filled")) / room).alias("left_over"))
