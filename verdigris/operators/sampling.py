"""Folds, splits and candidate sampling."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators.ranks import positions
from verdigris.plans.scratch import materialise


def uniform(*cols: Column | str, seed: int) -> Column:
    """A fixed number in (0, 1) of the columns and the seed."""
    return (F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _places(df: DataFrame, key: str, seed: int) -> tuple[DataFrame, int]:
    """The distinct keys in a fixed random order, numbered from 0, and how many they are. Null keys have no place."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("u_", F.xxhash64(key, F.lit(seed)))
    placed = materialise(positions(keys, ["u_", key], "place_").select(key, "place_"), "places")
    return placed, placed.count()


def split_groups(df: DataFrame, key: str = "conversation_id", validation: float = 0.2, seed: int = 0) -> DataFrame:
    """``split`` valid for exactly ``max(1, round(validation * keys))`` keys, the first ones in a fixed random order of all; all rows of a key
    are on one side."""
    placed, n = _places(df, key, seed)
    cut = max(1, round(n * validation))
    return df.join(placed, key).withColumn("split", F.when(F.col("place_") < cut, "valid").otherwise("train")).drop("place_")


def split_for_cv(df: DataFrame, cv: float, holdout: float, key: str = "conversation_id", seed: int = 0) -> DataFrame:
    """``part`` of each key, of exact sizes: in a fixed random order of all keys, holdout comes first, then cv, the rest is base."""
    if cv <= 0 or holdout <= 0 or cv + holdout >= 1:
        raise ValueError("cv and holdout must be positive and sum to less than 1")
    placed, n = _places(df, key, seed)
    first = max(1, round(n * holdout))
    second = first + max(1, round(n * cv))
    part = F.when(F.col("place_") < first, "holdout").when(F.col("place_") < second, "cv").otherwise("base")
    return df.join(placed, key).withColumn("part", part).drop("place_")


def assign_folds(df: DataFrame, k: int, key: str = "conversation_id", seed: int = 0) -> DataFrame:
    """``fold`` 0 to k-1 of each key, dealt in turn in a fixed random order: folds differ by one key at most."""
    if k < 2:
        raise ValueError("k must be at least 2")
    placed, _ = _places(df, key, seed)
    return df.join(placed, key).withColumn("fold", F.pmod("place_", F.lit(k)).cast("int")).drop("place_")


BATCH = 200_000  # rows that a task hands over at once
ORDERED = 4_000_000  # rows that a task holds to put them in the order of their tools


def _draw(rng: np.random.Generator, weights: np.ndarray, taken: np.ndarray, count: int) -> np.ndarray:
    """``count`` distinct places, or all there are, drawn one after the other by weight from those not ``taken``."""
    count, free = min(count, len(weights) - int(taken.sum())), taken.copy()
    total, out = np.cumsum(weights), []
    for _ in range(8):  # draws that hit what is taken count for nothing, which leaves the law as it is
        if not count or count * 4 > len(weights) or total[-1] <= 0:
            break
        hit = np.minimum(np.searchsorted(total, rng.random(count + 8) * total[-1], "right"), len(weights) - 1)
        hit = hit[np.sort(np.unique(hit, return_index=True)[1])]
        hit = hit[~free[hit] & (weights[hit] > 0)][:count]
        free[hit] = True
        out.append(hit)
        count -= len(hit)
    if count:  # the rest by keys over all that is left; those without a weight come last
        left = np.flatnonzero(~free)
        u = rng.random(len(left))
        key = np.divide(-np.log1p(-u), weights[left], out=np.full(len(left), np.inf), where=weights[left] > 0)
        out.append(left[np.lexsort((u, key))[:count]])
    return np.concatenate([np.zeros(0, np.int64), *out]).astype(np.int64)


def sample_candidates(conversations: DataFrame, tools: DataFrame, rate: float = 0.1, force: float = 1.0, seed: int = 0, weight: str | None = None) -> DataFrame:
    """A candidate set for every conversation: all agents, its target plugins (each with probability ``force``, the first
    ones if they are more than the set holds) and others drawn without replacement, ``ceil(rate * plugins)`` plugins in all:
    ``conversation_id, pos, tool_id``.

    ``conversations`` has ``conversation_id, target_tool_ids``. Others are drawn by the column ``weight`` of ``tools``, if named. Every conversation has a generator of its own, of the seed and its id, so
    draws do not depend on each other, and any set of plugins can be drawn. Only the conversations are shuffled; each task
    holds the catalogue's ids and makes whole sets, so that no row of the result is moved. A task's rows come tool by tool, some
    millions at a time: so written they take a fifth of the room that they take set by set.
    """
    if not 0 <= rate <= 1:
        raise ValueError("rate must be in [0, 1]")
    spark = conversations.sparkSession
    by = F.max(F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))) if weight else F.lit(1.0)
    rows = tools.where("kind in ('plugin', 'agent') and tool_id is not null").groupBy("tool_id").agg(F.min("kind").alias("kind"), by.alias("weight")).orderBy("tool_id").collect()
    agents, plugins = [r.tool_id for r in rows if r.kind == "agent"], [r.tool_id for r in rows if r.kind == "plugin"]
    given = np.array([r.weight for r in rows if r.kind == "plugin"], float)
    k = math.ceil(len(plugins) * rate)
    conv = conversations.select("conversation_id", F.coalesce("target_tool_ids", F.array().cast("array<string>")).alias("t"), F.xxhash64("conversation_id").alias("h"))
    shared = spark.sparkContext.broadcast((agents, plugins, given))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agents, plugins, weights = shared.value
        names, number = pa.array(agents + plugins, pa.string()), {x: n for n, x in enumerate(plugins)}
        always = np.arange(len(agents))
        step = max(1, ORDERED // max(1, len(agents) + k))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch, made = whole.slice(at, step), []
                for h, targets in zip(batch["h"].to_pylist(), batch["t"].to_pylist()):
                    rng = np.random.default_rng([seed, h % (1 << 64)])
                    forced = [number[x] for x in dict.fromkeys(targets) if x in number and rng.random() < force][:k]
                    taken = np.zeros(len(plugins), bool)
                    taken[forced] = True
                    drawn = _draw(rng, weights, taken, k - len(forced)) if plugins else always[:0]
                    made.append(rng.permutation(np.concatenate([always, len(agents) + np.array(forced, np.int64), len(agents) + drawn])).astype(np.int32))
                sizes = [len(x) for x in made]
                tool, owner = np.concatenate(made), np.repeat(np.arange(len(made), dtype=np.int32), sizes)
                pos = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
                order = np.argsort(tool, kind="stable")
                for lo in range(0, len(order), BATCH):
                    part = order[lo : lo + BATCH]
                    columns = [batch["conversation_id"].take(pa.array(owner[part])), pa.array(pos[part], pa.int32()), names.take(pa.array(tool[part]))]
                    yield pa.RecordBatch.from_arrays(columns, ["conversation_id", "pos", "tool_id"])

    dealt = conv.repartition(4 * spark.sparkContext.defaultParallelism)
    return dealt.mapInArrow(sets, f"conversation_id {dict(conv.dtypes)['conversation_id']}, pos int, tool_id string")


class ExposureSampler:
    """Candidate sets drawn one after the other, each draw leaving its mark on the next: a plugin that was drawn weighs
    ``decay`` times what it weighed, and what it lost is shared by those that were not. The state is the catalogue's weights and
    exposures, whatever the number of samples."""

    def __init__(self, agents: list[str], plugins: list[str], rate: float = 0.1, force: float = 1.0, decay: float = 0.7, shuffle: bool = True):
        if not (0 <= rate <= 1 and 0 <= force <= 1):
            raise ValueError("rate and force must be in [0, 1]")
        if not 0 < decay <= 1:
            raise ValueError("decay must be in (0, 1]")
        self.agents, self.plugins, self.size = agents, plugins, math.ceil(len(plugins) * rate)
        self.force, self.decay, self.shuffle = force, decay, shuffle
        self.number = {x: k for k, x in enumerate(plugins)}
        self.weights, self.exposures = np.ones(len(plugins)), np.zeros(len(plugins), np.int64)

    def pick(self, left: np.ndarray, u: float) -> int:
        """The first place at which the running weight of those ``left`` reaches the share ``u`` of their sum."""
        upto = np.cumsum(np.maximum(self.weights[left], 0.0))
        return min(int(np.searchsorted(upto, u * upto[-1], "left")), len(left) - 1)

    def sample(self, targets: list[str], seed: int) -> list[str]:
        rng = random.Random(seed)
        taken: list[int] = []
        for x in targets:
            if x in self.number and len(taken) < self.size and rng.random() <= self.force and self.number[x] not in taken:
                taken.append(self.number[x])
        left = np.setdiff1d(np.arange(len(self.plugins)), taken)
        for _ in range(min(self.size - len(taken), len(left))):
            k = self.pick(left, rng.random()) if self.weights[left].clip(0).sum() > 0 else rng.randrange(len(left))
            taken.append(int(left[k]))
            left = np.delete(left, k)
        lost = self.weights[taken].sum() * (1 - self.decay)
        self.weights[taken] *= self.decay
        self.exposures[taken] += 1
        if len(left) and lost > 0:
            self.weights[left] += lost / len(left)
        out = self.agents + [self.plugins[k] for k in taken]
        if self.shuffle:
            rng.shuffle(out)
        return out


def sample_in_turn(conversations: DataFrame, tools: DataFrame, rate: float = 0.1, force: float = 1.0, decay: float = 0.7, seed: int = 0) -> DataFrame:
    """R1, R2 in their ordered form: ``conversation_id, number, tool_ids`` for all conversations in the order of their ids, by one
    :class:`ExposureSampler`, so that a resumed run draws what the first one drew.

    Each draw depends on those before it, so this is one task by its nature; it streams, and holds no more than the catalogue's
    weights. :func:`sample_candidates` is the form without memory, for many conversations.
    """
    rows = tools.where("kind in ('plugin', 'agent') and tool_id is not null").groupBy("tool_id").agg(F.min("kind").alias("kind")).orderBy("tool_id").collect()
    agents, plugins = [r.tool_id for r in rows if r.kind == "agent"], [r.tool_id for r in rows if r.kind == "plugin"]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, n = ExposureSampler(agents, plugins, rate, force, decay), 0
        for x in batches:
            sets = []
            for targets in x["t"].to_pylist():
                n += 1
                sets.append(sampler.sample(targets, seed + n))
            yield pa.RecordBatch.from_arrays([x["conversation_id"], pa.array(range(n - len(sets) + 1, n + 1), pa.int64()), pa.array(sets, pa.list_(pa.string()))], ["conversation_id", "number", "tool_ids"])

    conv = conversations.select("conversation_id", F.coalesce("target_tool_ids", F.array().cast("array<string>")).alias("t"))
    return conv.repartition(1).sortWithinPartitions("conversation_id").mapInArrow(draw, f"conversation_id {dict(conv.dtypes)['conversation_id']}, number long, tool_ids array<string>")


def number_samples(df: DataFrame, order: str = "conversation_id", prefix: str = "sample_") -> DataFrame:
    """``sample_id`` by position in the order of a column."""
    return positions(df, [order], "n_").withColumn("sample_id", F.format_string(f"{prefix}%06d", F.col("n_") + 1)).drop("n_")
