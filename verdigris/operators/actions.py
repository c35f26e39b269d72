"""A policy that enables and disables tools by desired state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.numeric import sigmoid


@dataclass(frozen=True)
class GapPolicy:
    """The policy's five numbers."""

    mu: float = 0.0
    temperature: float = 1.0
    enable_threshold: float = 0.75
    disable_threshold: float = 0.75
    action_temperature: float = 0.1


def gaps(states: DataFrame, policy: GapPolicy = GapPolicy()) -> DataFrame:
    """for rows with ``score`` and ``enabled``: how much each tool should be on, what acting on it gains, and
    how probable the action is, with and without its sign."""
    on = F.col("enabled")
    desired = sigmoid((F.col("score") - policy.mu) / policy.temperature)
    rows = states.withColumn("desired_probability", desired)
    rows = rows.withColumn("gain", F.when(on, 1.0 - F.col("desired_probability")).otherwise(F.col("desired_probability")))
    rows = rows.withColumn("threshold", F.when(on, F.lit(policy.disable_threshold)).otherwise(policy.enable_threshold))
    rows = rows.withColumn("action_probability", sigmoid((F.col("gain") - F.col("threshold")) / policy.action_temperature))
    signed = lambda c: F.when(on, -F.col(c)).otherwise(F.col(c))
    return rows.withColumns({"signed_gain": signed("gain"), "signed_action_probability": signed("action_probability")})


def log_probability(selected: Column, probability: Column) -> Column:
    """the Bernoulli log-probability of an action taken or not."""
    return F.when(selected, F.ln(F.greatest(probability, F.lit(1e-8)))).otherwise(F.ln(F.greatest(1.0 - probability, F.lit(1e-8))))


def recommend(states: DataFrame, policy: GapPolicy = GapPolicy(), max_actions: int | None = None, key: str = "state_id") -> DataFrame:
    """The actions that gain more than their threshold, best first, at most ``max_actions`` a state."""
    if max_actions is not None and max_actions < 1:
        raise ValueError("max_actions must be positive")
    rows = gaps(states, policy).where("gain > threshold")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("gain"), "tool_id")))
    rows = rows.where(F.col("place") <= max_actions) if max_actions else rows
    return rows.select(key, "tool_id", F.when(F.col("enabled"), "disable").otherwise("enable").alias("action"), "desired_probability", "gain", "action_probability", "place")


def slates(states: DataFrame, policy: GapPolicy = GapPolicy(), max_actions: int = 5, seed: int = 0, key: str = "state_id", group_size: int = 5) -> DataFrame:
    """``group_size`` alternative action lists of a state, a row an action: anchor, conservative, sampled (a fixed draw of seed,
    state and tool), over-recommending, and a hard negative: the anchor with its last action replaced by the weakest one (that
    alone, where the anchor is empty; where nothing is weak, the last action alone); then further samples, sampled_2 and so on.

    What the hard negative needs of a whole state is aggregated; the lists keep their first actions only, so that no state, however
    many tools it has, is ranked whole."""
    if group_size < 1 or max_actions < 1:
        raise ValueError("group_size and max_actions must be at least 1")
    rows = gaps(states, policy)
    g, t, tool = F.col("gain"), F.col("threshold"), F.col("tool_id")
    drawn = lambda k: F.pmod(F.xxhash64(key, "tool_id", F.lit(seed + k)), F.lit(1 << 52)) / float(1 << 52) < F.col("action_probability")
    last = lambda which: F.max_by("tool_id", F.when(which, F.struct(-g, tool)))
    of = rows.groupBy(key).agg(last(g > t).alias("last_strong"), last(g <= t).alias("weakest"))
    rows = rows.join(of, key)
    strong = F.when(F.col("weakest").isNull(), tool == F.col("last_strong")).otherwise((tool == F.col("weakest")) | ((g > t) & (tool != F.col("last_strong"))))
    kinds = {"anchor": g > t, "conservative": g > F.least(F.lit(0.98), t + 0.10), "sampled": drawn(0), "over_recommend": g > F.greatest(F.lit(0.0), t - 0.18), "hard_negative": strong}
    kinds |= {f"sampled_{k}": drawn(k - 1) for k in range(2, group_size - 3)}
    kinds = dict(list(kinds.items())[:group_size])
    rows = rows.withColumn("slate", F.explode(F.filter(F.array(*(F.when(v, F.lit(k)) for k, v in kinds.items())), lambda x: x.isNotNull())))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(key, "slate").orderBy(F.desc("gain"), "tool_id")))
    return rows.where(F.col("place") <= max_actions).select(key, "slate", "place", "tool_id", "enabled", "gain", "action_probability")


def dry_run_slate_score(n: Column, strong: Column) -> Column:
    """A stand-in for the judge of a slate: the mean of 0.8 for each strong action and -0.4 for others, less 0.15 for
    each action beyond two; 0.2 for an empty slate; between -1 and 1."""
    raw = (strong * 0.8 - (n - strong) * 0.4) / F.greatest(n, F.lit(1)) - F.greatest(n - 2, F.lit(0)) * 0.15
    return F.when(n == 0, F.lit(0.2)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))


def group_loss(states: DataFrame, chosen: DataFrame, judged: DataFrame, rated: DataFrame, policy: GapPolicy = GapPolicy(), action_weight: float = 0.35, entropy_weight: float = 0.0) -> DataFrame:
    """The value of the policy's loss for each state: ``state_id, slate_loss, action_loss, loss, mean_reward``.

    ``states(state_id, tool_id, score, enabled)``, the actions of each slate in ``chosen(state_id, slate, tool_id)``, ``judged(state_id, slate,
    slate_score)`` and ``rated(state_id, slate, tool_id, rating)``. Rewards are normalised in their state, ratings in their slate; a
    slate's log-probability is that of all tools of its state, taken or not.
    """
    rows = gaps(states, policy).select("state_id", "tool_id", "action_probability")
    mine = judged.select("state_id", "slate").join(rows, "state_id").join(chosen.select("state_id", "slate", "tool_id", F.lit(True).alias("taken")), ["state_id", "slate", "tool_id"], "left")
    mine = mine.withColumn("lp", log_probability(F.col("taken").isNotNull(), F.col("action_probability")))

    def advantage(df: DataFrame, by: list[str], value: str) -> DataFrame:
        of = df.groupBy(*by).agg(F.avg(value).alias("m_"), F.stddev_pop(value).alias("s_"))
        return df.join(of, by).withColumn("adv", F.when(F.col("s_") > 1e-6, F.try_divide(F.col(value) - F.col("m_"), F.col("s_"))).otherwise(0.0)).drop("m_", "s_")

    per = mine.groupBy("state_id", "slate").agg(F.sum("lp").alias("lp")).join(advantage(judged, ["state_id"], "slate_score"), ["state_id", "slate"])
    out = per.groupBy("state_id").agg((-F.avg(F.col("adv") * F.col("lp"))).alias("slate_loss"), F.avg("slate_score").alias("mean_reward"))
    acted = advantage(rated, ["state_id", "slate"], "rating").join(mine, ["state_id", "slate", "tool_id"]).groupBy("state_id").agg((-F.avg(F.col("adv") * F.col("lp"))).alias("action_loss"))
    p = F.col("action_probability")
    entropy = rows.groupBy("state_id").agg((-F.avg(p * F.ln(F.greatest(p, F.lit(1e-8))) + (1 - p) * F.ln(F.greatest(1 - p, F.lit(1e-8))))).alias("entropy"))
    out = out.join(acted, "state_id", "left").join(entropy, "state_id").withColumn("action_loss", F.coalesce("action_loss", F.lit(0.0)))
    return out.select("state_id", "slate_loss", "action_loss", (F.col("slate_loss") + action_weight * F.col("action_loss") - entropy_weight * F.col("entropy")).alias("loss"), "mean_reward")


def feedback_advantages(ratings: DataFrame, key: str = "state_id") -> DataFrame:
    """Ratings centred in their state and divided by its population deviation if that is over 1e-6; the sign
    turned for actions that disable."""
    of = ratings.groupBy(key).agg(F.avg("rating").alias("m_"), F.stddev_pop("rating").alias("s_"))
    gap = F.col("rating") - F.col("m_")
    value = F.when(F.col("s_") > 1e-6, F.try_divide(gap, F.col("s_"))).otherwise(gap)
    return ratings.join(of, key).withColumn("advantage", F.when(F.col("action") == "disable", -value).otherwise(value)).drop("m_", "s_")
