"""Values of the group losses (A23); gradients are no matter of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.numeric import softplus
from verdigris.operators.ranking import prediction_rank


def margin_loss(df: DataFrame, margin: float = 0.3, least_gap: float = 0.05) -> DataFrame:
    """By how much the best label's prediction fails to exceed the worst's by ``margin``, for each conversation of
    two tools or more whose labels differ by ``least_gap`` at least."""
    best, worst = F.max_by("prediction", F.struct("label", "tool_id")), F.min_by("prediction", F.struct("label", "tool_id"))
    ends = df.groupBy("conversation_id").agg(best.alias("best"), worst.alias("worst"), (F.max("label") - F.min("label")).alias("gap"), F.count("*").alias("n"))
    return ends.where((F.col("gap") >= least_gap) & (F.col("n") > 1)).select("conversation_id", F.greatest(F.lit(0.0), margin - (F.col("best") - F.col("worst"))).alias("loss"))


def listnet_loss(df: DataFrame, temperature: float = 1.0, least_gap: float = 0.05) -> DataFrame:
    """The cross entropy of the labels' and the predictions' softmax at a temperature, for the same conversations."""
    t = max(temperature, 1e-4)
    tops = df.groupBy("conversation_id").agg(F.max("label").alias("tl"), F.max("prediction").alias("tp"), (F.max("label") - F.min("label")).alias("gap"), F.count("*").alias("n"))
    tops = tops.where((F.col("gap") >= least_gap) & (F.col("n") > 1))
    x = (F.col("prediction") - F.col("tp")) / t
    e = df.join(tops, "conversation_id").select("conversation_id", F.exp((F.col("label") - F.col("tl")) / t).alias("el"), F.exp(x).alias("ep"), x.alias("x"))
    s = e.groupBy("conversation_id").agg(F.sum("el").alias("sl"), F.sum("ep").alias("sp"), F.sum(F.col("el") * F.col("x")).alias("lx"))
    return s.select("conversation_id", (F.ln("sp") - F.col("lx") / F.col("sl")).alias("loss"))


def lambda_loss(df: DataFrame, k: int = 5, sigma: float = 1.0, least_gap: float = 0.05) -> DataFrame:
    """For each conversation the mean, over pairs of tools whose labels differ by more than ``least_gap``, of
    ``ln(1 + exp(-sigma d)) / sigma`` times the change of NDCG@k that swapping them makes; ranks beyond k have no discount.

    A pair in which neither tool is among the first k weighs 0, so one side is taken from the first k only; all
    pairs are merely counted, over a sorted range. No conversation's tools are paired with each other.
    """
    sigma = max(sigma, 1e-4)
    own = Window.partitionBy("conversation_id")
    discount = F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    rows = prediction_rank(df).withColumns({"gain": F.col("label") - F.min("label").over(own), "d": discount, "under": F.expr(f"count(*) over (partition by conversation_id order by label range between unbounded preceding and {least_gap + 1e-9}D preceding)")})
    total = rows.groupBy("conversation_id").agg(F.sum("under").alias("pairs")).where("pairs > 0")
    ideal = prediction_rank(rows.drop("rank"), k=k, value="label", name="place").groupBy("conversation_id").agg(F.greatest(F.sum(F.col("gain") / F.log2(F.col("place") + 1)), F.lit(1e-6)).alias("ideal"))
    side = lambda n: ["conversation_id", *(F.col(c).alias(f"{c}{n}") for c in ("rank", "gain", "d", "prediction", "label"))]
    both = rows.where(F.col("rank") <= k).select(side(1)).join(rows.select(side(2)), "conversation_id").where((F.col("rank1") < F.col("rank2")) & (F.abs(F.col("label1") - F.col("label2")) >= least_gap + 1e-9)).join(ideal, "conversation_id")
    weight = F.abs(F.col("gain1") - F.col("gain2")) * F.abs(F.col("d1") - F.col("d2")) / F.col("ideal")
    gap = F.when(F.col("label1") > F.col("label2"), F.col("prediction1") - F.col("prediction2")).otherwise(F.col("prediction2") - F.col("prediction1"))
    lost = both.groupBy("conversation_id").agg(F.sum(weight * softplus(-sigma * gap) / sigma).alias("lost"))
    return total.join(lost, "conversation_id", "left").select("conversation_id", (F.coalesce("lost", F.lit(0.0)) / F.col("pairs")).alias("loss"))
