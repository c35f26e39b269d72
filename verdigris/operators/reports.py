"""Reports over runs, folds and epochs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inspect_dataset(pairs: DataFrame) -> DataFrame:
    """A10: sizes of groups and spread of labels, one row."""
    sizes = pairs.groupBy("conversation_id").agg(F.count("*").alias("n"))
    groups = sizes.agg(F.count("*").alias("groups"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.avg("n").alias("mean_size"))
    labels = pairs.agg(F.count("*").alias("pairs"), F.min("label").alias("min_label"), F.max("label").alias("max_label"), F.avg("label").alias("mean_label"), F.count_if(F.col("label") >= 0.8).alias("high_labels"))
    return groups.crossJoin(labels)


def aggregate_folds(folds: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean, sample deviation (0 for one fold), minimum and maximum of each metric: ``metric, mean, std, min, max``."""
    long = folds.unpivot([], list(metrics), "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def factor_errors(rows: DataFrame) -> DataFrame:
    """Mean absolute and squared error of each factor, from arrays ``factor_predictions`` and ``factor_labels``."""
    both = rows.select(F.posexplode(F.arrays_zip("factor_predictions", "factor_labels")).alias("axis", "x")).select("axis", (F.col("x.factor_predictions") - F.col("x.factor_labels")).alias("gap"))
    return both.groupBy("axis").agg(F.avg(F.abs("gap")).alias("mae"), F.avg(F.col("gap") * F.col("gap")).alias("mse"))


def best_epochs(epochs: DataFrame, objectives: dict[str, Column]) -> DataFrame:
    """For each objective (higher is better) its best epoch, the earliest of equal ones: ``objective, epoch, score``."""
    long = epochs.select("epoch", F.explode(F.array(*(F.struct(F.lit(k).alias("objective"), v.alias("score")) for k, v in objectives.items()))).alias("x")).select("epoch", "x.*")
    order = Window.partitionBy("objective").orderBy(F.desc("score"), "epoch")
    return long.withColumn("r", F.row_number().over(order)).where("r = 1").select("objective", "epoch", "score")


def checkpoint_scores() -> dict[str, Column]:
    """What checkpoints are chosen by, from the columns of the grouped metrics; higher is better."""
    c = F.col
    return {
        "legacy_score": c("topk_recall") - c("no_tool_fp_rate") - c("mae"),
        "composite": 0.35 * c("ndcg_at_5") + 0.25 * c("topk_recall") + 0.20 * c("high_value_recall_at_5") - 0.20 * c("top5_regret") - 0.20 * c("bad_top3_rate") - 0.10 * c("mae"),
        "ndcg_at_5": c("ndcg_at_5"),
        "top5_regret": -c("top5_regret"),
        "safety": 0.35 * c("high_conf_precision") + 0.25 * (1.0 - c("bad_top3_rate")) + 0.20 * (1.0 - c("bad_top5_rate")) + 0.20 * (1.0 - c("no_tool_fp_rate")),
    }


def trend(epochs: DataFrame, metric: str, patience: int = 3, lower_is_better: bool = False, flat: float = 0.01) -> DataFrame:
    """Best epoch (the first of equal ones), last value, change over the last ``patience`` epochs and
    whether that change is too small to go on."""
    sign = -1.0 if lower_is_better else 1.0
    best = F.max_by(F.struct("epoch", metric), F.struct(sign * F.col(metric), -F.col("epoch"))).alias("best")
    recent = epochs.withColumn("r", F.row_number().over(Window.orderBy(F.desc("epoch")))).where(F.col("r") <= patience)
    delta = recent.agg((F.max_by(metric, "epoch") - F.min_by(metric, "epoch")).alias("recent_delta"))
    out = epochs.agg(best, F.max_by(metric, "epoch").alias("last")).crossJoin(delta)
    return out.select(F.col("best.epoch").alias("best_epoch"), F.col(f"best.{metric}").alias("best"), "last", "recent_delta", (F.abs("recent_delta") < flat).alias("saturated"))


def with_train_loss(epochs: DataFrame, log: DataFrame) -> DataFrame:
    """Each epoch with its training loss, the last logged one if there are several; null if none."""
    last = log.groupBy("epoch").agg(F.max_by("train_loss", "pos").alias("train_loss"))
    return epochs.join(last, "epoch", "left")
