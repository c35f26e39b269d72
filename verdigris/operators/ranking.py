"""Grouped ranking metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.operators.ranks import spearman
from verdigris.plans.scratch import materialise

NO_TOOL, ASK_CONFIRM = "__NO_TOOL__", "__ASK_CONFIRM__"  # fixed values


def _any(c: Column) -> Column:
    return F.coalesce(F.max(c), F.lit(False))


def _floats(df: DataFrame) -> DataFrame:
    """Labels and predictions as the metrics take them: of single precision, summed in double."""
    return df.withColumns({"label": F.col("label").cast("float").cast("double"), "prediction": F.col("prediction").cast("float").cast("double")})


def prediction_rank(df: DataFrame, by: Sequence[str] = (), k: int | None = None, value: str = "prediction", tie: str = "tool_id", name: str = "rank") -> DataFrame:
    """The rank of ``value`` downward within a conversation, ties by ``tie``; the first k, if given
    (then all others leave before the shuffle)."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*by, "conversation_id").orderBy(F.desc(value), tie)))
    return ranked.where(F.col(name) <= k) if k else ranked


def group_facts(df: DataFrame, by: Sequence[str] = (), high_label: float = 0.8, high_pred: float = 0.8, topk: int = 3) -> DataFrame:
    """One row a conversation with all that the metrics sum: flags, regrets and NDCGs.

    ``df`` has ``conversation_id, tool_id, label, prediction``, a tool once a conversation. Three small results are joined on the
    conversation: plain aggregates, the first five by prediction and the first five by label; the ranks'
    limit is applied before the shuffle, so a hot conversation does not matter.
    """
    key, rows = [*by, "conversation_id"], _floats(df)
    bad, good = F.col("label") <= -high_label, F.col("label") >= high_label
    whole = rows.groupBy(*key).agg(
        F.count("*").alias("pairs"), F.min("label").alias("low"), F.max("label").alias("best_label"), F.max("prediction").alias("top_pred"), F.count_if(good).alias("high_value"),
        F.count_if(F.col("prediction") >= high_pred).alias("high_pred"), F.count_if((F.col("prediction") >= high_pred) & good).alias("high_pred_right"),
        _any(F.col("tool_id") == NO_TOOL).alias("has_nt"), _any(F.col("tool_id") == ASK_CONFIRM).alias("has_ac"),
    )
    r, deep = F.col("rank"), max(5, topk)
    first = lambda k: r <= k
    agg = [F.max_by("tool_id", -r).alias("pred_tool"), F.max(F.when(first(topk), F.struct(-r, "tool_id"))).isNotNull().alias("any_"), F.collect_list(F.when(first(topk), F.col("tool_id"))).alias("topk_tools")]
    for k in (1, 3, 5):
        agg += [F.max(F.when(first(k), F.col("label"))).alias(f"max{k}"), F.avg(F.when(first(k), F.col("label"))).alias(f"mean{k}"), _any(first(k) & bad).alias(f"bad{k}"), F.count_if(first(k) & good).alias(f"hits{k}")]
    agg.append(_any(first(3) & bad & F.col("tool_id").startswith("agent.")).alias("agent_bad3"))
    pred = prediction_rank(rows, by, deep)
    low = rows.groupBy(*key).agg(F.min("label").alias("low"))
    gain = lambda k: F.coalesce(F.sum(F.when(first(k), (F.col("label") - F.col("low")) / F.log2(r + 1))), F.lit(0.0))
    agg += [gain(3).alias("dcg3"), gain(5).alias("dcg5")]
    by_pred = pred.join(low, key).groupBy(*key).agg(*agg).drop("any_")
    ideal = prediction_rank(rows, by, deep, "label").join(low, key)
    by_label = ideal.groupBy(*key).agg(F.max_by("tool_id", -r).alias("best_tool"), gain(3).alias("ideal3"), gain(5).alias("ideal5"))
    out = whole.join(by_pred, key).join(by_label, key)
    ndcg = lambda k: F.when(F.col(f"ideal{k}") > 0, F.try_divide(f"dcg{k}", f"ideal{k}")).when(F.col(f"dcg{k}") <= 0, 1.0).otherwise(0.0)
    return out.withColumns({"ndcg_at_3": ndcg(3), "ndcg_at_5": ndcg(5), "topk_hit": F.array_contains("topk_tools", F.col("best_tool"))}).drop("topk_tools")


def compute_metrics(df: DataFrame, by: Sequence[str] = (), high_label: float = 0.8, high_pred: float = 0.8, topk: int = 3) -> DataFrame:
    """The 43 metrics, one row for each ``by``. Rates divide by at least 1; ``active_bad_*`` count groups that hold a
    no-tool candidate in their denominator only, as published, so without such candidates they are counts."""
    # read six times below: the pairs are worked out once
    df = materialise(df.select(*by, "conversation_id", "tool_id", "label", "prediction"), "pairs")
    g = group_facts(df, by, high_label, high_pred, topk)
    c = F.col
    gold_nt, pred_nt = c("best_tool") == NO_TOOL, c("pred_tool") == NO_TOOL
    gold_ac, pred_ac = c("best_tool") == ASK_CONFIRM, c("pred_tool") == ASK_CONFIRM
    quiet = pred_nt | pred_ac
    action = lambda x: F.when(x == NO_TOOL, 1).when(x == ASK_CONFIRM, 2).otherwise(3)
    hit = c("pred_tool") == c("best_tool")
    n, rate = F.count("*"), lambda x: F.count_if(x) / F.count("*")
    over = lambda x, y: F.count_if(x) / F.greatest(F.lit(1), F.count_if(y))
    active = c("has_nt") & ~gold_nt
    acts = c("has_nt") | c("has_ac")
    has_ac = c("has_ac")
    m = {
        "top1_match": rate(hit), "topk_recall": rate(c("topk_hit")),
        **{f"top{k}_regret": F.avg(c("best_label") - c(f"max{k}")) for k in (1, 3, 5)},
        "ndcg_at_3": F.avg("ndcg_at_3"), "ndcg_at_5": F.avg("ndcg_at_5"),
        "bad_top3_rate": rate(c("bad3")), "bad_top5_rate": rate(c("bad5")),
        **{f"bad_exposed_top{k}_rate": rate(c(f"bad{k}") & ~quiet) for k in (1, 3, 5)},
        **{f"active_bad_top{k}_rate": over(c(f"bad{k}") & ~quiet, active) for k in (1, 3, 5)},
        **{f"no_tool_suppressed_bad_top{k}_rate": over(c(f"bad{k}") & quiet, c("has_nt") & pred_nt) for k in (3, 5)},
        "agent_bad_top3_rate": rate(c("agent_bad3")),
        "top3_label_mean": F.avg("mean3"), "top5_label_mean": F.avg("mean5"), "top3_label_max": F.avg("max3"), "top5_label_max": F.avg("max5"),
        "high_value_recall_at_3": F.sum("hits3") / F.greatest(F.lit(1), F.sum("high_value")), "high_value_recall_at_5": F.sum("hits5") / F.greatest(F.lit(1), F.sum("high_value")),
        "no_tool_fp_rate": over((c("best_label") < high_label) & (c("top_pred") >= high_pred), c("best_label") < high_label),
        "high_conf_precision": F.sum("high_pred_right") / F.greatest(F.lit(1), F.sum("high_pred")),
        "activation_accuracy": over(c("has_nt") & (gold_nt == pred_nt), c("has_nt")),
        "no_tool_recall": over(c("has_nt") & gold_nt & pred_nt, c("has_nt") & gold_nt), "no_tool_precision": over(c("has_nt") & gold_nt & pred_nt, c("has_nt") & pred_nt),
        "active_tool_top1": over(active & hit, active), "active_tool_topk": over(active & c("topk_hit"), active),
        "activation_action_accuracy": over(acts & (action(c("best_tool")) == action(c("pred_tool"))), acts),
        "ask_confirm_recall": over(has_ac & gold_ac & pred_ac, has_ac & gold_ac), "ask_confirm_precision": over(has_ac & gold_ac & pred_ac, has_ac & pred_ac),
        "ask_confirm_candidate_groups": F.count_if(has_ac & gold_ac), "activation_groups": F.count_if(c("has_nt")), "no_tool_candidate_groups": F.count_if(c("has_nt") & gold_nt),
        "active_candidate_groups": F.count_if(active), "groups": n, "pairs": F.sum("pairs"),
    }
    grouped = g.groupBy(*by).agg(*(x.cast("double").alias(k) for k, x in m.items()))
    gap = F.col("prediction") - F.col("label")
    rows = _floats(df)
    errors = rows.groupBy(*by).agg(F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse"))
    ranks = spearman(rows, "label", "prediction", by)
    if by:
        return grouped.join(errors, list(by)).join(ranks, list(by))
    return grouped.crossJoin(errors).crossJoin(ranks)


def pair_metrics(df: DataFrame, by: Sequence[str] = (), high_label: float = 0.8, high_pred: float = 0.8) -> DataFrame:
    """Metrics over pairs, whatever their conversation."""
    rows = _floats(df)
    sure, good, bad = F.col("prediction") >= high_pred, F.col("label") >= high_label, F.col("label") <= -high_label
    over = lambda x, y: F.count_if(x) / F.greatest(F.lit(1), F.count_if(y))
    out = rows.groupBy(*by).agg(
        F.count("*").cast("double").alias("pairs"), F.avg("label").alias("label_mean"), F.avg("prediction").alias("prediction_mean"), F.avg(F.abs(F.col("prediction") - F.col("label"))).alias("mae"),
        over(sure & good, sure).alias("high_conf_precision"), over(sure & good, good).alias("high_value_recall"), over(sure & bad, sure).alias("bad_high_conf_rate"),
    )
    ranks = spearman(rows, "label", "prediction", by)
    return out.join(ranks, list(by)) if by else out.crossJoin(ranks)


def worst_errors(df: DataFrame, n: int) -> DataFrame:
    """The n pairs with the largest absolute error."""
    return df.withColumn("error", F.abs(F.col("prediction") - F.col("label"))).orderBy(F.desc("error"), "conversation_id", "tool_id").limit(n)


def top1_misses(df: DataFrame, n: int) -> DataFrame:
    """Conversations whose first prediction is not the best tool, by the label lost."""
    best = prediction_rank(df, k=1, value="label").select("conversation_id", F.col("tool_id").alias("gold_tool"), F.col("label").alias("gold_label"))
    pred = prediction_rank(df, k=1).select("conversation_id", F.col("tool_id").alias("pred_tool"), F.col("label").alias("pred_label"))
    out = best.join(pred, "conversation_id").where("gold_tool <> pred_tool").withColumn("severity", F.col("gold_label") - F.col("pred_label"))
    return out.orderBy(F.desc("severity"), "conversation_id").limit(n)


def false_positives(df: DataFrame, n: int) -> DataFrame:
    """Pairs predicted above 0 whose label is under -1."""
    return df.where("label < -1 and prediction > 0").withColumn("severity", F.col("prediction") - F.col("label")).orderBy(F.desc("severity"), "conversation_id", "tool_id").limit(n)


def false_negatives(df: DataFrame, n: int) -> DataFrame:
    """Pairs predicted under 0 whose label is above 1."""
    return df.where("label > 1 and prediction < 0").withColumn("severity", F.col("label") - F.col("prediction")).orderBy(F.desc("severity"), "conversation_id", "tool_id").limit(n)
