"""Metrics over overlapping slices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators.ranking import compute_metrics, pair_metrics, prediction_rank

# fixed values: named slices of scenarios, and of tools by words in their id or text
SCENARIO_SLICES = {
    "no_tool_companion": ("companion_chat_no_tool", "emotional_support_no_tool", "memory_recall_no_tool", "open_thread_followup_no_tool"),
    "boundary_refusal": ("boundary_or_refusal_no_tool",),
    "agentic_task": ("agentic_task",),
    "explicit_plugin_action": ("explicit_plugin_action",),
    "weak_context": ("assistant_suggested_tool_no_auth", "screen_context_weak_tool", "proactive_context_weak_tool", "passive_event"),
    "ambiguous": ("ambiguous_need_clarification",),
}
TOOL_SLICES = {
    "external": ("send", "post", "reply", "upload", "api", "browser", "web", "发送", "发布", "上传"),
    "monitoring": ("monitor", "listen", "watch", "camera", "detect", "监听", "监控", "观察"),
    "proactive": ("proactive", "remind", "monitor", "watch", "listen", "auto", "提醒", "监听", "监控", "自动"),
    "file": ("file", "folder", "pdf", "doc", "csv", "文件", "合同", "本地"),
    "browser": ("browser", "web", "url", "网页", "页面", "链接", "打开"),
    "search": ("search", "lookup", "find", "检索", "搜索", "查找"),
    "message": ("sms", "discord", "wechat", "email", "reply", "message", "短信", "回复"),
}


def scenario_slices(scenario: Column, slices: Mapping[str, Sequence[str]] = SCENARIO_SLICES) -> Column:
    """The names of the slices a scenario is in; any table of slices will do."""
    return F.filter(F.array(*(F.when(scenario.isin(*v), F.lit(k)) for k, v in slices.items())), lambda x: x.isNotNull())


def tool_slices(tool_id: Column, text: Column, slices: Mapping[str, Sequence[str]] = TOOL_SLICES) -> Column:
    """The names of the slices a tool is in, by its id's prefix and by words in id or text in any case; any table of
    slices will do."""
    both = F.lower(F.concat_ws("\n", tool_id, text))
    parts = [F.when(tool_id.startswith(f"{k}."), F.lit(k)) for k in ("agent", "plugin")]
    parts += [F.when(both.rlike("|".join(v)), F.lit(k)) for k, v in slices.items()]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def slice_rows(df: DataFrame) -> DataFrame:
    """Every pair once for each slice of conversations it is in: overall, named scenarios, each exact scenario and
    relevance mode. Overlapping slices become rows, so that one aggregation serves them all."""
    name = lambda kind, x: F.when(x.isNotNull(), F.struct(F.lit(kind).alias("slice_type"), x.alias("slice")))
    named = F.transform(scenario_slices(F.col("scenario_type")), lambda x: F.struct(F.lit("scenario_slice").alias("slice_type"), x.alias("slice")))
    single = F.array(name("overall", F.lit("all")), name("scenario", F.col("scenario_type")), name("relevance", F.col("relevance_mode")))
    return df.withColumn("s_", F.explode(F.filter(F.concat(single, named), lambda x: x.isNotNull()))).select("s_.*", *df.columns)


def slice_metrics(df: DataFrame, **thresholds: float) -> DataFrame:
    """The grouped metrics of each slice of conversations."""
    return compute_metrics(slice_rows(df), ("slice_type", "slice"), **thresholds)


def tool_slice_metrics(df: DataFrame, **thresholds: float) -> DataFrame:
    """The pair metrics of each slice of tools; ``df`` has ``tool_text``."""
    rows = df.withColumn("slice", F.explode(tool_slices(F.col("tool_id"), F.col("tool_text"))))
    return pair_metrics(rows, ("slice",), **thresholds)


def tool_exposure(df: DataFrame, high_label: float = 0.8) -> DataFrame:
    """How often each slice of tools is among a conversation's first 1, 3 and 5, over all conversations."""
    total = df.select("conversation_id").distinct().agg(F.count("*").alias("groups"))
    top = prediction_rank(df, k=5)
    hit = top.withColumn("slice", F.explode(tool_slices(F.col("tool_id"), F.col("tool_text"))))
    r, bad = F.col("rank"), F.col("label") <= -high_label
    per = hit.groupBy("slice", "conversation_id").agg(
        *(F.max(r <= k).alias(f"any{k}") for k in (1, 3, 5)), *(F.max((r <= k) & bad).alias(f"bad{k}") for k in (3, 5)), *(F.count_if(r <= k).alias(f"count{k}") for k in (3, 5))
    )
    out = per.groupBy("slice").agg(
        *(F.count_if(F.col(f"any{k}")).alias(f"n{k}") for k in (1, 3, 5)), *(F.count_if(F.col(f"bad{k}")).alias(f"b{k}") for k in (3, 5)), *(F.sum(f"count{k}").alias(f"c{k}") for k in (3, 5))
    ).crossJoin(F.broadcast(total))
    g = F.col("groups")
    return out.select("slice", g.cast("double").alias("groups"), *((F.col(f"n{k}") / g).alias(f"top{k}_exposure_rate") for k in (1, 3, 5)), *((F.col(f"b{k}") / g).alias(f"bad_top{k}_exposure_rate") for k in (3, 5)), *((F.col(f"c{k}") / g).alias(f"avg_top{k}_count") for k in (3, 5)))
