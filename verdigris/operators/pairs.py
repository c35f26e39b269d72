"""Conversation-tool pairs: joins, rendering, virtual candidates, dry-run judgments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators.calibrate import AXES
from verdigris.operators.ranking import ASK_CONFIRM, NO_TOOL

# fixed values: texts by which a conversation counts as one that wants no tool, or wants to be asked first
NO_TOOL_SCENARIOS = ("no_tool", "boundary_or_refusal")
NO_TOOL_MODES = ("no_tool", "low_relevance")
NO_TOOL_TEXTS = ("先别", "不用", "不要", "别帮", "别查", "不查", "不想", "让我安静", "安静会", "just chat", "quiet", "do not", "don't", "no need", "not now")
ASK_SCENARIOS = ("assistant_suggested_tool_no_auth", "proactive_context_weak_tool", "screen_context_weak_tool", "passive_event")
ASK_MODES = ("weak_or_requires_confirmation",)
NO_TOOL_AXES = (0.0, 0.0, 0.0, 2.5, 0.0, 1.5)
ASK_CONFIRM_AXES = (0.5, 0.2, 0.3, 2.5, 0.1, 0.3)


def holds_any(text: Column, parts: Sequence[str]) -> Column:
    """Whether the lower-cased text holds one of the parts; false for a null text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for p in parts:
        out = out | low.contains(p.lower())
    return out


def missing_and_extra(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys in which two tables differ, with ``side`` missing or extra."""
    e, a = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    return e.join(a, list(keys), "left_anti").withColumn("side", F.lit("missing")).unionByName(a.join(e, list(keys), "left_anti").withColumn("side", F.lit("extra")))


def require_none(df: DataFrame, message: str, limit: int = 20) -> None:
    """Raise ``ValueError`` with the first rows, in order, of a table of violations, if it has any."""
    rows = [str(tuple(r)) for r in df.distinct().orderBy(*df.columns).limit(limit).collect()]
    if rows:
        raise ValueError(f"{message}: {', '.join(rows)}")


def join_pairs(scored: DataFrame, candidates: DataFrame, conversations: DataFrame, tools: DataFrame) -> DataFrame:
    """Scores with their candidate set, conversation and tool; anything that is not found raises."""
    for left, right, key in ((scored, candidates, "sample_id"), (candidates, conversations, "conversation_id"), (scored, tools, "tool_id")):
        require_none(left.select(key).distinct().join(right.select(key), key, "left_anti"), f"unknown {key}")
    return scored.join(candidates, "sample_id").join(conversations, "conversation_id").join(tools, "tool_id")


def anchors(pairs: DataFrame, order: str = "tool_id") -> DataFrame:
    """The first row of every conversation, by ``order``, and its highest label: what group predicates look at."""
    cols = [c for c in ("scenario_type", "relevance_mode", "latest_user_text", "latest_user_actionability", "axis_labels", "conversation_text") if c in pairs.columns]
    first = F.min_by(F.struct(*cols), order).alias("a")
    return pairs.groupBy("conversation_id").agg(first, F.max("label").alias("top_label")).select("conversation_id", "a.*", "top_label")


def is_no_tool(threshold: float = 1.0) -> Column:
    """P9, over :func:`anchors`."""
    return holds_any(F.col("scenario_type"), NO_TOOL_SCENARIOS) | holds_any(F.col("relevance_mode"), NO_TOOL_MODES) | holds_any(F.col("latest_user_text"), NO_TOOL_TEXTS) | (F.col("top_label") < threshold)


def is_ask_confirm(exclude_no_tool: bool = False, exclude_actionable: bool = False) -> Column:
    """P10, over :func:`anchors`."""
    out = holds_any(F.col("scenario_type"), ASK_SCENARIOS) | holds_any(F.col("relevance_mode"), ASK_MODES)
    if exclude_no_tool:
        out &= ~is_no_tool(1.0)
    if exclude_actionable:
        out &= ~((F.lower("latest_user_actionability") == "actionable") & ~holds_any(F.col("latest_user_text"), NO_TOOL_TEXTS))
    return out


def _with_virtual(pairs: DataFrame, groups: DataFrame, tool: str, label: Column, axes: tuple[float, ...]) -> DataFrame:
    fixed = {"tool_id": F.lit(tool), "label": label, "raw_score": F.lit(0.0)}
    if "axis_labels" in pairs.columns:
        fixed["axis_labels"] = F.when(F.col("axis_labels").isNotNull(), F.array(*map(F.lit, axes)))
    rows = groups.select(*(fixed.get(c, F.col(c) if c in groups.columns else F.lit(None)).cast(pairs.schema[c].dataType).alias(c) for c in pairs.columns))
    return pairs.unionByName(rows)


def add_no_tool(pairs: DataFrame, no_tool_label: float = 2.5, active_label: float = -0.5, margin: float = 0.0, threshold: float = 1.0) -> DataFrame:
    """A no-tool row for every conversation, on top of its labels if it wants no tool."""
    label = F.when(is_no_tool(threshold), F.greatest(F.lit(no_tool_label), F.col("top_label") + margin)).otherwise(active_label)
    return _with_virtual(pairs, anchors(pairs), NO_TOOL, label, NO_TOOL_AXES)


def add_ask_confirm(pairs: DataFrame, ask_label: float = 2.5, inactive_label: float = -0.5, margin: float = 0.0, ceiling_margin: float = 0.0, exclude_no_tool: bool = False, exclude_actionable: bool = False) -> DataFrame:
    """An ask-first row for every conversation; with ``ceiling_margin``, other labels of those that want to be
    asked are held under it. Apply after :func:`add_no_tool`, whose row it then sees."""
    groups = anchors(pairs).withColumn("asks", is_ask_confirm(exclude_no_tool, exclude_actionable))
    label = F.when(F.col("asks"), F.greatest(F.lit(ask_label), F.col("top_label") + margin)).otherwise(inactive_label)
    groups = groups.withColumn("ask_label", label)
    rows = pairs
    if ceiling_margin > 0:
        top = groups.where("asks").select("conversation_id", (F.col("ask_label") - ceiling_margin).alias("ceiling_"))
        rows = pairs.join(top, "conversation_id", "left").withColumn("label", F.least("label", "ceiling_")).select(pairs.columns)
    return _with_virtual(rows, groups, ASK_CONFIRM, F.col("ask_label"), ASK_CONFIRM_AXES)


def axis_labels(scores: Column) -> Column:
    """A map of axis scores as an array of the six factor axes in their order."""
    return F.array(*(scores[a] for a in AXES[:-1]))


def render_messages(messages: Column, trigger: Column) -> Column:
    """A conversation as prompt text, a line a message, with the number of attachments if there are any."""
    line = lambda m: F.concat(m["role"], F.when(F.size(m["attachments"]) > 0, F.concat(F.lit(" attachments:"), F.size(m["attachments"]))).otherwise(F.lit("")), F.lit(": "), m["text"])
    return F.concat_ws("\n", F.concat(F.lit("trigger: "), trigger), F.transform(messages, line))


def latest_user_text(messages: Column) -> Column:
    """P5: the last message of the user, or an empty text."""
    own = F.filter(messages, lambda m: m["role"] == "user")
    return F.coalesce(F.try_element_at(own, F.lit(-1))["text"], F.lit(""))


def render_tool(tool_id: Column, kind: Column, name: Column, source_text: Column) -> Column:
    """A tool as text; a missing name has no line."""
    return F.concat_ws("\n", F.concat(F.lit("tool_id: "), tool_id), F.concat(F.lit("kind: "), kind), F.when(F.trim(name) != "", F.concat(F.lit("name: "), name)), source_text)


def render_tool_list(candidates: DataFrame, tools: DataFrame) -> DataFrame:
    """Each sample's candidate tools as one numbered text, in candidate order."""
    rows = candidates.select("sample_id", F.posexplode("tool_ids").alias("pos", "tool_id")).join(tools.select("tool_id", "source_text"), "tool_id")
    part = F.concat(F.col("pos") + 1, F.lit(". "), F.col("tool_id"), F.lit("\n"), F.col("source_text"))
    return rows.groupBy("sample_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("tool_list"))


def normalise_judgments(scores: DataFrame, candidates: DataFrame) -> DataFrame:
    """Scores in candidate order; a sample whose scores and candidates differ raises."""
    order = candidates.select("sample_id", F.posexplode("tool_ids").alias("pos", "tool_id"))
    require_none(missing_and_extra(order, scores, ["sample_id", "tool_id"]), "scores and candidates differ")
    return order.join(scores, ["sample_id", "tool_id"])


def dry_run_score(pos: Column, tool_id: Column, is_target: Column, mode: Column, context: Column) -> Column:
    """The deterministic stand-in for a judge. ``pos`` is the 0-based place among the candidates."""
    aimed = F.when(mode == "actionable_tool_relevance", 92.0).when(mode == "weak_or_requires_confirmation", 58.0).when(context == "assistant_tool_suggestion", 38.0).otherwise(24.0)
    return F.when(is_target, aimed).when(tool_id.startswith("agent."), F.greatest(F.lit(15.0), 35.0 - pos)).otherwise(F.greatest(F.lit(2.0), 20.0 - pos))
