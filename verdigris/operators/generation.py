"""Tasks, specifications and stand-in judgments that start a data set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.operators.calibrate import AXES
from verdigris.operators.ranks import positions
from verdigris.operators.sampling import uniform
from verdigris.operators.universe import clean_keywords, plugin_source_text

# fixed values: scenarios with their context, authorisation, activity, actionability and relevance mode
SCENARIOS = (
    ("companion_chat_no_tool", "companion_chat", "none", "chatting", "none", "no_tool_or_low_relevance"),
    ("emotional_support_no_tool", "emotional_support", "none", "unknown", "none", "no_tool_or_low_relevance"),
    ("boundary_or_refusal_no_tool", "user_boundary", "none", "unknown", "none", "no_tool_or_low_relevance"),
    ("memory_recall_no_tool", "memory_recall", "none", "chatting", "none", "no_tool_or_low_relevance"),
    ("open_thread_followup_no_tool", "open_thread_followup", "none", "idle", "none", "no_tool_or_low_relevance"),
    ("ambiguous_need_clarification", "ambiguous_request", "implied", "unknown", "clarify", "weak_or_requires_confirmation"),
    ("screen_context_weak_tool", "screen_context", "implied", "focused_work", "clarify", "weak_or_requires_confirmation"),
    ("proactive_context_weak_tool", "proactive_context", "none", "idle", "none", "weak_or_requires_confirmation"),
    ("assistant_suggested_tool_no_auth", "assistant_tool_suggestion", "none", "chatting", "none", "no_tool_or_low_relevance"),
    ("explicit_plugin_action", "explicit_plugin_action", "explicit", "unknown", "actionable", "actionable_tool_relevance"),
    ("agentic_task", "agentic_task", "explicit", "focused_work", "actionable", "actionable_tool_relevance"),
    ("passive_event", "passive_event", "implied", "unknown", "actionable", "actionable_tool_relevance"),
)
SCENARIO_MIX = ("companion_chat_no_tool", *(s[0] for s in SCENARIOS))  # the first counts twice
LANGUAGE_MIX = ("zh", "zh", "zh", "en", "mixed")
PLUGIN_SCENARIOS = ("explicit_plugin_action", "passive_event", "screen_context_weak_tool", "proactive_context_weak_tool", "assistant_suggested_tool_no_auth")


def scenario_metadata(df: DataFrame) -> DataFrame:
    """P25: ``df`` with what goes with its ``scenario_type``: an unknown one counts as companion chat, with the actionable
    mode. The table of scenarios is fixed, so it is broadcast."""
    names = ("context_type", "authorization_level", "activity_state", "latest_user_actionability", "relevance_mode")
    table = df.sparkSession.createDataFrame(list(SCENARIOS), ", ".join(f"{c} string" for c in ("scenario_type", *names)))
    rest = (*SCENARIOS[0][1:5], "actionable_tool_relevance")
    joined = df.join(F.broadcast(table), "scenario_type", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in zip(names, rest)})


def dry_run_axes(rows: DataFrame) -> DataFrame:
    """A stand-in for the multi-axis judge, in long form. ``rows`` has ``pos`` (from 0), ``tool_id, is_target, relevance_mode``."""
    none, weak = F.col("relevance_mode") == "no_tool_or_low_relevance", F.col("relevance_mode") == "weak_or_requires_confirmation"
    aim, pos = F.col("is_target"), F.col("pos")
    values = (
        F.when(aim, 88.0).otherwise(F.greatest(F.lit(8.0), 35.0 - pos)), F.when(none, 25.0).when(weak, 55.0).otherwise(88.0), F.when(aim, 82.0).otherwise(F.greatest(F.lit(5.0), 30.0 - pos)), F.when(none, 35.0).when(weak, 58.0).otherwise(82.0),
        F.when(F.col("tool_id").startswith("agent."), 72.0).otherwise(42.0), F.when(none & aim, 35.0).when(weak, 62.0).otherwise(76.0), F.when(none & aim, 20.0).when(weak & aim, 52.0).when(aim, 90.0).otherwise(12.0),
    )
    scores = F.array(*(F.struct(F.lit(a).alias("axis"), v.alias("raw_score")) for a, v in zip(AXES, values)))
    return rows.withColumn("x_", F.explode(scores)).select(*rows.columns, "x_.axis", "x_.raw_score")


def conversation_tasks(spark: SparkSession, tools: DataFrame, count: int, targets: int = 1, seed: int = 0, scenarios: Sequence[str] = SCENARIO_MIX, languages: Sequence[str] = LANGUAGE_MIX) -> DataFrame:
    """``count`` tasks, each with a scenario, a language and ``targets`` tools from the pool that suits the scenario: agents for
    agentic tasks, plugins for five others, else all. Draws are fixed by seed and task, so tasks are made in parallel.

    Tools are numbered within their pool; a task draws distinct numbers, any set of which is as likely, and joins the tools by number."""
    if count < 1 or targets < 1:
        raise ValueError("count and targets must be at least 1")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (F.floor(uniform("n", seed=seed + k) * len(values)) + 1).cast("int"))
    tasks = spark.range(1, count + 1).withColumnRenamed("id", "n").withColumn("scenario_type", pick(scenarios, 1)).withColumn("language", pick(languages, 2))
    kinds = {r.kind: r.n for r in tools.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    size = {"agent": kinds.get("agent", 0), "plugin": kinds.get("plugin", 0), "all": sum(kinds.values())}
    if not size["all"]:
        raise ValueError("no tools")
    s = F.col("scenario_type")
    wanted = F.when((s == "agentic_task") & F.lit(size["agent"] > 0), "agent").when(s.isin(*PLUGIN_SCENARIOS) & F.lit(size["plugin"] > 0), "plugin").otherwise("all")
    pools = tools.select("tool_id", F.explode(F.array("kind", F.lit("all"))).alias("pool"))
    pools = positions(pools, ["pool", "tool_id"], "place")
    first = pools.groupBy("pool").agg(F.min("place").alias("first"))  # three rows at most
    pools = pools.join(F.broadcast(first), "pool").select("tool_id", "pool", (F.col("place") - F.col("first")).alias("number"))
    sizes = F.create_map(*(x for k, v in size.items() for x in (F.lit(k), F.lit(v))))
    tasks = tasks.withColumn("pool", wanted).withColumn("size", sizes[F.col("pool")])
    # each target has a draw of its own among the numbers that are left: one that hits a taken number moves on past it
    def next_(acc: Column, k: Column) -> Column:
        draw = F.floor(uniform("n", k, seed=seed + 3) * (F.col("size") - F.size(acc))).cast("long")
        free = F.aggregate(F.array_sort(acc), draw, lambda at, taken: at + (taken <= at).cast("long"))
        return F.concat(acc, F.array(free))

    wanted_ = F.sequence(F.lit(1), F.least(F.lit(targets), F.col("size")).cast("int"))
    numbers = F.aggregate(wanted_, F.array().cast("array<bigint>"), next_)
    drawn = tasks.select("*", F.posexplode(numbers).alias("k", "number"))
    named = drawn.join(pools, ["pool", "number"]).groupBy("n").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "tool_id"))), lambda x: x["tool_id"]).alias("target_tool_ids"))
    return tasks.join(named, "n").select(F.format_string("conv_%06d", "n").alias("conversation_id"), "target_tool_ids", "language", "scenario_type")


def checked_specs(specs: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Specifications of synthetic plugins as (tools, faults).

    Texts are trimmed, the prefix of the id dropped, keywords cleaned. A specification with a malformed id, a blank text or no
    keyword is a fault. Of several with one id the first by ``pos`` stays; ids that exist already are left out.
    """
    text = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("name", "description", "short_description")}
    rows = specs.withColumns(text | {"id": F.regexp_replace(F.trim("id"), "^plugin\\.", ""), "keywords": F.coalesce(clean_keywords(F.col("keywords")), F.array().cast("array<string>"))})
    faults = [F.when(~F.coalesce(F.col("id").rlike("^[a-z][a-z0-9_]{2,63}$"), F.lit(False)), F.lit("id"))] + [F.when(F.col(c) == "", F.lit(c)) for c in text] + [F.when(F.size("keywords") == 0, F.lit("keywords"))]
    rows = rows.withColumn("faults", F.filter(F.array(*faults), lambda x: x.isNotNull()))
    good = rows.where(F.size("faults") == 0).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where("r = 1").withColumn("tool_id", F.concat(F.lit("plugin."), F.col("id")))
    if existing is not None:
        good = good.join(existing.select("tool_id"), "tool_id", "left_anti")
    source = plugin_source_text(F.col("id"), F.col("name"), F.coalesce("type", F.lit("plugin")), F.col("description"), F.col("short_description"), F.col("keywords"), F.coalesce("passive", F.lit(False)))
    return good.select("tool_id", F.lit("plugin").alias("kind"), source.alias("source_text")), rows.where(F.size("faults") > 0).select("pos", "id", "faults")


def tool_fields(tools: DataFrame) -> DataFrame:
    """A tool's text in fields: identity, description and capabilities, from ``metadata`` where it has them, else from
    the text that stands in for them."""
    m = F.col("metadata")
    line = lambda key, v: F.when(F.length(v) > 0, F.concat(F.lit(f"{key}: "), v))
    identity = F.concat_ws("\n", F.concat(F.lit("tool_id: "), F.col("tool_id")), F.concat(F.lit("kind: "), F.col("kind")), *(line(k, m[k]) for k in ("id", "name", "type")))
    described = F.concat_ws("\n", *(line(k, m[k]) for k in ("description", "short_description")))
    described = F.when(described != "", described).otherwise(F.col("source_text"))
    text = {"keywords": F.array_join(F.transform(m["keywords"], lambda x: F.coalesce(x, F.lit("None"))), ", "), "capability_key": m["capability_key"], "method": m["method"], "passive": F.initcap(m["passive"].cast("string")), "priority": m["priority"].cast("string")}
    able = F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), v) for k, v in text.items()))
    return tools.select("tool_id", identity.alias("identity"), described.alias("description"), F.when(able != "", able).otherwise(described).alias("capabilities"))


def render_with_context(messages: Column, trigger: Column, extra: Column) -> Column:
    """A conversation as model text: trigger, what is known of it (``extra``, a map), and a line a message."""
    known = lambda k: F.coalesce(extra[k], F.lit("unknown"))
    context = F.concat(F.lit("context: scenario="), known("scenario_type"), F.lit("; auth="), known("authorization_level"), F.lit("; actionability="), known("latest_user_actionability"))
    note = lambda m: F.when(F.size(m["attachments"]) > 0, F.concat(F.lit(" attachments="), F.array_join(m["attachments"], "; "))).otherwise(F.lit(""))
    lines = F.transform(messages, lambda m: F.concat(m["role"], note(m), F.lit(": "), F.coalesce(m["text"], F.lit(""))))
    return F.concat_ws("\n", F.concat(F.lit("trigger: "), F.coalesce(trigger, F.lit("turn_end"))), F.when(F.size(extra) > 0, context), lines)
