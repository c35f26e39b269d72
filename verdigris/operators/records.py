"""Records as judges and generators return them: parsed, checked, put in order, joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import json_object
from verdigris.operators.calibrate import AXES
from verdigris.operators.generation import scenario_metadata
from verdigris.operators.pairs import missing_and_extra, require_none


def judge_tasks(candidates: DataFrame, conversations: DataFrame) -> DataFrame:
    """Candidate sets with their conversation; conversations that are not found raise, named in order."""
    require_none(candidates.select("conversation_id").distinct().join(conversations.select("conversation_id"), "conversation_id", "left_anti"), "unknown conversations")
    return candidates.join(conversations, "conversation_id")


def join_predictions(predictions: DataFrame, examples: DataFrame) -> DataFrame:
    """Predictions with the example of their conversation and tool; one without raises, and so does one made twice."""
    keys = ["conversation_id", "tool_id"]
    require_none(predictions.groupBy(*keys).count().where("count > 1").select(*keys), "predicted twice")
    require_none(predictions.select(*keys).join(examples.select(*keys), keys, "left_anti"), "predicted, but no example")
    return predictions.join(examples.drop(*(c for c in predictions.columns if c not in keys)), keys)


def axis_scores(judgments: DataFrame, candidates: DataFrame) -> DataFrame:
    """Multi-axis scores ``sample_id, pos, tool_id, axis_no, axis, raw_score`` in candidate order and the axes' own.

    ``judgments(sample_id, tool_id, axis, raw_score)``, ``candidates(sample_id, tool_ids)``. A sample whose tools differ from its
    candidates raises, and so does a tool that lacks an axis; axes beyond the seven are left out, and of a repeated one the
    highest score counts.
    """
    order = candidates.select("sample_id", F.posexplode("tool_ids").alias("pos", "tool_id"))
    require_none(missing_and_extra(order, judgments, ["sample_id", "tool_id"]), "scores and candidates differ")
    wanted = F.array(*map(F.lit, AXES))
    rows = judgments.where(F.array_contains(wanted, F.col("axis"))).groupBy("sample_id", "tool_id", "axis").agg(F.max("raw_score").alias("raw_score"))
    full = rows.where("raw_score is not null").groupBy("sample_id", "tool_id").agg(F.count("*").alias("n")).where(F.col("n") == len(AXES))
    require_none(order.select("sample_id", "tool_id").distinct().join(full, ["sample_id", "tool_id"], "left_anti"), "missing axis scores")
    return order.join(rows, ["sample_id", "tool_id"]).select("sample_id", "pos", "tool_id", F.array_position(wanted, F.col("axis")).cast("int").alias("axis_no"), "axis", "raw_score")


def attachment_text(value: Column) -> Column:
    """An attachment, as JSON, as a text: a string as it is, an object by what names it and its kind, unless the name tells
    the kind, else its JSON. A null is the text null."""
    at = lambda *names: F.coalesce(*(F.nullif(F.get_json_object(value, f"$.{n}"), F.lit("")) for n in names))
    name, kind = at("name", "filename", "title", "type"), at("type", "mime_type")
    text = F.when(kind.isNotNull() & ~F.contains(name, kind), F.concat(name, F.lit(" ("), kind, F.lit(")"))).otherwise(name)
    bare = F.from_json(F.concat(F.lit('{"x":'), value, F.lit("}")), "x string")["x"]
    return F.when(value.startswith('"'), bare).when(value.startswith("{") & name.isNotNull(), text).otherwise(value)


def attachments(value: Column) -> Column:
    """A message's attachments, as JSON of whatever kind a model gave, as an array of texts: null is none, a single one a list."""
    items = F.when(value.startswith("["), F.from_json(value, "array<string>")).otherwise(F.array(value))
    # array elements that are strings come without their quotes
    each = F.transform(items, lambda x: F.when(value.startswith("[") & ~x.rlike("^[{\\[]"), x).otherwise(attachment_text(x)))
    return F.when(value.isNull() | (value == "null"), F.array().cast("array<string>")).otherwise(each)


def normalise_conversations(generated: DataFrame, tasks: DataFrame) -> DataFrame:
    """P20: generated conversations with what their task says in place of what the model says of it.

    ``generated`` has ``conversation_id, messages, trigger, scenario_id, language, extra`` (a map); ``tasks`` has ``conversation_id,
    target_tool_ids, language, scenario_type, seed``. The messages stay; a missing trigger is the turn's end, a missing language the
    task's; what goes with the scenario wins over the model's extra entries.
    """
    own = ("context_type", "authorization_level", "activity_state", "latest_user_actionability")
    t = scenario_metadata(tasks.select("conversation_id", "target_tool_ids", F.col("language").alias("task_language"), "scenario_type", "seed"))
    known = F.create_map(*(x for k, v in {"scenario_type": "scenario_type", "tool_relevance_mode": "relevance_mode", **{c: c for c in own}}.items() for x in (F.lit(k), F.col(v).cast("string"))))
    rows = generated.select("conversation_id", "messages", "trigger", "scenario_id", "language", "extra").join(t, "conversation_id")
    rest = F.map_filter(F.coalesce("extra", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(known), k))
    return rows.select("conversation_id", "messages", F.coalesce(F.nullif("trigger", F.lit("")), F.lit("turn_end")).alias("trigger"), "target_tool_ids", "scenario_id", F.coalesce(F.nullif("language", F.lit("")), "task_language").alias("language"), "seed", F.map_concat(rest, known).alias("extra"))


def dry_run_conversations(tasks: DataFrame, tools: DataFrame, ask: str = "Something about {}: what is needed?", answer: str = "Tell me the goal and what there is.") -> DataFrame:
    """A stand-in conversation of two messages for each task; ``ask`` takes the names of the target tools, in their order.

    ``tasks(conversation_id, target_tool_ids, scenario_type)``, ``tools(tool_id, name)``; a tool without a name goes by its id."""
    names = tools.groupBy("tool_id").agg(F.max("name").alias("name"))
    each = tasks.select("conversation_id", F.posexplode_outer("target_tool_ids").alias("pos", "tool_id")).join(names, "tool_id", "left")
    named = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("name", "tool_id").alias("n")))), lambda x: x["n"])
    topic = each.groupBy("conversation_id").agg(F.array_join(named, "、").alias("topic"))
    before, _, after = ask.partition("{}")
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
    both = F.array(message("user", F.concat(F.lit(before), "topic", F.lit(after))), message("assistant", F.lit(answer)))
    return tasks.join(topic, "conversation_id").select("conversation_id", both.alias("messages"), F.lit("turn_end").alias("trigger"), F.concat(F.lit("dry_run:"), "conversation_id").alias("scenario_id"), "target_tool_ids", "scenario_type")


def response_text(response: Column) -> Column:
    """The text of a model's response, as JSON: its ``output_text``, or all texts of its output's contents; null if it has none."""
    parsed = F.from_json(response, "output array<struct<content: array<struct<text: string>>>>")
    texts = F.filter(F.flatten(F.transform(parsed["output"], lambda o: F.coalesce(F.transform(o["content"], lambda c: c["text"]), F.array().cast("array<string>")))), lambda x: x.isNotNull())
    return F.coalesce(F.get_json_object(response, "$.output_text"), F.when(F.size(texts) > 0, F.array_join(texts, "")))


_REPLY = "state_id string, rationale string, slates array<struct<slate_id: string, slate_score: double, action_scores: array<struct<tool_id: string, action: string, score: double>>>>"


def parse_slate_judgments(replies: DataFrame, slates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """judges' replies ``state_id, reply`` (JSON, bare or in prose) as (judged slates, faults).

    ``slates(state_id, slate_id)`` are those that were shown. A reply that is no object, names another state, judges a slate that
    was not shown or leaves one out is a fault, ``state_id, fault, slate_ids``, and gives no judged slate. Of a slate judged
    twice both stay. Judged: ``state_id, slate_id, slate_score, action_scores, rationale``; missing scores are 0.
    """
    r = replies.select("state_id", F.from_json(json_text(F.col("reply")), _REPLY).alias("r"))
    given = F.array_distinct(F.transform(F.coalesce("r.slates", F.array().cast("array<struct<slate_id: string, slate_score: double, action_scores: array<struct<tool_id: string, action: string, score: double>>>>")), lambda s: F.coalesce(s["slate_id"], F.lit(""))))
    shown = slates.groupBy("state_id").agg(F.array_sort(F.collect_set("slate_id")).alias("shown"))
    rows = r.withColumn("given", given).join(shown, "state_id", "left").withColumn("shown", F.coalesce("shown", F.array().cast("array<string>")))
    extra, missing = F.array_sort(F.array_except("given", "shown")), F.array_sort(F.array_except("shown", "given"))
    fault = F.when(F.col("r").isNull(), "not_an_object").when(~F.col("r.state_id").eqNullSafe(F.col("state_id")), "other_state").when(F.size(extra) > 0, "unexpected_slates").when(F.size(missing) > 0, "missing_slates")
    rows = rows.withColumn("fault", fault).withColumn("slate_ids", F.when(F.col("fault") == "unexpected_slates", extra).when(F.col("fault") == "missing_slates", missing))
    good = rows.where("fault is null").select("state_id", F.explode("r.slates").alias("s"), F.coalesce("r.rationale", F.lit("")).alias("rationale"))
    scores = F.transform(F.coalesce("s.action_scores", F.array().cast("array<struct<tool_id: string, action: string, score: double>>")), lambda a: F.struct(F.coalesce(a["tool_id"], F.lit("")).alias("tool_id"), F.coalesce(a["action"], F.lit("")).alias("action"), F.coalesce(a["score"], F.lit(0.0)).alias("score")))
    return good.select("state_id", "s.slate_id", F.coalesce("s.slate_score", F.lit(0.0)).alias("slate_score"), scores.alias("action_scores"), "rationale"), rows.where("fault is not null").select("state_id", "fault", "slate_ids")


def json_text(text: Column) -> Column:
    """The JSON object of a reply as it stands there: all of it, or from the first brace to the last; null if it is none."""
    bare = F.trim(text)
    return F.when(json_object(text).isNotNull(), F.when(bare.startswith("{") & F.try_parse_json(bare).isNotNull(), bare).otherwise(F.regexp_extract(text, "(?s)\\{.*\\}", 0)))


def judged_actions(judged: DataFrame, slates: DataFrame) -> DataFrame:
    """Each judged action with the action of its slate, ``state_id, slate_id, tool_id, action, score``; one that its slate does
    not hold raises. ``slates(state_id, slate_id, tool_id, action)`` is in long form."""
    rows = judged.select("state_id", "slate_id", F.explode("action_scores").alias("a")).select("state_id", "slate_id", "a.*")
    keys = ["state_id", "slate_id", "tool_id", "action"]
    require_none(rows.join(slates.select(*keys), keys, "left_anti").select(*keys), "judged actions that are not in their slate")
    return rows.join(slates.select(*keys).distinct(), keys)


def rollout_records(states: DataFrame, slates: DataFrame, judged: DataFrame) -> DataFrame:
    """A nested record for each state: its slates, in the order of their ids, with their actions and what the judge gave."""
    actions = slates.groupBy("state_id", "slate_id").agg(F.array_sort(F.collect_list(F.struct("place", "tool_id", F.round("gain", 4).alias("gain")))).alias("actions"))
    both = actions.join(judged.select("state_id", "slate_id", "slate_score", "action_scores"), ["state_id", "slate_id"], "left")
    nested = both.groupBy("state_id").agg(F.array_sort(F.collect_list(F.struct("slate_id", "slate_score", "actions", "action_scores"))).alias("slates"))
    return states.join(nested, "state_id", "left")
