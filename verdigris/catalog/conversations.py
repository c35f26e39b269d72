"""Queries on conversations, candidates and jobs: J1, J5, J6, J8-J10, J12, P2, P6, P7, P23-P27, R1, R4, W11, X1, A5, A25."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.catalog.bindings import judgments, table, tasks, tools
from verdigris.catalog.ranking import rounded
from verdigris.operators import generation, jobs, pairs, sampling, universe


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pair_examples").where("sample_id is not null and tool_id is not null").select("sample_id", "tool_id").distinct()


def coverage_missing_extra(spark: SparkSession, d: str) -> DataFrame:
    """Conversations with a task and none with a split, and the other way round."""
    own = table(spark, d, "dataset_bundle").where("conversation_id is not null")
    return pairs.missing_and_extra(tasks(spark, d), own, ["conversation_id"])


def pending_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Documents that no one has labelled."""
    return jobs.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "doc_labels"), "doc_id")


def prune_errors(spark: SparkSession, d: str) -> DataFrame:
    """Error events of users without a purchase."""
    e = table(spark, d, "events")
    return jobs.prune_errors(e.where("event_type = 'error'").select("event_id", "user_id"), e.where("event_type = 'purchase'"), "user_id")


def dry_run_judgment(spark: SparkSession, d: str) -> DataFrame:
    """For every conversation and its targets: what the stand-in judge gives, in the order of ids."""
    t = tasks(spark, d).select("conversation_id", "scenario_type", F.posexplode(F.array_sort(F.array_distinct("target_tool_ids"))).alias("pos", "tool_id"))
    mode = F.when(F.col("scenario_type").endswith("no_tool"), "no_tool_or_low_relevance").when(F.col("scenario_type").contains("weak"), "weak_or_requires_confirmation").otherwise("actionable_tool_relevance")
    score = pairs.dry_run_score(F.col("pos"), F.col("tool_id"), F.col("pos") % 2 == 0, mode, F.lit("none"))
    return t.select("conversation_id", "tool_id", score.alias("raw_score"))


def dry_run_axes(spark: SparkSession, d: str) -> DataFrame:
    """As the query above, for all axes."""
    t = generation.scenario_metadata(tasks(spark, d)).select("conversation_id", "relevance_mode", F.posexplode(F.array_sort(F.array_distinct("target_tool_ids"))).alias("pos", "tool_id"))
    rows = generation.dry_run_axes(t.withColumn("is_target", F.col("pos") % 2 == 0))
    return rows.select("conversation_id", "tool_id", "axis", "raw_score")


def scenario_metadata(spark: SparkSession, d: str) -> DataFrame:
    """P25: tasks by what goes with their scenario."""
    return generation.scenario_metadata(tasks(spark, d)).groupBy("authorization_level", "relevance_mode").agg(F.count("*").alias("tasks"))


def tool_fields(spark: SparkSession, d: str) -> DataFrame:
    """P7."""
    return generation.tool_fields(table(spark, d, "tools").select("tool_id", "kind", "source_text", "metadata").dropDuplicates(["tool_id"]))


def conversation_tasks(spark: SparkSession, d: str) -> DataFrame:
    """P26, P27 over the whole catalogue, as many tasks as there are rows of them."""
    return generation.conversation_tasks(spark, tools(spark, d).select("tool_id", "kind"), table(spark, d, "generation_tasks").count(), 2)


def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(universe.quality_summary(_candidates(spark, d), judgments(spark, d), tools(spark, d)))


def plugin_exposures(spark: SparkSession, d: str) -> DataFrame:
    return universe.plugin_exposures(_candidates(spark, d), tools(spark, d))


def anchor_join(spark: SparkSession, d: str) -> DataFrame:
    """Labelled pairs with their tool and their task."""
    rows = table(spark, d, "pair_examples").where("label is not null and sample_id is not null").select("sample_id", "conversation_id", "tool_id", "label")
    known, conv = tools(spark, d).select("tool_id", "kind", "name"), tasks(spark, d).select("conversation_id", "language")
    rows = rows.join(known, "tool_id", "left_semi").join(conv, "conversation_id", "left_semi")
    return pairs.join_pairs(rows.select("sample_id", "tool_id", "label").distinct(), rows.select("sample_id", "conversation_id").distinct(), conv, known)


def render_tools(spark: SparkSession, d: str) -> DataFrame:
    t = tools(spark, d)
    return t.select("tool_id", pairs.render_tool(F.col("tool_id"), F.col("kind"), F.col("name"), F.col("source_text")).alias("text"))


def render_tool_lists(spark: SparkSession, d: str) -> DataFrame:
    """The target tools of every conversation as prompt text."""
    return pairs.render_tool_list(tasks(spark, d).select(F.col("conversation_id").alias("sample_id"), F.col("target_tool_ids").alias("tool_ids")), tools(spark, d))


def sample_candidates(spark: SparkSession, d: str) -> DataFrame:
    """R1 over the whole catalogue, the tools and the runtime pool; at this rate a set has room for all targets."""
    both = universe.union_universes([tools(spark, d).select("tool_id", "kind"), table(spark, d, "runtime_pool").select("tool_id", "kind")])
    return sampling.sample_candidates(tasks(spark, d), both, 0.01)


def split_groups(spark: SparkSession, d: str) -> DataFrame:
    return sampling.split_groups(tasks(spark, d).select("conversation_id"))


def sample_numbers(spark: SparkSession, d: str) -> DataFrame:
    return sampling.number_samples(tasks(spark, d).select("conversation_id"))


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """A job over unlabelled documents whose worker refuses those without a language."""

    def worker(item: dict) -> str:
        if not isinstance(item["lang"], str):
            raise ValueError("no language")
        return item["lang"].strip().lower()

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "lang")
    _, _, counts = jobs.run_jobs(docs, table(spark, d, "doc_labels").select(F.col("doc_id").alias("item_id")), worker)
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} long" for k in counts))


QUERIES = {f.__name__: f for f in (coverage_missing_extra, pending_jobs, prune_errors, dry_run_judgment, dry_run_axes, scenario_metadata, tool_fields, conversation_tasks, quality_summary, plugin_exposures, anchor_join, render_tools, render_tool_lists, sample_candidates, split_groups, sample_numbers, run_summary)}

_TASKS = "t as (select conversation_id, min(target_tool_ids) target_tool_ids, min(lower(trim(scenario_type))) scenario_type, min(lower(trim(language))) language from generation_tasks where conversation_id is not null group by 1)"
_TOOLS = "u as (select tool_id, any_value(kind) kind, any_value(source_text) source_text, any_value(metadata.name) name from tools group by 1)"

ORACLES = {
    "coverage_missing_extra": "with a as (select distinct conversation_id from generation_tasks where conversation_id is not null), b as (select distinct conversation_id from dataset_bundle where conversation_id is not null) select conversation_id, 'missing' side from (from a except from b) union all select conversation_id, 'extra' from (from b except from a)",
    "pending_jobs": "select doc_id from documents where doc_id not in (select doc_id from doc_labels where doc_id is not null)",
    "prune_errors": "select event_id, user_id from events where event_type = 'error' and user_id not in (select user_id from events where event_type = 'purchase' and user_id is not null)",
    "dry_run_judgment": f"""with {_TASKS}, l as (select conversation_id, scenario_type, list_sort(list_distinct(target_tool_ids)) ids from t), e as (select conversation_id, scenario_type, unnest(ids) tool_id, unnest(range(len(ids))) pos from l)
        select conversation_id, tool_id, case when pos % 2 = 0 then case when scenario_type like '%no\\_tool' escape '\\' then 24.0 when contains(scenario_type, 'weak') then 58.0 else 92.0 end
            when starts_with(tool_id, 'agent.') then greatest(15.0, 35.0 - pos) else greatest(2.0, 20.0 - pos) end::double raw_score from e""",
    "dry_run_axes": f"""with {_TASKS}, l as (select conversation_id, scenario_type s, list_sort(list_distinct(target_tool_ids)) ids from t), e as (select conversation_id, s, unnest(ids) tool_id, unnest(range(len(ids))) pos from l),
        m as (select *, pos % 2 = 0 aim, s in ('companion_chat_no_tool', 'emotional_support_no_tool', 'boundary_or_refusal_no_tool', 'memory_recall_no_tool', 'open_thread_followup_no_tool', 'assistant_suggested_tool_no_auth') no,
            s in ('screen_context_weak_tool', 'proactive_context_weak_tool', 'ambiguous_need_clarification') weak from e),
        v as (select conversation_id, tool_id, case when aim then 88 else greatest(8, 35 - pos) end::double capability_match, case when coalesce(no, false) then 25 when coalesce(weak, false) then 55 else 88 end::double action_demand, case when aim then 82 else greatest(5, 30 - pos) end::double target_specificity,
            case when coalesce(no, false) then 35 when coalesce(weak, false) then 58 else 82 end::double consent_boundary, case when starts_with(tool_id, 'agent.') then 72 else 42 end::double intervention_cost,
            case when coalesce(no, false) and aim then 35 when coalesce(weak, false) then 62 else 76 end::double companionship_fit, case when coalesce(no, false) and aim then 20 when coalesce(weak, false) and aim then 52 when aim then 90 else 12 end::double final_preference from m)
        unpivot v on columns(* exclude (conversation_id, tool_id)) into name axis value raw_score""",
    "scenario_metadata": f"""with {_TASKS} select case when scenario_type in ('explicit_plugin_action', 'agentic_task') then 'explicit' when scenario_type in ('ambiguous_need_clarification', 'screen_context_weak_tool', 'passive_event') then 'implied' else 'none' end authorization_level,
        case when scenario_type in ('companion_chat_no_tool', 'emotional_support_no_tool', 'boundary_or_refusal_no_tool', 'memory_recall_no_tool', 'open_thread_followup_no_tool', 'assistant_suggested_tool_no_auth') then 'no_tool_or_low_relevance'
            when scenario_type in ('screen_context_weak_tool', 'proactive_context_weak_tool', 'ambiguous_need_clarification') then 'weak_or_requires_confirmation' else 'actionable_tool_relevance' end relevance_mode, count(*) tasks from t group by 1, 2""",
    "tool_fields": """with u as (select tool_id, any_value(kind) kind, any_value(source_text) st, any_value(metadata) m from tools group by 1),
        f as (select tool_id, concat_ws(chr(10), 'tool_id: ' || tool_id, 'kind: ' || kind, 'id: ' || nullif(m.id, ''), 'name: ' || nullif(m.name, ''), 'type: ' || nullif(m.type, '')) identity,
            coalesce(nullif(concat_ws(chr(10), 'description: ' || nullif(m.description, ''), 'short_description: ' || nullif(m.short_description, '')), ''), st) description,
            concat_ws(chr(10), 'keywords: ' || list_aggregate(list_transform(m.keywords, lambda x: coalesce(x, 'None')), 'string_agg', ', '), case when len(m.keywords) = 0 then 'keywords: ' end, 'capability_key: ' || m.capability_key, 'method: ' || m.method, 'passive: ' || case when m.passive then 'True' when not m.passive then 'False' end, 'priority: ' || m.priority) c from u)
        select tool_id, identity, description, coalesce(nullif(c, ''), description) capabilities from f""",
    "quality_summary": f"""with {_TOOLS}, c as (select distinct sample_id, tool_id from pair_examples where sample_id is not null and tool_id is not null), j as (select sample_id, tool_id, raw_score from pair_examples where sample_id is not null and tool_id is not null and not isnan(raw_score) and raw_score between 0 and 100),
        a as (select tool_id from u where kind = 'agent'), k as (select sample_id, sum((tool_id in (select tool_id from a))::int) n from c group by 1), o as (select sample_id from (from c except select sample_id, tool_id from j) union select sample_id from (select sample_id, tool_id from j except from c))
        select (select count(*) from k) samples, (select count(*) from c where tool_id in (select tool_id from u where kind = 'plugin')) plugin_exposures, (select count(*) from k where n < (select count(*) from a)) missing_agent_samples, (select count(*) from o) invalid_judgment_samples,
            (select round(avg((m >= 80)::int), 6) from (select max(raw_score) m from j group by sample_id)) high_raw_score_ratio""",
    "plugin_exposures": f"with {_TOOLS} select tool_id, count(distinct sample_id) samples from pair_examples where tool_id in (select tool_id from u where kind = 'plugin') and sample_id is not null group by 1",
    "anchor_join": f"with {_TASKS}, {_TOOLS}, r as (select distinct sample_id, conversation_id, tool_id, label from pair_examples where label is not null and sample_id is not null) select r.*, u.kind, u.name, t.language from r join u using (tool_id) join t using (conversation_id)",
    "render_tools": f"with {_TOOLS} select tool_id, concat_ws(chr(10), 'tool_id: ' || tool_id, 'kind: ' || kind, case when trim(name) <> '' then 'name: ' || name end, source_text) \"text\" from u",
    "render_tool_lists": f"with {_TASKS}, {_TOOLS}, e as (select conversation_id, unnest(target_tool_ids) tool_id, unnest(range(len(target_tool_ids))) pos from t) select conversation_id sample_id, string_agg((pos + 1) || '. ' || tool_id || chr(10) || source_text, chr(10) || chr(10) order by pos) tool_list from e join u using (tool_id) group by 1",
    "sample_numbers": f"with {_TASKS} select conversation_id, printf('sample_%06d', row_number() over (order by conversation_id)) sample_id from t",
    "run_summary": """with i as (select doc_id, lang from documents), d as (select distinct doc_id from doc_labels where doc_id is not null), s as (select i.* from i where doc_id not in (select doc_id from d))
        select (select count(*) from i) total, (select count(*) from d) completed_existing, count(*) submitted, count(lang) succeeded, (count(*) - count(lang)) failed, (select count(*) from i) - count(*) skipped from s""",
}
