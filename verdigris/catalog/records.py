"""Queries on judges' and generators' records, splits of exact size and scorers: J2, J3, P17, P20, P22, F15, A16, S12, J11, M1, M7, R1, R4, R6."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.catalog.bindings import axis_judgments, pairs, table, tasks, tools
from verdigris.catalog.ranking import rounded
from verdigris.operators import models, records, reports, sampling
from verdigris.operators.calibrate import AXES


def judge_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Samples of known conversations with their task."""
    rows = table(spark, d, "pair_examples").where("sample_id is not null").select("sample_id", "conversation_id").distinct()
    known = tasks(spark, d).select("conversation_id", "language", "scenario_type")
    return records.judge_tasks(rows.join(known.select("conversation_id"), "conversation_id", "left_semi"), known)


def join_predictions(spark: SparkSession, d: str) -> DataFrame:
    """A prediction for each labelled pair."""
    rows = pairs(spark, d)
    return rounded(records.join_predictions(rows.select("conversation_id", "tool_id", "prediction"), rows.select("conversation_id", "tool_id", "label")))


def axis_scores(spark: SparkSession, d: str) -> DataFrame:
    """P17 over all order lines."""
    rows = axis_judgments(spark, d)
    candidates = rows.groupBy("sample_id").agg(F.array_sort(F.collect_set("tool_id")).alias("tool_ids"))
    return records.axis_scores(rows.unpivot(["sample_id", "tool_id"], list(AXES), "axis", "raw_score"), candidates)


def _dry_run(spark: SparkSession, d: str) -> DataFrame:
    return records.dry_run_conversations(tasks(spark, d), tools(spark, d).select("tool_id", "name"))


def dry_run_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The first message for each task."""
    return _dry_run(spark, d).select("conversation_id", "scenario_id", F.get("messages", 0)["text"].alias("ask"), F.size("messages").alias("messages"))


def normalise_conversations(spark: SparkSession, d: str) -> DataFrame:
    """P20 over P22, whose records claim another mode and no language."""
    made = _dry_run(spark, d).withColumn("language", F.lit("")).withColumn("extra", F.create_map(F.lit("tool_relevance_mode"), F.lit("claimed"), F.lit("note"), F.col("conversation_id")))
    own = tasks(spark, d).withColumn("seed", F.lit(0))
    out = records.normalise_conversations(made, own)
    return out.select("conversation_id", "trigger", "language", F.col("extra")["tool_relevance_mode"].alias("mode"), F.col("extra")["note"].alias("note"))


def factor_interactions(spark: SparkSession, d: str) -> DataFrame:
    """the first six numbers of each vector as factors."""
    rows = table(spark, d, "embeddings").select("vec_id", models.factor_interactions(F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double"))).alias("x"))
    return rounded(rows.select("vec_id", *(F.get("x", k).alias(f"x{k}") for k in range(7))), 5)


def factor_errors(spark: SparkSession, d: str) -> DataFrame:
    """Axis labels against the next axis's."""
    rows = table(spark, d, "pair_examples").where("axis_labels is not null").select(F.col("axis_labels").alias("factor_labels"), F.concat(F.slice("axis_labels", 2, 5), F.slice("axis_labels", 1, 1)).alias("factor_predictions"))
    return rounded(reports.factor_errors(rows))


def train_losses(spark: SparkSession, d: str) -> DataFrame:
    """A log of customers by nation as epochs; the last entry of an epoch counts."""
    log = table(spark, d, "customer").select(F.col("c_nationkey").alias("epoch"), F.col("c_custkey").alias("pos"), F.col("c_acctbal").cast("double").alias("train_loss"))
    return reports.with_train_loss(table(spark, d, "nation").select(F.col("n_nationkey").alias("epoch")), log)


def split_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many conversations are on each side."""
    return sampling.split_groups(tasks(spark, d).select("conversation_id"), validation=0.15).groupBy("split").agg(F.count("*").alias("conversations"))


def fold_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The sizes of seven folds."""
    return sampling.assign_folds(tasks(spark, d).select("conversation_id"), 7).groupBy("fold").agg(F.count("*").alias("conversations"))


def cv_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The sizes of three parts."""
    return sampling.split_for_cv(tasks(spark, d).select("conversation_id"), 0.3, 0.1).groupBy("part").agg(F.count("*").alias("conversations"))


def sample_in_turn(spark: SparkSession, d: str) -> DataFrame:
    """Candidate sets for all conversations, one after the other, from the runtime pool: weights last from set to set."""
    return sampling.sample_in_turn(tasks(spark, d), table(spark, d, "runtime_pool"), 0.05)


def pair_scores(spark: SparkSession, d: str) -> DataFrame:
    """M1, M7: a network of equal weights over all vectors."""
    w = {k: np.full_like(v, 0.0 if k.endswith(".b") else 0.1) for k, v in models.new_network([64, 8, 4, 1]).items()}
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return rounded(models.predict(rows, "embedding", functools.partial(models.pair_score, w)).drop("factor_predictions"), 4)


QUERIES = {f.__name__: f for f in (judge_tasks, join_predictions, axis_scores, dry_run_conversations, normalise_conversations, factor_interactions, factor_errors, train_losses, split_sizes, fold_sizes, cv_sizes, sample_in_turn, pair_scores)}

_TASKS = "t as (select conversation_id, min(target_tool_ids) target_tool_ids, min(lower(trim(scenario_type))) scenario_type, min(lower(trim(language))) \"language\" from generation_tasks where conversation_id is not null group by 1)"
_COUNT = f"with {_TASKS}, c as (select count(*) n from t)"
_AXES = ", ".join(f"{{'k': {k + 1}, 'axis': '{a}', 'v': {v}}}" for k, (a, v) in enumerate(zip(AXES, ("l_quantity", "l_discount * 1000", "l_tax * 1250", "(l_linenumber * 14)::double", "(l_partkey % 101)::double", "(l_suppkey % 101)::double", "l_quantity * 2"))))
_ASK = """_n as (select tool_id, any_value(metadata.name) name from tools group by 1), e as (select conversation_id, unnest(target_tool_ids) tool_id, unnest(range(len(target_tool_ids))) pos from t),
        a as (select conversation_id, string_agg(coalesce(name, e.tool_id), '、' order by pos) topic from e left join _n using (tool_id) group by 1)"""

ORACLES = {
    "judge_tasks": f"with {_TASKS} select distinct sample_id, p.conversation_id, t.\"language\", t.scenario_type from pair_examples p join t using (conversation_id) where sample_id is not null",
    "join_predictions": "select conversation_id, tool_id, round(max(raw_score) / 25 - 2, 6) prediction, round(max(label), 6) \"label\" from pair_examples where conversation_id is not null and tool_id is not null and label is not null and not isnan(raw_score) and raw_score between 0 and 100 group by 1, 2",
    "axis_scores": f"""with l as (select l_orderkey sample_id, 'plugin.s' || l_suppkey tool_id, unnest([{_AXES}], recursive := true) from lineitem), m as (select sample_id, tool_id, k, axis, max(v) raw_score from l group by all)
        select sample_id, (dense_rank() over (partition by sample_id order by tool_id) - 1)::int pos, tool_id, k::int axis_no, axis, raw_score from m""",
    "dry_run_conversations": f"with {_TASKS}, {_ASK} select conversation_id, 'dry_run:' || conversation_id scenario_id, 'Something about ' || coalesce(topic, '') || ': what is needed?' ask, 2::int messages from t left join a using (conversation_id)",
    "normalise_conversations": f"""with {_TASKS} select conversation_id, 'turn_end' "trigger", "language", case when scenario_type in ('companion_chat_no_tool', 'emotional_support_no_tool', 'boundary_or_refusal_no_tool', 'memory_recall_no_tool', 'open_thread_followup_no_tool', 'assistant_suggested_tool_no_auth') then 'no_tool_or_low_relevance'
        when scenario_type in ('screen_context_weak_tool', 'proactive_context_weak_tool', 'ambiguous_need_clarification') then 'weak_or_requires_confirmation' else 'actionable_tool_relevance' end "mode", conversation_id note from t""",
    "factor_interactions": "with e as (select vec_id, embedding::double[] e from embeddings) select vec_id, " + ", ".join(f"round(e[{i + 1}] * e[{j + 1}], 5) + 0.0 x{k}" for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 3), (3, 5), (1, 5), (4, 1), (4, 3)))) + " from e",
    "factor_errors": "with e as (select unnest(axis_labels) y, unnest(axis_labels[2:6] || axis_labels[1:1]) x, unnest(range(6)) axis from pair_examples where axis_labels is not null) select axis::int axis, round(avg(abs(x - y)), 6) mae, round(avg((x - y) * (x - y)), 6) mse from e group by 1",
    "train_losses": "select n_nationkey epoch, arg_max(c_acctbal::double, c_custkey) train_loss from nation left join customer on c_nationkey = n_nationkey group by 1",
    "split_sizes": f"{_COUNT} select 'valid' split, greatest(1, round_even(n * 0.15, 0))::bigint conversations from c union all select 'train', (n - greatest(1, round_even(n * 0.15, 0)))::bigint from c",
    "fold_sizes": f"{_COUNT} select f::int fold, ((n - f + 6) // 7)::bigint conversations from c, range(7) r(f)",
    "cv_sizes": f"{_COUNT}, k as (select n, greatest(1, round_even(n * 0.1, 0))::bigint h, greatest(1, round_even(n * 0.3, 0))::bigint v from c) select 'holdout' part, h conversations from k union all select 'cv', v from k union all select 'base', n - h - v from k",
    "pair_scores": "select vec_id, round(0.032 * greatest(list_sum(embedding::double[]), 0), 4) prediction from embeddings",
}
