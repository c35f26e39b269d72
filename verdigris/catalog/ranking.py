"""Queries on ranking metrics, slices and reports: A10-A16, A19-A21, W7-W10, O3-O8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.catalog.bindings import pairs, tools
from verdigris.functions.numeric import exact_mean
from verdigris.operators import pairs as p
from verdigris.operators import ranking, ranks, reports, sampling, slices

FOLD_METRICS = ("top1_match", "ndcg_at_3", "ndcg_at_5", "mae", "top3_regret")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


def _virtual(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with both virtual candidates; these are predicted by the conversation's mean. A mean of -1.25 gives a prediction of 0,
    which ties with many others in the ranks, so no trace of a summation's order may stay in it."""
    rows = p.add_ask_confirm(p.add_no_tool(pairs(spark, d)))
    mean = pairs(spark, d).groupBy("conversation_id").agg(exact_mean(F.col("prediction")).alias("m"))
    return rows.join(mean, "conversation_id").withColumn("prediction", F.coalesce("prediction", F.col("m") + F.when(F.col("tool_id") == p.NO_TOOL, 1.5).otherwise(1.25))).drop("m")


def _text(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with their tool's text; tools outside the catalogue have none."""
    return pairs(spark, d).join(tools(spark, d).select("tool_id", F.col("source_text").alias("tool_text")), "tool_id", "left")


def metrics_overall(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.compute_metrics(_virtual(spark, d), high_label=1.0, high_pred=1.0))


def group_facts(spark: SparkSession, d: str) -> DataFrame:
    cols = ["conversation_id", "best_tool", "pred_tool", "ndcg_at_3", "ndcg_at_5", "max1", "max3", "max5", "mean3", "bad5", "hits5", "topk_hit"]
    return rounded(ranking.group_facts(pairs(spark, d)).select(cols))


def spearman(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranks.spearman(pairs(spark, d), "label", "prediction", ("scenario_type",)).where("scenario_type is not null"))


def pair_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.pair_metrics(pairs(spark, d)))


def slice_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(slices.slice_metrics(pairs(spark, d)).select("slice_type", "slice", "groups", "pairs", "top1_match", "ndcg_at_5", "bad_top3_rate", "top3_regret", "mae"))


def tool_slice_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(slices.tool_slice_metrics(_text(spark, d)).drop("spearman"))


def tool_exposure(spark: SparkSession, d: str) -> DataFrame:
    return rounded(slices.tool_exposure(_text(spark, d)))


def ranking_table(spark: SparkSession, d: str) -> DataFrame:
    return ranking.prediction_rank(pairs(spark, d), k=8).select("conversation_id", "tool_id", "label", F.round("prediction", 6).alias("prediction"), "rank")


def worst_errors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.worst_errors(pairs(spark, d), 20).select("conversation_id", "tool_id", "label", "prediction", "error"))


def top1_misses(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.top1_misses(pairs(spark, d), 20))


def false_positives(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.false_positives(pairs(spark, d), 20).select("conversation_id", "tool_id", "severity"))


def false_negatives(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.false_negatives(pairs(spark, d), 20).select("conversation_id", "tool_id", "severity"))


def dataset_inspection(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.inspect_dataset(pairs(spark, d)))


def add_virtual(spark: SparkSession, d: str) -> DataFrame:
    """P11 and P12 in turn, the second with a ceiling."""
    rows = p.add_ask_confirm(p.add_no_tool(pairs(spark, d), margin=0.25), margin=0.5, ceiling_margin=0.75)
    return rounded(rows.select("conversation_id", "tool_id", "label", "scenario_type"))


def _folds(spark: SparkSession, d: str) -> DataFrame:
    return ranking.compute_metrics(pairs(spark, d).withColumn("fold", F.pmod(F.substring("conversation_id", 6, 8).cast("int"), F.lit(5))), ("fold",))


def cv_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.aggregate_folds(_folds(spark, d), FOLD_METRICS))


def checkpoint_best(spark: SparkSession, d: str) -> DataFrame:
    """Folds as epochs: the best by each of five objectives."""
    rows = _folds(spark, d).withColumnRenamed("fold", "epoch")
    return reports.best_epochs(rows, {k: F.round(v, 6) for k, v in reports.checkpoint_scores().items()})


def trend_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.trend(_folds(spark, d).withColumnRenamed("fold", "epoch"), "ndcg_at_5"))


def assign_folds(spark: SparkSession, d: str) -> DataFrame:
    return sampling.assign_folds(pairs(spark, d).select("conversation_id").distinct(), 5)


QUERIES = {
    f.__name__: f
    for f in (
        metrics_overall, group_facts, spearman, pair_metrics, slice_metrics, tool_slice_metrics, tool_exposure, ranking_table, worst_errors, top1_misses, false_positives, false_negatives,
        dataset_inspection, add_virtual, cv_aggregate, checkpoint_best, trend_summary, assign_folds,
    )
}

PAIRS = """p as (select conversation_id, tool_id, max(label) label, max(raw_score) raw_score, min(scenario_type) scenario_type, min(relevance_mode) relevance_mode, min(latest_user_text) latest_user_text,
        max(raw_score) / 25 - 2 prediction from pair_examples where conversation_id is not null and tool_id is not null and label is not null and not isnan(raw_score) and raw_score between 0 and 100 group by 1, 2)"""
NO_TOOL = "coalesce(a.scenario_type, '') ilike '%no\\_tool%' escape '\\' or coalesce(a.scenario_type, '') ilike '%boundary\\_or\\_refusal%' escape '\\' or coalesce(a.relevance_mode, '') ilike '%no\\_tool%' escape '\\' or coalesce(a.relevance_mode, '') ilike '%low\\_relevance%' escape '\\' or regexp_matches(lower(coalesce(a.latest_user_text, '')), '先别|不用|不要|别帮|别查|不查|不想|让我安静|安静会|just chat|quiet|do not|don''t|no need|not now')"
ASK = "regexp_matches(lower(coalesce(a.scenario_type, '')), 'assistant_suggested_tool_no_auth|proactive_context_weak_tool|screen_context_weak_tool|passive_event') or lower(coalesce(a.relevance_mode, '')) like '%weak\\_or\\_requires\\_confirmation%' escape '\\'"


def virtual(nt_margin: float = 0.0, ac_margin: float = 0.0, ceiling: float | None = None) -> str:
    """Common table expressions up to v, the pairs with both virtual rows."""
    cap = f"least(n.label, g.ac - {ceiling})" if ceiling else "n.label"
    return f"""{PAIRS},
        a as (select conversation_id, arg_min(scenario_type, tool_id) scenario_type, arg_min(relevance_mode, tool_id) relevance_mode, arg_min(latest_user_text, tool_id) latest_user_text, max(label) top from p group by 1),
        n as (select conversation_id, tool_id, label, prediction, scenario_type from p union all
              select conversation_id, '__NO_TOOL__', case when {NO_TOOL} or top < 1 then greatest(2.5, top + {nt_margin}) else -0.5 end, null, scenario_type from a),
        t as (select conversation_id, max(label) top from n group by 1),
        g as (select conversation_id, a.scenario_type, ({ASK}) asks, case when {ASK} then greatest(2.5, t.top + {ac_margin}) else -0.5 end ac from a join t using (conversation_id)),
        v as (select conversation_id, tool_id, case when g.asks then {cap} else n.label end label, prediction, n.scenario_type from n join g using (conversation_id)
              union all select conversation_id, '__ASK_CONFIRM__', ac, null, scenario_type from g)"""


#: From x(conversation_id, tool_id, label, prediction, keys): one row a conversation.
def facts(keys: str = "", h: float = 0.8) -> str:
    part = f"{keys} conversation_id"
    return f"""f0 as (select {part}, tool_id, label::float::double label, prediction::float::double prediction from x),
        f1 as (select *, row_number() over (partition by {part} order by prediction desc, tool_id) pr, row_number() over (partition by {part} order by label desc, tool_id) lr, min(label) over (partition by {part}) lo from f0),
        f as (select {part}, count(*) pairs, max(label) best_label, max(prediction) top_pred, max(case when lr = 1 then tool_id end) best_tool, max(case when pr = 1 then tool_id end) pred_tool,
            bool_or(tool_id = '__NO_TOOL__') nt, bool_or(tool_id = '__ASK_CONFIRM__') ac, sum((label >= {h})::int) hv, sum((prediction >= {h})::int) hp, sum((prediction >= {h} and label >= {h})::int) hpr,
            max(case when pr <= 1 then label end) m1, max(case when pr <= 3 then label end) m3, max(case when pr <= 5 then label end) m5, avg(case when pr <= 3 then label end) a3, avg(case when pr <= 5 then label end) a5,
            bool_or(pr <= 1 and label <= -{h}) b1, bool_or(pr <= 3 and label <= -{h}) b3, bool_or(pr <= 5 and label <= -{h}) b5, sum((pr <= 3 and label >= {h})::int) h3, sum((pr <= 5 and label >= {h})::int) h5,
            bool_or(pr <= 3 and label <= -{h} and starts_with(tool_id, 'agent.')) ab3, bool_or(pr <= 3 and lr = 1) tk,
            sum(case when pr <= 3 then (label - lo) / log2(pr + 1) else 0 end) d3, sum(case when lr <= 3 then (label - lo) / log2(lr + 1) else 0 end) i3,
            sum(case when pr <= 5 then (label - lo) / log2(pr + 1) else 0 end) d5, sum(case when lr <= 5 then (label - lo) / log2(lr + 1) else 0 end) i5 from f1 group by {part}),
        e as (select *, case when i3 > 0 then d3 / i3 when d3 <= 0 then 1 else 0 end n3, case when i5 > 0 then d5 / i5 when d5 <= 0 then 1 else 0 end n5, best_tool = '__NO_TOOL__' gnt, pred_tool = '__NO_TOOL__' pnt,
            best_tool = '__ASK_CONFIRM__' gac, pred_tool = '__ASK_CONFIRM__' pac, pred_tool in ('__NO_TOOL__', '__ASK_CONFIRM__') quiet, case best_tool when '__NO_TOOL__' then 1 when '__ASK_CONFIRM__' then 2 else 3 end ga,
            case pred_tool when '__NO_TOOL__' then 1 when '__ASK_CONFIRM__' then 2 else 3 end pa from f)"""


def _over(x: str, y: str) -> str:
    return f"round(sum(({x})::int) / greatest(1, sum(({y})::int)), 6)"


def _rate(x: str) -> str:
    return f"round(sum(({x})::int) / count(*), 6)"


_ERR = "round(avg(abs(prediction::float::double - label::float::double)), 6) mae"
_TOOL_SLICES = " union all ".join(
    [f"select conversation_id, tool_id, label, prediction, '{k}' slice from y where starts_with(tool_id, '{k}.')" for k in ("agent", "plugin")]
    + [f"select conversation_id, tool_id, label, prediction, '{k}' slice from y where regexp_matches(lower(concat_ws(chr(10), tool_id, tool_text)), '{'|'.join(v)}')" for k, v in slices.TOOL_SLICES.items()]
)
_TEXT = f"{PAIRS}, s as (select tool_id, any_value(source_text) tool_text from tools group by 1), y as (select p.*, s.tool_text from p left join s using (tool_id))"
_FOLD = f"{PAIRS}, x as (select *, substr(conversation_id, 6, 8)::int % 5 fold from p), {facts('fold,')}, m as (select fold, sum((best_tool = pred_tool)::int) / count(*) top1_match, avg(n3) ndcg_at_3, avg(n5) ndcg_at_5, avg(best_label - m3) top3_regret, avg(best_label - m5) top5_regret, sum(b3::int) / count(*) bad_top3_rate, sum(b5::int) / count(*) bad_top5_rate, sum(tk::int) / count(*) topk_recall, sum(h5) / greatest(1, sum(hv)) hv5, sum(hpr) / greatest(1, sum(hp)) hcp, sum((best_label < 0.8 and top_pred >= 0.8)::int) / greatest(1, sum((best_label < 0.8)::int)) fp from e group by 1), q as (select fold, avg(abs(prediction::float::double - label::float::double)) mae from x group by 1), k as (select * from m join q using (fold))"

ORACLES = {
    "metrics_overall": f"""with {virtual()}, mm as (select conversation_id, avg(prediction) m from p group by 1),
        x as (select v.* replace (coalesce(prediction, m + case when tool_id = '__NO_TOOL__' then 1.5 else 1.25 end) as prediction) from v join mm using (conversation_id)), {facts(h=1.0)},
        o as (select {_rate('best_tool = pred_tool')} top1_match, {_rate('tk')} topk_recall, round(avg(best_label - m1), 6) top1_regret, round(avg(best_label - m3), 6) top3_regret, round(avg(best_label - m5), 6) top5_regret,
            round(avg(n3), 6) ndcg_at_3, round(avg(n5), 6) ndcg_at_5, {_rate('b3')} bad_top3_rate, {_rate('b5')} bad_top5_rate, {_rate('b1 and not quiet')} bad_exposed_top1_rate, {_rate('b3 and not quiet')} bad_exposed_top3_rate, {_rate('b5 and not quiet')} bad_exposed_top5_rate,
            {_over('b1 and not quiet', 'nt and not gnt')} active_bad_top1_rate, {_over('b3 and not quiet', 'nt and not gnt')} active_bad_top3_rate, {_over('b5 and not quiet', 'nt and not gnt')} active_bad_top5_rate,
            {_over('b3 and quiet', 'nt and pnt')} no_tool_suppressed_bad_top3_rate, {_over('b5 and quiet', 'nt and pnt')} no_tool_suppressed_bad_top5_rate, {_rate('ab3')} agent_bad_top3_rate,
            round(avg(a3), 6) top3_label_mean, round(avg(a5), 6) top5_label_mean, round(avg(m3), 6) top3_label_max, round(avg(m5), 6) top5_label_max,
            round(sum(h3) / greatest(1, sum(hv)), 6) high_value_recall_at_3, round(sum(h5) / greatest(1, sum(hv)), 6) high_value_recall_at_5, {_over('best_label < 1 and top_pred >= 1', 'best_label < 1')} no_tool_fp_rate,
            round(sum(hpr) / greatest(1, sum(hp)), 6) high_conf_precision, {_over('nt and gnt = pnt', 'nt')} activation_accuracy, {_over('nt and gnt and pnt', 'nt and gnt')} no_tool_recall, {_over('nt and gnt and pnt', 'nt and pnt')} no_tool_precision,
            {_over('nt and not gnt and best_tool = pred_tool', 'nt and not gnt')} active_tool_top1, {_over('nt and not gnt and tk', 'nt and not gnt')} active_tool_topk, {_over('(nt or ac) and ga = pa', 'nt or ac')} activation_action_accuracy,
            {_over('ac and gac and pac', 'ac and gac')} ask_confirm_recall, {_over('ac and gac and pac', 'ac and pac')} ask_confirm_precision, sum((ac and gac)::int)::double ask_confirm_candidate_groups, sum(nt::int)::double activation_groups,
            sum((nt and gnt)::int)::double no_tool_candidate_groups, sum((nt and not gnt)::int)::double active_candidate_groups, count(*)::double "groups", sum(pairs)::double pairs from e),
        s as (select {_ERR}, round(avg((prediction::float::double - label::float::double) ** 2), 6) mse from x),
        rk as (select rank() over (order by l) + (count(*) over (partition by l) - 1) / 2 lr, rank() over (order by q) + (count(*) over (partition by q) - 1) / 2 qr from (select label::float::double l, prediction::float::double q from x))
        select o.*, s.*, (select round(corr(lr, qr), 6) from rk) spearman from o, s""",
    "group_facts": f"with {PAIRS}, x as (select * from p), {facts()} select conversation_id, best_tool, pred_tool, round(n3, 6) ndcg_at_3, round(n5, 6) ndcg_at_5, round(m1, 6) max1, round(m3, 6) max3, round(m5, 6) max5, round(a3, 6) mean3, b5 bad5, h5 hits5, tk topk_hit from e",
    "spearman": f"""with {PAIRS}, r as (select scenario_type, rank() over (partition by scenario_type order by label) + (count(*) over (partition by scenario_type, label) - 1) / 2 x,
        rank() over (partition by scenario_type order by prediction) + (count(*) over (partition by scenario_type, prediction) - 1) / 2 y from p where scenario_type is not null)
        select scenario_type, round(case when min(x) = max(x) or min(y) = max(y) then 0 else corr(x, y) end, 6) spearman from r group by 1""",
    "pair_metrics": f"""with {PAIRS}, x as (select label::float::double l, prediction::float::double q from p),
        rk as (select rank() over (order by l) + (count(*) over (partition by l) - 1) / 2 lr, rank() over (order by q) + (count(*) over (partition by q) - 1) / 2 qr from x)
        select count(*)::double pairs, round(avg(l), 6) label_mean, round(avg(q), 6) prediction_mean, round(avg(abs(q - l)), 6) mae, {_over('q >= 0.8 and l >= 0.8', 'q >= 0.8')} high_conf_precision, {_over('q >= 0.8 and l >= 0.8', 'l >= 0.8')} high_value_recall,
            {_over('q >= 0.8 and l <= -0.8', 'q >= 0.8')} bad_high_conf_rate, (select round(corr(lr, qr), 6) from rk) spearman from x""",
    "slice_metrics": f"""with {PAIRS}, w as (select *, 'overall' slice_type, 'all' slice from p union all select *, 'scenario', scenario_type from p where scenario_type is not null
        union all select *, 'relevance', relevance_mode from p where relevance_mode is not null union all select *, 'scenario_slice', case when scenario_type in ('companion_chat_no_tool', 'emotional_support_no_tool', 'memory_recall_no_tool', 'open_thread_followup_no_tool') then 'no_tool_companion'
            when scenario_type = 'boundary_or_refusal_no_tool' then 'boundary_refusal' when scenario_type in ('assistant_suggested_tool_no_auth', 'screen_context_weak_tool', 'proactive_context_weak_tool', 'passive_event') then 'weak_context'
            when scenario_type = 'ambiguous_need_clarification' then 'ambiguous' else scenario_type end from p where scenario_type is not null), x as (select * from w where slice_type <> 'scenario_slice' or slice in ('no_tool_companion', 'boundary_refusal', 'agentic_task', 'explicit_plugin_action', 'weak_context', 'ambiguous')), {facts('slice_type, slice,')},
        o as (select slice_type, slice, count(*)::double "groups", sum(pairs)::double pairs, {_rate('best_tool = pred_tool')} top1_match, round(avg(n5), 6) ndcg_at_5, {_rate('b3')} bad_top3_rate, round(avg(best_label - m3), 6) top3_regret from e group by 1, 2)
        select o.*, q.mae from o join (select slice_type, slice, {_ERR} from x group by 1, 2) q using (slice_type, slice)""",
    "tool_slice_metrics": f"""with {_TEXT}, x as (select slice, label::float::double l, prediction::float::double q from ({_TOOL_SLICES}))
        select slice, count(*)::double pairs, round(avg(l), 6) label_mean, round(avg(q), 6) prediction_mean, round(avg(abs(q - l)), 6) mae, {_over('q >= 0.8 and l >= 0.8', 'q >= 0.8')} high_conf_precision, {_over('q >= 0.8 and l >= 0.8', 'l >= 0.8')} high_value_recall, {_over('q >= 0.8 and l <= -0.8', 'q >= 0.8')} bad_high_conf_rate from x group by 1""",
    "tool_exposure": f"""with {_TEXT.replace(', y as (select p.*', ', y0 as (select p.*')}, y as (select * from y0 qualify row_number() over (partition by conversation_id order by prediction desc, tool_id) <= 5),
        z as (select conversation_id, tool_id, row_number() over (partition by conversation_id order by prediction desc, tool_id) r from y), u as ({_TOOL_SLICES}), k as (select u.*, z.r from u join z using (conversation_id, tool_id)), n as (select count(distinct conversation_id) g from p),
        c as (select slice, conversation_id, bool_or(r <= 1)::int a1, bool_or(r <= 3)::int a3, bool_or(r <= 5)::int a5, bool_or(r <= 3 and label <= -0.8)::int b3, bool_or(r <= 5 and label <= -0.8)::int b5, sum((r <= 3)::int) c3, count(*) c5 from k group by 1, 2)
        select slice, max(g)::double "groups", round(sum(a1) / max(g), 6) top1_exposure_rate, round(sum(a3) / max(g), 6) top3_exposure_rate, round(sum(a5) / max(g), 6) top5_exposure_rate, round(sum(b3) / max(g), 6) bad_top3_exposure_rate,
            round(sum(b5) / max(g), 6) bad_top5_exposure_rate, round(sum(c3) / max(g), 6) avg_top3_count, round(sum(c5) / max(g), 6) avg_top5_count from c, n group by 1""",
    "ranking_table": f"with {PAIRS} select conversation_id, tool_id, label, round(prediction, 6) prediction, row_number() over (partition by conversation_id order by prediction desc, tool_id) rank from p qualify rank <= 8",
    "worst_errors": f"with {PAIRS} select conversation_id, tool_id, round(label, 6) label, round(prediction, 6) prediction, round(abs(prediction - label), 6) error from p order by abs(prediction - label) desc, conversation_id, tool_id limit 20",
    "top1_misses": f"""with {PAIRS}, k as (select *, row_number() over (partition by conversation_id order by label desc, tool_id) l, row_number() over (partition by conversation_id order by prediction desc, tool_id) q from p)
        select conversation_id, g.tool_id gold_tool, round(g.label, 6) gold_label, b.tool_id pred_tool, round(b.label, 6) pred_label, round(g.label - b.label, 6) severity from k g join k b using (conversation_id) where g.l = 1 and b.q = 1 and g.tool_id <> b.tool_id order by g.label - b.label desc, conversation_id limit 20""",
    "false_positives": f"with {PAIRS} select conversation_id, tool_id, round(prediction - label, 6) severity from p where label < -1 and prediction > 0 order by prediction - label desc, conversation_id, tool_id limit 20",
    "false_negatives": f"with {PAIRS} select conversation_id, tool_id, round(label - prediction, 6) severity from p where label > 1 and prediction < 0 order by label - prediction desc, conversation_id, tool_id limit 20",
    "dataset_inspection": f"with {PAIRS}, g as (select count(*) n from p group by conversation_id) select (select count(*) from g) \"groups\", (select min(n) from g) min_size, (select max(n) from g) max_size, (select round(avg(n), 6) from g) mean_size, count(*) pairs, round(min(label), 6) min_label, round(max(label), 6) max_label, round(avg(label), 6) mean_label, sum((label >= 0.8)::int) high_labels from p",
    "add_virtual": f"with {virtual(0.25, 0.5, 0.75)} select conversation_id, tool_id, round(label, 6) label, scenario_type from v",
    "cv_aggregate": f"with {_FOLD}, u as (unpivot (select top1_match, ndcg_at_3, ndcg_at_5, mae, top3_regret from k) on * into name metric value value) select metric, round(avg(value), 6) mean, round(stddev_samp(value), 6) std, round(min(value), 6) min, round(max(value), 6) max from u group by 1",
    "checkpoint_best": f"""with {_FOLD}, u as (select fold epoch, 'ndcg_at_5' objective, round(ndcg_at_5, 6) score from k union all select fold, 'top5_regret', round(-top5_regret, 6) from k union all select fold, 'legacy_score', round(topk_recall - fp - mae, 6) from k
        union all select fold, 'composite', round(0.35 * ndcg_at_5 + 0.25 * topk_recall + 0.2 * hv5 - 0.2 * top5_regret - 0.2 * bad_top3_rate - 0.1 * mae, 6) from k union all select fold, 'safety', round(0.35 * hcp + 0.25 * (1 - bad_top3_rate) + 0.2 * (1 - bad_top5_rate) + 0.2 * (1 - fp), 6) from k)
        select objective, epoch, score from u qualify row_number() over (partition by objective order by score desc, epoch) = 1""",
    "trend_summary": f"""with {_FOLD}, l as (select arg_max(ndcg_at_5, fold) v from k), r as (select arg_max(ndcg_at_5, fold) - arg_min(ndcg_at_5, fold) x from (select * from k order by fold desc limit 3))
        select fold best_epoch, round(ndcg_at_5, 6) best, round(l.v, 6) last, round(r.x, 6) recent_delta, abs(r.x) < 0.01 saturated from k, l, r order by ndcg_at_5 desc, fold limit 1""",
}
