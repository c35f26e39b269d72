import pytest
from pyspark.sql import functions as F

from verdigris.catalog import ranking as queries
from verdigris.operators import pairs as p
from verdigris.operators.ranking import ASK_CONFIRM, NO_TOOL, compute_metrics, group_facts
from verdigris.operators.slices import tool_exposure

M = "conversation_id string, tool_id string, label double, prediction double"
P = "conversation_id string, tool_id string, label double, raw_score double, scenario_type string, relevance_mode string, latest_user_text string, latest_user_actionability string, axis_labels array<double>"


def metrics(spark, rows):
    return compute_metrics(spark.createDataFrame(rows, M), high_label=1.0, high_pred=1.0).first()


def test_activation(spark):
    m = metrics(spark, [("n", NO_TOOL, 2.5, 2.2), ("n", "plugin.monitor", 1.0, 1.4), ("a", "agent.browser_use", 2.0, 2.1), ("a", NO_TOOL, -0.5, 0.2)])
    assert m.activation_accuracy == m.no_tool_recall == m.no_tool_precision == m.active_tool_top1 == m.activation_action_accuracy == 1.0
    assert m.bad_exposed_top3_rate == m.bad_exposed_top5_rate == 0.0


def test_exposure(spark):
    rows = [("n", NO_TOOL, 2.5, 2.4), ("n", "plugin.bad_monitor", -1.2, 2.1), ("n", "plugin.ok_reader", 1.1, 1.8), ("n", "plugin.bad_reply", -1.3, 1.7), ("a", "agent.browser_use", 2.0, 2.2), ("a", "plugin.bad_uploader", -1.4, 1.9)]
    m = metrics(spark, rows)
    assert (m.bad_top3_rate, m.bad_exposed_top3_rate, m.bad_exposed_top5_rate, m.no_tool_suppressed_bad_top3_rate, m.active_bad_top3_rate) == (1.0, 0.5, 0.5, 1.0, 1.0)
    facts = {r.conversation_id: r for r in group_facts(spark.createDataFrame(rows, M), high_label=1.0).collect()}
    assert facts["n"].ndcg_at_3 == pytest.approx(0.943862, abs=1e-6) and facts["a"].ndcg_at_3 == 1.0


def test_ask_confirm(spark):
    m = metrics(spark, [("c", ASK_CONFIRM, 2.5, 2.4), ("c", "plugin.weak", 1.7, 2.1), ("c", "plugin.bad", -1.2, 1.9), ("a", "agent.browser_use", 2.0, 2.2), ("a", ASK_CONFIRM, -0.5, 0.2)])
    assert m.activation_action_accuracy == m.ask_confirm_recall == m.ask_confirm_precision == 1.0
    assert m.bad_top3_rate == 0.5 and m.bad_exposed_top3_rate == 0.0 and len(m.__fields__) == 43


def row(scenario, mode, label, text=""):
    return ("c", "plugin.x", label, 0.0, scenario, mode, text, "none", None)


@pytest.mark.parametrize("scenario,mode,label,margin,want", [("boundary_or_refusal_no_tool", "m", 1.2, 0.0, 2.5), ("actionable_browser_task", "high_relevance", 2.1, 0.0, -0.5), ("companion_chat_no_tool", "m", 3.1, 0.25, 3.35)])
def test_no_tool_rows(spark, scenario, mode, label, margin, want):
    got = p.add_no_tool(spark.createDataFrame([row(scenario, mode, label)], P), margin=margin)
    assert [r.label for r in got.where(F.col("tool_id") == NO_TOOL).collect()] == [pytest.approx(want)]


def test_ask_rows(spark):
    add = lambda s, m, l, **k: {r.tool_id: r.label for r in p.add_ask_confirm(spark.createDataFrame([row(s, m, l)], P), **k).collect()}  # noqa: E731, E741
    assert add("proactive_context_weak_tool", "m", 1.7)[ASK_CONFIRM] == 2.5
    assert add("explicit_plugin_action", "high", 2.1)[ASK_CONFIRM] == -0.5
    got = add("screen_context_weak_tool", "m", 3.0, margin=0.5, ceiling_margin=0.75)
    assert got[ASK_CONFIRM] == 3.5 and got["plugin.x"] == 2.75


def test_refusing_text(spark):
    got = p.add_no_tool(spark.createDataFrame([row("x", "y", 3.0, "今天先别动工具")], P)).where(F.col("tool_id") == NO_TOOL).first()
    assert got.label == 3.0


def test_tool_exposure(spark):
    rows = [("c", "agent.a", 1.0, 3.0, None), ("c", "plugin.web_x", -1.0, 2.0, "t"), ("d", "plugin.y", 0.0, 1.0, "监听")]
    got = {r.slice: r for r in tool_exposure(spark.createDataFrame(rows, M + ", tool_text string")).collect()}
    assert got["plugin"].top1_exposure_rate == 0.5 and got["plugin"].top3_exposure_rate == 1.0 and got["browser"].bad_top3_exposure_rate == 0.5 and got["monitoring"].groups == 2


def test_coverage_raises(spark):
    a, b = spark.createDataFrame([("s", "x"), ("s", "y")], "sample_id string, tool_id string"), spark.createDataFrame([("s", ["x", "z"])], "sample_id string, tool_ids array<string>")
    with pytest.raises(ValueError, match="differ"):
        p.normalise_judgments(a, b)


def test_virtual_predictions_are_exact(spark, tmp_path):
    # the mean of the three predictions is -1.25, but summed in double, in any order, it misses that by 2.2e-16
    rows = [("c", f"plugin.{k}", 1.0, x, "s", "r", "t", "a", None) for k, x in enumerate((23.02, 21.2, 12.03))]
    spark.createDataFrame(rows, P).write.parquet(f"{tmp_path}/pair_examples.parquet")
    got = {r.tool_id: r.prediction for r in queries._virtual(spark, str(tmp_path)).collect()}
    assert (got[NO_TOOL], got[ASK_CONFIRM]) == (0.25, 0.0)
