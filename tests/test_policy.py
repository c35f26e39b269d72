import pytest

from verdigris.operators import consent, policy

C = "conversation_id string, conversation_text string, latest_user_text string, scenario_type string, relevance_mode string, latest_user_actionability string, authorization_level string"
QUIET_LAMP = "用户说：先别监听我的情绪，也别提醒我开安抚灯。今天只想安静写论文。"
FORM = "帮我打开这个网页链接，填写志愿者报名表。最后到提交前停一下给我确认，别直接提交。"
AROMA = "我在想睡前仪式里要不要用薰衣草和暖光，但先别控制设备，只陪我想想。"
LAMP = ("plugin.emotion_lamp_listener", "监听本地语音语调和对话情绪变化，将房间氛围灯调整为安抚模式。")
BROWSER = ("agent.browser_use", "本地浏览器自动化，适合打开 URL、填写网页表单、网页搜索、从网络下载。")
MIXER = ("plugin.aroma_ritual_mixer", "连接本地智能香薰机与灯带，根据聊天主题调配香型、扩香强度与氛围灯颜色。")


def features(spark, text, tool, second, scenario="boundary_or_refusal_no_tool", mode="no_tool_or_low_relevance", act="none", auth="none"):
    conv = spark.createDataFrame([("c", text, "", scenario, mode, act, auth)], C)
    tools = spark.createDataFrame([tool], "tool_id string, source_text string")
    pair = spark.createDataFrame([("c", tool[0])], "conversation_id string, tool_id string")
    return consent.consent_features(pair, consent.consent_signals(conv), consent.tool_abilities(tools), second).first().asDict()


def test_refused_monitoring(spark):
    f = features(spark, QUIET_LAMP, LAMP, False)
    assert len(f) == 47
    assert min(f[k] for k in ("ac_no_call_intent", "ac_denies_monitoring", "ac_tool_continuous_monitoring", "ac_conflict_denied_monitoring", "ac_no_call_side_effect_risk")) > 0
    f = features(spark, QUIET_LAMP, LAMP, True)
    assert len(f) == 24
    assert min(f[k] for k in ("acb_no_call_intent", "acb_tool_background_monitor", "acb_tool_user_state_inference", "acb_denied_operation_conflict", "acb_no_call_side_effect_conflict", "acb_refusal_background_monitor_veto", "acb_refusal_user_state_veto")) > 0


def test_form(spark):
    f = features(spark, FORM, BROWSER, False, "agentic_task", "actionable_tool_relevance", "actionable", "explicit")
    assert min(f[k] for k in ("ac_can_call_intent", "ac_requested_browser", "ac_requested_form_fill", "ac_match_requested_browser", "ac_match_requested_form_fill", "ac_requires_final_confirmation", "ac_conflict_final_submit")) > 0


def test_device_is_no_strong_match(spark):
    f = features(spark, AROMA, MIXER, True)
    assert f["acb_tool_device_or_environment_control"] > 0 and f["acb_refusal_device_control_veto"] > 0 and f["acb_strong_operation_match"] == 0


def test_base_groups(spark):
    conv = policy.conversation_features(spark.createDataFrame([("c", QUIET_LAMP, None, None, None, None, None)], C))
    tool = policy.tool_features(spark.createDataFrame([LAMP, ("agent.a", None)], "tool_id string, source_text string"))
    pair = spark.createDataFrame([("c", LAMP[0]), ("c", "agent.a")], "conversation_id string, tool_id string")
    rows = {r.tool_id: r for r in policy.pair_features(pair, conv, tool).collect()}
    assert len(rows["agent.a"]) == 59 and rows["agent.a"].tool_agent == 1.0 and rows[LAMP[0]].conflict_no_monitoring_tool > 0 and rows[LAMP[0]].conv_quiet_presence > 0
    with pytest.raises(ValueError, match="unknown"):
        policy.pair_features(pair, conv, tool, ("nope",))
