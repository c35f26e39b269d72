"""Policy features on consent: what a conversation wants, refuses or puts off, against what a tool may do (section 2.9.1: the groups
action_consent and action_consent_b).

Everything is a table: signals of a conversation and abilities of a tool are each the highest of some base features and pattern scores;
a feature is a signal, an ability, or a signal times the highest of some abilities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import score_any
from verdigris.operators.policy import REFUSAL, conversation_features, latest_or_whole, tool_features

# fixed values: patterns over lower-cased texts
DEFER = ("先别", "现在.*别", "暂时.*别", "等.*再", "not now", "later", "don't.*now")
CONFIRM = ("提交前.*确认", "发送前.*确认", "发布前.*确认", "先.*确认", "别.*提交", "不要.*提交", "before.*submit", "before.*send", "confirm.*before")
REQUESTS = {
    "search": ("搜", "搜索", "查", "检索", "找.*资料", "lookup", "search", "find"),
    "browser": ("打开.*链接", "打开.*网页", "网页", "url", "链接", "browser", "web"),
    "form_fill": ("填.*表", "填写", "报名", "表单", "form", "apply"),
    "save_template": ("存.*模板", "保存.*模板", "话术", "文本片段", "snippet", "template"),
    "message_reply": ("回复", "私信", "短信", "邮件", "send", "reply", "message", "email"),
    "file_access": ("文件", "资料", "pdf", "文档", "folder", "file", "doc"),
    "monitoring": ("监听", "监控", "提醒", "watch", "listen", "monitor", "detect"),
    "device_control": ("调灯", "开灯", "关灯", "控制", "香薰", "设备", "灯光", "control"),
}
OPERATIONS = {
    "read_or_fetch": ("读", "读取", "查看", "打开", "检索", "搜索", "查找", "retrieve", "read", "fetch", "search", "lookup"),
    "local_write": ("保存", "记录", "写入", "创建", "整理", "模板", "片段", "save", "write", "create", "template", "snippet"),
    "external_action": ("发送", "发布", "上传", "回复", "私信", "邮件", "api", "send", "post", "upload", "reply", "message", "email"),
    "agentic_operation": ("帮我", "打开.*网页", "填写", "填.*表", "处理", "执行", "自动", "browser", "web", "form", "execute", "automate"),
    "background_monitor": ("监听", "监控", "后台", "提醒", "自动回复", "monitor", "watch", "listen", "detect", "auto.?reply"),
    "user_state_inference": ("情绪", "心情", "语气", "压力", "状态", "emotion", "mood", "tone", "stress"),
    "device_or_environment_control": ("调灯", "开灯", "关灯", "灯光", "香薰", "设备", "清洁", "机器人", "device", "light", "lamp", "diffuser", "robot", "control"),
    "commit_or_submit": ("提交", "确认提交", "发送", "发布", "下单", "submit", "commit", "send", "post", "purchase"),
}
DENIALS = {
    "search": ("别.*搜", "不要.*搜", "别.*查", "不要.*查", "先别.*查", "don't search", "do not search"),
    "monitoring": ("别.*监听", "不要.*监听", "不想.*监听", "别.*监控", "不要.*监控", "别.*看", "don't monitor"),
    "upload": ("别.*上传", "不要.*上传", "don't upload", "do not upload"),
    "message": ("别.*回复", "不要.*回复", "别.*发", "不要.*发", "don't send", "do not send"),
    "control": ("别.*控制", "不要.*控制", "不要管", "别.*调灯", "不要.*调灯", "don't control"),
    "file_access": ("别.*资料", "不要.*资料", "别.*文件", "不要.*文件", "别.*索引", "不要.*索引"),
}
# fixed values: a signal's base features, then its patterns by the text they look at
SIGNALS = {
    "no_call": (("conv_no_tool", "conv_just_venting", "conv_quiet_presence"), {"mode": ("no_tool", "companion", "emotional_support", "memory_recall")}),
    "ask": ((), {"mode": ("weak", "clarification", "ambiguous", "suggested_tool_no_auth"), "user": ("要不要", "可以吗", "先问", "确认", "maybe", "should i")}),
    "call": (("conv_authorized",), {"mode": ("agentic_task", "explicit_plugin_action", "actionable_tool")}),
    "refusal": (("conv_refusal",), {"text": REFUSAL}),
    "user_refusal": (("conv_refusal",), {}),
    "defer": ((), {"user": DEFER}),
    "venting": (("conv_just_venting",), {}),
    "quiet": (("conv_quiet_presence",), {}),
    "authorized": (("conv_authorized",), {}),
    "confirm": ((), {"text": CONFIRM}),
    "user_confirm": ((), {"user": CONFIRM}),
    **{f"denies_{k}": ((), {"user": v}) for k, v in DENIALS.items()},
    **{f"requested_{k}": ((), {"user": v}) for k, v in REQUESTS.items()},
    **{f"wants_{k}": ((), {"user": OPERATIONS[k]}) for k in ("read_or_fetch", "local_write", "external_action", "agentic_operation")},
}
# fixed values: an ability's base features, then its patterns; abilities of the second group carry the prefix op_
ABILITIES = {
    "external_side_effect": (("tool_external", "tool_message", "tool_social"), ()),
    "continuous_monitoring": (("tool_monitoring", "tool_camera", "tool_emotion"), ()),
    "device_control": (("tool_home", "tool_audio", "tool_emotion"), ()),
    "agentic_control": (("tool_agent", "tool_browser"), ()),
    "search": (("tool_search", "tool_research"), ()),
    "browser": (("tool_browser",), ()),
    "form_fill": (("tool_browser",), ("form", "表单", "报名", "apply")),
    "save_template": ((), ("snippet", "template", "模板", "话术", "文本片段")),
    "message_reply": (("tool_message",), ()),
    "file_access": (("tool_file",), ()),
    "op_read_or_fetch": (("tool_file", "tool_search", "tool_research", "tool_browser"), OPERATIONS["read_or_fetch"]),
    "op_local_write": ((), OPERATIONS["local_write"]),
    "op_external_action": (("tool_external", "tool_message", "tool_social"), OPERATIONS["external_action"]),
    "op_background_monitor": (("tool_monitoring", "tool_camera", "tool_proactive"), OPERATIONS["background_monitor"]),
    "op_user_state_inference": (("tool_emotion",), OPERATIONS["user_state_inference"]),
    "op_device_or_environment_control": (("tool_home", "tool_audio"), OPERATIONS["device_or_environment_control"]),
    "op_agentic_operation": (("tool_agent", "tool_browser"), OPERATIONS["agentic_operation"]),
    "op_commit_or_submit": ((), OPERATIONS["commit_or_submit"]),
}
SIDE_EFFECTS = tuple(f"op_{k}" for k in OPERATIONS if k not in ("read_or_fetch", "local_write"))
# fixed values: the features of the first group: a signal, abilities, or both
_MONITORING = "continuous_monitoring"
CONSENT = {
    "ac_no_call_intent": ("no_call", ()), "ac_ask_confirm_intent": ("ask", ()), "ac_can_call_intent": ("call", ()), "ac_explicit_refusal": ("refusal", ()), "ac_temporary_defer": ("defer", ()),
    "ac_just_venting": ("venting", ()), "ac_quiet_presence": ("quiet", ()), "ac_explicit_authorization": ("authorized", ()), **{f"ac_denies_{k}": (f"denies_{k}", ()) for k in DENIALS},
    "ac_requires_final_confirmation": ("confirm", ()), **{f"ac_requested_{k}": (f"requested_{k}", ()) for k in REQUESTS},
    "ac_tool_read_only": (None, ("read_only",)), "ac_tool_external_side_effect": (None, ("external_side_effect",)), "ac_tool_continuous_monitoring": (None, (_MONITORING,)), "ac_tool_device_control": (None, ("device_control",)),
    "ac_tool_agentic_control": (None, ("agentic_control",)), "ac_tool_final_submit_risk": (None, ("external_side_effect", "agentic_control")),
    **{f"ac_match_requested_{k}": (f"requested_{k}", (_MONITORING if k == "monitoring" else k,)) for k in REQUESTS},
    "ac_conflict_denied_search": ("denies_search", ("search",)), "ac_conflict_denied_monitoring": ("denies_monitoring", (_MONITORING,)), "ac_conflict_denied_upload": ("denies_upload", ("external_side_effect",)),
    "ac_conflict_denied_message": ("denies_message", ("message_reply",)), "ac_conflict_denied_control": ("denies_control", ("device_control", "agentic_control")), "ac_conflict_denied_file_access": ("denies_file_access", ("file_access",)),
    "ac_conflict_final_submit": ("confirm", ("external_side_effect", "agentic_control")), "ac_no_call_side_effect_risk": ("no_call", ("external_side_effect", _MONITORING, "device_control", "agentic_control")),
}
CONSENT_B = {
    "acb_no_call_intent": ("no_call", ()), "acb_ask_confirm_intent": ("ask", ()), "acb_can_call_intent": ("call", ()), "acb_temporary_defer": ("defer", ()), "acb_final_confirmation_required": ("user_confirm", ()), "acb_tool_read_only": (None, ("op_read_only",)),
    **{f"acb_tool_{k}": (None, (f"op_{k}",)) for k in ("local_write", "external_action", "background_monitor", "user_state_inference", "device_or_environment_control", "agentic_operation", "commit_or_submit")},
    "acb_no_call_side_effect_conflict": ("no_call", SIDE_EFFECTS), "acb_confirmation_boundary_conflict": ("user_confirm", ("op_commit_or_submit", "op_external_action", "op_agentic_operation")),
    "acb_refusal_background_monitor_veto": ("user_refusal", ("op_background_monitor",)), "acb_refusal_user_state_veto": ("user_refusal", ("op_user_state_inference",)),
    "acb_refusal_external_action_veto": ("user_refusal", ("op_external_action",)), "acb_refusal_device_control_veto": ("user_refusal", ("op_device_or_environment_control",)),
}
# fixed values: the highest of several products; device and monitoring operations never count as a match
MATCHES = {"wants_read_or_fetch": ("op_read_or_fetch",), "wants_local_write": ("op_local_write",), "wants_external_action": ("op_external_action",), "wants_agentic_operation": ("op_agentic_operation",)}
DENIED = {
    "denies_search": ("op_read_or_fetch",), "denies_upload": ("op_external_action",), "denies_message": ("op_external_action",), "denies_file_access": ("op_read_or_fetch",),
    "denies_monitoring": ("op_background_monitor", "op_user_state_inference"), "denies_control": ("op_device_or_environment_control", "op_agentic_operation"),
}


def _top(parts: list[Column]) -> Column:
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def consent_signals(conversations: DataFrame) -> DataFrame:
    """The signals of each conversation, one row a conversation."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    texts = conversations.select("conversation_id", low("conversation_text").alias("text"), latest_or_whole(F.col("latest_user_text"), F.col("conversation_text")).alias("user"), F.concat(low("scenario_type"), F.lit(" "), low("relevance_mode")).alias("mode"))
    rows = texts.join(conversation_features(conversations), "conversation_id")
    return rows.select("conversation_id", *(_top([*map(F.col, base), *(score_any(F.col(t), p) for t, p in patterns.items())]).alias(name) for name, (base, patterns) in SIGNALS.items()))


def tool_abilities(tools: DataFrame) -> DataFrame:
    """The abilities of each tool, one row a tool."""
    rows = tools.select("tool_id", F.lower(F.concat_ws("\n", "tool_id", "source_text")).alias("text")).join(tool_features(tools), "tool_id")
    out = rows.select("tool_id", *(_top([*map(F.col, base), *([score_any(F.col("text"), p)] if p else [])]).alias(name) for name, (base, p) in ABILITIES.items()), (F.greatest("tool_file", "tool_research", "tool_study") * (1.0 - F.col("tool_external"))).alias("read_only"))
    return out.withColumn("op_read_only", F.col("op_read_or_fetch") * (1.0 - _top(list(map(F.col, SIDE_EFFECTS)))))


def consent_features(pairs: DataFrame, signals: DataFrame, abilities: DataFrame, second: bool = False) -> DataFrame:
    """The 45 features of the first group, or the 22 of the second, for each pair ``(conversation_id, tool_id)``."""
    both = pairs.select("conversation_id", "tool_id").join(signals, "conversation_id").join(abilities, "tool_id")

    def value(signal: str | None, names: tuple[str, ...]) -> Column:
        parts = ([F.col(signal)] if signal else []) + ([_top(list(map(F.col, names)))] if names else [])
        return parts[0] * parts[1] if len(parts) == 2 else parts[0]

    made = {name: value(*spec) for name, spec in (CONSENT_B if second else CONSENT).items()}
    if second:
        match = {k: value(k, v) for k, v in MATCHES.items()}
        strong = [F.col(v[0]) * F.col(k) for k, v in MATCHES.items() if k != "wants_read_or_fetch"]
        made |= {"acb_weak_operation_match": _top(list(match.values())), "acb_strong_operation_match": F.col("call") * _top(strong), "acb_denied_operation_conflict": _top([value(k, v) for k, v in DENIED.items()])}
    return both.select("conversation_id", "tool_id", *(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x)).alias(n) for n, x in made.items()))
