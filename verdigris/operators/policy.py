"""Policy features of conversations, tools and their pairs, from patterns (F16, F17, J14, section 2.9.1: conv, tool, interaction and
cross groups)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import score_any

# fixed values: patterns over lower-cased texts
REFUSAL = (r"\bdo not\b", r"\bdon't\b", r"\bno need\b", r"\bnot now\b", "不要", "别", "不用", "先别", "不想", "别帮")
VENTING = ("只是想", "吐槽", "随便看看", "just looking", "just vent", "陪我", "安静")
QUIET = ("安静", "陪着", "别打扰", "放着", "慢慢看", "quiet")
DOMAINS = {
    "file": ("file", "folder", "pdf", "doc", "csv", "文件", "合同", "本地"),
    "browser": ("browser", "web", "url", "网页", "页面", "链接", "打开"),
    "search": ("search", "lookup", "find", "检索", "搜索", "查找"),
    "message": ("sms", "discord", "wechat", "email", "reply", "message", "短信", "回复"),
    "calendar": ("calendar", "schedule", "日历", "行程", "安排"),
    "reminder": ("remind", "todo", "task", "habit", "提醒", "待办"),
    "monitoring": ("monitor", "listen", "watch", "camera", "detect", "监听", "监控", "观察"),
    "emotion": ("emotion", "mood", "stress", "lamp", "情绪", "心情", "压力", "灯"),
    "audio": ("audio", "sound", "music", "voice", "声音", "音乐"),
    "camera": ("camera", "photo", "vision", "摄像", "照片"),
    "home": ("home", "clean", "robot", "air", "plant", "家", "清洁", "空气", "植物"),
    "travel": ("travel", "trip", "itinerary", "ticket", "hotel", "旅行", "行程", "机票", "酒店"),
    "code": ("code", "vscode", "github", "编程", "代码"),
    "research": ("paper", "research", "archive", "论文", "资料", "引用"),
    "study": ("study", "anki", "reading", "学习", "阅读", "报名"),
    "social": ("mastodon", "xiaohongshu", "post", "social", "社交", "发布"),
}
EXTERNAL = ("send", "post", "reply", "upload", "api", "connector", "browser", "web", "发送", "发布", "上传")
PROACTIVE = ("proactive", "remind", "monitor", "watch", "listen", "auto", "提醒", "监听", "监控", "自动")
# fixed values: a feature's steps, tried in order until one is not 0: (text looked at, patterns)
CONVERSATION = {
    "conv_agentic_task": (("scenario", ("agentic",)), ("text", ("帮我", "please", "can you", "打开", "处理", "calculate", "fill"))),
    "conv_companion": (("mode", ("companion", "no_tool")), ("text", ("陪", "聊", "吐槽"))),
    "conv_boundary": (("mode", ("boundary", "refusal")), ("text", REFUSAL)),
    "conv_proactive": (("mode", ("proactive", "followup")),),
    "conv_open_thread": (("mode", ("open_thread",)),),
    "conv_actionable": (("actionable", ()), ("user", ("帮我", "please", "can you", "处理", "计算", "打开", "填", "生成", "整理", "要", "yes"))),
    "conv_authorized": (("authorized", ()), ("user", ("帮我", "please", "can you", "直接", "按我说的", "我授权", "actually yes", r"\byes\b", "要"))),
    "conv_refusal": (("user", REFUSAL),),
    "conv_no_tool": (("user", ("不要.*工具", "别.*帮", "不用.*帮", "不要.*变成", "no tool", "no need", "just chat")),),
    "conv_no_reminder": (("text", ("别.*提醒", "不要.*提醒", "不用.*提醒", "no reminder")),),
    "conv_no_upload": (("text", ("别.*上传", "不要.*上传", "don't upload", "do not upload")),),
    "conv_no_monitoring": (("user", ("别.*监听", "不要.*监听", "不想.*监听", "别.*监控", "monitoring")),),
    "conv_no_search": (("user", ("别.*搜", "不要.*搜", "别.*查", "不要.*查", "不查", "don't search")),),
    "conv_no_file": (("text", ("别.*文件", "不要.*文件", "别.*索引", "不要.*索引", "file")),),
    "conv_no_planning": (("text", ("别.*规划", "不要.*规划", "别.*行程", "不要.*行程", "itinerary")),),
    "conv_no_control": (("user", ("别.*控制", "不要.*控制", "不要管", "don't control")),),
    "conv_just_venting": (("user", VENTING),),
    "conv_quiet_presence": (("user", QUIET),),
}
# fixed values: the same product of a conversation's feature and the highest of some tool features, under its name
INTERACTIONS = {
    "conflict_no_reminder_tool": ("conv_no_reminder", ("tool_reminder",)),
    "conflict_no_upload_external": ("conv_no_upload", ("tool_external",)),
    "conflict_no_monitoring_tool": ("conv_no_monitoring", ("tool_monitoring", "tool_emotion")),
    "conflict_no_search_tool": ("conv_no_search", ("tool_search",)),
    "conflict_no_file_tool": ("conv_no_file", ("tool_file",)),
    "conflict_no_planning_tool": ("conv_no_planning", ("tool_travel", "tool_calendar")),
    "conflict_no_control_external": ("conv_no_control", ("tool_external",)),
    "conflict_companion_proactive": ("conv_companion", ("tool_proactive",)),
    "opportunity_agentic_control": ("conv_agentic_task", ("tool_agent", "tool_browser", "tool_file")),
}
CROSSES = {
    "agentic_x_agent": ("conv_agentic_task", ("tool_agent",)),
    "companion_x_intrusive": ("conv_companion", ("tool_proactive", "tool_monitoring", "tool_external")),
    "boundary_x_external": ("conv_boundary", ("tool_external",)),
    "actionable_x_browser": ("conv_actionable", ("tool_browser",)),
    "actionable_x_file": ("conv_actionable", ("tool_file",)),
    "actionable_x_agent": ("conv_actionable", ("tool_agent",)),
    "refusal_x_monitoring": ("conv_refusal", ("tool_monitoring", "tool_emotion")),
    "refusal_x_message": ("conv_refusal", ("tool_message",)),
}
TOOL_FEATURES = ("tool_agent", "tool_plugin", *(f"tool_{d}" for d in DOMAINS), "tool_external", "tool_proactive")
GROUPS = {"conv": tuple(CONVERSATION), "tool": TOOL_FEATURES, "interaction": ("conflict_refusal_domain", *INTERACTIONS, "opportunity_recommendation"), "cross": tuple(CROSSES)}


def latest_or_whole(latest: Column, whole: Column) -> Column:
    """the user's last text, or the conversation where there is none; lower-cased."""
    own = F.lower(F.trim(F.coalesce(latest, F.lit(""))))
    return F.when(own != "", own).otherwise(F.lower(F.coalesce(whole, F.lit(""))))


def conversation_features(conversations: DataFrame) -> DataFrame:
    """The 18 features of each conversation. Works on one row a conversation, so that each pattern is matched once a text."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    rows = conversations.select(
        "conversation_id", low("conversation_text").alias("text"), latest_or_whole(F.col("latest_user_text"), F.col("conversation_text")).alias("user"), low("scenario_type").alias("scenario"),
        F.concat(low("scenario_type"), F.lit(" "), low("relevance_mode")).alias("mode"), low("latest_user_actionability").alias("act"), low("authorization_level").alias("auth"),
    )
    able = F.col("act") == "actionable"
    flags = {"actionable": able, "authorized": able & F.col("auth").isin("explicit", "implied")}

    def feature(steps: Sequence[tuple[str, Sequence[str]]]) -> Column:
        scores = [flags[source].cast("double") if source in flags else score_any(F.col(source), patterns) for source, patterns in steps]
        out = scores[-1]
        for s in reversed(scores[:-1]):
            out = F.when(s != 0, s).otherwise(out)
        return out

    return rows.select("conversation_id", *(feature(steps).alias(name) for name, steps in CONVERSATION.items()))


def tool_features(tools: DataFrame) -> DataFrame:
    """The 20 features of each tool, one row a tool."""
    rows = tools.select("tool_id", F.lower(F.concat_ws("\n", "tool_id", "source_text")).alias("text"))
    agent = F.col("tool_id").startswith("agent.").cast("double")
    scores = {"tool_agent": agent, "tool_plugin": 1.0 - agent, "tool_external": score_any(F.col("text"), EXTERNAL), "tool_proactive": score_any(F.col("text"), PROACTIVE)}
    scores |= {f"tool_{d}": score_any(F.col("text"), p) for d, p in DOMAINS.items()}
    return rows.select("tool_id", *(scores[name].alias(name) for name in TOOL_FEATURES))


def pair_features(pairs: DataFrame, conversations: DataFrame, tools: DataFrame, groups: Sequence[str] = tuple(GROUPS)) -> DataFrame:
    """The wanted groups for each pair ``(conversation_id, tool_id)``: the features of its conversation and tool,
    found once each, and products of them, between -1 and 1."""
    if unknown := sorted(set(groups) - set(GROUPS)):
        raise ValueError(f"unknown feature groups: {', '.join(unknown)}")
    both = pairs.select("conversation_id", "tool_id").join(conversations, "conversation_id").join(tools, "tool_id")
    top = lambda names: F.greatest(*map(F.col, names)) if len(names) > 1 else F.col(names[0])
    made = {name: F.col(c) * top(t) for name, (c, t) in (INTERACTIONS | CROSSES).items()}
    denied = F.greatest(*(made[k] for k in INTERACTIONS if k.startswith("conflict_no_")))
    made["conflict_refusal_domain"] = F.col("conv_refusal") * F.greatest(denied, "tool_proactive")
    made["opportunity_recommendation"] = F.greatest("conv_proactive", "conv_open_thread") * (1.0 - F.col("conv_refusal"))
    names = [n for g in groups for n in GROUPS[g]]
    return both.select("conversation_id", "tool_id", *(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), made.get(n, F.col(n)))).alias(n) for n in names))
