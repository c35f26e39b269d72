"""Queries on policy features: F16, F17, J14."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.catalog.bindings import pairs, table, tools
from verdigris.catalog.ranking import rounded
from verdigris.operators import consent, policy

_FIELDS = ("conversation_text", "latest_user_text", "scenario_type", "relevance_mode", "latest_user_actionability", "authorization_level")


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    """One row a conversation; each field is its least value there."""
    rows = table(spark, d, "pair_examples").where("conversation_id is not null").select("conversation_id", *_FIELDS).distinct()
    return rows.groupBy("conversation_id").agg(*(F.min(c).alias(c) for c in _FIELDS))


def policy_conv(spark: SparkSession, d: str) -> DataFrame:
    return rounded(policy.conversation_features(_conversations(spark, d)))


def policy_tool(spark: SparkSession, d: str) -> DataFrame:
    return rounded(policy.tool_features(tools(spark, d)))


def _pairs(spark: SparkSession, d: str, *groups: str) -> DataFrame:
    return rounded(policy.pair_features(pairs(spark, d), policy.conversation_features(_conversations(spark, d)), policy.tool_features(tools(spark, d)), groups))


def policy_interaction(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, "interaction")


def policy_cross(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, "cross")


def _consent(spark: SparkSession, d: str, second: bool) -> DataFrame:
    return rounded(consent.consent_features(pairs(spark, d), consent.consent_signals(_conversations(spark, d)), consent.tool_abilities(tools(spark, d)), second))


def policy_action_consent(spark: SparkSession, d: str) -> DataFrame:
    return _consent(spark, d, False)


def policy_action_consent_b(spark: SparkSession, d: str) -> DataFrame:
    return _consent(spark, d, True)


QUERIES = {f.__name__: f for f in (policy_conv, policy_tool, policy_interaction, policy_cross, policy_action_consent, policy_action_consent_b)}


def _score(text: str, patterns: tuple[str, ...]) -> str:
    hits = " + ".join("regexp_matches({}, '{}')::int".format(text, p.replace("'", "''")) for p in patterns)
    return f"least(1.0, ({hits}) / {max(1.0, min(3.0, len(patterns) / 2))})::double"


def _feature(steps: tuple) -> str:
    parts = [f"({source})::int::double" if source in ("actionable", "authorized") else _score(source if source != "text" else "txt", patterns) for source, patterns in steps]
    return f"coalesce({', '.join(f'nullif({p}, 0)' for p in parts)}, 0)"


_CONV = f"""a as (select conversation_id, lower(coalesce(min(conversation_text), '')) txt, lower(trim(coalesce(min(latest_user_text), ''))) u, lower(coalesce(min(scenario_type), '')) scenario, lower(coalesce(min(scenario_type), '')) || ' ' || lower(coalesce(min(relevance_mode), '')) "mode",
        lower(coalesce(min(latest_user_actionability), '')) = 'actionable' actionable, lower(coalesce(min(authorization_level), '')) in ('explicit', 'implied') auth from pair_examples where conversation_id is not null group by 1),
    b as (select * exclude (auth, u), case when u <> '' then u else txt end "user", actionable and auth authorized from a),
    c as (select conversation_id, {', '.join(f'{_feature(s)} {n}' for n, s in policy.CONVERSATION.items())} from (select * rename ("user" as usr, "mode" as md) from b))""".replace("regexp_matches(user,", "regexp_matches(usr,").replace("regexp_matches(mode,", "regexp_matches(md,")
_TOOL = f"""u as (select tool_id, any_value(source_text) x from tools group by 1), w as (select tool_id, lower(concat_ws(chr(10), tool_id, x)) t from u),
    f as (select tool_id, starts_with(tool_id, 'agent.')::int::double tool_agent, 1 - starts_with(tool_id, 'agent.')::int::double tool_plugin, {', '.join(f'{_score("t", p)} tool_{d}' for d, p in policy.DOMAINS.items())}, {_score('t', policy.EXTERNAL)} tool_external, {_score('t', policy.PROACTIVE)} tool_proactive from w)"""
_P = "p as (select distinct conversation_id, tool_id from pair_examples where conversation_id is not null and tool_id is not null and label is not null and not isnan(raw_score) and raw_score between 0 and 100)"
_R = lambda names: ", ".join(f"round({n}, 6) {n}" for n in names)

ORACLES = {
    "policy_conv": f"with {_CONV} select conversation_id, {_R(policy.CONVERSATION)} from c",
    "policy_tool": f"with {_TOOL} select tool_id, {_R(policy.TOOL_FEATURES)} from f",
    "policy_interaction": f"""with {_CONV}, {_TOOL}, {_P}, j as (select *, conv_no_reminder * tool_reminder conflict_no_reminder_tool, conv_no_upload * tool_external conflict_no_upload_external, conv_no_monitoring * greatest(tool_monitoring, tool_emotion) conflict_no_monitoring_tool,
            conv_no_search * tool_search conflict_no_search_tool, conv_no_file * tool_file conflict_no_file_tool, conv_no_planning * greatest(tool_travel, tool_calendar) conflict_no_planning_tool, conv_no_control * tool_external conflict_no_control_external,
            conv_companion * tool_proactive conflict_companion_proactive, conv_agentic_task * greatest(tool_agent, tool_browser, tool_file) opportunity_agentic_control, greatest(conv_proactive, conv_open_thread) * (1 - conv_refusal) opportunity_recommendation from p join c using (conversation_id) join f using (tool_id)),
        k as (select *, conv_refusal * greatest(conflict_no_reminder_tool, conflict_no_upload_external, conflict_no_monitoring_tool, conflict_no_search_tool, conflict_no_file_tool, conflict_no_planning_tool, conflict_no_control_external, tool_proactive) conflict_refusal_domain from j)
        select conversation_id, tool_id, {_R(policy.GROUPS['interaction'])} from k""",
    "policy_cross": f"""with {_CONV}, {_TOOL}, {_P}, j as (select conversation_id, tool_id, conv_agentic_task * tool_agent agentic_x_agent, conv_companion * greatest(tool_proactive, tool_monitoring, tool_external) companion_x_intrusive, conv_boundary * tool_external boundary_x_external, conv_actionable * tool_browser actionable_x_browser,
            conv_actionable * tool_file actionable_x_file, conv_actionable * tool_agent actionable_x_agent, conv_refusal * greatest(tool_monitoring, tool_emotion) refusal_x_monitoring, conv_refusal * tool_message refusal_x_message from p join c using (conversation_id) join f using (tool_id))
        select conversation_id, tool_id, {_R(policy.CROSSES)} from j""",
}


def _signal(base: tuple[str, ...], patterns: dict[str, tuple[str, ...]]) -> str:
    return f"greatest({', '.join([*base, *(_score({'text': 'txt', 'user': 'usr', 'mode': 'md'}[t], p) for t, p in patterns.items())])})"


_SIGNALS = f"{_CONV}, s as (select conversation_id, {', '.join(f'{_signal(*v)} sig_{k}' for k, v in consent.SIGNALS.items())} from c join (select * rename (\"user\" as usr, \"mode\" as md) from b) using (conversation_id))"
_ABILITIES = f"""{_TOOL}, g0 as (select tool_id, {', '.join(f"greatest({', '.join([*b, *([_score('t', p)] if p else [])])}) abl_{k}" for k, (b, p) in consent.ABILITIES.items())}, greatest(tool_file, tool_research, tool_study) * (1 - tool_external) abl_read_only from f join w using (tool_id)),
    g as (select *, abl_op_read_or_fetch * (1 - greatest({', '.join(f'abl_{k}' for k in consent.SIDE_EFFECTS)})) abl_op_read_only from g0)"""


def _product(signal: str | None, names: tuple[str, ...]) -> str:
    parts = ([f"sig_{signal}"] if signal else []) + ([f"greatest({', '.join(f'abl_{n}' for n in names)})"] if names else [])
    return " * ".join(parts)


_JOIN = "from p join s using (conversation_id) join g using (tool_id)"
ORACLES["policy_action_consent"] = f"with {_SIGNALS}, {_ABILITIES}, {_P} select conversation_id, tool_id, {', '.join(f'round({_product(*v)}, 6) {k}' for k, v in consent.CONSENT.items())} {_JOIN}"
ORACLES["policy_action_consent_b"] = f"""with {_SIGNALS}, {_ABILITIES}, {_P} select conversation_id, tool_id, {', '.join(f'round({_product(*v)}, 6) {k}' for k, v in consent.CONSENT_B.items())},
    round(greatest(sig_wants_read_or_fetch * abl_op_read_or_fetch, sig_wants_local_write * abl_op_local_write, sig_wants_external_action * abl_op_external_action, sig_wants_agentic_operation * abl_op_agentic_operation), 6) acb_weak_operation_match,
    round(sig_call * greatest(sig_wants_local_write * abl_op_local_write, sig_wants_external_action * abl_op_external_action, sig_wants_agentic_operation * abl_op_agentic_operation), 6) acb_strong_operation_match,
    round(greatest(sig_denies_search * abl_op_read_or_fetch, sig_denies_upload * abl_op_external_action, sig_denies_message * abl_op_external_action, sig_denies_file_access * abl_op_read_or_fetch, sig_denies_monitoring * greatest(abl_op_background_monitor, abl_op_user_state_inference),
        sig_denies_control * greatest(abl_op_device_or_environment_control, abl_op_agentic_operation)), 6) acb_denied_operation_conflict {_JOIN}"""
