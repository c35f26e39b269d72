import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from verdigris.catalog.bindings import tasks, tools
from verdigris.operators import actions, generation, pairs, sampling
from verdigris.sources.plugins import read_plugins

MESSAGES = "messages array<struct<role: string, text: string, attachments: array<string>>>, trigger string, extra map<string, string>"


def test_rendering(spark):
    df = spark.createDataFrame([([("user", "hi", ["a.png", "b"]), ("assistant", None, None), ("user", "last", [])], None, {"scenario_type": "s"}), ([], "tick", {})], MESSAGES)
    got = df.select(generation.render_with_context(F.col("messages"), F.col("trigger"), F.col("extra")).alias("t"), pairs.latest_user_text(F.col("messages")).alias("u"), pairs.render_messages(F.col("messages"), F.coalesce("trigger", F.lit("x"))).alias("m")).collect()
    assert got[0].t == "trigger: turn_end\ncontext: scenario=s; auth=unknown; actionability=unknown\nuser attachments=a.png; b: hi\nassistant: \nuser: last"
    assert got[1].t == "trigger: tick" and (got[0].u, got[1].u) == ("last", "")
    assert got[0].m.startswith("trigger: x\nuser attachments:2: hi")


def test_tasks(spark):
    tools = spark.createDataFrame([(f"plugin.p{k}", "plugin") for k in range(20)] + [("agent.a", "agent"), ("agent.b", "agent")], "tool_id string, kind string")
    rows = generation.conversation_tasks(spark, tools, 300, 3, seed=4).collect()
    assert len(rows) == 300 and rows[0].conversation_id.startswith("conv_0")
    for r in rows:
        assert len(set(r.target_tool_ids)) == len(r.target_tool_ids) == (2 if r.scenario_type == "agentic_task" else 3)
        if r.scenario_type in generation.PLUGIN_SCENARIOS:
            assert all(t.startswith("plugin.") for t in r.target_tool_ids)
    assert sum(r.scenario_type == "companion_chat_no_tool" for r in rows) > 25 and {r.language for r in rows} == {"zh", "en", "mixed"}
    meta = generation.scenario_metadata(spark.createDataFrame([("agentic_task",), ("what",), (None,)], "scenario_type string")).collect()
    assert {(r.scenario_type, r.context_type, r.relevance_mode) for r in meta} == {("agentic_task", "agentic_task", "actionable_tool_relevance"), ("what", "companion_chat", "actionable_tool_relevance"), (None, "companion_chat", "actionable_tool_relevance")}
    with pytest.raises(ValueError):
        generation.conversation_tasks(spark, tools, 0)


def test_candidates(spark):
    tools = spark.createDataFrame([(f"plugin.tool_{k:03}", "plugin") for k in range(20)] + [("agent.a", "agent"), ("agent.b", "agent")], "tool_id string, kind string")
    conv = spark.createDataFrame([(f"c{k}", ["plugin.tool_019", "gone"] if k % 2 else None) for k in range(200)], "conversation_id string, target_tool_ids array<string>")
    got = {}
    for r in sampling.sample_candidates(conv, tools, 0.1, seed=123).collect():
        got.setdefault(r.conversation_id, {})[r.pos] = r.tool_id
    assert len(got) == 200
    for c, x in got.items():
        assert sorted(x) == [0, 1, 2, 3] and {"agent.a", "agent.b"} <= set(x.values()) and len(set(x.values())) == 4
        assert int(c[1:]) % 2 == 0 or "plugin.tool_019" in x.values()
    free = [t for c, x in got.items() if int(c[1:]) % 2 == 0 for t in x.values() if t.startswith("plugin.")]
    assert len(set(free)) == 20
    numbered = sampling.number_samples(conv.select("conversation_id")).collect()
    assert [r.sample_id for r in sorted(numbered, key=lambda r: r.conversation_id)] == [f"sample_{k:06}" for k in range(1, 201)]
    with pytest.raises(ValueError):
        sampling.sample_candidates(conv, tools, 1.5)


def test_candidates_hold_all_targets(spark, data):
    got = entry.queries()["sample_candidates"](spark, data).cache()
    plugins = tools(spark, data).where("kind = 'plugin'").select("tool_id").union(spark.read.parquet(f"{data}/runtime_pool.parquet").where("kind = 'plugin'").select("tool_id"))
    wanted = tasks(spark, data).select("conversation_id", F.explode("target_tool_ids").alias("tool_id")).distinct().join(plugins, "tool_id", "left_semi")
    assert wanted.count() > 50 and wanted.join(got, ["conversation_id", "tool_id"], "left_anti").count() == 0
    assert got.groupBy("conversation_id").agg(F.countDistinct("tool_id").alias("n"), F.max("pos").alias("m")).where("n <> m + 1").count() == 0


def test_candidates_come_tool_by_tool(spark):
    """Rows are handed over in the order of their tools, which is what keeps a large result small on disk."""
    tools = spark.createDataFrame([(f"plugin.{k:03}", "plugin") for k in range(100)] + [(f"agent.{k:02}", "agent") for k in range(20)], "tool_id string, kind string")
    conv = spark.createDataFrame([(f"c{k:03}", []) for k in range(400)], "conversation_id string, target_tool_ids array<string>")
    parts = sampling.sample_candidates(conv, tools, 0.1).rdd.glom().collect()
    sets = {}
    for rows in parts:
        assert sum(a.tool_id != b.tool_id for a, b in zip(rows, rows[1:])) < 120
        for r in rows:
            sets.setdefault(r.conversation_id, {})[r.pos] = r.tool_id
    assert len(sets) == 400 and all(sorted(x) == list(range(30)) and len(set(x.values())) == 30 for x in sets.values())


def test_specs(spark):
    s = "pos int, id string, name string, type string, description string, short_description string, keywords array<string>, passive boolean"
    rows = [(1, " plugin.alpha_x ", " A ", None, "d", "s", [" k ", "", "k", None], None), (2, "alpha_x", "B", None, "d", "s", ["k"], None), (3, "9bad", "C", None, "", "s", [], None), (4, "taken_id", "D", "plugin", "d", "s", ["k"], True)]
    tools, faults = generation.checked_specs(spark.createDataFrame(rows, s), spark.createDataFrame([("plugin.taken_id",)], "tool_id string"))
    assert [(r.tool_id, r.source_text) for r in tools.collect()] == [("plugin.alpha_x", "kind: plugin\nid: alpha_x\nname: A\ntype: plugin\ndescription: d\nshort_description: s\nkeywords: k\npassive: false")]
    assert [(r.pos, r.faults) for r in faults.collect()] == [(3, ["id", "description", "keywords"])]


def test_plugin_folders(spark, tmp_path):
    (tmp_path / "b/i18n").mkdir(parents=True)
    (tmp_path / "b/plugin.toml").write_text('[plugin]\nid = "bee"\nname = "key.name"\nkeywords = [" x ", "x", ""]\npassive = true\n[plugin.i18n]\ndefault_locale = "en"\n')
    (tmp_path / "b/i18n/en.json").write_text(json.dumps({"key.name": " Bee ", "n": 3}))
    (tmp_path / "a").mkdir()
    (tmp_path / "a/plugin.toml").write_text('description = "alone"\n')
    got = read_plugins(spark, str(tmp_path)).collect()
    assert [(r.tool_id, r.name, r.keywords, r.passive) for r in got] == [("plugin.a", "a", [], False), ("plugin.bee", "Bee", ["x"], True)]
    assert "description: alone" in got[0].source_text


def test_axes_slates_and_splits(spark):
    df = spark.createDataFrame([(0, "agent.a", True, "no_tool_or_low_relevance"), (40, "plugin.b", False, "actionable_tool_relevance")], "pos int, tool_id string, is_target boolean, relevance_mode string")
    got = {(r.tool_id, r.axis): r.raw_score for r in generation.dry_run_axes(df).collect()}
    assert len(got) == 14 and got["agent.a", "final_preference"] == 20.0 and got["plugin.b", "capability_match"] == 8.0 and got["agent.a", "intervention_cost"] == 72.0
    states = spark.createDataFrame([("s", "calendar", 2.0, False), ("s", "browser", 0.1, False), ("s", "monitor", -1.9, True), ("s", "music", 0.0, True)], "state_id string, tool_id string, score double, enabled boolean")
    policy = actions.GapPolicy(enable_threshold=0.7, disable_threshold=0.7)
    rows = actions.slates(states, policy, 3).collect()
    kinds = {r.slate for r in rows}
    assert {"anchor", "conservative", "over_recommend", "hard_negative"} <= kinds
    assert {r.tool_id for r in rows if r.slate == "hard_negative"} == {"calendar", "music"}
    chosen = actions.slates(states, policy, 3).select("state_id", "slate", "tool_id")
    judged = chosen.groupBy("state_id", "slate").agg(F.count("*").cast("double").alias("slate_score"))
    rated = chosen.withColumn("rating", F.length("tool_id").cast("double"))
    loss = actions.group_loss(states, chosen, judged, rated, policy, entropy_weight=0.01).first()
    assert abs(loss.loss) < 100 and loss.loss == loss.loss
    parts = {r.part: r["count"] for r in sampling.split_for_cv(spark.range(2000).select(F.col("id").alias("conversation_id")), 0.2, 0.1).groupBy("part").count().collect()}
    assert abs(parts["cv"] - 400) < 70 and abs(parts["holdout"] - 200) < 60
    with pytest.raises(ValueError):
        sampling.split_for_cv(states, 0.5, 0.5)
