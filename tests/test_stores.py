import json

import pytest
from pyspark.sql import functions as F

from verdigris.operators.reports import with_train_loss
from verdigris.plans import scratch as plans
from verdigris.sources import records, stores

TOOLS = "tool_id string, kind string, source_text string, metadata string"


def tools(spark, prefix, n):
    return spark.createDataFrame([(f"{prefix}{k}", "plugin", f"text {k} 文", json.dumps({"name": f"n{k}"})) for k in range(n)], TOOLS)


def test_universes_round_trip(spark, tmp_path):
    made = stores.merge_universes({"u1": tools(spark, "a", 3), "u2": tools(spark, "b", 2)}, f"{tmp_path}/merged", "m")
    assert made["tool_count"] == 5 and made["source"] == {"type": "merged", "input_universe_ids": ["u1", "u2"]}
    got = records.read_universe(spark, f"{tmp_path}/merged")
    assert got.count() == 5 and got.select("tool_universe_id").distinct().first()[0] == "m"
    assert json.loads(got.where("tool_id = 'a1'").first().metadata) == {"name": "n1"}
    stores.write_universe(tools(spark, "c", 2), f"{tmp_path}/one.json", "one")
    assert sorted((r.tool_universe_id, r.tool_id, r.source_text) for r in records.read_universe(spark, f"{tmp_path}/one.json").collect()) == [("one", "c0", "text 0 文"), ("one", "c1", "text 1 文")]
    with pytest.raises(ValueError, match="duplicate"):
        stores.merge_universes({"u1": tools(spark, "a", 3), "u2": tools(spark, "a", 2)}, f"{tmp_path}/bad", "bad")
    assert not (tmp_path / "bad" / "manifest.json").exists()


def test_agents(spark):
    row = stores.agent_tools(spark.createDataFrame([("web", "m", "f", "c", 2, "d")], "id string, method string, enable_flag string, capability_key string, priority int, description string")).first()
    assert row.tool_id == "agent.web" and row.source_text.splitlines() == ["kind: agent", "id: web", "method: m", "enable_flag: f", "capability_key: c", "priority: 2", "description: d"] and json.loads(row.metadata)["priority"] == 2


def test_configuration_and_manifest(spark, tmp_path):
    (tmp_path / "c.toml").write_text('n = 3\n[model]\napi_key = "env:K"\n')
    base = {"n": 1, "model": {"api_key": None, "name": "m"}}
    config = stores.read_config(spark, f"{tmp_path}/c.toml", base, {"K": "secret-value"})
    assert config == {"n": 3, "model": {"api_key": "secret-value", "name": "m"}} and base["n"] == 1
    stores.write_manifest(spark, f"{tmp_path}/m.json", config, "running", samples=2)
    text = (tmp_path / "m.json").read_text()
    assert "secret-value" not in text and json.loads(text)["config"]["model"] == {"api_key": True, "name": "m"}
    (tmp_path / "c.toml").write_text("other = 3")
    with pytest.raises(ValueError, match="other"):
        stores.read_config(spark, f"{tmp_path}/c.toml", base)
    with pytest.raises(ValueError):
        stores.write_manifest(spark, f"{tmp_path}/m.json", {}, "odd")
    assert stores.is_placeholder(" TODO ") and not stores.is_placeholder("x")


def test_runs(spark, tmp_path):
    assert stores.read_metrics(spark, f"{tmp_path}/none", "epoch int, mae double")[0].count() == 0
    (tmp_path / "metrics.jsonl").write_text('{"epoch": 1, "mae": 0.5, "more": 1}\n')
    (tmp_path / "report.json").write_text('{"best": 1}')
    (tmp_path / "train.jsonl").write_text('{"epoch": 1, "train_loss": 0.9}\n{"epoch": 1, "train_loss": 0.8}\n')
    metrics, report = stores.read_metrics(spark, str(tmp_path), "epoch int, mae double")
    assert metrics.first().mae == 0.5 and report == {"best": 1}
    assert with_train_loss(metrics, stores.read_train_losses(spark, f"{tmp_path}/train.jsonl")).first().train_loss == 0.8
    rows = spark.createDataFrame([("c", "t", 1.0, 0.5, "x")], "conversation_id string, tool_id string, label double, prediction double, other string")
    stores.write_predictions(rows, f"{tmp_path}/best_val_predictions.jsonl")
    assert records.read_predictions(spark, str(tmp_path)).first().prediction == 0.5
    (tmp_path / "epoch_0003").mkdir()
    (tmp_path / "epoch_0003" / "w").write_text("3")
    assert list(stores.keep_best(spark, str(tmp_path), spark.createDataFrame([("mae", 3)], "objective string, epoch int"))) == ["mae"]
    assert (tmp_path / "best_mae" / "w").read_text() == "3"
    assert stores.epoch_of("/a/epoch_0012.pt") == 12 and stores.epoch_of("x") is None
    assert stores.run_of("a=/b/c") == ("a", "/b/c") and stores.run_of("/b/c/") == ("c", "/b/c/")


def test_reports(spark):
    df = spark.createDataFrame([("a|b", 0.12345, None)], "name string, score double, rest double")
    text = stores.markdown("Bad", {"worst": df})
    assert "| a\\|b | 0.123 |  |" in text and text.startswith("# Bad\n")
    assert tuple(stores.summary_csv(df).first()) == ("a|b", "0.123450", "NA")


def test_replaced_lines_stand_until_the_new_ones_do(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "x string, y int")
    records.write_jsonl(df, f"{tmp_path}/l.jsonl")
    with pytest.raises(Exception):  # noqa: B017
        records.write_jsonl(df.select(F.raise_error(F.lit("no")).cast("string").alias("x")), f"{tmp_path}/l.jsonl")
    assert spark.read.json(f"{tmp_path}/l.jsonl").count() == 1
    records.write_jsonl(df.union(df), f"{tmp_path}/l.jsonl")
    assert spark.read.json(f"{tmp_path}/l.jsonl").count() == 2


def test_scopes_leave_nothing(spark, data):
    from verdigris.catalog import QUERIES

    folder = plans.app_dir(spark).removeprefix("file:").replace("//", "/")
    import os

    before = set(os.listdir(folder))
    with plans.scratch(spark):
        for q in ("calibrate_single", "metrics_overall", "split_groups"):
            QUERIES[q](spark, data).count()
        with plans.scratch(spark):
            kept = plans.keep(plans.materialise(spark.range(3), "kept"))
            plans.materialise(spark.range(3), "gone")
        assert kept.count() == 3 and not any(x.startswith("gone") for x in os.listdir(folder))
    assert set(os.listdir(folder)) == before
