import json
import math
import random
import re
from collections import Counter
from difflib import SequenceMatcher
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from verdigris.functions import text
from verdigris.operators import actions, jobs, losses, pairs, similarity, universe, vectors
from verdigris.plans.components import connected_components
from verdigris.sources import records
from verdigris.streaming.resume import stream_once

T = "tool_id string, kind string, source_text string"


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 102), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_universe(spark):
    real = spark.createDataFrame([("plugin.web_search", "plugin", "x")], T)
    synth = spark.createDataFrame([("plugin.synthetic_bad", "plugin", "status: running"), ("plugin.web_search", "plugin", "y")], T).withColumn("keys", F.when(F.col("tool_id") == "plugin.synthetic_bad", F.array(F.lit("runtime"))))
    got = {(r.tool_id, r.fault) for r in universe.synthetic_violations(synth, real, F.col("keys")).collect()}
    assert got == {("plugin.web_search", "conflicting_id"), ("plugin.synthetic_bad", "forbidden_text"), ("plugin.synthetic_bad", "forbidden_metadata")}
    with pytest.raises(ValueError, match="web_search"):
        universe.union_universes([real, synth.drop("keys")])
    c = {r.tool_id: r for r in universe.classify(spark.createDataFrame([("plugin.a", "plugin", "Search   the web and read pdf"), ("agent.b", "agent", "浏览器"), ("plugin.c", "plugin", "qqq")], T)).collect()}
    assert c["plugin.a"].primary_category == "web_retrieval" and c["plugin.a"].secondary_categories == ["file_document"] and c["agent.b"].generation_tags == ["agent", "browser", "web"] and c["plugin.c"].primary_category == "other"


def test_text(spark):
    df = spark.createDataFrame([("ok {\"a\": 1} end", "plugin.foo_bar_foo"), ("{\"a\": 2}", "agent.x"), ("none", "plugin.")], "t string, i string")
    got = df.select(text.json_object(F.col("t")).alias("j"), text.id_family(F.col("i")).alias("f"), text.stable_int(F.col("i")).alias("n")).collect()
    assert [r.j and json.loads(r.j) for r in got] == [{"a": "1"}, {"a": "2"}, None]
    assert got[0].f == ["foo", "bar"]
    want = 0
    for ch in "agent.x":
        want = (want * 131 + ord(ch)) % 1_000_000_007
    assert got[1].n == want
    toks = spark.createDataFrame([("The Plugin_X 提醒我们 a _b_",)], "t string").select(text.tool_tokens(F.col("t")).alias("x")).first().x
    assert toks == ["the", "plugin_x", "我们"]


def test_similar_tools(spark):
    rows = [("plugin.alpha_one", "Alpha", "draw charts of birds", ["bird", "chart"]), ("plugin.beta_one", "Alphb", "draw charts of birds", ["Bird"]), ("plugin.gamma", "Z", "nothing alike", None)]
    got = similarity.similar_tools(spark.createDataFrame(rows, "tool_id string, name string, text string, keywords array<string>")).collect()
    assert [(r.left_tool_id, r.right_tool_id) for r in got] == [("plugin.alpha_one", "plugin.beta_one")]
    assert got[0].text_cosine == pytest.approx(1.0) and got[0].keyword_jaccard == 0.5 and got[0].name_similarity == pytest.approx(0.8)


def test_similar_tools_of_the_whole_table(spark, data):
    rows = {r.tool_id: r.metadata for r in spark.read.parquet(f"{data}/tools.parquet").select("tool_id", "metadata").collect()}

    def sides(i, m):
        words = [str(x) for x in m.keywords or [] if x is not None]
        found = re.findall("[a-zA-Z0-9_]+|[一-鿿]{1,2}", " ".join([i, m.name or "", m.description or "", m.short_description or "", *words]).lower())
        counts = Counter(w for w in found if w not in text.STOP_TOKENS and len(w.strip("_")) > 1)
        return counts, {w and w.lower() for w in m.keywords or []}, {x for x in i.removeprefix("plugin.").split("_") if x}, m.name or ""

    s, want = {i: sides(i, m) for i, m in rows.items()}, {}
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    for l, r in combinations(sorted(s), 2):
        (a, k, f, n), (b, m, g, o) = s[l], s[r]
        cosine = sum(v * b[w] for w, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        score = 0.58 * cosine + 0.22 * share(k, m) + 0.1 * share(f, g) + 0.1 * SequenceMatcher(None, n, o).ratio()
        if score >= 0.28 or cosine >= 0.42 or share(k, m) >= 0.3 or share(f, g) >= 0.5:
            want[l, r] = score
    got = {(r.left_tool_id, r.right_tool_id): r.score for r in entry.queries()["similar_tools"](spark, data).collect()}
    assert got.keys() == want.keys() and len(got) > 20 and all(abs(got[p] - want[p]) < 1e-5 for p in got)
    small = spark.createDataFrame([(i, n, " ".join(c.elements()), sorted(x for x in k if x)) for i, (c, k, _, n) in s.items()], "tool_id string, name string, text string, keywords array<string>")
    one, many = ({tuple(r) for r in similarity.similar_tools(small, block=b).collect()} for b in (2000, 13))
    assert one == many


def test_name_ratios():
    rng = random.Random(4)
    names = ["", "a", "aaaa", "ab" * 24, "ab" * 25, "x" * 250, "\U0001f600ab", *("".join(rng.choice("abc ") for _ in range(rng.randrange(60))) for _ in range(60))]
    left, right = (np.array(x) for x in zip(*product(range(len(names)), repeat=2)))
    got = similarity._ratios(names, similarity._codes(names), left, right)
    assert got.tolist() == [SequenceMatcher(None, names[a], names[b]).ratio() for a, b in zip(left, right)]


def test_similar_tools_move_no_copies(spark):
    # blocks are read where they are compared: no tool is copied and exchanged for each block it meets
    t = spark.createDataFrame([(f"plugin.t{k}", "n", f"word{k % 3} other", None) for k in range(40)], "tool_id string, name string, text string, keywords array<string>")
    out = similarity.similar_tools(t, block=10)
    assert "Exchange" not in out._jdf.queryExecution().toString() and out.count() > 0


def test_actions(spark):
    s = "state_id string, tool_id string, score double, enabled boolean"
    states = spark.createDataFrame([("s", "good", 2.0, False), ("s", "bad", -2.0, True), ("s", "ok", 0.2, False)], s)
    got = {(r.action, r.tool_id) for r in actions.recommend(states).collect()}
    assert got == {("enable", "good"), ("disable", "bad")} and all(r.action_probability > 0.5 for r in actions.recommend(states).collect())
    even = spark.createDataFrame([("s", "a", 0.0, False), ("s", "b", 0.0, True)], s)
    assert actions.recommend(even, actions.GapPolicy(enable_threshold=0.9, disable_threshold=0.9)).collect() == []
    three = spark.createDataFrame([("s", "a", 3.0, False), ("s", "b", 2.0, False), ("s", "c", -3.0, True)], s)
    low = actions.GapPolicy(enable_threshold=0.65, disable_threshold=0.65)
    assert actions.recommend(three, low).count() == 3 and actions.recommend(three, low, 2).count() == 2
    rated = spark.createDataFrame([("s", "a", 1.0, "enable"), ("s", "b", 0.5, "disable"), ("s", "c", -1.0, "enable")], "state_id string, tool_id string, rating double, action string")
    assert [r.advantage > 0 for r in actions.feedback_advantages(rated).orderBy("tool_id").collect()] == [True, False, False]
    with pytest.raises(ValueError):
        actions.recommend(three, low, 0)


def test_dry_run_judgment(spark):
    df = spark.createDataFrame([(0, "agent.browser_use", False, "actionable_tool_relevance"), (1, "plugin.web_search", True, "actionable_tool_relevance"), (2, "plugin.q", True, "no_tool_or_low_relevance")], "pos int, t string, aim boolean, mode string")
    assert [r.s for r in df.select(pairs.dry_run_score(F.col("pos"), F.col("t"), F.col("aim"), F.col("mode"), F.lit("")).alias("s")).collect()] == [35.0, 92.0, 24.0]


def test_losses_and_vectors(spark):
    df = spark.createDataFrame([("c", "a", 2.0, 0.5), ("c", "b", 0.0, 0.4), ("d", "x", 1.0, 1.0)], "conversation_id string, tool_id string, label double, prediction double")
    assert [round(r.loss, 6) for r in losses.margin_loss(df).collect()] == [0.2]
    assert losses.listnet_loss(df).count() == 1 and losses.lambda_loss(df).first().loss == pytest.approx(0.644397 * abs(1 - 1 / 1.584962501), abs=1e-5)
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [round(r.c, 6) for r in v.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0, 1, 0]
    assert v.select(F.size(vectors.pair_features(F.col("a"), F.col("b"))).alias("n")).first().n == 8


def test_jobs(spark):
    items = spark.createDataFrame([(k, "x") for k in ("a", "b", "c", "bad")], "item_id string, v string")
    done = spark.createDataFrame([("a",), ("old",)], "item_id string")

    def worker(item):
        if item["item_id"] == "bad":
            raise KeyError("no")
        return item["item_id"] * 2

    ok, errors, n = jobs.run_jobs(items, done, worker, attempts=2)
    assert {(r.item_id, r.result) for r in ok.collect()} == {("b", "bb"), ("c", "cc")}
    assert [(r.item_id, r.error_type, r.attempt) for r in errors.collect()] == [("bad", "KeyError", 2)]
    assert n == {"total": 4, "completed_existing": 2, "submitted": 3, "succeeded": 2, "failed": 1, "skipped": 1}
    assert jobs.prune_errors(errors, ok).count() == 1


def test_records(spark, tmp_path):
    path = str(tmp_path / "t.jsonl")
    assert records.read_jsonl(spark, path, records.TOOLS).count() == 0
    with pytest.raises(Exception):
        records.read_jsonl(spark, path, records.TOOLS, missing_ok=False).count()
    rows = spark.createDataFrame([("b", "plugin", "t", "{}"), ("a", "agent", "u", "{}")], records.TOOLS)
    records.write_jsonl(rows, path)
    assert records.read_jsonl(spark, path, records.TOOLS).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"tool_id": "a", "extra": 1}\n')
    with pytest.raises(Exception, match="unknown fields"):
        records.read_jsonl(spark, str(tmp_path / "bad.jsonl"), records.TOOLS).collect()
    (tmp_path / "u").mkdir()
    (tmp_path / "u/tools.jsonl").write_text('{"tool_id": "a", "kind": "agent", "source_text": "x", "metadata": "{}"}\n\n')
    (tmp_path / "u/manifest.json").write_text(json.dumps({"tool_universe_id": "u1", "tool_count": 1}))
    assert records.read_universe(spark, str(tmp_path / "u")).first().tool_universe_id == "u1"
    (tmp_path / "u/manifest.json").write_text(json.dumps({"tool_universe_id": "u1", "tool_count": 2}))
    with pytest.raises(ValueError, match="manifest"):
        records.read_universe(spark, str(tmp_path / "u"))


def test_stream_once(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.sql("select id, timestamp '2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) ts from range(20)")
    rows.union(rows).write.parquet(src)
    run = lambda: stream_once(spark.readStream.schema(rows.schema).parquet(src), "id", lambda x: x.selectExpr("id", "id * 2 as twice"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    rows.write.mode("append").parquet(src)
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_slates_fill_their_group(spark):
    states = spark.createDataFrame([("s", f"t{k}", float(k - 3), k % 2 == 0) for k in range(8)], "state_id string, tool_id string, score double, enabled boolean")
    kinds = lambda n: {r.slate for r in actions.slates(states, group_size=n).collect()}
    assert kinds(2) <= {"anchor", "conservative"} and "hard_negative" in kinds(5) and not any(k.startswith("sampled_") for k in kinds(5))
    assert {k for k in kinds(12) if k.startswith("sampled_")} <= {f"sampled_{k}" for k in range(2, 9)} and any(k.startswith("sampled_") for k in kinds(12))
    with pytest.raises(ValueError):
        actions.slates(states, group_size=0)


def test_bm25_keeps_pairs_whole(spark):
    # a pair that stands twice scores as it does once, and no join makes a row for each token of a pair
    docs = spark.createDataFrame([("d1", "a_1 b b 知道"), ("d2", "b c"), ("d3", ""), ("d4", None)], "doc_id string, text string")
    asked = spark.createDataFrame([("q1", "B 知 b x"), ("q2", None)], "query_id string, text string")
    pairs = spark.createDataFrame([("q1", "d1"), ("q1", "d1"), ("q1", "d2"), ("q1", "d3"), ("q1", "none"), ("q2", "d1"), ("q9", "d2")], "query_id string, doc_id string")
    out = similarity.bm25(asked, docs, pairs, "text", "text")
    got = sorted((r.query_id, r.doc_id, round(r.bm25, 9)) for r in out.collect())
    idf = lambda df: math.log(1 + (4 - df + 0.5) / (df + 0.5))
    mean = 7 / 3  # a null text has no length
    one = idf(2) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 5 / mean)) + idf(1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 5 / mean))
    two = idf(2) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / mean))
    assert got == [("q1", "d1", round(one, 9)), ("q1", "d1", round(one, 9)), ("q1", "d2", round(two, 9)), ("q1", "d3", 0.0), ("q1", "none", 0.0), ("q2", "d1", 0.0), ("q9", "d2", 0.0)]
