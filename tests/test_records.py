import json

import pytest
from pyspark.sql import functions as F

from verdigris.operators import pairs, records, similarity
from verdigris.operators.calibrate import AXES


def test_axis_scores_in_candidate_order(spark):
    rows = [("s", t, a, float(k)) for t in ("b", "a") for k, a in enumerate([*reversed(AXES), "other"])]
    schema = "sample_id string, tool_id string, axis string, raw_score double"
    cand = spark.createDataFrame([("s", ["b", "a"])], "sample_id string, tool_ids array<string>")
    got = records.axis_scores(spark.createDataFrame(rows, schema), cand).orderBy("pos", "axis_no").collect()
    assert [(r.tool_id, r.axis) for r in got] == [(t, a) for t in ("b", "a") for a in AXES]
    with pytest.raises(ValueError, match="missing axis"):
        records.axis_scores(spark.createDataFrame(rows[1:], schema), cand)
    with pytest.raises(ValueError, match="differ"):
        records.axis_scores(spark.createDataFrame(rows, schema), cand.limit(0))
    assert records.axis_scores(spark.createDataFrame([], schema), cand.limit(0)).count() == 0


def test_attachments(spark):
    cases = {
        None: [], "null": [], "[]": [], '"a.txt"': ["a.txt"], '["a", "b"]': ["a", "b"],
        '{"name": "x.png", "type": "image"}': ["x.png (image)"], '[{"filename": "image.png", "mime_type": "image"}, "t"]': ["image.png", "t"],
        '{"type": "audio"}': ["audio"], '{"size":3}': ['{"size":3}'], "7": ["7"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string").select("x", records.attachments(F.col("x")).alias("a"))
    assert {r.x: r.a for r in df.collect()} == cases


def test_normalised_conversations(spark):
    made = spark.createDataFrame([("c", [("user", "hi")], None, "sc", "", {"scenario_type": "claimed", "own": "1"}), ("d", [("user", "ho")], "timer", "sc", "en", None)], "conversation_id string, messages array<struct<role: string, text: string>>, trigger string, scenario_id string, language string, extra map<string, string>")
    own = spark.createDataFrame([("c", ["t"], "zh", "agentic_task", 5), ("d", ["t"], "zh", "unknown", 6)], "conversation_id string, target_tool_ids array<string>, language string, scenario_type string, seed int")
    got = {r.conversation_id: r for r in records.normalise_conversations(made, own).collect()}
    assert got["c"].trigger == "turn_end" and got["c"].language == "zh" and got["c"].seed == 5
    assert got["c"].extra["scenario_type"] == "agentic_task" and got["c"].extra["own"] == "1" and got["c"].extra["tool_relevance_mode"] == "actionable_tool_relevance"
    assert got["d"].trigger == "timer" and got["d"].language == "en" and got["d"].extra["scenario_type"] == "unknown"


def test_response_texts(spark):
    cases = [('{"output_text": "a"}', "a"), ('{"output": [{"content": [{"text": "b"}, {"kind": 1}]}, {"content": null}, {"content": [{"text": "c"}]}]}', "bc"), ('{"output": []}', None), ("{}", None)]
    got = spark.createDataFrame([(x,) for x, _ in cases], "x string").select(records.response_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in got] == [y for _, y in cases]


def test_slate_judgments(spark):
    reply = lambda state, *slates: json.dumps({"state_id": state, "slates": [{"slate_id": s, "slate_score": 0.5, "action_scores": [{"tool_id": "t", "action": "enable", "score": 0.2}]} for s in slates]})
    rows = [("a", reply("a", "s1", "s2")), ("b", "Sure: " + reply("b", "s1") + " done"), ("c", reply("other", "s1")), ("d", "no json"), ("e", reply("e", "s1", "s9")), ("f", reply("f"))]
    shown = spark.createDataFrame([("a", "s1"), ("a", "s2"), *((x, "s1") for x in "bcdef")], "state_id string, slate_id string")
    judged, faults = records.parse_slate_judgments(spark.createDataFrame(rows, "state_id string, reply string"), shown)
    assert sorted((r.state_id, r.slate_id, r.slate_score) for r in judged.collect()) == [("a", "s1", 0.5), ("a", "s2", 0.5), ("b", "s1", 0.5)]
    assert {r.state_id: (r.fault, r.slate_ids) for r in faults.collect()} == {"c": ("other_state", None), "d": ("not_an_object", None), "e": ("unexpected_slates", ["s9"]), "f": ("missing_slates", ["s1"])}
    actions = spark.createDataFrame([(x, s, "t", "enable", 1, 0.12345) for x, s in (("a", "s1"), ("a", "s2"), ("b", "s1"))], "state_id string, slate_id string, tool_id string, action string, place int, gain double")
    assert records.judged_actions(judged, actions).count() == 3
    with pytest.raises(ValueError, match="not in their slate"):
        records.judged_actions(judged, actions.where("state_id = 'a'"))
    nested = {r.state_id: r.slates for r in records.rollout_records(spark.createDataFrame([("a",), ("z",)], "state_id string"), actions, judged).collect()}
    assert [s.slate_id for s in nested["a"]] == ["s1", "s2"] and nested["a"][0].actions[0].gain == 0.1235 and nested["z"] is None


def test_joins_raise_in_order(spark):
    rows = spark.createDataFrame([(f"s{k:02}", f"c{k:02}") for k in range(30)], "sample_id string, conversation_id string")
    with pytest.raises(ValueError, match="c00.*c01.*c19"):
        records.judge_tasks(rows, rows.select("conversation_id").limit(0))
    assert records.judge_tasks(rows, rows.select("conversation_id")).count() == 30
    p = spark.createDataFrame([("c", "t", 0.5)], "conversation_id string, tool_id string, prediction double")
    with pytest.raises(ValueError, match="twice"):
        records.join_predictions(p.union(p), p)
    with pytest.raises(ValueError, match="no example"):
        records.join_predictions(p, p.limit(0))
    assert pairs.axis_labels(F.col("m")) is not None
    m = spark.createDataFrame([({a: float(k) for k, a in enumerate(AXES)},)], "m map<string, double>")
    assert m.select(pairs.axis_labels(F.col("m")).alias("x")).first().x == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


def test_cosines_against_plain(spark):
    import math
    import re
    from collections import Counter

    def words(t):
        w = re.findall(r"\b\w\w+\b", t.lower())
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    def chars(t):
        out = []
        for w in t.lower().split():
            w = f" {w} "
            for n in range(2, 6):
                out += [w[k : k + n] for k in range(len(w) - n + 1)] or [w]
                if len(w) <= n:
                    break
        return out

    texts = {"c1": "Open the browser page now", "c2": "打开 网页 a bb", "c3": "", "t1": "browser page opener", "t2": "Open 网页 工具 the page", "t3": "zzz"}

    def cosines(grams, limit):
        counts = {k: Counter(grams(t)) for k, t in texts.items()}
        total, df = Counter(), Counter()
        for c in counts.values():
            total.update(c)
            df.update(c.keys())
        voc = {g for g, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:limit]}
        v = {k: {g: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, n in c.items() if g in voc} for k, c in counts.items()}
        norm = lambda x: math.sqrt(sum(y * y for y in x.values())) or 1.0
        return {(a, b): sum(x * v[b].get(g, 0.0) for g, x in v[a].items()) / norm(v[a]) / norm(v[b]) for a in texts for b in texts if a[0] == "c" and b[0] == "t"}

    for limit in (20_000, 12):
        conv = spark.createDataFrame([(k, t) for k, t in texts.items() if k[0] == "c"], "conversation_id string, text string")
        tool = spark.createDataFrame([(k, t) for k, t in texts.items() if k[0] == "t"], "tool_id string, text string")
        got = similarity.text_cosines(conv.select("conversation_id").crossJoin(tool.select("tool_id")), conv, tool, limit)
        w, c = cosines(words, limit), cosines(chars, limit)
        for r in got.collect():
            k = (r.conversation_id, r.tool_id)
            assert abs(r.word_cosine - w[k]) < 1e-9 and abs(r.character_cosine - c[k]) < 1e-9
