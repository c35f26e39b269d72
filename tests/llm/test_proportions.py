import numpy as np
import pytest

from verdigris.llm.proportions import _quotas, sample_to_targets

TARGETS = "kind string, lang string, target_share double, min_count int"


def test_shares_minimum_and_deficit(spark):
    rows = [(f"a{k}", " Chat ", "EN") for k in range(6000)] + [(f"b{k}", "task", "zh") for k in range(2900)] + [(f"c{k}", "task", "en") for k in range(60)] + [(f"d{k}", "chat", "zh") for k in range(3)]
    rows += [(f"n{k}", None, "en") for k in range(37)] + [(None, "chat", "en")] + rows[:500]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "id string, kind string, lang string, u string, p double").repartition(5)
    targets = spark.createDataFrame([("chat", "en", 0.5, 5), ("TASK ", "zh", 0.46, 5), ("task", "en", 0.01, 40), ("chat", "zh", 0.03, 10), ("none", "en", 0.0, 2)], TARGETS)
    sample, report = sample_to_targets(df, targets, "id", ["kind", "lang"])
    r = {(x.kind, x.lang): x for x in report.collect()}
    assert {x.size for x in r.values()} == {1800}
    assert sum(x.quota for x in r.values()) == 1800
    assert r["task", "en"].drawn == 40 and not r["task", "en"].short
    assert r["chat", "zh"].drawn == 3 and r["chat", "zh"].short and r["chat", "zh"].deficit == r["chat", "zh"].quota - 3
    assert r["none", "en"].short and r["none", "en"].drawn == 0
    assert abs(r["chat", "en"].drawn / r["task", "zh"].drawn - 0.5 / 0.46) < 0.01
    got = sample.collect()
    assert len({x.id for x in got}) == len(got) == sum(x.drawn for x in r.values())
    assert {x.id for x in sample_to_targets(df, targets, "id", ["kind", "lang"])[0].collect()} == {x.id for x in got}


def test_empty(spark):
    empty = spark.createDataFrame([], "id string, kind string, lang string")
    targets = spark.createDataFrame([("chat", "en", 1.0, 2)], TARGETS)
    sample, report = sample_to_targets(empty, targets, "id", ["kind", "lang"])
    assert sample.count() == 0 and [(x.drawn, x.deficit, x.short) for x in report.collect()] == [(0, 2, True)]
    sample, report = sample_to_targets(empty, targets.limit(0), "id", ["kind", "lang"])
    assert sample.count() == report.count() == 0


def test_quotas_add_up():
    cells = [{"target_share": s, "min_count": m, "key": (str(k),)} for k, (s, m) in enumerate([(0.7, 0), (0.2, 0), (0.1, 30)])]
    _quotas(cells, 100)
    assert [c["quota"] for c in cells] == [54, 16, 30] or sum(c["quota"] for c in cells) == 100


def test_too_many_targets(spark, monkeypatch):
    monkeypatch.setattr("verdigris.llm.proportions.MAX_TARGETS", 1)
    targets = spark.createDataFrame([("a", "en", 0.5, 0), ("b", "en", 0.5, 0)], TARGETS)
    with pytest.raises(ValueError):
        sample_to_targets(spark.createDataFrame([("x", "a", "en")], "id string, kind string, lang string"), targets, "id", ["kind", "lang"])


def test_quotas_of_many_cells():
    r = np.random.default_rng(1)
    cells = [{"target_share": x, "min_count": int(m), "key": (k,)} for k, (x, m) in enumerate(zip(r.random(20_000) ** 3 / 5000, r.integers(0, 50, 20_000)))]
    _quotas(cells, 6_000_000)
    assert sum(c["quota"] for c in cells) == 6_000_000 and all(c["quota"] >= c["min_count"] for c in cells)
    per = [c["quota"] / c["target_share"] for c in cells if c["quota"] > max(200, c["min_count"])]
    assert max(per) / min(per) < 1.02  # those above their minimum share in proportion


def test_a_cell_that_chance_left_short(spark):
    df = spark.createDataFrame([(k, "a") for k in range(400)], "id int, kind string")
    targets = spark.createDataFrame([("a", 1.0, 0)], "kind string, target_share double, min_count int")
    sample, report = sample_to_targets(df, targets, "id", ["kind"], oversample=-10.0)  # accepts next to none at first
    assert sample.count() == 80 and report.first().drawn == 80
