import random

import pytest

from verdigris.llm.top_n import top_n_per_group

SCHEMA = "g string, i string, s double, bound string, least int, h string"


def rows(spark, data):
    return spark.createDataFrame([(*r, "x", 1, None) for r in data], SCHEMA)


def plain(data, n, lo, hi):
    best = {}
    for g, i, s in data:
        if g is not None and i is not None and s is not None and s == s and lo <= s <= hi:
            best.setdefault(g, {})
            best[g][i] = max(s, best[g].get(i, s))
    return {(g, i, s, k + 1) for g, x in best.items() for k, (i, s) in enumerate(sorted(x.items(), key=lambda t: (-t[1], t[0].encode()))[:n])}


@pytest.mark.parametrize("n", [1, 3])
def test_against_plain(spark, n):
    r = random.Random(n)
    data = [(r.choice(["a", "b", "hot", "hot", "hot", None]), r.choice([f"t{k}" for k in range(30)] + ["é", "中", "Z", None]), r.choice([0.0, 1.0, 2.0, 50.0, 100.0, 101.0, -1.0, float("nan"), None])) for _ in range(2000)]
    got = top_n_per_group(rows(spark, data).repartition(7), "g", "i", "s", n, 0, 100)
    assert got.columns == ["g", "i", "s", "rank"]
    assert {tuple(x) for x in got.collect()} == plain(data, n, 0, 100)


def test_empty_and_wrong(spark):
    assert top_n_per_group(rows(spark, []), "g", "i", "s").collect() == []
    assert top_n_per_group(rows(spark, [(None, "a", 1.0), ("g", None, 1.0), ("g", "a", None)]), "g", "i", "s").collect() == []
    with pytest.raises(ValueError):
        top_n_per_group(rows(spark, []), "g", "i", "s", 0)


def test_fewer_items_than_n_and_repeats(spark):
    got = top_n_per_group(rows(spark, [("g", "b", 1.0), ("g", "b", 1.0), ("g", "a", 1.0)]), "g", "i", "s", 3)
    assert [tuple(x) for x in got.orderBy("rank").collect()] == [("g", "a", 1.0, 1), ("g", "b", 1.0, 2)]
