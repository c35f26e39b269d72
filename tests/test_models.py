import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.operators import models
from verdigris.operators.sampling import ExposureSampler, sample_candidates, sample_in_turn, split_for_cv, split_groups


def weights(seed, **layers):
    r = np.random.default_rng(seed)
    return {f"{k.replace('__', '.')}.{p}": r.normal(size=(a, b) if p == "w" else b) for k, (a, b) in layers.items() for p in "wb"}


def test_heads_and_scorers():
    r = np.random.default_rng(1)
    x = r.normal(size=(5, 4))
    w = weights(2, score__hidden0=(4, 3), score__hidden1=(3, 3), score__out=(3, 1))
    h = np.maximum(x @ w["score.hidden0.w"] + w["score.hidden0.b"], 0)
    h = np.maximum(h @ w["score.hidden1.w"] + w["score.hidden1.b"], 0)
    assert np.allclose(models.pair_score(w, x), (h @ w["score.out.w"] + w["score.out.b"])[:, 0])
    g = weights(3, score__gate=(4, 6), score__up=(4, 6), score__out=(6, 1))
    assert models.head(g, "score", "swiglu", x).shape == (5,)
    with pytest.raises(ValueError):
        models.head(w, "score", "other", x)
    f = weights(4, field=(4, 3), rate=(3, 1), score__hidden0=(3, 2), score__out=(2, 1))
    assert np.allclose(models.field_score(f, np.stack([x, x], 1)), models.field_score(f, x[:, None]))  # like fields count as one
    lex, pol = r.normal(size=(5, 2)), r.normal(size=(5, 3))
    late = weights(5, score__out=(6, 1), gate=(6, 4), lift=(2, 4), policy_gate=(3, 1), policy__hidden0=(3, 2), policy__out=(2, 1))
    base = models.late_score(late, x, lex, kind="linear")
    assert np.allclose(base, np.concatenate([x, lex], 1) @ late["score.out.w"][:, 0] + late["score.out.b"])
    assert not np.allclose(models.late_score(late, x, lex, policy=pol, kind="linear"), base)
    added = weights(6, score__out=(4, 1), gate=(6, 4), lift=(2, 4))
    assert models.late_score(added, x, lex, "gated_add", kind="linear").shape == (5,)
    cat = weights(7, score__out=(6, 1), gate=(6, 2))
    assert models.late_score(cat, x, lex, "gated_concat", kind="linear").shape == (5,)
    fac = weights(8, **{f"factor{k}__hidden0": (4, 2) for k in range(6)}, **{f"factor{k}__out": (2, 1) for k in range(6)}, final__out=(13, 1))
    final, factors = models.factor_scores(fac, x)
    assert final.shape == (5,) and factors.shape == (5, 6)


def test_predict_in_batches(spark):
    w = weights(2, score__hidden0=(2, 3), score__hidden1=(3, 3), score__out=(3, 1))
    rows = [(k, [float(k), 1.0]) for k in range(700)] + [(900, None)]
    got = {r.id: r.prediction for r in models.predict(spark.createDataFrame(rows, "id int, x array<double>"), "x", functools.partial(models.pair_score, w), 64).collect()}
    want = models.pair_score(w, np.array([x for _, x in rows[:-1]]))
    assert got[900] is None and np.allclose([got[k] for k in range(700)], want)


def test_training_follows_the_gradient(spark):
    w = {k: v * 1.0 for k, v in models.new_network([3, 4, 1], 3).items()}
    r = np.random.default_rng(1)
    x, y = r.normal(size=(6, 3)), r.normal(size=6)
    _, g = models._gradient(w, 1, x, y, 1.0)
    for k in w:
        at = tuple(0 for _ in w[k].shape)
        up, down = {**w, k: w[k].copy()}, {**w, k: w[k].copy()}
        up[k][at] += 1e-6
        down[k][at] -= 1e-6
        assert abs((models._gradient(up, 1, x, y, 1.0)[0] - models._gradient(down, 1, x, y, 1.0)[0]) / 2e-6 - g[k][at]) < 1e-4
    rows = [([float(a), float(b)], 2.0 * a - b) for a, b in r.normal(size=(300, 2)).tolist()] + [(None, 1.0), ([0.0, 0.0], None)]
    _, losses = models.train(spark.createDataFrame(rows, "x array<double>, y double").repartition(3), "x", "y", [2, 8, 1], epochs=25)
    assert losses[-1] < 0.3 * losses[0]
    assert models.train(spark.createDataFrame([], "x array<double>, y double"), "x", "y", [2, 1], epochs=3)[1] == []


def test_texts_are_encoded_once_and_cached(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("bb", 2), ("a", 3), (None, 4)], "t string, k int")
    calls = spark.sparkContext.accumulator(0)

    def encode(texts):
        calls.add(len(texts))
        return np.array([[len(t), 1.0] for t in texts])

    key = models.cache_key("m", 16, df, "t")
    assert key == models.cache_key("m", 16, df.repartition(3), "t") != models.cache_key("m", 17, df, "t") and len(key) == 20
    got = models.cached(str(tmp_path), key, lambda: models.encode_once(df, "t", encode), spark)
    assert {r.k: r.vector for r in got.collect()} == {1: [1.0, 1.0], 2: [2.0, 1.0], 3: [1.0, 1.0], 4: None} and calls.value == 2
    assert models.cached(str(tmp_path), key, lambda: 1 / 0, spark).count() == 4


def test_exposures_even_out(spark):
    s = ExposureSampler(["agent.a"], [f"p{k}" for k in range(20)], rate=0.2, decay=0.2)
    total = s.weights.sum()
    sets = [s.sample([], seed) for seed in range(200)]
    assert all(len(x) == 5 and "agent.a" in x and len(set(x)) == 5 for x in sets)
    assert abs(s.weights.sum() - total) < 1e-6 and s.exposures.sum() == 800 and s.exposures.max() - s.exposures.min() < 20
    assert "p7" in s.sample(["none", "p7"], 1) and ExposureSampler([], ["p"], 0.5, force=0.0).sample(["p"], 3) == ["p"]
    for bad in ({"rate": 2}, {"decay": 0}, {"force": -1}):
        with pytest.raises(ValueError):
            ExposureSampler([], [], **bad)
    # the draw itself: the first place at which the running weight reaches the share
    s.weights[:] = np.arange(1, 21)
    r = random.Random(4)
    for _ in range(50):
        u, run, left = r.random(), 0.0, np.array([3, 5, 8, 19])
        k = next(j for j, p in enumerate(left) if (run := run + s.weights[p]) >= u * s.weights[left].sum())
        assert s.pick(left, u) == k


def test_ordered_and_weighted_sampling(spark):
    conv = spark.createDataFrame([(f"c{k:03}", ["p3"] if k % 2 else None) for k in range(60)], "conversation_id string, target_tool_ids array<string>")
    tools = spark.createDataFrame([("agent.x", "agent", 1.0)] + [(f"p{k}", "plugin", float(k < 5)) for k in range(30)], "tool_id string, kind string, weight double")
    a, b = (sorted(map(tuple, sample_in_turn(conv.repartition(n), tools, 0.1).select("conversation_id", "number", F.array_join("tool_ids", ",")).collect())) for n in (1, 4))
    assert a == b and [x[1] for x in a] == list(range(1, 61)) and all("p3" in x[2].split(",") for x in a if int(x[0][1:]) % 2)
    got = sample_candidates(conv, tools, 0.1, weight="weight").where("tool_id like 'p%'").select("tool_id").distinct().collect()
    assert {r.tool_id for r in got} == {f"p{k}" for k in range(5)}  # three of five are drawn; those without weight never


def test_exact_splits(spark):
    df = spark.createDataFrame([(f"c{k % 43}", k) for k in range(200)] + [(None, 1)], "conversation_id string, x int")
    sizes = lambda rows, c: {r[0]: r[1] for r in rows.select("conversation_id", c).distinct().groupBy(c).count().collect()}
    assert sizes(split_groups(df), "split") == {"valid": 9, "train": 34} and split_groups(df).count() == 200
    assert sizes(split_for_cv(df, 0.3, 0.1), "part") == {"holdout": 4, "cv": 13, "base": 26}
