import random
import statistics
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from verdigris.functions.numeric import inverse_normal, sigmoid, softplus
from verdigris.operators import calibrate as c
from verdigris.operators.ranks import average_rank, ordinal, spearman

J = "sample_id string, tool_id string, raw_score double"


def test_median_and_range(spark):
    df = spark.createDataFrame([("sample_1", "a", 90.0), ("sample_1", "b", 10.0), ("sample_1", "a", 80.0), ("sample_1", "b", 20.0)], J)
    got = {r.tool_id: r for r in c.calibrate(df).collect()}
    assert got["a"].raw_score == 85 and got["a"].judge_disagreement == 10 and got["b"].raw_score == 15
    assert got["a"].local_z == 1 and got["b"].local_z == -1
    assert got["a"].confidence == pytest.approx(0.674490, abs=1e-5) and got["b"].confidence == pytest.approx(-0.674490, abs=1e-5)


def test_two_samples(spark):
    df = spark.createDataFrame([("s1", "x", 90.0), ("s1", "y", 60.0), ("s1", "z", 10.0), ("s2", "x", 20.0), ("s2", "y", 85.0), ("s2", "z", 30.0)], J)
    got = {(r.sample_id, r.tool_id): (round(r.local_z, 6), round(r.confidence, 6)) for r in c.calibrate(df).collect()}
    want = {("s1", "x"): (1.111168, 0.674490), ("s1", "y"): (0.202031, 0.210428), ("s1", "z"): (-1.313198, -1.382994), ("s2", "x"): (-0.874818, -0.674490), ("s2", "y"): (1.399708, 1.382994), ("s2", "z"): (-0.524891, -0.210428)}
    for k, (z, conf) in want.items():
        assert got[k][0] == z and got[k][1] == pytest.approx(conf, abs=2e-6)


def test_spread_and_edges(spark):
    rows = [(f"s{k}", t, float(v)) for k, vs in enumerate([(90, 60, 10), (20, 85, 30), (10, 20, 95), (80, 40, 30)]) for t, v in zip("abc", vs)]
    conf = [r.confidence for r in c.calibrate(spark.createDataFrame(rows, J)).collect()]
    assert abs(statistics.fmean(conf)) < 0.1 and 0.7 < statistics.pstdev(conf) < 1.2
    flat = c.calibrate(spark.createDataFrame([("s", "a", 5.0), ("s", "b", 5.0)], J)).collect()
    assert [r.local_z for r in flat] == [0.0, 0.0]
    assert c.calibrate(spark.createDataFrame([], J)).collect() == []
    with pytest.raises(ValueError):
        c.calibrate(spark.createDataFrame([], J), clip_at=0.5)


def test_ranks(spark):
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate([3, 1, 1, 2])], "k int, v double")
    assert [r["rank"] for r in average_rank(df, "v").orderBy("k").collect()] == [4, 1.5, 1.5, 3]
    r = random.Random(2)
    vals = [(r.choice("ab"), r.choice([r.random(), 0.5, 1e9, -3.0])) for _ in range(500)]
    got = average_rank(spark.createDataFrame(vals, "g string, v double").repartition(6), "v", ("g",)).collect()
    for x in got:
        own = [v for g, v in vals if g == x.g]
        assert x["rank"] == sum(v < x.v for v in own) + (sum(v == x.v for v in own) + 1) / 2
    rows = spark.createDataFrame([(r.randint(0, 9), r.randint(0, 10**6)) for _ in range(300)], "a long, b long")
    got = ordinal(rows, "a", ["b"]).orderBy("ord").collect()
    assert [x.ord for x in got] == list(range(300)) and [(x.a, x.b) for x in got] == sorted((x.a, x.b) for x in got)


def test_functions(spark):
    ps = [0.001, 0.01, 0.02425, 0.3, 0.5, 0.8, 0.98, 0.999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(inverse_normal(F.col("p")).alias("q"), sigmoid(F.col("p")).alias("s"), softplus(F.lit(800.0)).alias("t")).collect()
    for p, r in zip(ps, got):
        assert r.q == pytest.approx(NormalDist().inv_cdf(p), abs=5e-9)
    assert got[4].s == pytest.approx(0.6224593312) and got[0].t == 800.0
    assert spearman(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, z double"), "x", "z").first().spearman == 0.0


def test_multiaxis(spark):
    r = random.Random(1)
    rows = [(s, t, a, float(r.randint(0, 100))) for s in range(12) for t in ("p", "q", "r") for a in c.AXES]
    out = c.calibrate_multiaxis(spark.createDataFrame(rows, "sample_id long, tool_id string, axis string, raw_score double")).collect()
    assert len(out) == 36 and all(set(x.axis_scores) == set(c.AXES) for x in out)
    best = max(out, key=lambda x: x.confidence)
    assert best.raw_score == max(x.raw_score for x in out) and len({x.confidence for x in out}) == 36
    with pytest.raises(ValueError):
        c.hybrid_final(spark.createDataFrame([], "sample_id long, tool_id string, axis string, raw_score double, confidence double"), absolute=60, full=60)
