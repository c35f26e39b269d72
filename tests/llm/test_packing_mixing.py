import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import queries
from verdigris.llm.mixing import hypergeometric, mix_sources, shard_quotas
from verdigris.llm.packing import pack, pack_report, sum_of_squares
from verdigris.llm.tokens import token_count


def test_tokens(spark):
    got = spark.createDataFrame([("hello world",), ("",), (None,), ("<|endoftext|>",), ("你好 " * 5000,)], "t string").select(token_count(F.col("t")).alias("n")).collect()
    assert [r.n for r in got[:3]] == [2, 0, 0] and got[3].n > 1 and got[4].n > 5000


def test_sum_of_squares_fits():
    r = np.random.default_rng(1)
    for capacity in (10, 512):
        sizes = r.integers(1, capacity + 1, 3000)
        box, offset = sum_of_squares(sizes, capacity)
        fill = np.bincount(box, sizes)
        assert fill.max() <= capacity and sizes.sum() / (len(fill) * capacity) > 0.92
        at = {}
        for b, o, s in zip(box, offset, sizes):
            assert at.get(b, 0) == o
            at[b] = o + s


def test_pack(spark):
    sizes = [(f"d{k}", int(k * 37 % 900)) for k in range(1, 800)] + [("long", 5000), ("exact", 512), ("zero", 0), ("neg", -3), ("none", None), (None, 5), ("twice", 100), ("twice", 100)]
    df = spark.createDataFrame([(*s, "k", 7) for s in sizes], "id string, tokens long, key string, capacity int").repartition(3)
    kinds = spark.createDataFrame([("s", 512), ("b", 2048), ("bad", 0), ("nil", None)], "pack_kind string, capacity_tokens int")
    out = pack(df, "id", "tokens", kinds, shard_size=50_000).toPandas()
    assert set(out.pack_kind) == {"s", "b"}
    good = [(i, n) for i, n in sizes if i is not None and n and n > 0]
    for kind, capacity in (("s", 512), ("b", 2048)):
        o = out[out.pack_kind == kind]
        assert o["size"].sum() == sum(n for _, n in good)
        assert o.groupby(["shard", "container"])["size"].sum().max() <= capacity
        pieces = o.groupby("item_id").size()
        assert all(pieces[i] == -(-n // capacity) for i, n in good if i != "twice") and pieces["twice"] == 2
        for _, x in o.sort_values("offset").groupby(["shard", "container"]):
            assert list(x["offset"]) == [0, *np.cumsum(x["size"])[:-1]]
        x = o[o.item_id == "long"].sort_values("piece")
        assert list(x["from_size"]) == [k * capacity for k in range(len(x))]
    report = {r.pack_kind: r for r in pack_report(pack(df, "id", "tokens", kinds, shard_size=50_000)).collect()}
    assert report["s"].left_over < 0.1 and report["s"].split_items >= 1
    assert pack(df.limit(0), "id", "tokens", kinds).count() == 0
    assert pack(df, "id", "tokens", kinds.limit(0)).count() == 0


def test_quota_tree_adds_up():
    blocks = np.array([100, 0, 7, 33])
    got = [shard_quotas(k, 9, blocks, 5) for k in range(9)]
    assert (sum(q for q, _ in got) == blocks).all()
    for s in range(4):
        at = 0
        for q, first in got:
            assert first[s] == at
            at += q[s]
    totals = [q.sum() for q, _ in got]
    assert max(totals) - min(totals) <= 2


def test_quota_tree_of_huge_totals():
    blocks = np.array([3_000_000_000, 7, 500_000_000, 10**13])
    got = [shard_quotas(k, 5, blocks, 5)[0] for k in range(5)]
    assert (sum(got) == blocks).all() and max(q.sum() for q in got) - min(q.sum() for q in got) <= 3
    for k in (0, 3):  # fair: within many deviations of the mean
        assert all(abs(int(q[k]) - blocks[k] / 5) < 12 * blocks[k] ** 0.5 for q in got)


def test_hypergeometric_of_large_numbers():
    rng = np.random.default_rng(1)
    x = np.array([hypergeometric(rng, 10**9, 3 * 10**9, 4000) for _ in range(400)])
    assert abs(x.mean() - 1000) < 8 and 20 < x.std() < 36  # the law's: 1000 and 27.4
    assert hypergeometric(rng, 10**10, 0, 5) == 5 and hypergeometric(rng, 0, 10**10, 5) == 0 and hypergeometric(rng, 2, 10**10, 10**10 + 2) == 2
    assert hypergeometric(rng, 10**10, 10**10, 2 * 10**10 - 1) in (10**10, 10**10 - 1)


def test_draws_do_not_depend_on_files(spark):
    rows = [(k % 700, ("big", "mid")[k % 2], 1 + k * 37 % 90) for k in range(1500)]
    df = spark.createDataFrame(rows, "id int, source string, tokens int")
    other = df.orderBy(F.desc("tokens")).repartition(7, "tokens")
    weights = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.5, 2)], "source string, target_share double, max_repeats int")
    kinds = spark.createDataFrame([("s", 512)], "pack_kind string, capacity_tokens int")
    same = lambda f: sorted(map(tuple, f(df).collect())) == sorted(map(tuple, f(other).collect()))
    assert same(lambda x: pack(x, "id", "tokens", kinds, shard_size=20_000))
    assert same(lambda x: mix_sources(x, "id", "source", "tokens", weights, block=200, shard_size=5000, rows_a_bin=50)[0])


def test_mix(spark):
    rows = [(f"a{k}", " Big", 10 + k % 5, 1) for k in range(3000)] + [(f"b{k}", "small", 8, 1) for k in range(100)] + [(f"c{k}", "Mid ", 20, 1) for k in range(700)]
    rows += [("n1", None, 5, 1), (None, "big", 5, 1), ("z", "big", 0, 1), ("y", "big", None, 1), ("x", "other", 9, 1)]
    df = spark.createDataFrame(rows, "id string, source string, tokens int, shard int")
    weights = spark.createDataFrame([("big", 0.5, 1), ("SMALL", 0.2, 3), ("mid", 0.3, 1), ("gone", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixture, report = mix_sources(df, "id", "source", "tokens", weights, block=200, shard_size=2000, rows_a_bin=50)
    m, r = mixture.toPandas(), {x.source: x for x in report.collect()}
    assert r["small"].repeats == 3.0 and r["small"].used == 2400
    assert abs(r["big"].actual_share - 0.5) < 0.01 and abs(r["mid"].actual_share - 0.3) < 0.01
    assert m["size"].sum() == sum(x.used for x in r.values())
    assert not m.duplicated(["item_id", "repeat"]).any() and m.groupby("item_id").size().max() == 3
    assert (m.groupby("shard")["position"].max() + 1 == m.groupby("shard").size()).all()
    per = m.groupby("shard")["size"].sum()
    assert len(per) == 6 and per.max() < 1.35 * per.mean()
    again = mix_sources(df, "id", "source", "tokens", weights, block=200, shard_size=2000, rows_a_bin=50)[0].toPandas()
    assert set(map(tuple, again.values)) == set(map(tuple, m.values))
    _, report = mix_sources(df, "id", "source", "tokens", weights, total=20_000, block=200)
    assert {x.source: x.reached for x in report.collect()} == {"big": True, "small": False, "mid": True, "gone": False}
    mixture, report = mix_sources(df.limit(0), "id", "source", "tokens", weights)
    assert mixture.count() == 0 and report.count() == 4


@pytest.mark.parametrize("n", [1, 2])
def test_mix_tiny(spark, n):
    df = spark.createDataFrame([(k, "a", 3) for k in range(n)], "id int, source string, tokens int")
    weights = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mix_sources(df, "id", "source", "tokens", weights)[0].count() == n


def test_mix_all_is_not_set_by_the_scarcest(spark, tmp_path):
    rows = [(k, "big", "word " * 40) for k in range(300)] + [(1000, "Small", "one two")] + [(2000 + k, "mid", "word " * 40) for k in range(100)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 3), ("mid", 0.3, 1)], "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/source_weights.parquet")
    r = {x.source: x for x in queries.p7_report(spark, str(tmp_path)).collect()}
    total = sum(x.available for x in r.values())
    assert r["small"].used == 3 * r["small"].available and not r["small"].reached and r["small"].unused == 0
    assert r["big"].reached and abs(r["big"].used / total - 0.5) < 0.01 and abs(r["big"].unused - 1 / 3) < 0.01
    assert not r["mid"].reached and r["mid"].used == r["mid"].available
    assert queries.p7_mix(spark, str(tmp_path)).groupBy().sum("size").first()[0] == sum(x.used for x in r.values())
