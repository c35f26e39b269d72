import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from verdigris.llm import chosen_path
from verdigris.llm.chosen_path import similar_sets, trees_for
from verdigris.llm.overlap import overlapping_ids, partner_counts, split_overlap
from verdigris.llm.sets import item_set, shingle_set, word_set
from verdigris.llm.vp_forest import near_duplicate_groups, near_duplicate_pairs


def words(t):
    out = set()
    for run in re.findall("[a-z0-9]+|[一-鿿]+", (t or "").lower()):
        out |= {run} if run[0] < "一" or len(run) == 1 else {run[k : k + 2] for k in range(len(run) - 1)}
    return out


def test_words_and_shingles(spark):
    texts = ["Hello, hello WORLD_9 你好吗x好", "", None, "ab", "。", "一", "a b c a b c", "İx"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.size(word_set(F.col("t"))), F.size(shingle_set(F.col("t")))).collect()
    for t, n, k in got:
        if t is None:
            assert n in (-1, None) and k in (-1, None)
            continue
        w = re.findall("[a-z0-9]+|[一-鿿]", t.lower())
        assert n == len(words(t)) and k == len({tuple(w[j : j + 3]) for j in range(len(w) - 2)})


def test_items(spark):
    got = spark.createDataFrame([([" A", "a ", None, "", "  ", "b"],), ([],), (None,)], "x array<string>").select(F.size(item_set(F.col("x")))).collect()
    assert [r[0] for r in got] == [2, 0, 0]


def near(rows, t):
    return {(a, b) for (a, x), (b, y) in combinations(sorted(rows), 2) if x and y and len(x & y) >= t * len(x | y) - 1e-12}


def expand(members, pairs):
    m = {}
    for r in members.collect():
        m.setdefault(r.cls, set()).add(r.id)
    out = {tuple(sorted(p)) for c in m.values() for p in combinations(c, 2)}
    return out | {tuple(sorted((x, y))) for p in pairs.collect() for x in m[p.a] for y in m[p.b]}


def sets(seed, n, common, size):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        if rows and r.random() < 0.5:
            x = set(r.choice(rows)[1])
            for _ in range(r.randint(0, 4)):
                x ^= {f"w{r.randint(0, 60)}"}
        else:
            x = {f"w{r.randint(0, 400)}" for _ in range(r.randint(*size))}
        if common and r.random() < 0.7:
            x |= {"plugin", "tool"}
        rows.append((f"id{k:04}", x))
    return rows + [("empty", set())]


@pytest.mark.parametrize("seed", [1, 2])
def test_chosen_path_finds_all(spark, seed):
    rows = sets(seed, 400, True, (1, 9))
    df = spark.createDataFrame([(i, sorted(x), 1, "z") for i, x in rows] + [(None, ["a"], 1, "z"), ("nil", None, 1, "z")], "id string, kw array<string>, n int, cls string")
    df = df.where("id is not null").withColumn("items", item_set(F.col("kw")))
    got = expand(*similar_sets(df, "id", "items", 0.6, node_size=8))
    want = near(rows, 0.6)
    assert got <= want and len(got) >= 0.995 * len(want) and len(want) > 100


def test_chosen_path_hot_copies_and_empty(spark):
    df = spark.createDataFrame([(f"h{k}", ["plugin", "x"]) for k in range(300)] + [("a", ["plugin", "x", "y"])], "id string, kw array<string>").withColumn("items", item_set(F.col("kw")))
    members, pairs = similar_sets(df, "id", "items", 0.6)
    assert members.count() == 301 and pairs.count() == 1
    members, pairs = similar_sets(df.limit(0), "id", "items", 0.6)
    assert members.count() == pairs.count() == 0
    with pytest.raises(ValueError):
        similar_sets(df, "id", "items", 0.0)


def near_copies(n, size, edits=2, seed=1):
    r = random.Random(seed)
    base = [f"b{k}" for k in range(size)]
    return [(f"c{k:04}", set(base) - set(r.sample(base, edits)) | {f"n{r.randint(0, 10**6)}" for _ in range(edits)}) for k in range(n)]


def with_common_part(n, common, size, seed=2):
    r = random.Random(seed)
    rows = [(f"t{k:04}", {f"b{j}" for j in range(common)} | {f"x{r.randint(0, 2000)}" for _ in range(size - common)}) for k in range(n)]
    return [*rows, ("base", {f"b{j}" for j in range(common)})]


@pytest.mark.parametrize("rows", [near_copies(300, 80), near_copies(1000, 40), with_common_part(600, 12, 20)], ids=["80", "many", "nested"])
def test_chosen_path_ends_in_hot_nodes(spark, rows, monkeypatch):
    made = []

    def counted(df, label="step"):
        out = materialise(df, label)
        if label in ("nodes", "prefixes", "dense", "blocks"):
            made.append(out.count())
        return out

    materialise = chosen_path.materialise
    monkeypatch.setattr(chosen_path, "materialise", counted)
    df = spark.createDataFrame([(i, sorted(x)) for i, x in rows], "id string, kw array<string>").withColumn("items", item_set(F.col("kw")))
    got, want = expand(*similar_sets(df, "id", "items", 0.6)), near(rows, 0.6)
    assert got <= want and len(got) >= 0.995 * len(want)
    assert sum(made) < 500 * len(rows) and len(made) < 20  # a level's rows do not grow with its depth


def test_chosen_path_beyond_its_depth_is_exact(spark):
    rows = sets(3, 300, True, (1, 9))
    df = spark.createDataFrame([(i, sorted(x)) for i, x in rows], "id string, kw array<string>").withColumn("items", item_set(F.col("kw")))
    for depth in (0, 1):
        assert expand(*similar_sets(df, "id", "items", 0.6, node_size=2, max_depth=depth, block=50)) == near(rows, 0.6)


def test_trees_follow_recall():
    assert trees_for(0.999, 1.5) == 8 and trees_for(0.99, 1.5) < trees_for(0.9999, 1.5)
    with pytest.raises(ValueError):
        trees_for(1.0, 1.5)


@pytest.mark.parametrize("leaf,reach", [(8, 0), (16, 1), (64, 3)])
def test_forest_is_exact(spark, leaf, reach):
    rows = sets(leaf, 500, True, (5, 60))
    df = spark.createDataFrame([(i, sorted(x)) for i, x in rows], "id string, kw array<string>").withColumn("items", item_set(F.col("kw")))
    assert expand(*near_duplicate_pairs(df, "id", "items", 0.7, 1, leaf, reach)) == near(rows, 0.7)


@pytest.mark.parametrize("leaf", [16, 4096])
def test_spanning_pairs_connect_the_same(spark, leaf):
    rows = [(i, x) for i, x in sets(5, 300, True, (5, 40))]
    r = random.Random(6)
    base = {f"b{k}" for k in range(60)}
    rows += [(f"hot{k:03}", base - set(r.sample(sorted(base), 5)) | {f"e{r.randint(0, 99)}"}) for k in range(200)]
    df = spark.createDataFrame([(i, sorted(x)) for i, x in rows], "id string, kw array<string>").withColumn("items", item_set(F.col("kw")))

    def groups(pairs):
        top = {i: i for i, _ in rows}

        def find(x):
            while top[x] != x:
                x = top[x]
            return x

        for a, b in pairs:
            top[max(find(a), find(b))] = min(find(a), find(b))
        return {i: find(i) for i in top}

    members, pairs = near_duplicate_pairs(df, "id", "items", 0.7, 1, leaf, spanning=True)
    got, want = expand(members, pairs), near(rows, 0.7)
    assert got <= want and groups(got) == groups(want)
    hot = [p for p in want if p[0].startswith("hot") and p[1].startswith("hot")]
    assert len([p for p in got if p in set(hot)]) < len(hot) / 2


def test_groups_close_chains(spark):
    base = [f"w{k}" for k in range(40)]
    chain = [(f"c{j}", [w for w in base if w not in base[:j]] + [f"n{k}" for k in range(j)]) for j in range(0, 30, 3)]
    rows = [(i, x, None, "k") for i, x in chain] + [("c0", base, None, "k"), ("far", ["q1", "q2"], None, "k"), ("s1", ["u"], base[:12], "k"), ("s2", ["v"], base[:12], "k"), ("s3", ["w"], base[:5], "k"), ("s4", ["y"], base[:5], "k"), (None, base, None, "k"), ("nil", None, None, "k")]
    df = spark.createDataFrame(rows, "tool string, a array<string>, b array<string>, cls string")
    df = df.select("tool", "cls", item_set(F.col("a")).alias("long"), item_set(F.col("b")).alias("short"))
    got = {r.id: r.grp for r in near_duplicate_groups(df, "tool", {"long": 1, "short": 10}, 0.7).collect()}
    assert got == {i: "c0" for i, _ in chain} | {"s1": "s1", "s2": "s1"}
    assert near_duplicate_groups(df.limit(0), "tool", {"long": 1, "short": 10}).collect() == []


def test_overlap_against_plain(spark):
    r = random.Random(4)
    voc = [f"w{k}" for k in range(80)] + list("天地玄黄宇宙洪荒")
    texts = {}
    for k in range(240):
        if texts and r.random() < 0.5:
            t = r.choice(list(texts.values())).split(" ")
            for _ in range(r.randint(0, 5)):
                t[r.randrange(len(t))] = r.choice(voc)
            t = t + [r.choice(voc) for _ in range(r.choice([0, 0, 40]))]
        else:
            t = ["stock", "phrase", "here"] + [r.choice(voc) for _ in range(r.randint(1, 30))]
        texts[f"c{k:03}"] = " ".join(t)
    texts |= {"short": "a b", "empty": "", "copy1": texts["c000"], "copy2": texts["c000"]}
    split = {i: r.choice(["train", "Train ", "valid", "test"]) for i in texts} | {"copy1": "train", "copy2": "TEST"}
    rows = [(i, t, 3) for i, t in texts.items()] + [("c001", texts["c001"], 4), ("nil", None, 1), (None, "a b c d", 1)]
    df = spark.createDataFrame(rows, "id string, text string, df int")
    sp = spark.createDataFrame([(i, s, "x") for i, s in split.items()] + [("c002", None, "x"), ("nil", "test", "x")], "id string, split string, txt string")

    def shingles(t):
        w = re.findall("[a-z0-9]+|[一-鿿]", t.lower())
        return {tuple(w[k : k + 3]) for k in range(len(w) - 2)}

    s = {i: shingles(t) for i, t in texts.items()}
    side = {i: x.strip().lower() for i, x in split.items()}
    want = {(e, t) for e in s for t in s if side[e] != "train" and side[t] == "train" and s[e] and len(s[e] & s[t]) * 4 >= 3 * len(s[e])}
    found = split_overlap(df, sp, "id", "text", "split")
    got = overlapping_ids(*found)
    assert {(x.eval_id, x.train_id) for x in got.collect()} == want and len(want) > 20
    assert {x.id: x.partners for x in partner_counts(*found).collect()} == {e: sum(1 for a, _ in want if a == e) for e, _ in want}
    # ids on both sides, and with several texts
    both = spark.createDataFrame([("a", "u v w x"), ("b", "u v w x"), ("c", "u v w x"), ("c", "k l m n"), ("d", "k l m n")], "id string, text string")
    sides = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "test"), ("c", "train"), ("d", "valid")], "id string, split string")
    assert {x.id: x.partners for x in partner_counts(*split_overlap(both, sides, "id", "text", "split")).collect()} == {"a": 1, "b": 2, "d": 1}
    assert overlapping_ids(*split_overlap(df.limit(0), sp, "id", "text", "split")).collect() == []


def test_overlap_in_blocks(spark, monkeypatch):
    """Texts of shared phrases, nearly all of which meet: found over several blocks, and no pair of texts that only meets is shuffled."""
    r = random.Random(7)
    phrases = [" ".join(f"w{r.randrange(5000)}" for _ in range(12)) for _ in range(40)]
    texts = {f"c{k:03}": " ".join(r.sample(phrases, 10)) for k in range(600)}
    texts |= {f"d{k:03}": texts[f"c{k:03}"] + " and more of it" for k in range(20)}
    side = {i: "train" if i[0] == "c" and k % 3 else "test" for k, i in enumerate(texts)}
    df = spark.createDataFrame(list(texts.items()), "id string, text string").repartition(2)
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def shuffled():
        bus.waitUntilEmpty(30_000)
        all_ = store.executorList(False)
        return sum(all_.apply(k).totalShuffleWrite() for k in range(all_.size()))

    def shingles(t):
        w = t.split(" ")
        return {tuple(w[k : k + 3]) for k in range(len(w) - 2)}

    s = {i: shingles(t) for i, t in texts.items()}
    want = {(e, t) for e in s for t in s if side[e] == "test" and side[t] == "train" and len(s[e] & s[t]) * 4 >= 3 * len(s[e])}
    monkeypatch.setattr("verdigris.llm.overlap.BLOCK", 5000, raising=False)
    before = shuffled()
    found = split_overlap(df, spark.createDataFrame(list(side.items()), "id string, split string"), "id", "text", "split")
    assert shuffled() - before < sum(map(len, texts.values()))
    assert {(x.eval_id, x.train_id) for x in overlapping_ids(*found).collect()} == want and len(want) > 10
