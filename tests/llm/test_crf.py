import random

import numpy as np

from verdigris.llm.crf import Tokens, _Ids, _normal, forms, marginals, plain, toxic_documents

FINE = ["The report of {x} is ready by noon.", "Please tidy the shelf near {x}.", "Kill the stuck {x} process.", "{x} 的清单今天整理好了。", "The filter of {x} flags insults."]
FOUL = ["Shut up, you disgusting {i}, nobody asked {x}.", "你怎么不去死，{i}。", "People as dumb as you should not be near {x}.", "Get lost and die in a ditch, {i}."]


def documents(seed, n):
    r = random.Random(seed)
    name = lambda: "".join(r.choice("bdgklm") + r.choice("aeiou") for _ in range(3))
    out = []
    for k in range(n):
        bad = r.random() < 0.2
        s = [r.choice(FINE).format(x=name()) for _ in range(r.randint(1, 6))]
        if bad:
            s.insert(r.randrange(len(s) + 1), r.choice(FOUL).format(x=name(), i=r.choice(["rat", "r a t s", "ra.t", "RAT", "pig", "蠢货"])))
        out.append((k, r.choice(["\n", " "]).join(s), bad))
    return out


def test_chain_sums_match_enumeration():
    r = np.random.default_rng(3)
    s, trans = r.normal(size=5), r.normal(size=(2, 2))
    p, pairs = marginals(s, np.array([0, 3]), np.array([3, 2]), trans, True)
    for at, n in ((0, 3), (3, 2)):
        z, one, moves = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            w = np.exp(sum(s[at + k] * y[k] for k in range(n)) + sum(trans[y[k], y[k + 1]] for k in range(n - 1)))
            z += w
            one += w * np.array(y)
        assert np.allclose(p[at : at + n], one / z)
    assert np.isclose(pairs.sum(), 3)


def test_forms():
    assert _normal("as.shole") == _normal("asshole") == _normal("asssshole")
    assert _normal("l o s e r") == "loser" and _normal("a***e") == "a*e" and _normal("42") == "0"
    t = Tokens(*forms(["Ａb c.\n你 好", "", "x"], _Ids()))
    assert list(t.doc) == [0] * 5 + [2] and len(t.starts) == 3


def test_finds_passages(spark):
    docs = documents(1, 1500)
    df = spark.createDataFrame([(k, t, "src", 0.1) for k, t, _ in docs] + [(9000, None, "src", 0.0), (9001, "", "src", 0.0), (9002, "You rat. " * 9000, "src", 0.0)], "doc_id long, text string, source string, score double").repartition(3)
    labels = spark.createDataFrame([(k, "abusive" if bad else "none", "a") for k, _, bad in docs[:700]] + [(1, None, "b"), (None, "abusive", "b")], "doc_id long, label string, text string")
    got = {r.id: r for r in toxic_documents(df, labels, keep_cols=("source",)).collect()}
    assert len(got) == 1503 and got[9000].score == got[9001].score == 0.0 and got[9000].spans == []
    held = docs[700:]
    hit = {k for k, _, _ in held if got[k].flagged}
    bad = {k for k, _, b in held if b}
    assert len(hit & bad) >= 0.9 * len(bad) and len(hit - bad) <= 0.05 * len(hit)
    k, text, _ = next(d for d in held if d[0] in hit & bad)
    assert {got[j].kind for j in hit} == {"abusive"} and all(got[j].kind is None for j in got if not got[j].flagged)
    assert all(0 <= s.start < s.end <= len(text) for s in got[k].spans) and got[k].spans


def test_sample_is_bounded(spark):
    docs = documents(2, 300)
    df = spark.createDataFrame([(k, t) for k, t, _ in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(k, "abusive" if bad else "none") for k, _, bad in docs], "doc_id long, label string")
    got = toxic_documents(df, labels, max_flagged=20, max_clean=50, max_chars=500, max_total=4000).collect()
    assert len(got) == 300 and {r.score for r in toxic_documents(df, labels, max_total=1).collect()} == {0.0}


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "Shut up.")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, label string")
    assert [r.score for r in toxic_documents(df, none).collect()] == [0.0]
    assert toxic_documents(df.limit(0), none).collect() == []


def test_plain_keeps_places():
    for t in ("ＡＢ　c", "İstanbul Ａ", "Straße É", ""):
        assert len(plain(t)) == len(t)
    assert plain("ＡＢ　c！") == "ab c!"


def test_classes_are_told_apart(spark):
    r = random.Random(5)
    say = {"abusive": "You are a useless {i}, shut up.", "sexual": "Describe your naked {i} to me slowly."}
    name = lambda: "".join(r.choice("bdgklm") + r.choice("aeiou") for _ in range(3))
    docs = [(k, " ".join([r.choice(FINE).format(x=name()), *([say[c].format(i=r.choice(["rat", "body", "pig"]))] if c else []), r.choice(FINE).format(x=name())]), c) for k, c in enumerate(r.choice(["abusive", "sexual", None, None, None]) for _ in range(900))]
    df = spark.createDataFrame([(k, t) for k, t, _ in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(k, c or "None ", c) for k, _, c in docs[:500]], "doc_id long, label string, kind string")
    got = {x.id: x.kind for x in toxic_documents(df, labels).collect()}
    right = [got[k] == c for k, _, c in docs[500:]]
    assert sum(right) >= 0.95 * len(right)
