"""Problem 8: abusive, hateful or sexual passages, tagged by a linear-chain conditional random field."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.plans.scratch import keep, materialise, scratch

BITS = 20
LONGEST = 256  # tokens in a chain; longer lines are several chains
ENDS = frozenset(".!?。")
LEAST_ODDS = (0.25, 0.35, 0.45, 0.55, 0.7, 0.9)  # among which folds of the labelled sample choose
THRESHOLDS = tuple(k / 20 for k in range(6, 15))
# every character keeps its place: wide letters become plain, A-Z lower case, wide spaces spaces
_PLAIN = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20}
_PLAIN |= {c: c + 32 for c in range(65, 91)} | {c: c - 0xFEE0 + 32 for c in range(0xFF21, 0xFF3B)}
_WIDE = re.compile("[\uff01-\uff5e\u3000]+")
_JOIN = "[.*@#$_'’~+\\-\u200b\u200c\u200d]"
_TOKEN = re.compile(f"(?:[a-z](?: |{_JOIN})){{3,}}[a-z](?![a-z0-9])|[a-z0-9]+(?:{_JOIN}+[a-z0-9]+|[*]+)*|\n|[^\\s\u200b\u200c\u200d]")


def plain(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):  # some capitals become two characters
        return text.translate(_PLAIN)
    return _WIDE.sub(lambda m: m.group().translate(_PLAIN), low)


def _normal(token: str) -> str:
    """A token's form: numbers alike, letters without what was put between them or repeated; a starred word by its
    first and last letter."""
    if not token[0].isascii() or not token[0].isalnum():
        return token
    if "*" in token:
        return token[0] + "*" + token[-1]
    word = re.sub("[^a-z0-9]", "", token)
    return "0" if word.isdigit() else re.sub(r"(.)\1+", r"\1", word)


class _Ids(dict):
    def __missing__(self, token: str) -> int:
        n = 0 if token == "\n" else 1 if token in ENDS else zlib.crc32(_normal(token).encode()) % (2**31 - 2) + 2
        if len(self) < 1_000_000:
            self[token] = n
        return n


def forms(texts: list[str], ids: _Ids) -> tuple[np.ndarray, np.ndarray]:
    """The forms of all tokens, newlines among them, and how many each text has."""
    lists = [_TOKEN.findall(plain(t)) for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(map(ids.__getitem__, chain.from_iterable(lists)), np.int32, int(sizes.sum())), sizes


class Tokens:
    """The tokens of some texts in flat arrays, from their forms: chain, sentence and text of each; newlines only separate."""

    def __init__(self, form: np.ndarray, sizes: np.ndarray):
        form = form.astype(np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        new_doc = np.zeros(len(form), bool)
        new_doc[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        before_line = np.concatenate([[True], form[:-1] == 0]) if len(form) else np.zeros(0, bool)
        before_end = np.concatenate([[True], form[:-1] == 1]) if len(form) else np.zeros(0, bool)
        line = np.cumsum(new_doc | before_line)
        sentence = np.cumsum(new_doc | before_line | before_end)
        kept = form != 0
        self.kept, self.form, self.doc, self.sentence = kept, form[kept], doc[kept], sentence[kept]
        line = line[kept]
        at = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
        place = np.arange(len(line)) - np.repeat(at, np.diff(np.append(at, len(line))))
        self.starts = np.flatnonzero(place % LONGEST == 0)
        self.lengths = np.diff(np.append(self.starts, len(line)))
        self.line = line

    def features(self) -> np.ndarray:
        """[tokens, 8] hashed features: the form, and pairs and triples of forms around it within the line."""
        n, x = len(self.form), self.form.astype(np.uint64)
        pad = np.zeros(n, np.uint64)

        def near(k: int) -> np.ndarray:
            out = pad.copy()
            if k < 0:
                same = self.line[-k:] == self.line[:k]
                out[-k:] = np.where(same, x[:k], 0)
            else:
                same = self.line[:-k] == self.line[k:]
                out[:-k] = np.where(same, x[k:], 0)
            return out

        a, b, c, d = (near(k) if n > abs(k) else pad for k in (-2, -1, 1, 2))
        out = np.empty((n, 8), np.int32)
        sets = [(x,), (b, x), (x, c), (a, b, x), (b, x, c), (x, c, d), (a, x), (x, d)]
        for k, parts in enumerate(sets):
            h = np.full(n, 0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1), np.uint64)
            for p in parts:
                h = (h ^ p) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(29)
            out[:, k] = (h >> np.uint64(64 - BITS)).astype(np.int32)
        return out


def marginals(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, trans: np.ndarray, expect: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over two states, in log odds: each token's probability of being in a passage, and (if
    asked for) the expected counts of the four transitions. Chains of like length go together."""
    p, pairs = np.zeros(len(scores)), np.zeros((2, 2))
    order, at = np.argsort(lengths, kind="stable"), 0
    while at < len(order):
        to = min(len(order), at + 4096)
        while to - at > 1 and lengths[order[to - 1]] > 2 * lengths[order[at]] + 8:
            to = at + max(1, (to - at) // 2)
        own = order[at:to]
        at = to
        wide = int(lengths[own[-1]])
        place = starts[own][:, None] + np.arange(wide)
        real = np.arange(wide) < lengths[own][:, None]
        s = scores[np.where(real, place, 0)]
        fore, back = np.empty_like(s), np.zeros_like(s)
        fore[:, 0] = s[:, 0]
        for t in range(1, wide):
            r = fore[:, t - 1]
            fore[:, t] = s[:, t] + np.logaddexp(trans[0, 1], trans[1, 1] + r) - np.logaddexp(trans[0, 0], trans[1, 0] + r)
        for t in range(wide - 2, -1, -1):
            v = s[:, t + 1] + back[:, t + 1]
            b = np.logaddexp(trans[1, 0], trans[1, 1] + v) - np.logaddexp(trans[0, 0], trans[0, 1] + v)
            back[:, t] = np.where(real[:, t + 1], b, 0.0)
        p[place[real]] = 1 / (1 + np.exp(-np.clip((fore + back)[real], -50, 50)))
        if expect and wide > 1:
            r, v, m = fore[:, :-1], (s + back)[:, 1:], real[:, 1:]
            four = np.stack([np.full_like(r, trans[0, 0]), trans[0, 1] + v, trans[1, 0] + r, trans[1, 1] + r + v])[:, m]
            four = np.exp(four - four.max(0))
            pairs += (four / four.sum(0)).sum(1).reshape(2, 2)
    return p, pairs


class Crf:
    def __init__(self) -> None:
        self.weights, self.bias, self.trans = np.zeros(1 << BITS, np.float32), -2.0, np.array([[1.0, -1.0], [-1.0, 1.0]])

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.full(len(features), self.bias)
        for k in range(features.shape[1]):
            out += self.weights[features[:, k]]
        return out

    def fit(self, tokens: Tokens, features: np.ndarray, tags: np.ndarray, chains: np.ndarray, rounds: int = 30, decay: float = 2e-7) -> Crf:
        """Raise the likelihood of ``tags`` on the given chains, by full-batch adaptive gradient steps from where the field
        stands. Features that these chains do not have keep their weight."""
        starts, lengths = tokens.starts[chains], tokens.lengths[chains]
        own = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
        inside = np.zeros(len(tags), bool)
        inside[own] = True
        counts = np.bincount(features[own].ravel(), minlength=1 << BITS)
        often = np.flatnonzero(counts >= 2)  # a feature seen once teaches nothing
        place = np.full(1 << BITS, len(often), np.int32)
        place[often] = np.arange(len(often))
        f = place[features[own]]
        flat, weights = f.ravel(), np.append(self.weights[often], np.float32(0))
        follows = np.ones(len(tags), bool)
        follows[tokens.starts] = False
        both = np.flatnonzero(follows & inside)
        seen = np.zeros((2, 2))
        np.add.at(seen, (tags[both - 1].astype(int), tags[both].astype(int)), 1)
        memory, small, y, s = np.full(len(weights), 1e-6), np.full(5, 1e-6), tags[own].astype(float), np.zeros(len(tags))
        for _ in range(rounds):
            s[own] = self.bias + sum(weights[f[:, k]] for k in range(f.shape[1]))
            p, pairs = marginals(s, starts, lengths, self.trans, True)
            gap = y - p[own]
            g = np.bincount(flat, np.repeat(gap, f.shape[1]), minlength=len(weights)) - decay * len(own) * weights
            g[-1] = 0
            memory += g * g
            weights += (0.3 * g / np.sqrt(memory)).astype(np.float32)
            h = np.concatenate([[gap.sum()], (seen - pairs).ravel()])
            small += h * h
            step = 0.3 * h / np.sqrt(small)
            self.bias += step[0]
            self.trans = self.trans + step[1:].reshape(2, 2)
        self.weights[often] = weights[:-1]
        return self

    def tag(self, tokens: Tokens, features: np.ndarray) -> np.ndarray:
        return marginals(self.scores(features), tokens.starts, tokens.lengths, self.trans)[0]


def _by_sentence(tokens: Tokens, values: np.ndarray) -> np.ndarray:
    """The mean of a token's value over its sentence, for every token."""
    if not len(values):
        return values
    n = np.bincount(tokens.sentence)
    return (np.bincount(tokens.sentence, values) / np.maximum(n, 1))[tokens.sentence]


def sentence_scores(tokens: Tokens, p: np.ndarray) -> np.ndarray:
    """The mean probability of the likelier half of a sentence's tokens (three at least), for every token: names and
    times that fill a passage's slots do not dilute it."""
    if not len(p):
        return p
    order = np.argsort(tokens.sentence + 0.999 * (1 - p))
    own = tokens.sentence[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    n = np.diff(np.append(first, len(own)))
    taken = np.maximum((n + 1) // 2, np.minimum(3, n))
    kept = np.arange(len(own)) - np.repeat(first, n) < np.repeat(taken, n)
    out = np.empty(len(p))
    out[order] = np.repeat(np.add.reduceat(p[order] * kept, first) / taken, n)
    return out


class Labelled:
    """Whole documents that are known to hold such a passage or not. ``kinds`` has a class for each flagged one."""

    def __init__(self, form: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, kinds: list[str | None]):
        self.tokens, self.toxic, self.kinds = Tokens(form, sizes), toxic, np.array(kinds, object)
        self.features, self.flagged = self.tokens.features(), toxic[self.tokens.doc]
        self.hits = np.bincount(self.features[self.flagged].ravel(), minlength=1 << BITS)
        self.often = np.flatnonzero(self.hits >= 2).astype(np.int32)

    def odds(self, counts: np.ndarray, total: int, docs: np.ndarray) -> np.ndarray:
        """Each token's mean log ratio of its features' count in the flagged ones of ``docs`` against what their share
        of all documents lets expect (each plus one), averaged over its sentence."""
        own = self.flagged & docs[self.tokens.doc]
        hits = np.bincount(self.features[own].ravel(), minlength=1 << BITS)
        ratio = np.zeros(1 << BITS)
        ratio[self.often] = np.log((hits[self.often] + 1) / (counts / max(1, total) * hits.sum() + 1))
        return _by_sentence(self.tokens, ratio[self.features].mean(1))

    def fit(self, odds: np.ndarray, least: float, docs: np.ndarray, rounds: int) -> Crf:
        """The field of the given documents. Tags come from their labels: in a flagged document the sentences of at least
        ``least`` odds are its passages. Stock sentences are common everywhere, so they stay out, however few labels
        there are."""
        chains = np.flatnonzero(docs[self.tokens.doc[self.tokens.starts]])
        return Crf().fit(self.tokens, self.features, self.flagged & (odds > least), chains, rounds)

    def best(self, crf: Crf) -> np.ndarray:
        """The highest score of a sentence, for each document."""
        out = np.zeros(len(self.toxic))
        np.maximum.at(out, self.tokens.doc, sentence_scores(self.tokens, crf.tag(self.tokens, self.features)))
        return out

    def choose(self, counts: np.ndarray, total: int, seed: int = 1, rounds: int = 12, splits: int = 4) -> tuple[float, float]:
        """The least odds and the least score with the best F1 against the labels of documents held out: odds over some splits in
        halves, scores over one. Of those that do nearly as well, the least odds and a score in the lower quarter: what is
        flagged is reviewed, what is missed is not."""
        f1 = np.zeros(len(LEAST_ODDS))
        for k in range(splits):
            fold = np.random.default_rng([seed, k]).integers(0, 2, len(self.toxic)) == 0
            odds, highest = [self.odds(counts, total, docs) for docs in (fold, ~fold)], np.full(len(self.toxic), -np.inf)
            for docs, o in zip((~fold, fold), odds):  # odds of one half, on the other one
                own = docs[self.tokens.doc]
                np.maximum.at(highest, self.tokens.doc[own], o[own])
            f1 += [_f1(highest > x, self.toxic) / splits for x in LEAST_ODDS]
        least = LEAST_ODDS[int(np.argmax(f1 >= f1.max() - 0.01))]
        scores = np.zeros(len(self.toxic))
        for docs, o in zip((fold, ~fold), odds):
            scores[~docs] = self.best(self.fit(o, least, docs, rounds))[~docs]
        f1 = np.array([_f1(scores >= x, self.toxic) for x in THRESHOLDS])
        best = np.flatnonzero(f1 >= f1.max() - 0.005)
        return least, THRESHOLDS[int(best[len(best) // 4])]

    def train(self, counts: np.ndarray, total: int, threshold: float | None = None, rounds: int = 30) -> tuple[Crf, float, list[str], np.ndarray]:
        """The field, the least score, and for each class the log probabilities of its passages' features. ``counts`` says how
        often the features ``often`` occur in all documents, among ``total``."""
        least, chosen = self.choose(counts, total)
        everyone = np.ones(len(self.toxic), bool)
        odds = self.odds(counts, total, everyone)
        crf = self.fit(odds, least, everyone, rounds)
        tagged = self.flagged & (sentence_scores(self.tokens, crf.tag(self.tokens, self.features)) >= 0.5)
        names = sorted({k for k in self.kinds if k})
        law = np.stack([np.bincount(self.features[tagged & (self.kinds[self.tokens.doc] == k)].ravel(), minlength=1 << BITS) + 0.1 for k in names])
        return crf, chosen if threshold is None else threshold, names, np.log(law / law.sum(1, keepdims=True)).astype(np.float32)


def _f1(found: np.ndarray, true: np.ndarray) -> float:
    return 2 * (found & true).sum() / max(1, found.sum() + true.sum())


def _arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    at = column.offsets.to_numpy(zero_copy_only=False)
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], np.diff(at).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], tokens: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Cut batches with a column ``forms`` so that a slice has about so many tokens, or one row."""
    for x in batches:
        upto = x["forms"].offsets.to_numpy(zero_copy_only=False)[1:].astype(np.int64)
        at = 0
        while at < x.num_rows:
            base = int(upto[at - 1]) if at else int(x["forms"].offsets[0].as_py())
            to = max(at + 1, int(np.searchsorted(upto, base + tokens, "right")))
            yield x.slice(at, to - at)
            at = to


def feature_counts(tokens: DataFrame, wanted: np.ndarray) -> tuple[np.ndarray, int]:
    """How often each of the ``wanted`` features occurs in all texts, and how many features these have in all."""
    share = tokens.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = np.zeros(1 << BITS, np.int64)
        for x in _slices(batches):
            some += np.bincount(Tokens(*_arrays(x["forms"])).features().ravel(), minlength=1 << BITS)
        here = share.value[some[share.value] > 0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(here, -1).astype(np.int32)), pa.array(np.append(some[here], some.sum()))], ["feature", "n"])

    rows = tokens.select("forms").mapInArrow(count, "feature int, n long")
    got = rows.groupBy("feature").agg(F.sum("n").alias("n")).toArrow().to_pandas().set_index("feature")["n"]
    return got.reindex(wanted, fill_value=0).to_numpy(), int(got.get(-1, 0))


def toxic_documents(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", keep_cols: tuple[str, ...] = (), threshold: float | None = None, max_flagged: int = 3000, max_clean: int = 5000, max_chars: int = 20_000, max_total: int = 6_000_000, seed: int = 1) -> DataFrame:
    """``id, *keep_cols, score, flagged, kind, spans`` of every row of ``documents``; score is 0 for null and empty texts.

    ``labels(doc_id, label)`` holds a class or ``none``; null labels do not count, and a document labelled more than
    once is flagged if half of its labels or more are not ``none``. The field is fitted on the driver on a bounded sample
    of labelled documents: by hash of the id, at most ``max_flagged`` flagged and ``max_clean`` other ones, of at most
    ``max_chars`` characters each and ``max_total`` of either kind; feature counts are those of all documents. All documents
    are then scored, whole texts, in their partitions; each text is cut into tokens once. Without a flagged document, or
    without another, there is nothing to learn from and every score is 0.

    A document is flagged from a score of ``threshold`` on, by default the one that labels held out within the sample choose.
    Of flagged ones, ``kind`` is the likeliest class by the features of what is tagged, and ``spans`` are start and end of
    offending passages in characters; other rows have null and none. Repeated rows are scored each; an empty table gives
    no row.
    """
    with scratch(documents.sparkSession):
        return _toxic_documents(documents, labels, id_col, text, keep_cols, threshold, max_flagged, max_clean, max_chars, max_total, seed)


def _labelled(tokens: DataFrame, labels: DataFrame, max_flagged: int, max_clean: int, max_chars: int, max_total: int, seed: int) -> list:
    label = F.lower(F.trim("label"))
    each = labels.where("label is not null").select(F.col("doc_id").alias("id"), label.alias("label")).groupBy("id", "label").agg(F.count("*").alias("n"))
    bad = F.col("label") != "none"
    votes = each.groupBy("id").agg((F.sum(F.when(bad, F.col("n")).otherwise(0)) * 2 >= F.sum("n")).alias("flagged"), F.min_by("label", F.when(bad, F.struct(-F.col("n"), "label"))).alias("kind"))
    known = tokens.select("id", "text", "forms").where(f"id is not null and text is not null and length(text) <= {max_chars}")
    known = materialise(known.join(votes, "id").withColumn("h", F.xxhash64("id", F.lit(seed))), "labelled")
    sample = []
    for flagged, most in ((True, max_flagged), (False, max_clean)):
        own = known.where(F.col("flagged") == flagged)
        sizes = own.select("h", F.length("text").alias("n")).orderBy("h", "n").limit(most).collect()
        room = np.flatnonzero(np.cumsum([r.n for r in sizes] or [0]) <= max_total)
        if sizes and len(room):
            sample += own.where(F.col("h") <= sizes[room[-1]].h).orderBy("h", "text").limit(len(room)).select("flagged", "kind", "forms").collect()
    return sample


def _toxic_documents(documents: DataFrame, labels: DataFrame, id_col: str, text: str, keep_cols: tuple[str, ...], threshold: float | None, max_flagged: int, max_clean: int, max_chars: int, max_total: int, seed: int) -> DataFrame:
    spark = documents.sparkSession
    rows = documents.select(F.col(id_col).alias("id"), *keep_cols, F.col(text).alias("text"))
    kinds = dict(rows.dtypes)
    names = ["id", *keep_cols]
    own_schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                x = whole.slice(at, 500)
                form, sizes = forms([t or "" for t in x["text"].to_pylist()], ids)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(form))
                yield pa.RecordBatch.from_arrays([*x.columns, lists], [*names, "text", "forms"])

    tokens = keep(materialise(rows.mapInArrow(cut, f"{own_schema}, text string, forms array<int>"), "tokens"))
    sample = _labelled(tokens, labels, max_flagged, max_clean, max_chars, max_total, seed)
    toxic = np.array([r.flagged for r in sample], bool)
    state = None
    if toxic.any() and not toxic.all():
        lists = [np.array(r.forms, np.int32) for r in sample]
        labelled = Labelled(np.concatenate(lists), np.array([len(x) for x in lists]), toxic, [r.kind if r.flagged else None for r in sample])
        crf, threshold, classes, law = labelled.train(*feature_counts(tokens, labelled.often), threshold)
        used = np.flatnonzero(crf.weights).astype(np.int32)
        state = (used, crf.weights[used], crf.bias, crf.trans, threshold, classes, law[:, used], law.min(1))
    shared = spark.sparkContext.broadcast(state)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, least, classes, law = Crf(), 2.0, [], None
        if shared.value:
            at, weights, model.bias, model.trans, least, classes, own, rest = shared.value
            model.weights[at] = weights
            law = np.repeat(rest[:, None], 1 << BITS, 1)
            law[:, at] = own
        for x in _slices(batches):
            best, spans, kind = np.zeros(x.num_rows), [[] for _ in range(x.num_rows)], [None] * x.num_rows
            if shared.value:
                best, spans, kind = score_texts(model, x, least, classes, law)
            cols = [*(x[c] for c in names), pa.array(best), pa.array(best >= least), pa.array(kind, pa.string()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(cols, [*names, "score", "flagged", "kind", "spans"])

    return tokens.mapInArrow(score, f"{own_schema}, score double, flagged boolean, kind string, spans array<struct<start: int, end: int>>")


def score_texts(crf: Crf, x: pa.RecordBatch, least: float, classes: list[str], law: np.ndarray) -> tuple[np.ndarray, list[list[dict]], list[str | None]]:
    """Per text: the highest score of a sentence, and from ``least`` on the character ranges of its tagged runs and their class."""
    tokens = Tokens(*_arrays(x["forms"]))
    features = tokens.features()
    p = crf.tag(tokens, features)
    mean = sentence_scores(tokens, p)
    out, spans, kind = np.zeros(x.num_rows), [[] for _ in range(x.num_rows)], [None] * x.num_rows
    np.maximum.at(out, tokens.doc, mean)
    bounds = np.searchsorted(tokens.doc, np.arange(x.num_rows + 1))
    for k in np.flatnonzero(out >= least):
        here = slice(bounds[k], bounds[k + 1])
        inside = mean[here] >= least
        kind[k] = classes[int(np.argmax(law[:, features[here][inside].ravel()].sum(1)))]
        on = (p[here] > min(least, 0.5)) & inside
        places = [m.span() for m in _TOKEN.finditer(plain(x["text"][int(k)].as_py())) if m.group() != "\n"]
        line = tokens.line[here]
        for j in np.flatnonzero(on):
            if spans[k] and j and on[j - 1] and line[j] == line[j - 1]:
                spans[k][-1]["end"] = places[j][1]
            else:
                spans[k].append({"start": places[j][0], "end": places[j][1]})
    return out, spans, kind
