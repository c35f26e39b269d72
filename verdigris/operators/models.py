"""Scorers of pairs as numpy passes over Arrow batches, their training, and cached embeddings."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.plans.scratch import materialise

#: Parameters of a network by name; a layer is a matrix ``<name>.w`` [in, out] and a bias ``<name>.b``.
Weights = Mapping[str, np.ndarray]


def factor_interactions(f: Column) -> Column:
    """the seven products of the six factors (capability, action, specificity, consent, cost, style) that the final head sees;
    fewer factors raise."""
    pairs = ((0, 1), (0, 2), (1, 3), (3, 5), (1, 5), (4, 1), (4, 3))
    products = F.array(*(F.get(f, i) * F.get(f, j) for i, j in pairs))
    return F.when(F.size(f) >= 6, products).otherwise(F.raise_error(F.lit("six factors are needed")).cast("array<double>"))


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0.0)


def silu(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.exp(-np.clip(x, -60, 60)))


def layer(w: Weights, name: str, x: np.ndarray) -> np.ndarray:
    return x @ w[f"{name}.w"] + w[f"{name}.b"]


def head(w: Weights, name: str, kind: str, x: np.ndarray) -> np.ndarray:
    """M5: a head's single output: linear; small (one hidden layer); mlp (two); swiglu (a gated hidden layer)."""
    if kind == "linear":
        return layer(w, f"{name}.out", x)[:, 0]
    if kind == "swiglu":
        return layer(w, f"{name}.out", silu(layer(w, f"{name}.gate", x)) * layer(w, f"{name}.up", x))[:, 0]
    if kind not in ("small", "mlp"):
        raise ValueError(f"unknown head {kind}")
    for k in range(1 if kind == "small" else 2):
        x = relu(layer(w, f"{name}.hidden{k}", x))
    return layer(w, f"{name}.out", x)[:, 0]


def pair_score(w: Weights, x: np.ndarray) -> np.ndarray:
    """M1: pair features through two hidden layers."""
    return head(w, "score", "mlp", x)


def field_score(w: Weights, x: np.ndarray) -> np.ndarray:
    """M4: features of each of a tool's fields against the conversation, [rows, fields, features], each through the same layer,
    weighed against each other and scored."""
    each = relu(layer(w, "field", x))
    rate = layer(w, "rate", each)[..., 0]
    rate = np.exp(rate - rate.max(1, keepdims=True))
    mixed = (each * (rate / rate.sum(1, keepdims=True))[..., None]).sum(1)
    return head(w, "score", "small", mixed)


def late_score(w: Weights, semantic: np.ndarray, lexical: np.ndarray | None = None, fusion: str = "concat", policy: np.ndarray | None = None, kind: str = "mlp") -> np.ndarray:
    """M2: late-interaction features scored by a head, with lexical ones beside them (concat), added behind a gate (gated_add) or
    beside them behind a gate (gated_concat), and a residual of the policy features, itself gated, on top."""
    x = semantic
    if lexical is not None:
        if fusion == "concat":
            x = np.concatenate([semantic, lexical], 1)
        else:
            open_ = 1 / (1 + np.exp(-np.clip(layer(w, "gate", np.concatenate([semantic, lexical], 1)), -60, 60)))
            if fusion == "gated_add":
                x = semantic + open_ * layer(w, "lift", lexical)
            elif fusion == "gated_concat":
                x = np.concatenate([semantic, open_ * lexical], 1)
            else:
                raise ValueError(f"unknown fusion {fusion}")
    out = head(w, "score", kind, x)
    if policy is not None:
        gate = 1 / (1 + np.exp(-np.clip(layer(w, "policy_gate", policy)[:, 0], -60, 60)))
        out = out + gate * head(w, "policy", "small", policy)
    return out


def factor_scores(w: Weights, x: np.ndarray, kind: str = "small") -> tuple[np.ndarray, np.ndarray]:
    """M3: six factors, each by a head of its own, and the final score from them and their products: (final, factors)."""
    f = np.stack([head(w, f"factor{k}", kind, x) for k in range(6)], 1)
    products = np.stack([f[:, i] * f[:, j] for i, j in ((0, 1), (0, 2), (1, 3), (3, 5), (1, 5), (4, 1), (4, 3))], 1)
    return head(w, "final", "linear", np.concatenate([f, products], 1)), f


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def predict(rows: DataFrame, features: str, model: Callable[[np.ndarray], np.ndarray | tuple[np.ndarray, np.ndarray]], batch: int = 256) -> DataFrame:
    """M7, M8: ``rows`` with ``prediction`` (and, of a model with factors, ``factor_predictions``) by the column of features, in batches.

    The model goes to the tasks with its weights; a row without features has no prediction. Metrics and factor errors of the result
    are those of the ranking and report operators."""
    kept = [c for c in rows.columns if c != features]
    ready = rows.select(*kept, F.col(features).cast("array<double>").alias(features))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                x = whole.slice(at, batch)
                given = x[features].is_valid().to_numpy(zero_copy_only=False)
                final, factors = np.full(x.num_rows, np.nan), [None] * x.num_rows
                if given.any():
                    got = model(_matrix(x[features].filter(pa.array(given))))
                    if isinstance(got, tuple):
                        got, f = got
                        for k, v in zip(np.flatnonzero(given), f.tolist()):
                            factors[k] = v
                    final[given] = got
                yield pa.RecordBatch.from_arrays([*(x[c] for c in kept), pa.array(final, mask=~given), pa.array(factors, pa.list_(pa.float64()))], [*kept, "prediction", "factor_predictions"])

    kinds = dict(ready.dtypes)
    return ready.mapInArrow(score, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "prediction double", "factor_predictions array<double>"]))


def new_network(sizes: list[int], seed: int = 0, name: str = "score") -> dict[str, np.ndarray]:
    """A head of the sizes given (in, hidden ..., 1), drawn at random."""
    rng, out = np.random.default_rng(seed), {}
    for k, (a, b) in enumerate(zip(sizes, sizes[1:])):
        at = f"{name}.{f'hidden{k}' if k < len(sizes) - 2 else 'out'}"
        out |= {f"{at}.w": rng.normal(size=(a, b)) * (2 / a) ** 0.5, f"{at}.b": np.zeros(b)}
    return out


def _gradient(w: Weights, hidden: int, x: np.ndarray, y: np.ndarray, beta: float) -> tuple[float, dict[str, np.ndarray]]:
    """The summed smooth L1 loss of a head and its gradients."""
    layers, acts = [*(f"score.hidden{k}" for k in range(hidden)), "score.out"], [x]
    for name in layers[:-1]:
        acts.append(relu(layer(w, name, acts[-1])))
    gap = layer(w, layers[-1], acts[-1])[:, 0] - y
    small = np.abs(gap) < beta
    loss = np.where(small, 0.5 * gap * gap / beta, np.abs(gap) - 0.5 * beta).sum()
    back, out = np.where(small, gap / beta, np.sign(gap))[:, None], {}
    for name, act in zip(reversed(layers), reversed(acts)):
        out |= {f"{name}.w": act.T @ back, f"{name}.b": back.sum(0)}
        back = (back @ w[f"{name}.w"].T) * (act > 0)
    return float(loss), out


def train(rows: DataFrame, features: str, label: str, sizes: list[int], epochs: int = 20, rate: float = 0.05, beta: float = 1.0, seed: int = 0) -> tuple[dict[str, np.ndarray], list[float]]:
    """M6: fit a head of ``sizes`` by smooth L1 loss; returns (weights, mean loss by epoch).

    Every epoch each task sums the gradient of its rows, and the driver, which gets one gradient a task and no row, makes one
    adaptive step: all rows count, in whatever partitions they are. Rows without features or label do not count; without any row
    the network stays as drawn."""
    spark, w, hidden = rows.sparkSession, new_network(sizes, seed), len(sizes) - 2
    ready = materialise(rows.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y")).where("x is not null and y is not null and not isnan(y)"), "training")
    first, second, losses = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, []
    for t in range(1, epochs + 1):
        shared = spark.sparkContext.broadcast(w)

        def gradient(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            loss, n, total = 0.0, 0, np.zeros(sum(v.size for v in shared.value.values()))
            for b in batches:
                if b.num_rows:
                    one, g = _gradient(shared.value, hidden, _matrix(b["x"]), b["y"].to_numpy(), beta)
                    loss, n, total = loss + one, n + b.num_rows, total + np.concatenate([g[k].ravel() for k in shared.value])
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n]), pa.array([total.tolist()])], ["loss", "n", "g"])

        got = ready.mapInArrow(gradient, "loss double, n long, g array<double>").collect()
        n = sum(r.n for r in got)
        if not n:
            break
        losses.append(sum(r.loss for r in got) / n)
        flat, at = np.sum([r.g for r in got], 0) / n, 0
        w = dict(w)
        for k in w:
            g = flat[at : at + w[k].size].reshape(w[k].shape)
            at += w[k].size
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
            w[k] = w[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        shared.unpersist()
    return w, losses


def encode_once(pairs: DataFrame, text: str, encode: Callable[[list[str]], np.ndarray], name: str = "vector", batch: int = 64) -> DataFrame:
    """``pairs`` with the vector of their text by any encoder, a function of a list of texts: each distinct text is encoded
    once, whatever the number of its pairs, and joined back. A null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                x = whole.slice(at, batch)
                yield pa.RecordBatch.from_arrays([x["t_"], pa.array(np.asarray(encode(x["t_"].to_pylist()), float).tolist(), pa.list_(pa.float64()))], ["t_", name])

    texts = pairs.select(F.col(text).alias("t_")).where("t_ is not null").distinct()
    return pairs.join(texts.mapInArrow(run, f"t_ string, `{name}` array<double>"), F.col(text) == F.col("t_"), "left").drop("t_")


def cache_key(model: str, max_length: int, texts: DataFrame, text: str, name: str = "texts") -> str:
    """Twenty digits of what was encoded: the settings, and all distinct texts whatever their order, by hashes summed over
    the table, so that no text comes to the driver."""
    h = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), F.col("t_")).cast("decimal(38,0)")), F.lit(0)).cast("string")
    sums = texts.select(F.col(text).alias("t_")).where("t_ is not null").distinct().agg(F.count("*"), h(1), h(2)).first()
    return hashlib.sha256(json.dumps({"cache_key": name, "max_length": max_length, "model": model, "texts": [str(x) for x in sums]}, sort_keys=True).encode()).hexdigest()[:20]


def cached(folder: str, key: str, make: Callable[[], DataFrame], spark) -> DataFrame:
    """The table under a key in a folder, made and written if it is not there whole."""
    from verdigris.sources.records import path_of

    path = f"{folder.rstrip('/')}/{key}.parquet"
    p, fs = path_of(spark, f"{path}/_SUCCESS")
    if not fs.exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
