"""A grid of small classifiers, each fitted by numpy in a task of its own: boosted trees, forests, logistic regression.

Rows are a bounded sample (`most`, the smallest hashes of their keys), scaled by the mean and deviation of the training
part; trees see their columns cut into BINS quantile bins. The best models' chances are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 32
LEAST = 1e-6


def grid() -> list[dict]:
    """108 boosted, 36 forest and 20 logistic settings."""
    boosted = [{"model": "gbm", "trees": n, "depth": d, "rate": r, "share": s} for n, d, r, s in product((50, 100, 200, 300), (2, 3, 4), (0.05, 0.1, 0.15), (0.7, 0.9, 1.0))]
    forests = [{"model": "rf", "trees": n, "columns": c, "depth": d} for n, c, d in product((100, 200, 300, 500), ("sqrt", "log2", None), (None, 5, 10))]
    logistic = [{"model": "logreg", "c": c, "penalty": p, "solver": s} for c, p, s in product((0.01, 0.1, 1.0, 10.0, 100.0), ("l1", "l2"), ("full", "sampled"))]
    return [*boosted, *forests, *logistic]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)


def grow(bins: np.ndarray, slope: np.ndarray, curve: np.ndarray, depth: int | None, columns: int, rng: np.random.Generator, ridge: float = 1.0, least: int = 1) -> dict[str, np.ndarray]:
    """A tree by levels: all nodes of a level choose the split of largest gain among `columns` random columns at once."""
    n, d = bins.shape
    node, tree = np.zeros(n, np.int64), {"column": [], "bin": [], "left": [], "value": []}
    first, count, level = 0, 1, 0
    rows = np.arange(n)
    while count:
        here = node[rows] - first
        g, h = np.bincount(here, slope[rows], count), np.bincount(here, curve[rows], count)
        best, at, cut = np.zeros(count), np.full(count, -1), np.zeros(count, np.int64)
        if depth is None or level < depth:
            allowed = rng.random((count, d)).argsort(1) < columns
            for k in range(d):
                place = here * BINS + bins[rows, k]
                gl = np.bincount(place, slope[rows], count * BINS).reshape(count, BINS).cumsum(1)[:, :-1]
                hl = np.bincount(place, curve[rows], count * BINS).reshape(count, BINS).cumsum(1)[:, :-1]
                nl = np.bincount(place, minlength=count * BINS).reshape(count, BINS).cumsum(1)
                gain = gl**2 / (hl + ridge) + (g[:, None] - gl) ** 2 / (h[:, None] - hl + ridge) - (g**2 / (h + ridge))[:, None]
                gain[(nl[:, :-1] < least) | (nl[:, -1:] - nl[:, :-1] < least) | ~allowed[:, k : k + 1]] = 0
                top = gain.argmax(1)
                value = gain[np.arange(count), top]
                better = value > best + 1e-12
                best[better], at[better], cut[better] = value[better], k, top[better]
        split = at >= 0
        child = first + count + 2 * (np.cumsum(split) - 1)
        tree["column"].append(at)
        tree["bin"].append(cut)
        tree["left"].append(np.where(split, child, -1))
        tree["value"].append(-g / (h + ridge))
        rows = rows[split[here]]
        here = node[rows] - first
        node[rows] = child[here] + (bins[rows, at[here]] > cut[here])
        first, count, level = first + count, 2 * int(split.sum()), level + 1
    return {k: np.concatenate(v) for k, v in tree.items()}


def leaves(tree: dict[str, np.ndarray], bins: np.ndarray) -> np.ndarray:
    node = np.zeros(len(bins), np.int64)
    while (inner := np.flatnonzero(tree["left"][node] >= 0)).size:
        at = node[inner]
        node[inner] = tree["left"][at] + (bins[inner, tree["column"][at]] > tree["bin"][at])
    return tree["value"][node]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_predict(setting: dict, x: np.ndarray, y: np.ndarray, to: np.ndarray, seed: int = 42) -> np.ndarray:
    """The chances of label 1 that a model of this setting, fitted on (x, y), gives the rows `to`."""
    rng, n, d = np.random.default_rng(seed), len(x), x.shape[1]
    if not n or y.min() == y.max():
        return np.full(len(to), float(y.mean()) if n else 0.5)
    if setting["model"] == "logreg":
        weights, bias, pull = np.zeros(d), 0.0, 1 / (setting["c"] * n)
        steps = 300 if setting["solver"] == "full" else 100
        for step in range(steps):
            some = np.arange(n) if setting["solver"] == "full" else rng.integers(0, n, min(n, 512))
            off = _sigmoid(x[some] @ weights + bias) - y[some]
            rate = 1.0 / (1 + 0.01 * step)
            weights, bias = weights - rate * x[some].T @ off / len(some), bias - rate * off.mean()
            weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * pull, 0) if setting["penalty"] == "l1" else weights / (1 + rate * pull)
        return _sigmoid(to @ weights + bias)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS)[1:-1])) for k in range(d)]
    own, other = binned(x, edges), binned(to, edges)
    if setting["model"] == "gbm":
        base = float(np.log(y.mean() / (1 - y.mean())))
        now, out = np.full(n, base), np.full(len(to), base)
        for _ in range(setting["trees"]):
            some = np.flatnonzero(rng.random(n) < setting["share"])
            p = _sigmoid(now)
            tree = grow(own[some], (p - y)[some], (p * (1 - p))[some], setting["depth"], d, rng)
            now, out = now + setting["rate"] * leaves(tree, own), out + setting["rate"] * leaves(tree, other)
        return _sigmoid(out)
    columns = {"sqrt": max(1, int(d**0.5)), "log2": max(1, int(np.log2(d))), None: d}[setting["columns"]]
    total = np.zeros(len(to))
    for _ in range(setting["trees"]):
        some = rng.integers(0, n, n)
        total += leaves(grow(own[some], -y[some].astype(float), np.ones(n), setting["depth"], columns, rng, ridge=0.0 + 1e-9), other)
    return np.clip(total / setting["trees"], 0, 1)


def sample(rows: DataFrame, key: str, columns: Sequence[str], label: str, where: Column, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, columns and 0/1 labels of at most `most` rows, those with the smallest hashes of their keys."""
    own = rows.where(where).select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], F.col(label).cast("int").alias("label")).dropna()
    got = own.orderBy(F.xxhash64("key"), "key").limit(most).toPandas()
    return got["key"].to_numpy(), got[[f"x{i}" for i in range(len(columns))]].to_numpy(np.float64), got["label"].to_numpy(np.int64)


def run_grid(rows: DataFrame, key: str, columns: Sequence[str], label: str, hold_out: Column, settings: list[dict] | None = None, most: int = 1500, best: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Two tables: config, model, setting, log_loss on the hold-out sample; and key, label, p, the mean chance of the `best` models.

    Chances are kept LEAST off 0 and 1 for the loss. At most `most` rows of either part reach the driver and the tasks."""
    settings = grid() if settings is None else settings
    _, x, y = sample(rows, key, columns, label, ~hold_out, most)
    names, to, want = sample(rows, key, columns, label, hold_out, most)
    mean, spread = (x.mean(0), np.maximum(x.std(0), 1e-12)) if len(x) else (0.0, 1.0)
    x, to = (x - mean) / spread, (to - mean) / spread
    spark = rows.sparkSession

    def fit(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            for k in page["id"]:
                p = fit_predict(settings[k], x, y, to, seed)
                q = np.clip(p, LEAST, 1 - LEAST)
                loss = float(-np.where(want == 1, np.log(q), np.log(1 - q)).mean()) if len(want) else None
                yield pd.DataFrame({"config": [k], "model": [settings[k]["model"]], "setting": [str(settings[k])], "log_loss": [loss], "p": [p]})

    tasks = spark.range(len(settings)).repartition(max(1, min(len(settings), 4 * spark.sparkContext.defaultParallelism)))
    found = tasks.mapInPandas(fit, "config long, model string, setting string, log_loss double, p array<double>")
    got = found.toPandas().sort_values(["log_loss", "config"])  # a row a setting, `most` chances each
    top = np.mean(list(got["p"][:best]), axis=0) if len(names) else []
    kind = rows.schema[key].dataType.simpleString()
    ensemble = spark.createDataFrame([(k.item() if hasattr(k, "item") else k, int(v), float(p)) for k, v, p in zip(names, want, top, strict=True)], f"{key} {kind}, label int, p double")
    return spark.createDataFrame(list(got[["config", "model", "setting", "log_loss"]].itertuples(index=False, name=None)), "config long, model string, setting string, log_loss double"), ensemble
