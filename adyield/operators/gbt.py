"""Default learner for one group's rows: boosted regression trees with exact splits.

Spark partitions and shuffles the groups; a learner only ever sees the rows of
one (channel, campaign_type) group, one per day. ``models.fit_boosted`` takes
any object with ``fit``, ``predict`` and ``MODEL`` (the Spark type that holds
a fitted model), so this module can be replaced where another learner is
installed. Squared loss, depth-limited trees, row subsampling; every distinct
value is a possible split, however many there are. Missing values take the
column's median. Standardising would not move any split, so it is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class BoostParams:
    """Hyper-parameters of the boosted models.

    ``max_bins`` and ``partition_rows`` concern the fallback model, which Spark ML fits: candidate splits per
    feature, and the rows of a partition. The row sampling follows the partitions; these follow from the table
    alone, not from the cluster, so a table gives the same model wherever it is fitted.
    """
    n_estimators: int = 200
    learning_rate: float = 0.05
    max_depth: int = 4
    min_samples_leaf: int = 5
    subsample: float = 0.8
    seed: int = 42
    max_bins: int = 256
    partition_rows: int = 10_000


# Spark type of a fitted model: start value, medians, and per tree its nodes (feature -1: a leaf).
MODEL = ("struct<start: double, rate: double, medians: array<double>, trees: array<struct<feature: array<int>, "
         "threshold: array<double>, left: array<int>, right: array<int>, value: array<double>>>>")


def best_split(x: np.ndarray, r: np.ndarray, min_leaf: int) -> tuple[int, float] | None:
    """The (feature, threshold) that lowers the squared error of ``r`` most, or None if none does.

    Ties go to the smaller feature number, then the smaller threshold.
    """
    m = len(r)
    if m < 2 * min_leaf:
        return None
    order = np.argsort(x, axis=0, kind="stable")
    values = np.take_along_axis(x, order, 0)
    left, total = np.cumsum(r[order], 0)[:-1], r.sum()
    n = np.arange(1, m)[:, None]
    gain = left ** 2 / n + (total - left) ** 2 / (m - n)
    gain[values[1:] == values[:-1]] = -np.inf
    gain[: min_leaf - 1] = gain[m - min_leaf:] = -np.inf
    j, i = divmod(int(np.argmax(gain.T)), m - 1)
    if not gain[i, j] > total ** 2 / m + 1e-12:
        return None
    low, high = values[i, j], values[i + 1, j]
    middle = low + (high - low) / 2
    return j, float(middle if middle < high else low)


def _tree(x: np.ndarray, r: np.ndarray, params: BoostParams) -> dict:
    tree = {"feature": [], "threshold": [], "left": [], "right": [], "value": []}

    def node(rows: np.ndarray, depth: int) -> int:
        k = len(tree["feature"])
        for name, v in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("value", float(r[rows].mean()))):
            tree[name].append(v)
        split = best_split(x[rows], r[rows], params.min_samples_leaf) if depth < params.max_depth else None
        if split:
            tree["feature"][k], tree["threshold"][k] = split
            below = x[rows, split[0]] <= split[1]
            tree["left"][k] = node(rows[below], depth + 1)
            tree["right"][k] = node(rows[~below], depth + 1)
        return k

    node(np.arange(len(r)), 0)
    return tree


def _values(tree: dict, x: np.ndarray) -> np.ndarray:
    feature, threshold, left, right, value = (np.asarray(tree[k]) for k in ("feature", "threshold", "left", "right", "value"))
    at = np.zeros(len(x), np.int64)
    while (inner := feature[at] >= 0).any():
        below = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
        at = np.where(inner, np.where(below, left[at], right[at]), at)
    return value[at]


def _filled(x: np.ndarray, medians) -> np.ndarray:
    return np.where(np.isnan(x), np.asarray(medians, float), x)


def fit(x: np.ndarray, y: np.ndarray, params: BoostParams = BoostParams()) -> dict:
    """Fit one group's rows (at least one row)."""
    known = [c[~np.isnan(c)] for c in x.T]
    medians = [float(np.median(c)) if len(c) else 0.0 for c in known]
    x = _filled(x, medians)
    rng, now, trees = np.random.RandomState(params.seed), np.full(len(y), y.mean()), []
    take = max(1, int(params.subsample * len(y)))
    for _ in range(params.n_estimators):
        rows = np.sort(rng.permutation(len(y))[:take])
        trees.append(_tree(x[rows], (y - now)[rows], params))
        now = now + params.learning_rate * _values(trees[-1], x)
    return {"start": float(y.mean()), "rate": params.learning_rate, "medians": medians, "trees": trees}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    x = _filled(x, model["medians"])
    return model["start"] + model["rate"] * sum((_values(t, x) for t in model["trees"]), np.zeros(len(x)))
