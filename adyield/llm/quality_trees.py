"""Quality rules: statistics of whole texts, base rules, and gradient-boosted trees scored as node arrays.

The trees are fitted on the statistics of a bounded sample of labelled rows
(``SAMPLE_ROWS``, by smallest hash of the id) with monotonic constraints on
chosen features, flattened into numpy node arrays and applied to every row,
one array step per tree level. Null texts have no words and fail the base.

Every row of ``documents`` is judged by itself, repeated ones too. An id is
learned from once, whatever its rows in either table; contradicting labels
leave it out. Values that lie on a bin's edge go left. Without labels of both
kinds the score is the base rate (1 without any); an empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, labelled_sample, slices

SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, MIN_LEAF, L2 = 60, 4, 32, 0.15, 20, 1.0
KEEP_AT = 0.5

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# Direction of the quality score in each feature: +1 rising, -1 falling, 0 free.
FEATURES = {"log_words": 0, "mean_word": 0, "symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1,
            "upper_rate": -1, "digit_rate": -1, "punct_rate": 0, "distinct_rate": 0, "bar_rate": -1,
            "words_per_line": 0, "stop_rate": 0}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[np.frombuffer(b".,;:!?'\"()", np.uint8)] = True


def _per_text(mask: np.ndarray, words: Words) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(mask)])
    return run[words.offsets[1:]] - run[words.offsets[:-1]]


def _marked_windows(words: Words, exact: Words, k: int) -> np.ndarray:
    """For each word: does it lie in a window of k words that its text holds at least twice?"""
    win = exact.windows(k)
    marked = np.zeros(len(exact.hash), bool)
    if not len(win):
        return marked
    inside = exact.text[: len(win)] == exact.text[k - 1:]
    at = np.flatnonzero(inside)
    order = at[np.lexsort((win[at], exact.text[at]))]
    same = (win[order][1:] == win[order][:-1]) & (exact.text[order][1:] == exact.text[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hits = order[twice]
    for j in range(k):
        marked[hits + j] = True
    return marked


def _dup_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line of the text."""
    if not text or "\n" not in text:
        return 0
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    return dup


def statistics(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(base counts, features), one row per text; whole texts, exact counts."""
    w = Words(texts, fold=False)
    n = np.diff(w.first)
    starts_cp = _per_text(((w.raw & 0xC0) != 0x80) & ~_space(w), w)
    symbols = _per_text(_SYMBOL[w.raw], w)
    dup = np.array([_dup_lines(t) for t in texts], np.int64)
    lines = np.array([(t or "").count("\n") + 1 for t in texts], np.int64)
    marked = np.concatenate([[0], np.cumsum(_marked_windows(w, w, 3))])
    repeat = marked[w.first[1:]] - marked[w.first[:-1]]
    base = np.stack([n, starts_cp, symbols, dup, repeat], 1).astype(np.int64)
    one, chars = np.maximum(n, 1), np.maximum(starts_cp, 1)
    distinct = np.zeros(len(texts))
    if len(w.hash):
        order = np.lexsort((w.hash, w.text))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (w.text[order][1:] != w.text[order][:-1])
        distinct = np.bincount(w.text[order][fresh], minlength=len(texts)).astype(float)
    short = np.bincount(w.text[(w.ends - w.starts) <= 3], minlength=len(texts)).astype(float)
    x = np.stack([np.log1p(n), starts_cp / one, symbols / chars, dup / lines, repeat / one,
                  _per_text(_UPPER[w.raw], w) / chars, _per_text(_DIGIT[w.raw], w) / chars,
                  _per_text(_PUNCT[w.raw], w) / chars, distinct / one, _per_text(w.raw == 124, w) / one,
                  n / lines, short / one], 1)
    return base, x


def _space(w: Words) -> np.ndarray:
    from .common import _SPACE
    return _SPACE[w.raw]


# ------------------------------------------------------------------ boosted trees

class Trees:
    """Flattened trees: for each node its feature (-1: leaf), threshold, left child (right is next) and value."""

    def __init__(self, bias: float):
        self.bias, self.roots = bias, []
        self.feature, self.threshold, self.left, self.value = [], [], [], []

    def freeze(self) -> "Trees":
        self.feature, self.left = np.array(self.feature, np.int32), np.array(self.left, np.int32)
        self.threshold, self.value = np.array(self.threshold), np.array(self.value)
        return self

    def margin(self, x: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(depth):
                f = self.feature[node]
                right = x[rows, np.maximum(f, 0)] > self.threshold[node]
                node = np.where(f < 0, node, self.left[node] + right)
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Newton boosting of the logistic loss on quantile bins; splits that would break a sign are not taken,
    and both sides of a constrained split pass their middle value down as a bound."""
    rate = np.clip(y.mean() if len(y) else 1.0, 0.01, 0.99)
    model = Trees(float(np.log(rate / (1 - rate))))
    if len(y) < 2 * MIN_LEAF or y.min() == y.max():
        return model.freeze()
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    margin = np.full(len(y), model.bias)

    def leaf(g, h, low, high):
        return float(np.clip(-g / (h + L2), low, high))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        model.roots.append(len(model.feature))
        model.feature.append(-1), model.threshold.append(0.0), model.left.append(0), model.value.append(0.0)
        todo = [(len(model.feature) - 1, np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            node, rows, level, low, high = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value = leaf(gs, hs, low, high)
            best = (1e-6, -1, 0, 0.0, 0.0)
            if level < depth and len(rows) >= 2 * MIN_LEAF:
                whole = gs * gs / (hs + L2)
                for f, cut in enumerate(cuts):
                    if not len(cut):
                        continue
                    b = bins[rows, f]
                    gl = np.cumsum(np.bincount(b, g[rows], len(cut) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], len(cut) + 1))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=len(cut) + 1))[:-1]
                    gain = gl ** 2 / (hl + L2) + (gs - gl) ** 2 / (hs - hl + L2) - whole
                    vl, vr = np.clip(-gl / (hl + L2), low, high), np.clip(-(gs - gl) / (hs - hl + L2), low, high)
                    gain[(nl < MIN_LEAF) | (len(rows) - nl < MIN_LEAF) | (signs[f] * (vr - vl) < 0)] = -1
                    j = int(np.argmax(gain))
                    if gain[j] > best[0]:
                        best = (gain[j], f, j, float(vl[j]), float(vr[j]))
            _, f, j, vl, vr = best
            if f < 0:
                model.value[node] = RATE * value
                margin[rows] += RATE * value
                continue
            model.feature[node], model.threshold[node], model.left[node] = f, float(cuts[f][j]), len(model.feature)
            for _side in range(2):
                model.feature.append(-1), model.threshold.append(0.0), model.left.append(0), model.value.append(0.0)
            mid, go = (vl + vr) / 2, bins[rows, f] > j
            left_low, left_high, right_low, right_high = low, high, low, high
            if signs[f] > 0:
                left_high, right_low = mid, mid
            elif signs[f] < 0:
                left_low, right_high = mid, mid
            todo.append((model.left[node], rows[~go], level + 1, left_low, left_high))
            todo.append((model.left[node] + 1, rows[go], level + 1, right_low, right_high))
    return model.freeze()


# ------------------------------------------------------------------ Spark side

def training_rows(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``rows`` labelled documents (smallest id hash first), one per id."""
    sample = labelled_sample(documents, labels.select("doc_id", F.col("quality").cast("int")), "quality", {"true": rows})

    def features(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                _, x = statistics(part.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({"x": x.tolist(), "quality": part.column("quality")})

    # at most ``rows`` rows of a dozen numbers
    got = sample.mapInArrow(features, "x array<double>, quality int").toPandas()
    got = got.sort_values(["quality", "x"], key=lambda s: s if s.name == "quality" else s.map(tuple))
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    return x, got["quality"].to_numpy(float)


def judge(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, keep_at: float = KEEP_AT) -> DataFrame:
    """One row per document: the base counts, base_failed, the model's probability and kept."""
    model = fit_trees(*training_rows(documents, labels, rows), list(FEATURES.values()))

    def score(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                base, x = statistics(part.column("text").to_pylist())
                failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
                p = model.probability(x)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part.column("doc_id")} | {c: pa.array(base[:, i]) for i, c in enumerate(BASE)}
                    | {"base_failed": pa.array(failed), "quality_score": pa.array(p),
                       "kept": pa.array(~failed & (p >= keep_at))})

    kind = dict(documents.dtypes)["doc_id"]
    schema = (f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in BASE)
              + ", base_failed boolean, quality_score double, kept boolean")
    return documents.select("doc_id", "text").mapInArrow(score, schema)
