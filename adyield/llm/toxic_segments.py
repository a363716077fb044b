"""Toxicity by maximum-scoring segments.

Words back off to prefixes (``STEMS`` letters, or the whole word); the longest
form with support counts. An occurrence counts once per distinct pair of
neighbouring words, so copies of a text count once. A form is toxic if its
counts in toxic and clean labelled texts differ significantly (G test); its
score is the log-odds with a Dirichlet prior of the pooled frequencies. Every
other word costs a little, so that the expected score of clean text is
negative. A linear scan finds all maximal scoring segments of a whole text.
By extreme-value theory a text of n words holds ``K n exp(-lambda S)``
segments of score S or more by chance: lambda solves the moment equation over
clean word frequencies and K is counted on clean texts. The best segment and
the sum over all significant ones are calibrated to a probability by a
logistic fit.

Lexicon, K and calibration are learned from at most ``SAMPLE_TOXIC`` and
``SAMPLE_CLEAN`` labelled documents (smallest id hash first). An id is learned
from once, whatever its rows in either table; contradicting labels leave it out.
Segments that chance explains (expected number above ``MOST_CHANCE`` in a text
of that length) are not listed. Null and empty texts have no segments; without
both labels every score is the base rate. Repeated rows are scored one by one;
an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fold_of, labelled_sample, slices

SAMPLE_TOXIC, SAMPLE_CLEAN = 2_500, 7_500
STEMS = (4, 5, 6)
SUPPORT = 2                  # least occurrences of a form that decides
LEAST_G = 18.0               # least G statistic of a toxic form
LEAST_ODDS = 2.0             # least log-odds of a toxic form
PRIOR = 0.01                 # pseudo-counts of the Dirichlet prior, as a share of all occurrences
PASSAGE_RATE = 0.1           # share of toxic words that a passage keeps up its score with
MOST_CHANCE = 0.05           # E-value up to which a segment is significant
NULL_FROM = 3.0              # clean segments from this score on are counted for K
_WORD = re.compile(r"[^\W\d_]+")


def forms(word: str) -> list[str]:
    """The word (marked by a final blank) and its prefixes, longest first."""
    return [word + " ", *(word[:k] for k in reversed(STEMS) if len(word) >= k)]


def segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a text.

    ``scores`` lists the positive words (place, score); all other words score ``drift`` < 0. Ruzzo and
    Tompa's linear-time scan: a stack of candidate segments with running sums on either side.
    """
    stack: list[tuple[float, float, int, int]] = []      # sum before, sum after, first, last
    total, place = 0.0, 0
    for at, score in scores:
        total += drift * (at - place)
        left, right, first = total, total + score, at
        while stack:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] >= left:
                k -= 1
            if k < 0 or stack[k][1] >= right:
                break
            left, first = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append((left, right, first, at))
        total, place = right, at + 1
    return [(a, b, r - l) for l, r, a, b in stack]


class Scorer:
    """A lexicon with its calibration: ``weights`` maps forms to scores (0: a form that stops the back-off)."""

    def __init__(self, weights: dict[str, float], scale: float, k: float = 1e-4, fit=(0.0, 0.0, 0.0)):
        self.weights, self.scale, self.k, self.fit = weights, scale, k, tuple(fit)
        self.drift = float(np.log(1 - PASSAGE_RATE))
        self.short = STEMS[0]
        self.entry = {f.strip()[: self.short] for f, w in weights.items() if w > 0}

    def weight(self, word: str) -> float:
        for f in forms(word):
            if f in self.weights:
                return self.weights[f]
        return 0.0

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        words, short, entry = _WORD.findall((text or "").lower()), self.short, self.entry
        hits = [(i, s) for i, w in enumerate(words) if w[:short] in entry and (s := self.weight(w)) > 0]
        return len(words), segments(hits, self.drift) if hits else []

    def evidence(self, n: int, found) -> tuple[float, float]:
        """Best and summed surprise, -ln E of the segments that chance does not explain."""
        parts = [max(0.0, self.scale * s - np.log(self.k * max(n, 1))) for _, _, s in found]
        return (max(parts), sum(parts)) if parts else (0.0, 0.0)

    def significant(self, n: int, found) -> list[tuple[int, int, float]]:
        """Segments of which chance would show at most ``MOST_CHANCE`` in a text of n words."""
        return [f for f in found if self.k * max(n, 1) * np.exp(-self.scale * f[2]) <= MOST_CHANCE]

    def probability(self, n: int, found) -> float:
        best, total = self.evidence(n, found)
        z = self.fit[0] + self.fit[1] * best + self.fit[2] * np.log1p(total)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _count(sample: DataFrame) -> DataFrame:
    """(form, toxic, clean): distinct contexts of every form in the sample's texts of either label."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                seen = set()
                for text, label in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                    words = ["", *_WORD.findall((text or "").lower()), ""]
                    seen.update(zip(words[1:-1], map(" ".join, zip(words[:-2], words[2:])), [label] * len(words)))
                rows = list(zip(*seen)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()),
                                                  pa.array(rows[2], pa.int32())], names=["word", "context", "toxic"])

    found = sample.mapInArrow(run, "word string, context string, toxic int")
    words = (found.select("word", F.xxhash64("context").alias("context"), "toxic").distinct().groupBy("word")
             .agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")))
    stems = [F.when(F.length("word") >= k, F.substring("word", 1, k)) for k in STEMS]
    return (words.select(F.explode(F.array(F.concat("word", F.lit(" ")), *stems)).alias("form"), "toxic", "clean")
            .filter("form is not null").groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def _g(observed, expected):
    return F.when(observed > 0, 2 * observed * F.log(observed / expected)).otherwise(0.0)


def lexicon(sample: DataFrame) -> tuple[dict[str, float], float]:
    """Scores of the toxic forms (0: forms that stop the back-off) and lambda."""
    counts = _count(sample).persist()
    try:
        whole = counts.filter(F.col("form").endswith(" ")).agg(F.sum("clean"), F.sum("toxic")).first()
        n_clean, n_toxic = float(whole[0] or 0), float(whole[1] or 0)
        if not n_clean or not n_toxic:
            return {}, 1.0
        every, t, c = n_clean + n_toxic, F.col("toxic"), F.col("clean")
        prior = PRIOR * (t + c)
        odds = (F.log((t + prior) / (n_toxic + PRIOR * every - t - prior))
                - F.log((c + prior) / (n_clean + PRIOR * every - c - prior)))
        g = _g(t, (t + c) * (n_toxic / every)) + _g(c, (t + c) * (n_clean / every))
        judged = counts.filter(t + c >= SUPPORT).withColumn("odds", odds)
        judged = judged.withColumn("counts", (g >= LEAST_G) & (F.col("odds") >= LEAST_ODDS))
        # bounded by the sample: the toxic forms, then the supported forms that begin like them
        good = judged.filter("counts").collect()
        entry = sorted({r["form"].strip()[: STEMS[0]] for r in good})
        heads = F.broadcast(sample.sparkSession.createDataFrame([(e,) for e in entry], "entry string"))
        stops = judged.filter("not counts and clean > 0").join(
            heads, F.substring(F.trim("form"), 1, STEMS[0]) == F.col("entry"), "left_semi").select("form").collect()
    finally:
        counts.unpersist()
    weights = {r["form"]: 0.0 for r in stops} | {r["form"]: float(r["odds"]) for r in good}
    words = [r for r in good if r["form"].endswith(" ")]
    return weights, _scale(np.array([r["odds"] for r in words]),
                           np.array([(r["clean"] + PRIOR * (r["toxic"] + r["clean"])) / n_clean for r in words]))


def _scale(scores: np.ndarray, rates: np.ndarray) -> float:
    """The positive root of the moment equation sum(rate * exp(lambda * score)) = 1 over clean words."""
    if not len(scores):
        return 1.0
    drift, rest = float(np.log(1 - PASSAGE_RATE)), max(0.0, 1 - rates.sum())
    low, high = 1e-3, 10.0
    for _ in range(60):
        mid = (low + high) / 2
        over = (rates * np.exp(np.minimum(mid * scores, 500))).sum() + rest * np.exp(mid * drift) > 1
        low, high = (low, mid) if over else (mid, high)
    return float(min(low, 5.0))


def fit(documents: DataFrame, labels: DataFrame, learn: Column) -> Scorer:
    """Learn from labelled rows that ``learn`` (over ``doc_id``) admits."""
    rows = labels.filter(learn & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int"))
    # written: a bounded table that the counts and the calibration read
    sample = cut_lineage(labelled_sample(documents, rows, "toxic", {"toxic = 1": SAMPLE_TOXIC, "toxic = 0": SAMPLE_CLEAN}),
                         "toxic-sample")
    scorer = Scorer(*lexicon(sample))

    def scan(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = [scorer.scan(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({
                    "n": pa.array([n for n, _ in found], pa.int64()),
                    "scores": pa.array([[s for _, _, s in f] for _, f in found], pa.list_(pa.float64())),
                    "toxic": part.column("toxic")})

    got = sample.mapInArrow(scan, "n long, scores array<double>, toxic int").collect()
    y = np.array([r["toxic"] for r in got], float)
    clean = [r for r in got if not r["toxic"]]
    seen = sum(s >= NULL_FROM for r in clean for s in r["scores"])
    scorer.k = float(min(1.0, (seen + 0.5) * np.exp(scorer.scale * NULL_FROM) / (sum(r["n"] for r in clean) + 1)))
    if len(y) and 0 < y.mean() < 1:
        x = np.array([scorer.evidence(r["n"], [(0, 0, s) for s in r["scores"]]) for r in got])
        scorer.fit = tuple(_logistic(np.column_stack([x[:, 0], np.log1p(x[:, 1])]), y))
    else:
        rate = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
        scorer.fit = (float(np.log(rate / (1 - rate))), 0.0, 0.0)
    return scorer


def passages(documents: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score and the significant toxic segments (first word, last word, score) of every whole text."""
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = [scorer.scan(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"),
                    "score": pa.array([scorer.probability(n, f) for n, f in found], pa.float64()),
                    "segments": pa.array([[{"first": a, "last": b, "score": s} for a, b, s in scorer.significant(n, f)] for n, f in found],
                                         pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])))})

    return documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, score double, segments array<struct<first: long, last: long, score: double>>")


def predict(documents: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Contract form: learn outside the held-out fold, score every document."""
    scored = passages(documents, fit(documents, labels, fold_of("doc_id", folds) != held))
    return scored.select("doc_id", (fold_of("doc_id", folds) == held).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("segments").alias("n_segments"))
