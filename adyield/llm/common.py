"""Shared helpers: bounded Arrow slices, vectorised word hashing, connected components.

Words are maximal runs of bytes outside ``0x20, 0x09-0x0D``; these byte
classes never occur inside a multi-byte UTF-8 sequence, so byte positions
split texts exactly as the code-point rule does.
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# Text bytes handled by one vectorised step; memory per step is about 60 times this.
SLICE_BYTES = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MULT = 0x9E3779B97F4A7C15 | 1
_LANE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) applied to whole arrays."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64, kept per worker up to the slice size."""
    if n > len(_POWERS.get("up", ())):
        size = max(n, SLICE_BYTES + SLICE_BYTES // 4)
        for key, m in (("up", _MULT), ("down", pow(_MULT, -1, 1 << 64))):
            steps = np.full(size, m, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


_MODEL: dict = {}


def worker_model(key, build):
    """A model built once per Python worker; the worker keeps one at a time, whichever operator asked last."""
    if key not in _MODEL:
        forget_model()
        _MODEL[key] = build()
    return _MODEL[key]


def forget_model() -> None:
    """Drop what an operator that ran before left in this worker."""
    _MODEL.clear()
    give_back()


def give_back() -> None:
    """Return freed memory to the system: Arrow's pool and the C heap keep it otherwise, in every idle worker."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):        # a C library without it
        pass


def _unspaced() -> np.ndarray:
    """By code point: 1 for letters of scripts written without blanks, 2 for marks and punctuation that follow them."""
    kind = np.zeros(0x40000, np.uint8)
    kind[0x20000:0x40000] = kind[0x3400:0x4DC0] = kind[0x4E00:0xA000] = kind[0xF900:0xFB00] = 1        # Han
    blocks = [(0x0E00, 0x10A0), (0x1780, 0x1800), (0x1950, 0x19E0), (0x1A20, 0x1AB0),     # Thai to Myanmar, Khmer, Tai
              (0x3000, 0x3130), (0x31A0, 0x3200), (0xA000, 0xA4D0), (0xA980, 0xAA00), (0xAA60, 0xAAE0),  # kana, Yi, Javanese
              (0xFF61, 0xFFA0)]
    for a, b in blocks:
        for c in range(a, b):
            kind[c] = 1 if unicodedata.category(chr(c))[0] in "LN" else 2
    for c in range(0xFF01, 0xFF61):
        if unicodedata.category(chr(c))[0] == "P":
            kind[c] = 2
    return kind


_UNSPACED = _unspaced()


class Words:
    """The words of several texts at once: byte span, text number and 64-bit hash of each.

    With ``unspaced``, each letter of a script written without blanks (with its marks) is a word, flagged in ``letter``.
    """

    def __init__(self, texts: list[str | None], fold: bool = True, unspaced: bool = False):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.raw = np.frombuffer(b" ".join([*raw, b""]) or b" ", np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
        space = _SPACE[self.raw]
        edge = np.concatenate([[True], space])
        self.starts = np.flatnonzero(~space & edge[:-1])
        self.ends = np.flatnonzero(space & ~edge[:-1])
        if len(self.ends) < len(self.starts):
            self.ends = np.append(self.ends, len(self.raw))
        if unspaced:
            self._letters()
        # self.first[i] : number of the first word of text i
        self.first = np.searchsorted(self.starts, self.offsets)
        self.text = np.repeat(np.arange(len(raw)), np.diff(self.first))
        folded = _FOLD[self.raw] if fold else self.raw
        if len(self.starts):
            up, down = _powers(len(self.raw))
            value = _BYTE[folded]
            value[space] = 0
            value *= up[: len(value)]
            self.hash = mix(np.add.reduceat(value, self.starts) * down[self.starts])
        else:
            self.hash = np.zeros(0, np.uint64)

    def _letters(self) -> None:
        """Further words: every letter of an unspaced script, and what follows its marks."""
        self.letter = np.zeros(len(self.starts), bool)
        lead = np.flatnonzero(self.raw >= 0xE0)
        if not len(lead):
            return
        b = [np.append(self.raw, np.zeros(3, np.uint8))[lead + j].astype(np.int64) & (0x3F if j else 0x0F) for j in range(4)]
        point = np.where(self.raw[lead] >= 0xF0, (b[0] & 7) << 18 | b[1] << 12 | b[2] << 6 | b[3], b[0] << 12 | b[1] << 6 | b[2])
        found = np.where(point < len(_UNSPACED), _UNSPACED[np.minimum(point, len(_UNSPACED) - 1)], 0)
        if not found.any():
            return
        kind = np.zeros(len(self.raw), np.uint8)
        kind[lead] = found
        chars = np.flatnonzero((self.raw & 0xC0) != 0x80)
        own = kind[chars]
        after = np.concatenate([[False], own[:-1] > 0])
        begins = np.zeros(len(self.raw), bool)
        begins[self.starts] = True
        begins[chars[(own == 1) | ((own == 0) & after & ~_SPACE[self.raw[chars]])]] = True
        self.starts = np.flatnonzero(begins)
        stop = self.ends[np.searchsorted(self.ends, self.starts, "right")]
        self.ends = np.minimum(stop, np.append(self.starts[1:], len(self.raw)))
        self.letter = kind[self.starts] == 1

    def windows(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on (within or across texts; callers mask the crossings)."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out += self.hash[j: j + n] * _LANE[j]
        return mix(out)


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of a short whole sequence, apart from every window hash by its length."""
    h = 0x1234567 + len(hashes) * int(_LANE[63])
    for j, x in enumerate(hashes):
        h += int(x) * int(_LANE[j % 31 + 32])
    return mix(np.array([h & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]


def shingle_sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text (A-Z lower-cased); fewer words: the whole sequence."""
    words = Words(texts)
    win = words.windows(k)
    out = []
    for i in range(len(texts)):
        a, b = words.first[i], words.first[i + 1]
        if b - a >= k:
            out.append(np.unique(win[a: b - k + 1]))
        elif b > a:
            out.append(np.array([sequence_hash(words.hash[a:b])], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that each piece holds about ``size`` text bytes (always at least one row)."""
    lengths = np.array([0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()],
                       np.int64)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > size:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n) + 1
    if start < batch.num_rows:
        yield batch.slice(start)
    give_back()


def row_key(*columns: str) -> Column:
    """A 128-bit key of a row's columns: equal rows get equal keys, null and empty differ."""
    parts = []
    for c in columns:
        text = F.col(c).cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text)))
    return F.unhex(F.md5(F.concat(*parts)))


def hash64(*columns) -> Column:
    return F.xxhash64(*columns)


def fold_of(doc_id, folds: int) -> Column:
    """``crc32(doc_id as text) mod folds``; a null id counts as empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(F.encode(text, "UTF-8")), F.lit(folds))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, bounds: dict[str, int]) -> DataFrame:
    """(text, ``label``): at most ``bound`` labelled documents of each condition on the label, smallest id hash first.

    One row per id, however often it occurs in either table: an id whose labels contradict each other is left out, and
    of several texts under one id the one with the smallest hash counts. Null ids and labels are left out.
    """
    ids = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
           .agg(F.min(label).alias(label), F.max(label).alias("_other")).filter(F.col(label) == F.col("_other")).drop("_other"))
    chosen = None
    for condition, bound in bounds.items():
        part = ids.filter(condition).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        chosen = part if chosen is None else chosen.union(part)
    # at most the sum of the bounds: pairs of numbers
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", label).agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", label)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges (a, b)``: ``(node, component)`` with the smallest node of each.

    Alternates large-star and small-star contraction, each an aggregation
    and a join of the edge list, until the list stands still; every
    step is written to the shared folder, so lineage stays one step
    long. A hub's partners are only reduced to their minimum or split between tasks.
    """
    edges = edges.select("a", "b").filter("a != b")
    current = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        state = current.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        if (state["n"], state["h"]) == before:
            break
        before = (state["n"], state["h"])
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join has a plain shuffle on either side and a hub's edges can be split
        low = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), name)
        large = (both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u != v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        current = cut_lineage(small, name)
    return current.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
