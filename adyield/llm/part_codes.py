"""Vector code compression: parts of vectors are coded by the nearest entry of a small integer codebook.

Components become ``floor(256 * x)``; vectors are cut into ``PARTS`` equal consecutive parts. A part position's codebook
starts as that part of the ``ENTRIES`` smallest ids and is moved to the floored mean of its parts in ``ROUNDS`` rounds;
unused entries stay. A round is one pass over the vectors: a task adds up counts and component sums per entry, so
``PARTS * ENTRIES`` rows a task are shuffled and one codebook's worth of numbers reaches the driver, whatever the table.

The nearest entry is found by a GNAT (geometric near-neighbour access tree) over each codebook. A node holds split points;
every other entry belongs to its nearest split point, and the node stores for each (split point, subtree) the range of
distances between them. A query measures its distance to the split points and leaves out every subtree whose range lies
strictly beyond the distance of the best entry so far. Roots are rounded down in lower and up in upper bounds, so that a
subtree which could hold an equally near entry is always entered; distances that decide are integers, ties go to the lower index.

Rows whose vector is null or holds null or non-finite components are dropped. The vectors' length is the commonest one that
``PARTS`` divides; vectors of another length keep their row with null code and error. Repeated rows count as often as they
occur; equal smallest ids are taken in the order of their vectors; null ids come last. Integers are exact, also beyond 64
bits within a distance; components are held at 2^60 either way, and sums that 64 bits cannot hold are null. Fewer rows
than entries make a smaller codebook; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import broadcast_if_small
from ..session import cut_lineage
from .common import worker_model

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LIMIT = 1 << 60              # largest magnitude of a component
PLAIN = 1 << 28              # below it, squared distances fit 64 bits
DEGREE = 8                   # split points of a node
LEAF = 6                     # entries of a node without split points
SLACK = 1e-9                 # relative widening of bounds: far above the error of a double's root


def usable():
    """Vectors that take part: not null, all components finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))


def integers(x: np.ndarray, scale: int, limit: int = LIMIT, plain: int = PLAIN) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or as Python's own where products of them would not fit."""
    with np.errstate(over="ignore"):
        v = np.clip(np.floor(scale * x.astype(np.float64)), -float(limit), float(limit))
    if not v.size or np.abs(v).max() < plain:
        return v.astype(np.int64)
    return np.array([int(e) for e in v.ravel()], object).reshape(v.shape)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix, without a Python object per component."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def squared(q: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances, queries by points."""
    out = np.zeros((len(q), len(points)), q.dtype if q.dtype == points.dtype else object)
    for c in range(q.shape[1]):
        gap = q[:, c, None] - points[None, :, c]
        out += gap * gap
    return out


def _down(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 - SLACK)


def _up(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 + SLACK)


class Gnat:
    """The tree over the entries of one codebook; ``measured`` counts the distances that queries asked for."""

    def __init__(self, points: np.ndarray):
        self.points, self.measured = points, 0
        self.root = self._node(np.arange(len(points)))

    def _node(self, ids: np.ndarray):
        if len(ids) <= LEAF:
            return ids, None, None, []
        splits = [0]                                   # the first entry, then always the entry farthest from all split points
        away = squared(self.points[ids], self.points[ids[:1]])[:, 0]
        while len(splits) < min(DEGREE, len(ids)):
            splits.append(int(np.argmax(away)))
            away = np.minimum(away, squared(self.points[ids], self.points[ids[splits[-1:]]])[:, 0])
        d2 = squared(self.points[ids], self.points[ids[splits]])
        owner = np.argmin(d2, 1)
        owner[splits] = -1
        low, high, children = np.zeros((len(splits),) * 2), np.zeros((len(splits),) * 2), []
        for j in range(len(splits)):
            mine = np.flatnonzero(owner == j)
            children.append(self._node(ids[mine]) if len(mine) else None)
            if len(mine):
                low[:, j], high[:, j] = _down(d2[mine].min(0)), _up(d2[mine].max(0))
        return ids[splits], low, high, children

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties: the lower index) and its squared distance, for each row of ``q``."""
        best = squared(q, self.points[:1])[:, 0]
        index = np.zeros(len(q), np.int64)
        self._search(self.root, q, np.arange(len(q)), best, index)
        return index, best

    def _search(self, node, q, rows, best, index) -> None:
        ids, low, high, children = node
        d2 = squared(q[rows], self.points[ids])
        self.measured += d2.size
        for i, entry in enumerate(ids):
            nearer = (d2[:, i] < best[rows]) | ((d2[:, i] == best[rows]) & (entry < index[rows]))
            best[rows[nearer]], index[rows[nearer]] = d2[nearer, i], entry
        if not children:
            return
        lower, upper, own = _down(d2), _up(d2), np.argmin(d2, 1)
        for first in (True, False):                    # the nearest split point's subtree first: it narrows the rest
            for j, child in enumerate(children):
                if child is None:
                    continue
                r = _up(best[rows])[:, None]
                far = ((lower - r > high[:, j]) | (upper + r < low[:, j])).any(1)
                to = np.flatnonzero(((own == j) == first) & ~far)
                if len(to):
                    self._search(child, q, rows[to], best, index)


def _trees(books: list[np.ndarray]) -> list[Gnat]:
    return worker_model(("part-codes", digest(books)), lambda: [Gnat(b) for b in books])


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()


def assign(books: list[np.ndarray], values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Entry indexes (rows by parts) and, per part, the squared distances."""
    width = values.shape[1] // len(books)
    found = [t.nearest(values[:, k * width: (k + 1) * width]) for k, t in enumerate(_trees(books))]
    return np.stack([i for i, _ in found], 1), [d for _, d in found]


def _moved(kept: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round."""
    entries, width = len(books[0]), books[0].shape[1]

    def run(batches):
        sums, counts = np.zeros((len(books) * entries, width), object), np.zeros(len(books) * entries, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = integers(matrix(batch.column("embedding")), SCALE)
            index, _ = assign(books, values)
            for k in range(len(books)):
                part = values[:, k * width: (k + 1) * width]
                order = np.argsort(index[:, k], kind="stable")
                used, first = np.unique(index[order, k], return_index=True)
                sums[k * entries + used] += np.add.reduceat(part[order], first, 0).astype(object)
                counts[k * entries + used] += np.diff(np.append(first, len(order)))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({
            "slot": pa.array(np.repeat(at, width) * width + np.tile(np.arange(width), len(at)), pa.int32()),
            "n": pa.array(np.repeat(counts[at], width), pa.int64()),
            "total": pa.array([Decimal(int(v)) for v in sums[at].ravel()], pa.decimal128(38, 0))})

    got = (kept.select("embedding").mapInArrow(run, "slot int, n long, total decimal(38, 0)")
           .groupBy("slot").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect())   # one row per component of an entry
    out = [b.astype(object) for b in books]
    for r in got:
        entry, at = divmod(r["slot"], width)
        out[entry // entries][entry % entries, at] = int(r["total"]) // r["n"]
    return [_narrow(b) for b in out]


def _narrow(book: np.ndarray) -> np.ndarray:
    """64-bit integers where the entries allow it."""
    return book.astype(np.int64) if not book.size or max(abs(int(v)) for v in book.ravel()) < PLAIN else book


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """One codebook (entries by components) per part; none if no vector can be cut into parts."""
    kept = vectors.filter(usable()).select("vec_id", "embedding")
    lengths = kept.groupBy(F.size("embedding").alias("n")).count().filter(f"n > 0 and n % {parts} = 0")
    length = lengths.orderBy(F.desc("count"), "n").limit(1).collect()
    if not length:
        return []
    kept = kept.filter(F.size("embedding") == length[0]["n"])
    # ``entries`` rows
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    values = integers(np.array([r["embedding"] for r in first], np.float64), SCALE)
    width = values.shape[1] // parts
    books = [_narrow(values[:, k * width: (k + 1) * width]) for k in range(parts)]
    for _ in range(rounds):
        books = _moved(kept, books)
    return books


def encode(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code and error of every vector that takes part."""
    kinds = dict(vectors.dtypes)
    length = len(books) * books[0].shape[1] if books else -1
    rows = vectors.filter(usable()).select("vec_id", "label", "embedding")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            index, distances = assign(books, integers(matrix(batch.column("embedding")), SCALE))
            error = [int(e) if e < 1 << 63 else None for e in sum(d.astype(object) for d in distances)]
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id"), "label": batch.column("label"),
                "code": pa.array([bytes(r).hex() for r in index.astype(np.uint8)], pa.string()),
                "error": pa.array(error, pa.int64())})

    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    other = rows.filter(F.size("embedding") != length).select(
        "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not books:
        return other
    return rows.filter(F.size("embedding") == length).mapInArrow(run, schema).union(other)


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (of all rows of equal label) and the digest of the final codebooks."""
    books = train(vectors)
    coded = cut_lineage(encode(vectors, books), "part-codes")
    sums = cut_lineage(coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
                       .withColumnRenamed("label", "of"), "part-code-labels")
    return coded.join(broadcast_if_small(sums), F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle() -> str:
    """The same codes in DuckDB SQL over ``embeddings`` (vectors of one length)."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""
assigned{k} AS MATERIALIZED (
  SELECT row, part, arg_min(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d, any_value(v) AS v
  FROM (SELECT p.row, p.part, p.v, b.entry,
               list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(p.v, b.v)]) AS d
        FROM parts p JOIN book{k} b USING (part)) GROUP BY 1, 2)""")
        if k < ROUNDS:
            steps.append(f"""
means{k} AS (
  SELECT part, entry, list(m ORDER BY pos) AS v FROM (
    SELECT part, entry, pos, CAST(floor_div AS BIGINT) AS m FROM (
      SELECT part, entry, pos, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div FROM (
        SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS pos FROM assigned{k}) GROUP BY 1, 2, 3)) GROUP BY 1, 2),
book{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN means{k} m USING (part, entry))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label,
         [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (
  SELECT row, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS v
  FROM kept, range({PARTS}) r(part)),
book0 AS (SELECT part, row - 1 AS entry, v FROM parts WHERE row <= {ENTRIES}),
{','.join(steps)},
coded AS (
  SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM assigned{ROUNDS} GROUP BY 1),
digest AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM (
    SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS pos FROM book{ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row), digest"""
