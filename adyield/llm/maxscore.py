"""Exact top-k search by inner product with MaxScore.

Components become ``floor(64 * x)``. A term is a vector position; its posting list in a block of candidates holds those with
a component other than 0 there (a term that most of them hold is kept as a whole column). A term's bound for a query is the
largest product that any of the block's candidates can add, at least 0. Terms are put in the order of their bounds; the
longest run of small ones whose bounds together stay below the query's k-th best score is non-essential: a candidate in
none of the other postings cannot be competitive. So only essential postings are traversed, and of the candidates met
there only those are probed at the other terms, largest bound first, whose score so far plus the bounds left still reaches the
k-th best score. Equal scores stay in, since the smaller id may win.

Candidates are dealt to shards of about ``SHARD`` rows, queries to tiles of about ``TILE``; a task searches one shard for one
tile, block by block in the order of ids, and returns at most k rows a query. Shards are merged by a limited window. The first
shard is searched first, and its k-th scores are where the other shards begin. Neither queries nor candidates are ever
gathered in one place, and repeated vectors or ids spread over all shards.

Vectors that are null or hold null or non-finite components take no part, neither as queries nor as candidates; only
vectors of equal length are compared (empty ones score 0). Ties go to the smaller id, null ids last. A null id is no query.
A query's own row, and any row that repeats its id, is no candidate of it; repeated query rows return their
results once each. Scores are exact: 64-bit floats while all products stay below 2^53, else Python's integers (a score beyond 64
bits is returned as the nearest one that fits; components are held at 2^56 either way). An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import forget_model
from .part_codes import integers, matrix, usable

SCALE = 64
LIMIT = 1 << 56              # largest magnitude of a component
TOP = 20
EVERY = 20                   # a vector whose id it divides is a query
SHARD = 8_192                # candidates of a shard
BLOCK = 4_096                # candidates whose bounds are taken together
TILE = 1_024                 # queries searched by one task
FEW = 64                     # this few candidates are scored outright
EXACT = float(1 << 53)


class Postings:
    """The inverted lists of a block of candidates, given as a matrix in the order of ids."""

    def __init__(self, values: np.ndarray):
        self.values, n = values, len(values)
        self.columns = np.ascontiguousarray(values.T)
        held = self.columns != 0
        # per term: None if most candidates hold it, else the candidates that do
        self.lists = [None if 2 * h.sum() > n else np.flatnonzero(h) for h in held]
        self.low, self.high = self.columns.min(1), self.columns.max(1)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The most that a term can add to a query's score, queries by terms."""
        return np.maximum(np.maximum(queries * self.low, queries * self.high), 0)

    def search(self, query: np.ndarray, order: np.ndarray, bound: np.ndarray, rest: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all candidates whose score reaches ``floor`` (a few that do not may be among them).

        ``order``: terms by ascending bound, the first ``rest`` of them non-essential; ``bound``: their running sums.
        """
        score = np.zeros(len(self.values), self.values.dtype)
        met = np.full(len(score), floor <= 0)          # a score of 0 is competitive: so is a candidate in no list
        for t in order[rest:]:
            weight, docs = query[t], self.lists[t]
            if docs is None:
                score += weight * self.columns[t]
                met[:] = True
            else:
                score[docs] += weight * self.columns[t][docs]
                met[docs] = True
        left = bound[rest - 1] if rest else 0
        docs = np.flatnonzero(met & (score + left >= floor))
        score = score[docs]
        for k in range(rest - 1, -1, -1):
            if len(docs) <= FEW:
                return docs, score + self.values[np.ix_(docs, order[: k + 1])] @ query[order[: k + 1]]
            score = score + query[order[k]] * self.columns[order[k]][docs]
            competitive = score + (bound[k - 1] if k else 0) >= floor
            docs, score = docs[competitive], score[competitive]
        return docs, score


def search_shard(queries: np.ndarray, own: list[tuple[int, int]], floors: np.ndarray, values: np.ndarray, k: int):
    """Per query: places and scores of its k best candidates of a shard, best first, ties to the earlier place.

    ``own``: the run of places that is no candidate of the query; ``floors``: scores known to be reached by k others.
    """
    top = [(np.zeros(0, np.int64), np.zeros(0, values.dtype))] * len(queries)
    floors = floors.copy()
    for start in range(0, len(values), BLOCK):
        block = Postings(values[start: start + BLOCK])
        bounds = block.bounds(queries)
        orders = np.argsort(bounds.astype(np.float64), 1, kind="stable")
        sums = np.cumsum(np.take_along_axis(bounds, orders, 1), 1)
        rest = (sums < floors[:, None]).sum(1)
        for i in np.flatnonzero(rest < max(1, queries.shape[1])):
            docs, score = block.search(queries[i], orders[i], sums[i], int(rest[i]), floors[i])
            docs = docs + start
            a, b = own[i]
            outside = (docs < a) | (docs >= b)
            docs, score = docs[outside], score[outside]
            if not len(docs):
                continue
            docs, score = np.concatenate([top[i][0], docs]), np.concatenate([top[i][1], score])
            if len(docs) > 4 * k:                      # a cheap cut before the sort: all that reach the k-th score
                reach = score >= np.partition(score, len(score) - k)[len(score) - k]
                docs, score = docs[reach], score[reach]
            best = np.lexsort((docs, -score))[:k] if score.dtype != object else np.array(
                sorted(range(len(docs)), key=lambda j: (-score[j], docs[j]))[:k])
            top[i] = docs[best], score[best]
            if len(best) == k:
                floors[i] = max(floors[i], top[i][1][-1])
    return top


def _packed(rows: DataFrame, by: Column, name: str, extra: list[str]) -> DataFrame:
    """One row per group number and vector length: its ids (in order), vectors and further columns as lists."""
    kinds = dict(rows.dtypes)

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("vec_id", "ascending")])             # nulls last
        out: dict[str, list] = {c: [] for c in ["part", "dim", "vec_id", *extra, "vectors"]}
        lengths = pa.compute.list_value_length(group.column("embedding")).to_numpy()
        for dim in np.unique(lengths):
            mine = group.filter(pa.array(lengths == dim))
            out["part"].append(mine.column("part")[0].as_py())
            out["dim"].append(int(dim))
            out["vectors"].append(matrix(mine.column("embedding").combine_chunks()).astype("<f8").tobytes())
            for c in ["vec_id", *extra]:
                out[c].append(mine.column(c).to_pylist())
        types = {"part": pa.int64(), "dim": pa.int32(), "vectors": pa.binary(), "vec_id": pa.list_(group.schema.field("vec_id").type)}
        types |= {c: pa.list_(group.schema.field(c).type) for c in extra}
        return pa.table({c: pa.array(v, types[c]) for c, v in out.items()})

    schema = ", ".join(["part long", "dim int", f"vec_id array<{kinds['vec_id']}>", *[f"{c} array<{kinds[c]}>" for c in extra],
                        "vectors binary"])
    dealt = rows.withColumn("part", by)
    # a group is about SHARD or TILE rows
    return cut_lineage(dealt.groupBy("part").applyInArrow(pack, schema), name)


def _search(tiles: DataFrame, shards: DataFrame, first: int, last: int, n_tiles: int, k: int, kind: str) -> DataFrame:
    """(row, query_id, vec_id, score, at): the k best of every query in each of the shards first..last."""
    numbers = lambda a, b: F.explode(F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long")))
    # the stated query set against all rows, tile by shard
    left = tiles.withColumn("shard", numbers(first, last)).withColumnsRenamed(
        {"part": "tile", "vec_id": "query_ids", "vectors": "queries"})
    right = shards.filter(F.col("part").between(first, last)).withColumn("tile", numbers(0, n_tiles - 1)).withColumnRenamed("part", "shard")
    pairs = left.join(right, ["tile", "shard", "dim"]).select("dim", "row", "floor", "query_ids", "queries", "vec_id", "vectors")

    def run(batches):
        forget_model()
        for batch in batches:
            for n in range(batch.num_rows):
                g = lambda c: batch.column(c)[n]  # noqa: E731, B023
                dim, ids, query_ids = g("dim").as_py(), g("vec_id").values, g("query_ids").values
                values, queries = (integers(np.frombuffer(g(c).as_py(), "<f8").reshape(size, dim), SCALE, LIMIT, plain=1 << 57)
                                   for c, size in (("vectors", len(ids)), ("queries", len(query_ids))))
                floors = np.array([-np.inf if f is None else f for f in g("floor").as_py()])
                largest = [float(max(abs(int(v.max())), abs(int(v.min())))) if v.size else 0.0 for v in (values, queries)]
                plain = largest[0] * largest[1] * max(dim, 1) < EXACT
                values, queries = (v.astype(np.float64 if plain else object) for v in (values, queries))
                known = ids.drop_null().to_numpy()
                asked = query_ids.to_numpy()
                own = list(zip(np.searchsorted(known, asked), np.searchsorted(known, asked, "right")))
                top = search_shard(queries, own, floors, values, k)
                sizes = [len(d) for d, _ in top]
                at = np.repeat(np.arange(len(top)), sizes)
                score = np.concatenate([s for _, s in top] or [np.zeros(0)])
                score = pa.array(score.astype(np.int64)) if plain else pa.array([Decimal(int(s)) for s in score], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_pydict({
                    "row": g("row").values.take(pa.array(at)), "query_id": query_ids.take(pa.array(at)),
                    "vec_id": ids.take(pa.array(np.concatenate([d for d, _ in top] or [np.zeros(0, np.int64)]), pa.int64())),
                    "score": score.cast(pa.decimal128(38, 0)),
                    "at": pa.array([j + 1 for s in sizes for j in range(s)], pa.int32())})

    return pairs.mapInArrow(run, f"row long, query_id {kind}, vec_id {kind}, score decimal(38, 0), at int")


def search(vectors: DataFrame, is_query: Column | None = None, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query (``is_query``, over ``vec_id``)."""
    kind = dict(vectors.dtypes)["vec_id"]
    is_query = F.col("vec_id") % EVERY == 0 if is_query is None else is_query
    rows = cut_lineage(vectors.filter(usable()).select("vec_id", "embedding").withColumn(
        "row", F.monotonically_increasing_id()), "maxscore-rows")
    asked = rows.filter(is_query & F.col("vec_id").isNotNull())
    n_shards, n_tiles = (max(1, -(-n // size)) for n, size in ((rows.count(), SHARD), (asked.count(), TILE)))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("long")
    shards = _packed(rows.select("vec_id", "embedding", "row"), deal(n_shards), "maxscore-shards", [])
    asked = asked.select("vec_id", "embedding", "row")
    unknown = F.lit(None).cast("double").alias("floor")
    tiles = _packed(asked.select("*", unknown), deal(n_tiles), "maxscore-tiles", ["row", "floor"])
    found = cut_lineage(_search(tiles, shards, 0, 0, n_tiles, k, kind), "maxscore-first")
    if n_shards > 1:
        # only what a double holds exactly is a floor
        floors = found.filter((F.col("at") == k) & (F.abs("score") < int(EXACT))).select(
            "row", F.col("score").cast("double").alias("floor"))
        begun = _packed(asked.join(floors, "row", "left"), deal(n_tiles), "maxscore-tiles", ["row", "floor"])
        found = found.unionByName(_search(begun, shards, 1, n_shards - 1, n_tiles, k, kind))
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    fits = F.least(F.greatest("score", F.lit(Decimal(-1 << 63))), F.lit(Decimal((1 << 63) - 1))).cast("long")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", fits.alias("score")))


def oracle() -> str:
    """The same search in DuckDB SQL over ``embeddings``."""
    return f"""
WITH rows AS (
  SELECT vec_id, [floor({SCALE} * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM rows q JOIN rows c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {EVERY} = 0))
WHERE rank <= {TOP}"""
