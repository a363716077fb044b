"""Near-duplicate vectors by an epsilon grid order join.

Cosine of at least c between unit vectors means a distance of at most
``sqrt(2 - 2c)`` = epsilon. Unit vectors are rotated onto principal axes (of a
bounded sample; any rotation keeps distances, so the sample steers cost
only), laid on a grid of that width on the leading axes and sorted by grid
cell. The sorted sequence is cut into blocks; pairs of blocks whose boxes lie
further apart than epsilon are never joined, and inside a pair the two
intervals are halved recursively, skipping halves that are provably distant.
What is left is compared in double precision.

Equal vectors collapse into one class first and count by multiplicity, so a
group of copies costs one row. A block pair returns link counts and the
edges of a spanning forest (at most one per vector), never all its pairs.

Vectors that are null, empty, zero, or hold null or non-finite components
link with nothing. Vectors of different lengths never link. A null id is larger
than every other; a component of null ids alone has a null component id and all
its rows are kept. Repeated rows are vectors of their own and link with each
other. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import components

COSINE = 0.95
AXES = 8                     # leading axes of the grid
CELL_AXES = 3                # axes whose cells bring block boxes together
SAMPLE = 10_000              # vectors that fit the rotation
BLOCK = 4_096                # vectors per block
LEAF = 256                   # interval length that is compared outright


def number_type(vectors: DataFrame) -> str:
    """numpy type that holds the embedding's components exactly."""
    return "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"


def classes(vectors: DataFrame, number: str = "<f8") -> DataFrame:
    """(vec_id, signature, dim, vector): usable vectors get a signature of their exact components."""
    kind = dict(vectors.dtypes)["vec_id"]

    def run(batches):
        for batch in batches:
            ids, sig, dim, data = batch.column("vec_id"), [], [], []
            lists = batch.column("embedding")
            length = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            # null components come as NaN
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(number) + 0.0
            end = np.cumsum(length)
            upto = lambda mask: np.concatenate([[0], np.cumsum(mask)])
            bad, some = upto(~np.isfinite(flat)), upto(flat != 0)
            good = (length > 0) & (bad[end] == bad[end - length]) & (some[end] > some[end - length])
            for ok, n, stop in zip(good.tolist(), length.tolist(), end.tolist()):
                raw = flat[stop - n: stop].tobytes() if ok else None
                sig.append(hashlib.blake2b(raw, digest_size=16).digest() if ok else None)
                dim.append(n if ok else None)
                data.append(raw)
            yield pa.RecordBatch.from_pydict({"vec_id": ids, "signature": pa.array(sig, pa.binary()),
                                              "dim": pa.array(dim, pa.int32()), "vector": pa.array(data, pa.binary())})

    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, signature binary, dim int, vector binary")


def unit(data: list[bytes], number: str = "<f8") -> np.ndarray:
    """Unit vectors of one length in double precision, scaled first so that no square overflows."""
    x = np.stack([np.frombuffer(d, number) for d in data]).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rotation(found: DataFrame, number: str = "<f8", sample: int = SAMPLE) -> np.ndarray:
    """Principal axes of at most ``sample`` vectors (smallest hash first)."""
    rows = found.orderBy(F.xxhash64("signature"), "signature").select("vector").limit(sample).collect()
    x = unit([r["vector"] for r in rows], number)
    return np.linalg.svd(np.cov((x - x.mean(0)).T).reshape(x.shape[1], -1))[0] if len(x) > 1 else np.eye(x.shape[1])


def blocks(found: DataFrame, axes: np.ndarray, eps: float, number: str = "<f8", block: int | None = None) -> DataFrame:
    """Sort by grid cell and cut the sequence into blocks of equal size, whatever the partitions: members,
    multiplicities, vectors and box of each."""
    block, axes = block or BLOCK, axes[:, :AXES]

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                cells = np.floor(unit(batch.column("vector").to_pylist(), number) @ axes / eps).astype(np.int64)
                # cells of unit vectors lie in -64..63 for any eps above 1/64; offset bytes sort as the cells do
                order = [bytes(np.clip(c + 128, 0, 255).astype(np.uint8)) for c in cells]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(order, pa.binary())],
                                                 names=[*batch.schema.names, "cells"])

    # the hash splits a crowded cell between partitions and blocks
    order = ["cells", F.xxhash64("class_no"), "class_no"]
    placed = (found.mapInArrow(place, "class_no long, copies long, vector binary, cells binary")
              .repartitionByRange(*order).sortWithinPartitions(*order).drop("cells"))
    placed = cut_lineage(placed.withColumn("part", F.spark_partition_id()).withColumn(
        "at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "grid-order")
    # one row per partition
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    numbered = placed.join(F.broadcast(starts), "part").withColumn(
        "block", F.floor((F.col("start") + F.col("at")) / block)).select("block", "start", "at", "class_no", "copies", "vector")

    def cut(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("start", "ascending"), ("at", "ascending")])
        data = rows.column("vector").to_pylist()
        y = unit(data, number) @ axes
        return pa.table({
            "block": pa.array([rows.column("block")[0].as_py()], pa.int64()),
            "ids": pa.array([rows.column("class_no").to_pylist()], pa.list_(pa.int64())),
            "copies": pa.array([rows.column("copies").to_pylist()], pa.list_(pa.int64())),
            "vectors": pa.array([b"".join(data)], pa.binary()),
            "low": pa.array([y.min(0).tolist()], pa.list_(pa.float64())),
            "high": pa.array([y.max(0).tolist()], pa.list_(pa.float64()))})

    # a group is one block: at most ``block`` rows
    return cut_lineage(numbered.groupBy("block").applyInArrow(
        cut, "block long, ids array<long>, copies array<long>, vectors binary, low array<double>, high array<double>"), "grid-blocks")


def near_blocks(made: DataFrame, eps: float, dim: int) -> DataFrame:
    """Pairs (a, b), a <= b, of blocks whose boxes are within eps: joined on cells of the first axes."""
    boxes, axes = made.select("block", "low", "high"), range(min(dim, CELL_AXES))
    cells = lambda widen: F.array(*[
        F.sequence(F.floor((F.col("low")[i] - widen) / eps), F.floor((F.col("high")[i] + widen) / eps))
        for i in axes])

    def spread(widen: float, name: str) -> DataFrame:
        out = boxes.withColumn("ranges", cells(widen))
        for i in axes:
            out = out.withColumn(f"c{i}", F.explode(F.col("ranges")[i]))
        return out.select(*[f"c{i}" for i in axes], F.col("block").alias(name),
                          F.col("low").alias(f"{name}_low"), F.col("high").alias(f"{name}_high"))

    a, b = spread(eps * 1.0001, "a"), spread(0.0, "b")
    gaps = F.expr("aggregate(zip_with(zip_with(a_low, b_high, (x, y) -> x - y), zip_with(b_low, a_high, (x, y) -> x - y), "
                  "(x, y) -> greatest(x, y, 0D)), 0D, (s, x) -> s + x * x)")
    return (a.join(b, [f"c{i}" for i in axes]).filter((F.col("a") <= F.col("b")) & (gaps <= eps * eps * 1.0001))
            .select("a", "b").distinct())


class _Forest:
    """Disjoint sets over the rows of two blocks; keeps the edges that joined two sets."""

    def __init__(self, n: int):
        self.up, self.edges = list(range(n)), []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def _leaf_edges(mask: np.ndarray, rows: int, columns: int, forest: _Forest) -> None:
    """Join the forest along a leaf's links, one breadth-first sweep per group of rows."""
    left = mask.any(1)
    while left.any():
        group = np.zeros(len(mask), bool)
        group[np.argmax(left)] = True
        while True:
            reached = mask[group].any(0)
            wider = mask[:, reached].any(1)
            if (wider == group).all():
                break
            group = wider
        r, c = np.flatnonzero(group), np.flatnonzero(reached)
        for j in c:
            forest.join(rows + int(r[0]), columns + int(j))
        for i in r[1:]:
            forest.join(rows + int(i), columns + int(c[0]))
        left &= ~group


def join_blocks(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, same: bool, cosine: float, eps: float,
                wx: np.ndarray, wy: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Link counts (weighted by the other side's copies) of both blocks and a spanning forest of the links.

    Rows of y are numbered from len(x) on; for a block with itself each pair is met once.
    """
    nx, ny = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    shift = 0 if same else len(x)
    forest = _Forest(len(x) + (0 if same else len(y)))
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d or same and d <= a:
            continue
        gap = np.maximum(0, np.maximum(px[a:b].min(0) - py[c:d].max(0), py[c:d].min(0) - px[a:b].max(0)))
        if (gap * gap).sum() > eps * eps * 1.0001:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            mask = x[a:b] @ y[c:d].T >= cosine
            if same:
                mask &= np.arange(a, b)[:, None] < np.arange(c, d)[None, :]
            if mask.any():
                nx[a:b] += mask @ wy[c:d]
                ny[c:d] += mask.T @ wx[a:b]
                _leaf_edges(mask, a, shift + c, forest)
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]
    return nx, ny, forest.edges


def linked(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept (the component's smallest id)."""
    eps = float(np.sqrt(2 - 2 * cosine))
    number = number_type(vectors)
    rows = cut_lineage(classes(vectors, number), "grid-vectors")
    found = cut_lineage(
        rows.filter("signature is not null").groupBy("signature")
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"), F.first("dim").alias("dim"),
             F.first("vector").alias("vector")).withColumn("class_no", F.monotonically_increasing_id()), "grid-classes")
    parts = []
    for (dim,) in sorted(found.select("dim").distinct().collect()):      # vector lengths: few
        mine = found.filter(F.col("dim") == dim)
        axes = rotation(mine, number)
        made = blocks(mine.select("class_no", "copies", "vector"), axes, eps, number)
        leading = np.ascontiguousarray(axes[:, :AXES])
        parts.append(_join(made, near_blocks(made, eps, dim), leading, dim, cosine, eps, number))
    empty = vectors.sparkSession.createDataFrame([], "u long, v long, n long")
    out = empty
    for p in parts:
        out = out.union(p)
    out = cut_lineage(out, "grid-links")
    links = out.filter("v is null").groupBy("u").agg(F.sum("n").alias("n"))
    joined = components(out.filter("v is not null").select(F.col("u").alias("a"), F.col("v").alias("b")), "grid-components")
    named = (found.select("signature", "first_id", "copies", "class_no")
             .join(links.withColumnRenamed("u", "class_no"), "class_no", "left")
             .join(joined.withColumnRenamed("node", "class_no"), "class_no", "left")
             .withColumn("component", F.coalesce("component", "class_no")))
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    per_class = named.join(lowest, "component").select(
        "signature", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    own = rows.join(per_class, "signature", "left")
    component = F.when(F.col("signature").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return own.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _join(made: DataFrame, near: DataFrame, axes: np.ndarray, dim: int, cosine: float, eps: float, number: str) -> DataFrame:
    """Rows (u, null, n): links found of class u; (u, v, null): an edge of the forest."""
    side = made.select("block", "ids", "copies", "vectors")
    pairs = (near.join(side.toDF("a", "ids_a", "copies_a", "vectors_a"), "a")
             .join(side.toDF("b", "ids_b", "copies_b", "vectors_b"), "b"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                g = lambda c: batch.column(c)[i]
                ids = [np.array(g(f"ids_{s}").as_py(), np.int64) for s in "ab"]
                w = [np.array(g(f"copies_{s}").as_py(), np.int64) for s in "ab"]
                size = np.dtype(number).itemsize * dim
                raw = [g(f"vectors_{s}").as_py() for s in "ab"]
                x, y = [unit([v[k: k + size] for k in range(0, len(v), size)], number) for v in raw]
                same = g("a").as_py() == g("b").as_py()
                nx, ny, edges = join_blocks(x, y, x @ axes, y @ axes, same, cosine, eps, w[0], w[1])
                every = ids[0] if same else np.concatenate(ids)
                n = nx + ny if same else np.concatenate([nx, ny])
                at = np.flatnonzero(n)
                e = np.array(edges, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({
                    "u": pa.array(np.concatenate([every[at], every[e[:, 0]]])),
                    "v": pa.concat_arrays([pa.nulls(len(at), pa.int64()), pa.array(every[e[:, 1]])]),
                    "n": pa.concat_arrays([pa.array(n[at]), pa.nulls(len(e), pa.int64())])})

    columns = ["a", "b", "ids_a", "copies_a", "vectors_a", "ids_b", "copies_b", "vectors_b"]
    return pairs.select(columns).mapInArrow(run, "u long, v long, n long")
