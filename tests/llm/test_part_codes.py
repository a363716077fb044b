import hashlib

import numpy as np
import pytest

from adyield.llm import part_codes as c

FIELDS = "vec_id long, embedding array<{}>, label int"


def brute(rows):
    """The contract on Python integers; every vector has a length that 16 divides."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 16
    cut = [[tuple(v[k * width: (k + 1) * width]) for k in range(16)] for _, v, _ in kept]
    books = [[list(v[k]) for v in cut[:64]] for k in range(16)]

    def nearest(k, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(books[k]))

    for _ in range(2):
        moved = []
        for k in range(16):
            own = {}
            for v in cut:
                own.setdefault(nearest(k, v[k])[1], []).append(v[k])
            moved.append([[sum(x) // len(own[i]) for x in zip(*own[i])] if i in own else e for i, e in enumerate(books[k])])
        books = moved
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for (i, _, label), v in zip(kept, cut):
        found = [nearest(k, v[k]) for k in range(16)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(e for e, _ in found), label))
    sums = {}
    for r in out:
        sums[r[3]] = sums.get(r[3], 0) + r[2]
    return sorted(((i, code, e, sums[label], sha) for i, code, e, label in out), key=str)


def result(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, FIELDS.format(kind))
    return sorted((tuple(r) for r in c.compress(df).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def vectors(n, dim=32, seed=0, scale=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(scale=scale, size=(9, dim))
    return [(int(i), [float(x) for x in (centres[rng.integers(9)] + rng.normal(scale=scale / 3, size=dim)).astype(np.float32)],
             [None, 1, 2][int(rng.integers(3))]) for i in rng.permutation(n)]


def test_brute_force_with_copies_nulls_and_ties(spark):
    rows = vectors(300)
    rows += [(5, rows[0][1], 1), (5, rows[0][1], 1), (None, rows[1][1], None), (700, None, 1), (701, [None] * 32, 2),
             (702, [float("nan")] * 32, 2), (703, [float("inf")] + [0.0] * 31, None)]
    rows += [(800 + i, rows[2][1], 2) for i in range(150)]
    rows += [(1000 + i, [round(x, 1) for x in v], 3) for i, (_, v, _) in enumerate(vectors(60, seed=2))]    # coarse: many ties
    assert result(spark, rows) == brute(rows)


def test_fewer_rows_than_entries_and_double_components(spark):
    rows = vectors(20, dim=16) + [(50, [1e3, -1e3] * 8, 7)]
    assert result(spark, rows, "double") == brute(rows)


def test_components_beyond_64_bit_squares(spark):
    rows = vectors(40, dim=16) + [(-1, [3e9] * 16, 1), (90, [-2.5e9] * 16, 1), (91, [2.9e9] * 16, None)]
    found = result(spark, rows, "double")
    assert [r[:2] + r[4:] for r in found] == [r[:2] + r[4:] for r in brute(rows)]
    far = result(spark, vectors(20, dim=16) + [(91, [1e300] * 16, 1)], "double")
    assert len(far) == 21


def test_other_lengths_and_empty_tables(spark):
    rows = vectors(30, dim=16)
    found = result(spark, rows + [(100, [], 1), (101, [1.0] * 15, 1), (102, [1.0] * 32, None)])
    assert {r[0]: r[1:3] for r in found if r[0] >= 100} == {100: (None, None), 101: (None, None), 102: (None, None)}
    assert [r[1:3] for r in found if r[0] < 100] == [r[1:3] for r in brute(rows)]
    assert result(spark, []) == [] and result(spark, [(1, None, None)]) == []
    assert [r[:4] for r in result(spark, [(1, [1.0], 2)])] == [(1, None, None, None)]


def test_clashing_columns(spark):
    rows = vectors(80, dim=16)
    df = spark.createDataFrame(rows, FIELDS.format("float")).selectExpr("*", "'x' as code", "1 as error", "2 as of", "3 as label_error")
    assert sorted((tuple(r) for r in c.compress(df).collect()), key=str) == brute(rows)


def test_small_table_equals_sql(spark, small, duck):
    found = c.compress(small("embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(tuple(r) for r in found) == sorted(duck.sql(c.oracle()).fetchall())


@pytest.mark.parametrize("spread,kind", [(3, np.int64), (60, np.int64), (4000, np.int64), (1 << 40, object)])
def test_tree_finds_the_lowest_nearest_entry_and_saves_distances(spread, kind):
    rng = np.random.default_rng(spread & 0xFFFF)
    points, q = rng.integers(-spread, spread, (64, 4)), rng.integers(-spread, spread, (2000, 4))
    points[40:44] = points[3]
    points, q = points.astype(kind), q.astype(kind)
    tree = c.Gnat(points)
    index, d2 = tree.nearest(q)
    every = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(x, p)) for p in points.tolist()] for x in q.tolist()], object)
    assert (d2 == every.min(1)).all() and (index == [int(np.argmin(list(r))) for r in every]).all()
    assert tree.measured < 0.9 * every.size
