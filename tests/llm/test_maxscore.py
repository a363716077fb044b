import numpy as np
import pytest

from adyield.llm import maxscore as m


def brute(rows, k=20, every=20):
    """(query, rank, candidate, score) on Python integers."""
    usable = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows
              if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in usable:
        if q is None or q % every:
            continue
        found = [(-sum(a * b for a, b in zip(v, w)), i is None, i or 0, i) for i, w in usable if i != q and len(w) == len(v)]
        out += [(q, n + 1, i, -s) for n, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def result(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return sorted((tuple(r) for r in m.search(df).select("query_id", "rank", "vec_id", "score").collect()), key=str)


def vectors(n, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(scale=0.15, size=(7, dim))
    x = centres[rng.integers(7, size=n)] + rng.normal(scale=0.05, size=(n, dim))
    x[rng.random((n, dim)) < 0.6] = 0.0                     # lists that few hold
    return [(int(i), [float(e) for e in v.astype(np.float32)]) for i, v in zip(rng.permutation(n), x)]


@pytest.mark.parametrize("shard,tile", [(8192, 1024), (50, 7)])
def test_brute_force_with_copies_and_odd_vectors(spark, monkeypatch, shard, tile):
    monkeypatch.setattr(m, "SHARD", shard)
    monkeypatch.setattr(m, "TILE", tile)
    rows = vectors(400)
    rows += [(1000 + i, rows[7][1]) for i in range(130)]                                   # a large group of equal vectors
    rows += [(2000, None), (2020, [float("nan")] * 24), (2040, [None] * 24), (2060, [float("inf")] * 24), (2080, [0.0] * 24),
             (None, rows[3][1]), (2100, [1.0, 2.0]), (2101, [2.0, -1.0]), (2120, []), (2140, []), (-20, rows[9][1]), (0, rows[1][1])]
    assert result(spark, rows) == brute(rows)


def test_repeated_rows_and_few_candidates(spark):
    rows = [(20, [1.0, 0.5]), (20, [1.0, 0.5]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    assert result(spark, rows) == brute(rows) and len(result(spark, rows)) == 6
    assert result(spark, []) == [] and result(spark, [(1, [1.0])]) == [] and result(spark, [(20, [1.0])]) == []


def test_components_beyond_doubles(spark):
    rows = vectors(60, dim=6) + [(80, [1e9] * 6), (81, [1e9 + 64.0] * 6), (82, [-1e9] * 6), (100, [1e8, 1.0, 0.0, 0.0, 0.0, 0.0])]
    found = result(spark, rows, "double")
    limit = lambda s: min(max(s, -1 << 63), (1 << 63) - 1)
    assert found == sorted(((q, r, i, limit(s)) for q, r, i, s in brute(rows)), key=str)
    assert len(result(spark, rows + [(120, [1e300] * 6)], "double")) == len(found) + 20


def test_clashing_columns(spark):
    rows = vectors(90, dim=8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr(
        "*", "1 as row", "2 as part", "'x' as floor", "3 as dim", "4 as score", "5 as rank")
    assert sorted((tuple(r) for r in m.search(df).collect()), key=str) == brute(rows)


def test_small_table_equals_sql(spark, small, duck):
    found = m.search(small("embeddings")).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(tuple(r) for r in found) == sorted(
        duck.sql(f"SELECT query_id, rank, vec_id, score FROM ({m.oracle()})").fetchall())


@pytest.mark.parametrize("block", [16, 100, 4096])
def test_search_over_blocks_and_known_floors(monkeypatch, block):
    monkeypatch.setattr(m, "BLOCK", block)
    rng = np.random.default_rng(block)
    values = rng.integers(-9, 10, (500, 12)).astype(float) * (rng.random((500, 12)) < 0.4)
    queries = rng.integers(-9, 10, (40, 12)).astype(float)
    scores = queries @ values.T
    own = [(i, i + 1) for i in range(40)]
    for i in range(40):
        scores[i, i] = -np.inf
    want = [np.lexsort((np.arange(500), -s))[:20] for s in scores]
    kth = np.array([s[w[-1]] for s, w in zip(scores, want)])
    for floors in (np.full(40, -np.inf), kth):
        found = m.search_shard(queries, own, floors, values, 20)
        assert all((docs == w).all() and (score == s[w]).all() for (docs, score), w, s in zip(found, want, scores))
    assert all(not len(d) for d, _ in m.search_shard(queries, own, np.full(40, 1e9), values, 20))


def test_candidates_outside_essential_lists_are_not_met():
    values = np.array([[9.0, 0, 0], [0, 1, 0], [0, 0, 1], [8, 1, 1], [0, 1, 1]])
    block = m.Postings(values)
    q = np.array([5.0, 1.0, 1.0])
    bounds = block.bounds(q[None])[0]
    order = np.argsort(bounds, kind="stable")
    sums = np.cumsum(bounds[order])
    rest = int((sums < 40).sum())
    docs, score = block.search(q, order, sums, rest, 40)
    assert rest == 2 and docs.tolist() == [0, 3] and score.tolist() == [45, 42]
