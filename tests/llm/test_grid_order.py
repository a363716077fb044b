import numpy as np

from adyield.llm import grid_order as g

from .helpers import components


def brute(rows, cosine=0.95):
    usable = {}
    for i, v in rows:
        if v and not any(x is None for x in v):
            x = np.array(v, np.float64)
            if np.isfinite(x).all() and x.any():
                usable[i] = x
    ids = sorted(usable)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if len(usable[a]) == len(usable[b])
             and usable[a] @ usable[b] / np.linalg.norm(usable[a]) / np.linalg.norm(usable[b]) >= cosine]
    found = components([i for i, _ in rows], links)
    count = {i: 0 for i, _ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return {i: (count[i], found[i], found[i] == i) for i, _ in rows}


def result(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in g.linked(df).collect()}


def clustered(n, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    out = []
    for i in range(n):
        v = centres[rng.integers(6)] + rng.normal(scale=rng.choice([0.05, 0.2, 0.6]), size=dim)
        out.append((i, [float(x) for x in v.astype(np.float32)]))
    return out


def test_clusters_copies_and_odd_vectors(spark, monkeypatch):
    rows = clustered(400)
    rows += [(1000 + i, rows[3][1]) for i in range(30)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [float("nan")] * 24), (2004, [1.0, None] * 12),
             (2005, [float("inf")] * 24), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, [-2.0, -4.0]), (2010, [3.0]), (2011, [5.0]), (2012, [-1.0]),
             (2009, [x * 1e-30 for x in rows[5][1]])]
    for block, leaf in ((4096, 256), (64, 16)):
        monkeypatch.setattr(g, "BLOCK", block)
        monkeypatch.setattr(g, "LEAF", leaf)
        assert result(spark, rows) == brute(rows)


def test_documents_table(spark, small):
    rows = [(r["vec_id"], list(r["embedding"])) for r in small("embeddings").collect()]
    assert result(spark, rows) == brute(rows)


def test_join_skips_distant_intervals_only():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 5)) * [3, 1, 1, 1, 0.2]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    one = np.ones(len(x), np.int64)
    nx, ny, edges = g.join_blocks(x, x, x[:, :3], x[:, :3], True, 0.95, float(np.sqrt(0.1)), one, one)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    assert (nx + ny == near.sum(1)).all()
    links = list(zip(*np.nonzero(near)))
    assert components(range(len(x)), edges) == components(range(len(x)), links) and len(edges) < len(x)


def test_empty_and_repeated_rows(spark):
    assert result(spark, []) == {}
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None)],
                               "vec_id long, embedding array<float>")
    rows = g.linked(df.selectExpr("*", "1 as n_links", "2 as signature")).collect()
    assert sorted(r["n_links"] for r in rows) == [0, 2, 2, 2]
    assert {r["component_id"] for r in rows if r["n_links"]} == {1}


def test_kept_is_never_null(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (None, [0.0, 1.0]), (None, None), (5, [0.0, 1.0]), (6, [])],
                               "vec_id long, embedding array<float>")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in g.linked(df).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (None, 1, 5, False), (None, 0, None, True), (5, 1, 5, True), (6, 0, 6, True)], key=str)
