from collections import Counter

import numpy as np

from adyield.llm import quality_trees as q

from .helpers import WORD, documents, odd_rows, with_clashes


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = {i + j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(3)}
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(marked)]


def test_statistics_match_brute_force(small):
    texts = [r["text"] for r in small("documents").collect()] + [t for _, t, _, _ in odd_rows()] + ["a\na\n\n\na \na", "a b c a b c"]
    base, x = q.statistics(texts)
    assert base.tolist() == [brute(t) for t in texts]
    assert np.isfinite(x).all()


def test_trees_keep_their_signs_and_learn():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(3000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + rng.normal(0, 0.2, 3000) > 0.6).astype(float)
    model = q.fit_trees(x, y, [1, 0, -1])
    p = model.probability(x)
    assert ((p > 0.5) == y).mean() > 0.85
    grid = np.tile(rng.uniform(size=(50, 1, 3)), (1, 40, 1))
    grid[:, :, 0] = np.linspace(0, 1, 40)
    assert (np.diff(model.margin(grid.reshape(-1, 3)).reshape(50, 40), axis=1) >= -1e-12).all()
    grid[:, :, 0], grid[:, :, 2] = 0.5, np.linspace(0, 1, 40)
    assert (np.diff(model.margin(grid.reshape(-1, 3)).reshape(50, 40), axis=1) <= 1e-12).all()


def test_flattened_nodes_equal_a_walk():
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(500, 2))
    model = q.fit_trees(x, (x[:, 0] > 0.5).astype(float), [0, 0], trees=5)
    for row, margin in zip(x[:50], model.margin(x[:50])):
        total = model.bias
        for node in model.roots:
            while model.feature[node] >= 0:
                node = model.left[node] + (row[model.feature[node]] > model.threshold[node])
            total += model.value[node]
        assert np.isclose(total, margin)


def test_judges_all_rows(spark, small):
    rows = q.judge(small("documents"), small("labels")).collect()
    assert len(rows) == 200 and not any(r["kept"] and r["base_failed"] for r in rows)
    text = {r["doc_id"]: r["text"] for r in small("documents").collect()}
    for r in rows:
        n, *_, repeat = brute(text[r["doc_id"]])
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
    quality = {r["doc_id"]: r["quality"] for r in small("labels").collect()}
    good = [r["kept"] for r in rows if quality.get(r["doc_id"]) == 1]
    assert np.mean(good) > 0.85


def test_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1), (None, 0), (3, None)], "doc_id long, quality int")
    got = q.judge(with_clashes(documents(spark, odd_rows())), labels).collect()
    assert len(got) == len(odd_rows())
    assert all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 50)
    assert q.judge(documents(spark, []), labels).count() == 0


def test_the_sample_bound_holds_for_repeated_rows(spark):
    texts = [(i, "word " * (i + 60), "en", "a") for i in range(30)]
    docs = documents(spark, texts + [(3, "other words " * k, "en", "b") for k in range(1, 40)] + [(None, "x", "en", "a")] * 20)
    for _ in range(5):
        docs = docs.union(docs)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] * 20 + [(3, 1)] * 50 + [(7, 0), (None, 1)], "doc_id long, quality int")
    for rows in (5, 12, 1000):
        x, y = q.training_rows(docs, labels, rows)
        assert len(x) == len(y) == min(rows, 29)                 # 7 has contradicting labels
        again, _ = q.training_rows(docs.repartition(7), labels, rows)
        assert (again == x).all()
    assert q.judge(docs.limit(500), labels).count() == 500


def test_ties_and_a_single_label(spark):
    docs = documents(spark, [(i, "the same words " * 30, "en", "a") for i in range(200)])
    for labels, kept in (([(i, i % 2) for i in range(200)], None), ([(i, 1) for i in range(200)], True), ([(i, 0) for i in range(200)], False)):
        rows = q.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert len({(r["quality_score"], r["kept"]) for r in rows}) == 1 and all(r["base_failed"] for r in rows)
        assert kept is None or (rows[0]["quality_score"] >= 0.5) == kept
