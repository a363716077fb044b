import random

import numpy as np

from adyield.llm import toxic_segments as t

from .helpers import documents, fold, odd_rows, with_clashes


def brute_segments(values):
    """All maximal scoring segments by recursion: the best one first, then left and right of it."""
    best = None
    for a in range(len(values)):
        for b in range(a, len(values)):
            v = sum(values[a:b + 1])
            if v > 1e-12 and (best is None or v > best[2] + 1e-12):
                best = (a, b, v)
    if best is None:
        return []
    a, b, v = best
    left = brute_segments(values[:a])
    right = [(x + b + 1, y + b + 1, z) for x, y, z in brute_segments(values[b + 1:])]
    return left + [best] + right


def test_scan_finds_all_maximal_segments():
    rng = random.Random(3)
    for _ in range(300):
        n, drift = rng.randrange(1, 30), -rng.choice([0.3, 0.7, 1.1])
        hits = {i: rng.choice([0.53, 1.27, 2.11]) + rng.random() / 97 for i in range(n) if rng.random() < 0.35}
        got = t.segments(sorted(hits.items()), drift)
        want = brute_segments([hits.get(i, drift) for i in range(n)])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([v for *_, v in got], [v for *_, v in want])


def test_scale_solves_the_moment_equation():
    scores, rates = np.array([3.0, 5.0]), np.array([0.002, 0.0005])
    x = t._scale(scores, rates)
    drift = np.log(1 - t.PASSAGE_RATE)
    assert np.isclose((rates * np.exp(x * scores)).sum() + (1 - rates.sum()) * np.exp(x * drift), 1, atol=1e-6)


def planted(seed=1, n=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abdeginorst") for _ in range(rng.randrange(3, 9))) for _ in range(600)]
    bad = ["vilegrub", "mudhead", "wretchling"]
    docs, labels = [], []
    for d in range(n):
        text, toxic = [rng.choice(words) for _ in range(rng.randrange(30, 300))], d % 4 == 0
        for _ in range(rng.randrange(1, 5) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(bad) + rng.choice(["", "s", "ish."]))
        docs.append((d, " ".join(text), "en", "a"))
        labels.append((d, int(toxic)))
    return docs, labels


def test_held_out_documents(spark):
    docs, labels = planted()
    rows = t.predict(documents(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [(r["predicted"], dict(labels)[r["doc_id"]]) for r in rows if r["held_out"]]
    assert len(held) > 40 and np.mean([p == y for p, y in held]) > 0.95
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 for r in rows)
    scorer = t.fit(documents(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int"),
                   t.fold_of("doc_id", 5) != 0)
    n, found = scorer.scan("plain words here " * 40 + "you mudhead wretchling " + "more plain words " * 40)
    assert n == 120 + 3 + 120 and found[0][0] in (120, 121) and found[0][1] == 122


def test_label_free_and_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    df = with_clashes(documents(spark, odd_rows()))
    got = t.predict(df, none).collect()
    assert len(got) == len(odd_rows()) and all(r["predicted"] == 0 for r in got)
    some = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, None), (None, 1), (6, 0)], "doc_id long, toxic int")
    assert t.predict(df, some).count() == len(odd_rows())
    assert t.predict(documents(spark, []), some).count() == 0


def test_the_sample_bound_holds_for_repeated_rows(spark, monkeypatch):
    docs, labels = planted(n=60)
    df = documents(spark, docs + [(8, f"another text {k}", "en", "b") for k in range(50)])
    for _ in range(5):
        df = df.union(df)
    lab = spark.createDataFrame(labels * 30 + [(0, 0)] * 40, "doc_id long, toxic int")
    monkeypatch.setattr(t, "SAMPLE_TOXIC", 6)
    monkeypatch.setattr(t, "SAMPLE_CLEAN", 10)
    seen = []
    original = t.labelled_sample
    monkeypatch.setattr(t, "labelled_sample", lambda *a: seen.append(original(*a)) or seen[-1])
    t.fit(df, lab, t.fold_of("doc_id", 5) != 0)
    rows = seen[0].collect()
    assert [sum(r["toxic"] == k for r in rows) for k in (1, 0)] == [6, 10]


def test_listed_segments_are_significant(spark):
    docs, labels = planted()
    df, lab = documents(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")
    scorer = t.fit(df, lab, t.fold_of("doc_id", 5) != 0)
    text = dict((d, x) for d, x, *_ in docs)
    some = 0
    for r in t.passages(df, scorer).collect():
        n, found = scorer.scan(text[r["doc_id"]])
        expected = [f for f in found if scorer.k * n * np.exp(-scorer.scale * f[2]) <= 0.05]
        assert [(s["first"], s["last"]) for s in r["segments"]] == [f[:2] for f in expected]
        some += len(expected)
    assert some > 50
    weak = t.Scorer({"mild ": 0.5, "mildl": 0.5}, 1.0, k=0.01)
    n, found = weak.scan("plain " * 2000 + "mild")
    assert found and not weak.significant(n, found)
