import random

import numpy as np

from adyield.llm import ngram_join as j

from .helpers import PROSE, components, documents, odd_rows, shingles, with_clashes


def brute(rows):
    """doc_id -> (set size, smallest reachable id), ids distinct."""
    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    found = components(ids, links)
    return {d: (len(sets[d]), found[d]) for d in ids}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.linked(df).collect()}


def test_matches_brute_force_on_documents(small):
    df = small("documents")
    assert result(df) == brute([(r["doc_id"], r["text"]) for r in df.collect()])


def test_drifting_copies_and_ties(spark):
    rng = random.Random(5)
    words = [f"v{i}" for i in range(400)]
    rows, text = [], [rng.choice(words) for _ in range(120)]
    for d in range(160):
        if d % 4 == 0:
            text = list(text)
            text[rng.randrange(len(text))] = rng.choice(words)
        copy = list(text)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((d, " ".join(copy), "en", "a"))
    # sets right at the threshold: 9 of 10 shared is above 0.8, 8 of 10 is not
    rows += [(900 + k, " ".join(f"t{i}" for i in range(k, 44 + k)), "en", "a") for k in range(0, 12, 2)]
    rows += [(950, "a b", "en", "a"), (951, "A  b", "en", "a"), (952, "a c", "en", "a"), (953, "", "en", "a"), (954, None, "en", "a")]
    assert result(documents(spark, rows)) == brute([(d, t) for d, t, _, _ in rows])


def test_prefix_loses_no_similar_pair():
    rng = np.random.default_rng(3)
    weight = rng.integers(1, 1000, 5000)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        x = rng.choice(5000, n, replace=False)
        y = np.concatenate([x[rng.uniform(size=n) < 0.93], rng.choice(5000, int(rng.integers(0, 4)))])
        x, y = np.unique(x).astype(np.uint64), np.unique(y).astype(np.uint64)
        both = len(np.intersect1d(x, y))
        if not len(y) or 100 * both < 80 * (len(x) + len(y) - both):
            continue
        (px, mx), (py, my) = (j.choose_prefix(s, weight[s.astype(int)].astype(float)) for s in (x, y))
        assert len(np.intersect1d(px, py)) >= min(mx, my)


def test_odd_tables(spark):
    df = with_clashes(documents(spark, odd_rows()))
    got = j.linked(df).collect()
    assert len(got) == len(odd_rows())
    prose = [r for r in got if r["n_shingles"] == len(shingles(PROSE))]
    assert len(prose) == 4 and {r["component_id"] for r in prose} == {1}
    assert all(r["n_shingles"] == 0 and r["component_id"] == r["doc_id"] for r in got if r["n_shingles"] == 0)
    assert j.linked(documents(spark, [])).count() == 0


def test_one_of_each_group_stays(spark):
    df = with_clashes(documents(spark, odd_rows()))
    kept = j.one_of_each(df)
    assert kept.columns == df.columns
    texts = [r["text"] for r in kept.collect()]
    assert sum(shingles(t) == shingles(PROSE) for t in texts) == 1
    assert sum(shingles(t) == shingles("one two") for t in texts) == 1
    assert sum(t is None for t in texts) == 2 and "" in texts


def test_answer_does_not_follow_partitioning(spark, small):
    df = small("documents")
    assert result(df.repartition(13)) == result(df.coalesce(1))
