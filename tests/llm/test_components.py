import random

from adyield.llm.common import Words, components, shingle_sets

from .helpers import WORD, odd_rows, shingles
from .helpers import components as brute


def test_components_of_random_graphs_stars_and_chains(spark):
    rng = random.Random(2)
    graphs = [[(rng.randrange(300), rng.randrange(300)) for _ in range(200)], [(0, i) for i in range(1, 200)],
              [(i, i + 1) for i in range(200)], [(5, 5)], []]
    for edges in graphs:
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        nodes = {n for e in edges if e[0] != e[1] for n in e}
        assert got == {n: c for n, c in brute(nodes, [e for e in edges if e[0] != e[1]]).items()}


def test_words_and_shingles_match_plain_python(small):
    texts = [r["text"] for r in small("documents").collect()] + [t for _, t, _, _ in odd_rows()]
    w = Words(texts)
    found = [len(WORD.findall(t or "")) for t in texts]
    assert [int(b - a) for a, b in zip(w.first, w.first[1:])] == found
    names = {}
    for i, t in enumerate(texts):
        for k, word in enumerate(WORD.findall(t or "")):
            folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)
            assert names.setdefault(int(w.hash[w.first[i] + k]), folded) == folded
    assert [len(s) for s in shingle_sets(texts)] == [len(shingles(t)) for t in texts]
