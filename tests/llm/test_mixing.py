from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from adyield.llm import mixing as m

from .helpers import WORD, documents, odd_rows, with_clashes


@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=30))
@settings(max_examples=200, deadline=None)
def test_targets_share_all_words_and_stop_at_the_cap(sizes):
    got = m.targets(sizes)
    assert np.isclose(sum(got), sum(sizes))
    weight = [m.WEIGHTS[i % 3] for i in range(len(sizes))]
    assert all(t <= 3 * s + 1e-6 for t, s in zip(got, sizes))
    free = [t / w for t, w, s in zip(got, weight, sizes) if t < 3 * s - 1e-6]
    assert not free or np.allclose(free, free[0])
    assert all(t / w <= free[0] + 1e-6 for t, w, s in zip(got, weight, sizes) if free)


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        i = np.arange(n)
        a, b = (m.permute(i, np.full(n, n), np.full(n, key)) for key in (5, 6))
        assert sorted(a) == sorted(b) == list(range(n))
        assert n < 10 or (a != b).any()
        assert (m.permute(a, np.full(n, n), np.full(n, 5), back=True) == i).all()


def test_draws_meet_what_is_owed():
    owed, shards = np.array([50_000, 3, 0, 12_345]), 17
    draws = list(m.shard_draws(owed, shards, 7, 0, shards))
    counts = np.array([n for *_, n in draws])
    assert [s for s, *_ in draws] == list(range(shards))
    assert (counts.sum(0) == owed).all() and (counts >= 0).all() and len(set(counts[:, 0])) > 3
    assert set(counts.sum(1)) <= {owed.sum() // shards, owed.sum() // shards + 1}
    assert (np.array([b for _, b, _ in draws]) == np.cumsum(counts, 0) - counts).all()
    # any part of the shards can be drawn alone
    some = list(m.shard_draws(owed, shards, 7, 5, 9))
    assert [(s, b.tolist(), n.tolist()) for s, b, n in some] == [(s, b.tolist(), n.tolist()) for s, b, n in draws[5:9]]


@given(st.lists(st.integers(0, 700), min_size=1, max_size=12), st.integers(0, 5))
@settings(max_examples=200, deadline=None)
def test_slots_give_the_target_to_the_word(sizes, seed):
    want = m.targets(sizes)
    owed, last = m.slots_owed(sizes, want, seed)
    for no, (size, t) in enumerate(zip(sizes, want)):
        given_words, blocks = 0, -(-size // m.BLOCK)
        for slot in range(owed[no]):
            turn = slot // blocks
            b = m.permute(np.array([slot % blocks]), np.array([blocks]), np.array([m.pass_key(no, turn, seed)]))[0]
            whole = min(m.BLOCK, size - b * m.BLOCK)
            given_words += min(whole, last[no]) if slot == owed[no] - 1 else whole
        assert given_words == min(3 * size, round(t)) and owed[no] <= 3 * blocks


def brute(rows, seed=7):
    """taken of every row, by laying the words out one by one; equal rows in no order."""
    names = sorted({s for *_, s in rows if s is not None}) + [None] * any(s is None for *_, s in rows)
    size = lambda t: len(WORD.findall(t or ""))
    sizes = [sum(size(t) for _, t, _, s in rows if s == x) for x in names]
    want = m.targets(sizes)
    owed, last = m.slots_owed(sizes, want, seed)
    count = [np.zeros(s, int) for s in sizes]
    total, shards = int(owed.sum()), -(-int(owed.sum()) // m.SHARD_BLOCKS)
    drawn = np.zeros(len(names), int)
    for _, before, n in m.shard_draws(owed, shards, seed, 0, shards) if shards else ():
        assert (before == drawn).all()
        for no, k in enumerate(n):
            for slot in range(drawn[no], drawn[no] + k):
                blocks = -(-sizes[no] // m.BLOCK)
                b = m.permute(np.array([slot % blocks]), np.array([blocks]), np.array([m.pass_key(no, slot // blocks, seed)]))[0]
                words = last[no] if slot == owed[no] - 1 else m.BLOCK
                count[no][b * m.BLOCK: b * m.BLOCK + words] += 1
        drawn += n
    assert drawn.sum() == total
    return names, sizes, want, count


def test_taken_equals_the_words_laid_out_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(m, "SHARD_BLOCKS", 5)        # the driver draws with it
    monkeypatch.setattr(m, "SALTED", 4)
    rows = [(i, "w " * (7 * i % 90), "en", "abcd"[i % 4]) for i in range(60)]
    rows += [(100, "tiny text", "en", f"s{k:02d}") for k in range(12)] + [(200, "copied words " * 20, "en", "a")] * 30
    rows += [(None, None, None, None)] * 25 + [(None, "no id " * 5, "en", None)] * 9
    df = documents(spark, rows)
    names, sizes, want, count = brute(rows)
    layout = m.layout(df).collect()
    got = sorted((r["doc_id"] or -1, r["size"], r["source_size"], r["taken"]) for r in m.taken(df).collect())
    expected = [(r["doc_id"] or -1, r["size"], sizes[k], int(count[k][r["first_word"]: r["first_word"] + r["size"]].sum()))
                for r in layout for k in [names.index(r["source"])]]
    assert got == sorted(expected) and len(got) == len(rows)
    for k in range(len(names)):                       # every word of a source belongs to one row
        spans = sorted((r["first_word"], r["size"]) for r in layout if r["source"] == names[k] and r["size"])
        assert [a for a, _ in spans] == list(np.cumsum([0, *[n for _, n in spans]])[:-1]) and sum(n for _, n in spans) == sizes[k]
        assert count[k].sum() == min(3 * sizes[k], round(want[k]))
    _, mix = m.mix(df)
    places = [(r["shard"], r["place"]) for r in mix.select("shard", "place").distinct().collect()]
    for s in {a for a, _ in places}:
        mine = sorted(p for a, p in places if a == s)
        assert mine == list(range(len(mine))) and len(mine) <= 5


def test_small_sources_come_near_their_targets(spark):
    rows = [(k, "w " * 40, "en", f"s{k:02d}") for k in range(12)]
    got = {r["doc_id"]: (r["taken"], r["target"]) for r in m.taken(documents(spark, rows)).collect()}
    assert all(abs(a - t) <= 0.5 for a, t in got.values()) and {a for a, _ in got.values()} == {75, 30, 15}


def test_whole_table(spark, small):
    df = small("documents")
    text = {r["doc_id"]: (r["source"], len(WORD.findall(r["text"] or ""))) for r in df.collect()}
    rows = m.taken(df).collect()
    assert {r["doc_id"]: r["size"] for r in rows} == {d: n for d, (_, n) in text.items()}
    by = defaultdict(list)
    for r in rows:
        by[text[r["doc_id"]][0]].append(r)
    names = sorted(by)
    want = m.targets([sum(r["size"] for r in by[s]) for s in names])
    for s, t in zip(names, want):
        assert np.isclose(by[s][0]["target"], t) and by[s][0]["source_size"] == sum(r["size"] for r in by[s])
        assert abs(sum(r["taken"] for r in by[s]) - t) <= 0.5
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    again = {r["doc_id"]: r["taken"] for r in m.taken(df.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_mixed_rows_hold_the_words_taken(spark, small):
    df = small("documents")
    taken = {r["doc_id"]: r["taken"] for r in m.taken(df).collect()}
    got, text = defaultdict(int), {r["doc_id"]: r["text"] for r in df.collect()}
    mixed = m.mixed(df)
    assert mixed.columns == df.columns
    for r in mixed.collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["text"] in text[r["doc_id"]] and r["n_chars"] == len(r["text"])
    assert {d: n for d, n in taken.items() if n} == dict(got)


def test_odd_tables(spark):
    df = with_clashes(documents(spark, odd_rows()))
    rows = m.taken(df).collect()
    assert len(rows) == len(odd_rows())
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert all(r["taken"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    null = [r for r in rows if r["doc_id"] == 2][0]                       # the null source comes last
    names = sorted({s for _, _, _, s in odd_rows() if s is not None}) + [None]
    sizes = [sum(len(WORD.findall(t or "")) for _, t, _, s in odd_rows() if s == x) for x in names]
    assert np.isclose(null["target"], m.targets(sizes)[-1])
    assert m.mixed(df).columns == df.columns and m.mixed(df).count() > 0
    assert m.taken(documents(spark, [])).count() == 0 and m.mixed(documents(spark, [])).count() == 0


def test_equal_rows_share_a_text_and_keep_their_places(spark, monkeypatch):
    monkeypatch.setattr(m, "SALTED", 3)
    rows = [(1, "one two three four " * 30, "en", "a")] * 20 + [(2, "five six " * 40, "en", "b"), (None, "x y z " * 9, "en", "b")]
    rows += [(3, None, "en", "b")] * 7 + [(4, "", None, None)] * 5
    df = with_clashes(documents(spark, rows))
    taken, mixed = m.taken(df).collect(), m.mixed(df)
    got, want = defaultdict(int), defaultdict(int)
    for r in taken:
        want[r["doc_id"]] += r["taken"]
    for r in mixed.collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert mixed.columns == df.columns and dict(got) == {d: n for d, n in want.items() if n}
