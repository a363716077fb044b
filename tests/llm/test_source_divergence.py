import random
import re
from collections import Counter, defaultdict

import pytest

from adyield.llm import source_divergence as d

from .helpers import FOLD, documents, odd_rows, with_clashes

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows):
    """The contract's words, one by one."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall((text or "").translate(FOLD))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= 10]
        whole = Counter()
        sources = sorted(s for x, s in groups if x == lang)
        for s in sources:
            whole.update(counts[lang, s])

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(counts[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, 10)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in d.audit(df).collect())


def planted(n=240, seed=3):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("la", "ÉT", "no", "漢", "x")]
    rows = []
    for i in range(n):
        source = rng.choice(["a", "b", "c", "é", None, "Z", "a b"]) if i % 3 else "hot"
        lang = rng.choice(["en", "fr", None])
        text = " ".join(rng.choice(words[: 10 + 6 * (ord((source or "q")[0]) % 6)]) for _ in range(rng.randrange(40)))
        rows.append((i, rng.choice(["%s.", "<p>%s</p>", "%s\x00\t"]) % text, lang, source))
    return rows + [(900, "only here", "xx", "s"), (901, None, "xx", "t"), (902, "a", "alone", "s")]


@pytest.mark.parametrize("tile,terms", [(128, 1024), (2, 5)])
def test_brute_force(spark, monkeypatch, tile, terms):
    monkeypatch.setattr(d, "TILE", tile)
    monkeypatch.setattr(d, "TERMS", terms)
    rows = planted()
    found = result(documents(spark, rows))
    assert found == brute(rows) and any(r[2] == "term" for r in found)
    assert {r[:5] for r in found if r[0] == "xx"} == {("xx", "s", "pair", "t", 0), ("xx", "t", "pair", "s", 0)}
    assert not [r for r in found if r[0] == "alone"]


def test_odd_rows_repeats_and_clashing_columns(spark):
    rows = odd_rows() * 4 + planted(30)
    assert result(with_clashes(documents(spark, rows))) == brute(rows)
    assert result(documents(spark, [])) == []


def test_small_table_equals_sql(spark, small, duck):
    found = sorted(tuple(r) for r in d.audit(small("documents")).collect())
    assert found == sorted(duck.sql(d.oracle()).fetchall()) and found


def test_translate_table_cuts_terms_as_the_pattern_does():
    rng = random.Random(1)
    text = "".join(chr(rng.choice([*range(128), 0xE9, 0x6F22, 0x1F600, 0x3000, 0xA0])) for _ in range(20_000))
    want = Counter(t.encode() for t in TERM.findall(text.translate(FOLD)))
    assert d.term_counts(text.encode()) == want
    for size in (1, 7, 100, 10_000):
        pieces = list(d.split_pieces(text.encode(), size))
        assert sum((Counter(p) for p in pieces), Counter()) == want
    assert list(d.split_pieces(b"x" * 50, 7)) == [[b"x" * 50]]


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, kept = 9_000_000_000_123, 80_000_000_000_000_007, 12_345
    df = spark.createDataFrame([(n, total, kept)], "n long, total long, kept long")
    assert df.select(d.share("n", "total", "kept")).first()[0] == 1 + 10**9 * (n + 2) // (total + 2 * kept)
