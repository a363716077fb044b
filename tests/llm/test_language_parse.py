import numpy as np

from adyield.llm import language_parse as lp
from adyield.llm.common import fold_of

from .helpers import documents, fold, odd_rows, with_clashes


def greedy(sample, text):
    """Phrases of a greedy cross-parse by plain substring search, one segment."""
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i:i + k] in sample:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_phrase_counts_equal_substring_search():
    rng = np.random.default_rng(0)
    words = ["tion", "the", "and", "aux", "mente", "ung", "que"]
    make = lambda: " ".join("".join(rng.choice(words, 3)) for _ in range(30))
    samples = {"x": make(), "y": make()}
    parser = lp.CrossParser(samples)
    texts = [make() for _ in range(10)]
    got = parser.phrases([parser.codes(t) for t in texts])
    for i, t in enumerate(texts):
        codes = parser.codes(t)
        for k, lang in enumerate(parser.langs):
            want = sum(greedy(samples[lang], lp.letters(t)[a: a + lp.SEGMENT]) for a in range(0, len(codes), lp.SEGMENT))
            assert got[i, k] == want


def test_held_out_accuracy(small):
    rows = lp.predict(small("documents")).collect()
    lang = {r["doc_id"]: r["lang"] for r in small("documents").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 200 and all(r["held_out"] == (fold(r["doc_id"], 3) == 1) for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_tables(spark):
    df = with_clashes(documents(spark, odd_rows()))
    got = lp.predict(df).collect()
    assert len(got) == len(odd_rows())
    no_letter = [r for r in got if r["doc_id"] in (3, 4, 5, 9)]
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in no_letter)
    assert lp.predict(documents(spark, [])).count() == 0
    unlabelled = documents(spark, [(1, "some text", None, "a")])
    assert lp.predict(unlabelled).first()["lang_pred"] == "und"


def test_pipeline_form_rejects_texts_without_language(spark):
    df = with_clashes(documents(spark, odd_rows()))
    kept = lp.keep_identified(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 3 not in ids and 9 not in ids and 1 in ids


def test_fold_follows_crc32(spark):
    rows = documents(spark, [(i, "", "en", "a") for i in range(50)] + [(None, "", "en", "a")])
    for r in rows.select("doc_id", fold_of("doc_id", 3).alias("f")).collect():
        assert r["f"] == fold(r["doc_id"], 3)


def test_repeated_rows_and_copies_are_learned(spark, small):
    from pyspark.sql import functions as F
    df = small("documents")
    twice = df.union(df)
    learn = fold_of("doc_id", 3) != 1
    once = lp.sample_texts(df, learn)
    assert len(once) == 4 and lp.sample_texts(twice, learn) == once
    want = {(r["doc_id"], r["lang_pred"], r["score"]) for r in lp.predict(df).collect()}
    got = lp.predict(twice).collect()
    assert len(got) == 2 * len(want) and {(r["doc_id"], r["lang_pred"], r["score"]) for r in got} == want
    assert lp.keep_identified(twice).count() == 2 * lp.keep_identified(df).count() > 0
    # all documents of a language are copies of one, under other ids
    copies = df.filter("lang != 'de'").union(df.filter("lang = 'de'").withColumn("text", F.lit(
        "der alte fluss lief an der muehle vorbei. niemand fragte, warum das rad stand. im herbst kam ein boot an das ufer.")))
    assert "muehle" in lp.sample_texts(copies, learn)["de"]
    # a sentence of two languages is not learned
    two = documents(spark, [(1, "one of both. only here", "en", "a"), (2, "one of both. ici seul", "fr", "a")])
    assert lp.sample_texts(two, F.lit(True)) == {"en": "only here", "fr": "ici seul"}


def test_samples_are_equally_long():
    rows = [("aa", k, f"{chr(97 + k % 26)}word{'x' * (k % 7)} tail " * 60) for k in range(100)] + [("bb", 1, "short one")]
    long = [(lang, k, ". ".join(f"{lang}{chr(97 + j % 26)}{'q' * (k % 9)}{chr(97 + k % 26)} unit" for j in range(40))) for lang in ("cc", "dd")
            for k in range(60 if lang == "cc" else 30)]
    got = lp.samples_of(rows + long)
    assert len(got["bb"]) == 9 and all(len(t) <= lp.LEAST_CHARS for t in got.values())
    got = lp.samples_of(long)
    assert lp.LEAST_CHARS <= len(got["cc"]) == len(got["dd"])


def test_unlearned_languages_are_rejected(spark, small):
    """Texts of unlearned scripts go; what is learned stays."""
    foreign = {1: "река текла мимо старой мельницы и никто не спрашивал почему колесо остановилось " * 3,
               2: "川は古い水車小屋のそばを流れていたが車輪がなぜ止まったのか誰も尋ねなかった" * 3,
               3: "ο ποταμός κυλούσε δίπλα στον παλιό μύλο και κανείς δεν ρώτησε γιατί σταμάτησε ο τροχός " * 3,
               4: "nehir eski değirmenin yanından akıyordu ve kimse çarkın neden durduğunu sormadı " * 3}
    df = small("documents")
    packed = lp.learned(df, fold_of("doc_id", 3) != 1)
    rows = lp.identify(documents(spark, [(d, t, None, None) for d, t in foreign.items()]), packed).collect()
    assert all(r["is_foreign"] for r in rows if r["doc_id"] < 4)
    own = lp.identify(df, packed).collect()
    assert np.mean([r["is_foreign"] for r in own if r["lang_pred"] != "und"]) < 0.02
    both = df.union(documents(spark, [(10_000 + d, t, "xx", "a") for d, t in foreign.items() if d < 4]).select(df.columns))
    # a label that one document holds is learned like any other, unless the document is held out
    kept = {r["doc_id"] for r in lp.keep_identified(both).collect()}
    assert len([d for d in kept if d < 10_000]) > 0.97 * df.filter("text rlike '[a-z]'").count()
