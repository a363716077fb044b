"""Every stage of the corpus pipeline against its brute-force version on a planted table, and the run as a whole."""

import hashlib
import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest

from adyield.llm import language_parse as lp
from adyield.llm import mixing
from adyield.llm.common import fold_of

from . import test_language_parse, test_mixing, test_ngram_join, test_sentence_spans
from .helpers import WORD, with_clashes
from .test_byte_pieces import reference  # noqa: F401

FOREIGN = "река текла мимо старой мельницы и никто не спрашивал почему колесо остановилось "


def shuffled(rows, seed, n):
    """``n`` words of the English documents in any order."""
    words = sorted({w for r in rows if r[2] == "en" and r[0] < 5000 for w in WORD.findall(r[1] or "") if w.isalpha() and w.islower()})
    return " ".join(random.Random(seed).choices(words, k=n))


@pytest.fixture(scope="module")
def planted(spark, small, tmp_path_factory):
    """The small documents with near copies, a passage that many hold, foreign scripts and texts without letters."""
    docs = small("documents")
    rows = [tuple(r) for r in docs.collect()]
    long = next(r for r in rows if r[2] == "en" and 120 < len(WORD.findall(r[1])) < 400)
    words = long[1].split(" ")
    for k in range(6):
        copy = [*words]
        copy[7 * k] = f"changed{k}"
        rows.append((5000 + k, " ".join(copy), "en", long[3], 0))
    rows += [(6000 + k, f"{shuffled(rows, 80 + k, 60)}. {shuffled(rows, 77, 70)}. {shuffled(rows, 90 + k, 40)}.", "en", "planted", 0) for k in range(5)]
    rows += [(7000 + k, FOREIGN * 4 + str(k), None, "web", 0) for k in range(3)]
    rows += [(8000, None, None, None, None), (8001, "", "en", "web", 0), (8002, "12 34 ?!", "de", "web", 8)]
    folder = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.fixture(scope="module")
def staged(spark, planted):
    """The table and every stage's output, each written and read again."""
    out = [spark.read.parquet(f"{planted}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], planted).write.parquet(f"{planted}/stage{k}")
        out.append(spark.read.parquet(f"{planted}/stage{k}"))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_columns_stay(staged):
    assert all(df.columns == staged[0].columns for df in staged[1:-1])


def test_language_stage(staged):
    rows = lp.labelled_texts(staged[0], fold_of("doc_id", 3) != 1)
    samples = lp.samples_of([r for r in rows if r[1] % lp.CHECK_EVERY])

    def entropy(text):
        plain = lp.letters(text)
        parts = [plain[a: a + lp.SEGMENT] for a in range(0, len(plain), lp.SEGMENT)]
        return min(sum(test_language_parse.greedy(s, p) for p in parts) * np.log2(len(s) + 2) / len(plain) for s in samples.values())

    usual = defaultdict(list)
    for lang, rank, text in rows:
        if rank % lp.CHECK_EVERY == 0 and len(lp.letters(text)) >= lp.CHECK_LETTERS:
            plain, s = lp.letters(text), samples[lang]
            parts = [plain[a: a + lp.SEGMENT] for a in range(0, len(plain), lp.SEGMENT)]
            usual[lang].append(sum(test_language_parse.greedy(s, p) for p in parts) * np.log2(len(s) + 2) / len(plain))
    limit = lp.FOREIGN * max(np.median(v) for v in usual.values())
    want = []
    for r in staged[0].collect():
        n = len(lp.letters(r["text"] or ""))
        if n and (n < lp.CHECK_LETTERS or entropy(r["text"]) <= limit):
            want.append(r["doc_id"])
    got = ids(staged[1])
    assert got == sorted(want) and not {7000, 7001, 7002, 8000, 8001, 8002} & set(got) and len(got) > 200


def test_near_duplicate_stage(staged):
    rows = {r["doc_id"]: r["text"] for r in staged[1].collect()}
    found = test_ngram_join.brute(list(rows.items()))
    assert {r["doc_id"]: r["text"] for r in staged[2].collect()} == {d: rows[d] for d, (n, c) in found.items() if not n or c == d}
    assert len(staged[1].collect()) - 6 >= staged[2].count()


def test_passage_stage(staged):
    want = test_sentence_spans.brute([(r["doc_id"], r["text"]) for r in staged[2].collect()])
    before = {r["doc_id"]: r["text"] for r in staged[2].collect()}
    want = {d: t for d, t in want.items() if t == before[d] or WORD.search(t)}
    got = {r["doc_id"]: r["text"] for r in staged[3].collect()}
    assert got == want
    passage = shuffled([(r["doc_id"], r["text"], r["lang"]) for r in staged[0].collect()], 77, 70)
    assert [d for d, t in sorted(got.items()) if passage in t] == [6000] and set(range(6000, 6005)) <= set(got)


def test_mix_stage(staged):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in staged[3].collect()]
    layout = mixing.layout(staged[3]).collect()
    names, _, _, count = test_mixing.brute(rows)
    want = {r["doc_id"]: int(count[names.index(r["source"])][r["first_word"]: r["first_word"] + r["size"]].sum()) for r in layout}
    got, text = Counter(), {d: t for d, t, *_ in rows}
    for r in staged[4].collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["text"] in text[r["doc_id"]]
    assert dict(got) == {d: n for d, n in want.items() if n}


def coded(rows, reference):  # noqa: F811
    ids = [reference.encode_ordinary(t) for t in rows]
    return Counter((len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for x in ids)


def test_token_stage_and_run(spark, planted, staged, reference):  # noqa: F811
    want = coded([r["text"] for r in staged[4].collect()], reference)
    assert Counter((r["n_tokens"], r["ids_sha256"]) for r in staged[5].collect()) == want
    whole = corpus_pipeline.run(spark, planted)
    assert Counter((r["n_tokens"], r["ids_sha256"]) for r in whole.collect()) == want


def test_empty_table_and_clashing_columns(spark, small, tmp_path):
    docs = small("documents")
    docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    some = docs.limit(60)
    with_clashes(some).write.parquet(f"{tmp_path}/clash/documents.parquet")
    some.write.parquet(f"{tmp_path}/plain/documents.parquet")
    a, b = (sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, f"{tmp_path}/{d}").collect()) for d in ("clash", "plain"))
    assert a and {d for d, _ in a} == {d for d, _ in b}
