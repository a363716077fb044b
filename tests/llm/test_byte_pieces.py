import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from adyield.llm import byte_pieces as b

from .helpers import documents, odd_rows, with_clashes

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "\n\n  a", "it's  we'LL 12345 ½", "漢字かな混じり文 \U0001F600‍", "a" * 3000, "é" * 500, "<|endoftext|>", "\x00\x01\xa0　x",
       "<unk> ▁ <s>", "aA1" * 200]


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(n) for a, n in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_and_decode_back(small, reference):
    codec = b.Codec(PATH, public_tokenizers.PATTERN)
    for text in [r["text"] for r in small("documents").collect()] + ODD:
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_other_vocabulary(reference):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(n) for a, n in map(bytes.split, lines)}
    other = tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = b.Codec(path, public_tokenizers.PATTERN)
    for text in ODD:
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == other.encode_ordinary(text)


def test_cache_overflow_changes_nothing(monkeypatch, reference):
    monkeypatch.setattr(b, "CACHE", 3)
    codec = b.Codec(PATH, public_tokenizers.PATTERN)
    text = " ".join(f"zq{i}xv" for i in range(50))
    assert np.frombuffer(codec.encode(text) + codec.encode(text), "<u4").tolist() == 2 * reference.encode_ordinary(text)


def test_odd_tables(spark, reference):
    df = with_clashes(documents(spark, odd_rows()))
    got = b.tokenise(df, PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == len(odd_rows())
    want = sorted((d or -1, len(reference.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest())
                  for d, t, _, _ in odd_rows())
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["decoded_sha256"]) for r in got) == want
    assert all(hashlib.sha256(bytes(r["ids"])).hexdigest() == r["ids_sha256"] and len(r["ids"]) == 4 * r["n_tokens"] for r in got)
    assert b.tokenise(documents(spark, []), PATH, public_tokenizers.PATTERN).count() == 0
