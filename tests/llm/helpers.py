"""Brute-force counterparts and odd input tables shared by the operator tests."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

PROSE = ("the river ran past the old mill, and nobody asked why the wheel had stopped. " * 3
         + "later that year a boat was found on the bank; its owner never came back. it rained for a week. ")


def documents(spark, rows):
    """Rows (doc_id, text, lang, source) as a documents table."""
    return spark.createDataFrame([(d, t, lang, s, len(t) if t is not None else None) for d, t, lang, s in rows], DOCUMENTS)


def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    return [(1, PROSE, "en", "a"), (2, PROSE, "en", None), (None, PROSE, "en", "a"), (None, None, None, None),
            (3, None, "fr", "b"), (4, "", "fr", "b"), (5, " \n\t ", None, "b"), (6, long, "en", "c"), (7, "one two", "en", ""),
            (8, "One  TWO", "en", ""), (8, "One  TWO", "en", ""), (9, "12 34 ?!", "de", "c"), (8, PROSE.upper(), "en", "a"),
            (10, "x" * 200_000, "en", "c"), (11, "é" * 50 + " ñ 漢字 \U0001F600", "es", "b")]


def with_clashes(df):
    """The table with extra columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F
    names = ["score", "size", "n_words", "component_id", "taken", "hashes", "rkey", "row", "block", "lang_pred", "n_units",
             "stays", "key", "a.b", "c0", "predicted"]
    return df.withColumns({n: F.lit("x") for n in names})


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def shingles(text, k=5):
    words = WORD.findall((text or "").translate(FOLD))
    if not words:
        return frozenset()
    return frozenset(zip(*[words[i:] for i in range(k)])) if len(words) >= k else frozenset([tuple(words)])


def components(nodes, links):
    """Smallest reachable node of every node."""
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}
