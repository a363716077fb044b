"""Language identification by cross-parsing entropy.

For every language a suffix automaton of a bounded labelled sample is built.
A text is parsed greedily into the longest phrases that occur in the sample;
the phrase count, times the bits that name a phrase and over the text's
length, estimates the cross entropy. The language that needs the fewest
normalised phrases wins (ties: the first in code-point order).

Texts are lower-cased and every run of non-letters becomes one blank. Long
texts are parsed in segments of ``SEGMENT`` characters, all of them, so that
whole batches advance one character per array step; a segment border ends at
most one phrase, alike for every language. A text that is null or has no
letter is ``und`` with score 0.

The sample is bounded by ``SAMPLE_DOCS`` documents and ``SAMPLE_CHARS``
letters per language, the documents with the smallest id hashes. All languages
are cut to the letters of the shortest sample, but to no less than
``LEAST_CHARS``, so that none has the advantage of a smaller dictionary. The
texts of every ``CHECK_EVERY``-th of a language's documents, which the samples do
not hold, tell what entropy the learned languages have: a text of at least
``CHECK_LETTERS`` letters whose entropy lies ``FOREIGN`` times above the highest
of these languages' usual entropies is ``foreign``, whatever language is
nearest. The corpus pipeline rejects it; ``predict`` still names the nearest.

Repeated rows are predicted one by one and learned from once; ties go to the
first language. Without labelled texts every text is ``und``. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import broadcast_if_small
from ..session import cut_lineage
from .common import fold_of, give_back, slices, worker_model

SAMPLE_DOCS, SAMPLE_DOC_CHARS, SAMPLE_CHARS = 250, 3_000, 60_000
SAMPLE_SHARE = 600           # most letters that one document adds to its language's sample
LEAST_CHARS = 8_000          # letters that no sample is cut below for another's sake
PICKED = 2_000               # documents per language among which the smallest id hashes are ranked
CHECK_EVERY = 5              # of so many labelled documents, one tells the usual entropy and the others make the sample
CHECK_LETTERS = 40
FOREIGN = 2.0                # a text's entropy over the usual one that tells an unlearned language
SEGMENT = 512
SLICE = 1 << 19
UNDETERMINED = "und"
_SENTENCE = re.compile(r"[.!?\n]+")


class Automaton:
    """Suffix automaton of one sample: ``next[state]`` maps a letter code to a state; state 0 is the start."""

    def __init__(self, codes):
        self.next, link, length = [{}], [-1], [0]
        last = 0
        for c in codes:
            here = len(self.next)
            self.next.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = here
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[here] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[here] = copy
            last = here


def letters(text: str) -> str:
    """Lower-cased, each run of non-letters one blank."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class CrossParser:
    """Parses batches of texts against the samples of all languages at once."""

    def __init__(self, samples: dict[str, str], usual: float | None = None):
        self.langs = sorted(samples)
        self.usual = usual                           # highest usual entropy of the learned languages
        alphabet = sorted({c for s in samples.values() for c in s if c != " "})
        # codes: 0 blank, 1 a letter that no sample holds, 2.. the samples' letters
        self.code_of = {c: i + 2 for i, c in enumerate(alphabet)} | {" ": 0}
        width = len(alphabet) + 2
        # a language's own table: states by the letters that its sample holds (column 0: any other); row 0: no such phrase
        self.own, self.tables, self.restart, self.bits = [], [], [], []
        for lang in self.langs:
            auto = Automaton([self.code_of[c] for c in samples[lang]])
            held = sorted({self.code_of[c] for c in samples[lang]})
            own = np.zeros(width, np.int32)
            own[held] = np.arange(len(held)) + 1
            table = np.zeros((len(auto.next) + 1, len(held) + 1), np.int32)
            for state, edges in enumerate(auto.next):
                for c, to in edges.items():
                    table[state + 1, own[c]] = to + 1
            del auto
            self.own.append(own)
            self.tables.append(table)
            self.restart.append(np.where(table[1] > 0, table[1], 1).astype(np.int32))
            self.bits.append(np.log2(len(samples[lang]) + 2))
        give_back()
        self.bits = np.array(self.bits)
        self.lookup = np.full(0x110000, -1, np.int8 if width < 120 else np.int16)

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        got = self.lookup[points]
        if (got < 0).any():
            for p in np.unique(points[got < 0]):
                c = chr(p)
                self.lookup[p] = self.code_of.get(c, 1) if c.isalpha() else 0
            got = self.lookup[points]
        keep = got > 0
        keep[1:] |= keep[:-1]                        # the first blank after a letter
        return got[keep].astype(np.int32)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrase counts, texts by languages."""
        out = np.zeros((len(texts), len(self.langs)))
        parts, owner = [], []
        for i, codes in enumerate(texts):
            for a in range(0, len(codes), SEGMENT):
                parts.append(codes[a: a + SEGMENT])
                owner.append(i)
        if not parts:
            return out
        sizes = np.array([len(p) for p in parts])
        order = np.argsort(-sizes, kind="stable")
        sizes, owner = sizes[order], np.array(owner)[order]
        grid = np.zeros((sizes[0], len(parts)), np.int32)
        for column, k in enumerate(order):
            grid[: len(parts[k]), column] = parts[k]
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")   # segments longer than each step
        count = np.zeros((len(self.langs), len(parts)), np.int32)
        for k in range(len(self.langs)):
            state = np.ones(len(parts), np.int64)
            restart, tally = self.restart[k], count[k]
            table, width = self.tables[k].ravel(), self.tables[k].shape[1]
            mine = self.own[k][grid]
            tally += 1
            for step in range(sizes[0]):
                n = active[step]
                c = mine[step, :n]
                to = table[state[:n] * width + c]
                failed = to == 0
                tally[:n] += failed
                state[:n] = np.where(failed, restart[c], to)
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner, count[k], len(texts))
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of every text and its bits per letter in every language."""
        codes = [self.codes(t) if t else np.zeros(0, np.int32) for t in texts]
        n = np.array([len(c) for c in codes])
        return n, self.phrases(codes) * self.bits / np.maximum(n, 1)[:, None]

    def classify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Nearest language, confidence, and whether the text is foreign to all of them."""
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        n, entropy = self.entropies(texts)
        weight = np.exp2(-2 * (entropy - entropy.min(1, keepdims=True)))
        score = np.where(n > 0, weight.max(1) / weight.sum(1), 0.0)
        best = entropy.argmin(1)
        foreign = (n >= CHECK_LETTERS) & (entropy.min(1) > FOREIGN * (self.usual or np.inf))
        return [self.langs[b] if m else UNDETERMINED for b, m in zip(best, n)], score, foreign


def labelled_texts(documents: DataFrame, learn: Column, docs: int = SAMPLE_DOCS, doc_chars: int = SAMPLE_DOC_CHARS) -> list[tuple[str, int, str]]:
    """(lang, rank, text): beginnings of at most ``docs`` labelled documents per language, smallest id hash first.

    Rows that share id and label are one document (its least text). Ranked are only ids whose hash lies so low that
    some ``PICKED`` of the language are expected there, so that no task ranks a language.
    """
    ids = documents.filter(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select(
        "doc_id", "lang", F.xxhash64("doc_id").alias("order"))
    # one row per language; 2^64 hashes
    share = ids.groupBy(F.col("lang").alias("of")).agg((F.lit(float(PICKED)) / F.approx_count_distinct("doc_id")).alias("share"))
    low = F.lit(-2.0 ** 63) + F.col("share") * 2.0 ** 64
    by = Window.partitionBy("lang").orderBy("order", "doc_id")
    ids = (ids.join(broadcast_if_small(cut_lineage(share, "language-shares")), F.col("lang") == F.col("of"))
           .filter(F.col("order") <= low).select("doc_id", "lang", "order").distinct()
           .withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= docs).select("doc_id", "lang", "rank"))
    # at most ``docs`` ids per language: a fixed bound; the texts are read for these alone, one for each id
    rows = (documents.filter("text is not null").select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"])
            .groupBy("lang", "rank", "doc_id").agg(F.min(F.substring("text", 1, doc_chars)).alias("text")).collect())
    return sorted((r["lang"], r["rank"], r["text"]) for r in rows)


def samples_of(rows: list[tuple[str, int, str]], chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """At most ``chars`` letters per language. A sentence counts once, and not at all if documents of several languages
    hold it."""
    units = [(lang, [u for u in map(letters, _SENTENCE.split(text)) if u]) for lang, _, text in rows]
    # sentences that documents of several languages hold are inserted passages or wrongly labelled copies
    held = Counter(u for _, u in {(lang, u) for lang, own in units for u in own})
    out: dict[str, str] = {}
    seen: set[str] = set()
    for lang, mine in units:
        fresh = [u for u in dict.fromkeys(mine) if held[u] == 1 and u not in seen]
        seen.update(fresh)
        own = " ".join(fresh)[:SAMPLE_SHARE]
        have = out.get(lang, "")
        if own and len(have) < chars:
            out[lang] = (have + " " + own).strip()[:chars]
    equal = max(LEAST_CHARS, min(map(len, out.values()), default=0))
    return {lang: text[:equal] for lang, text in out.items()}


def sample_texts(documents: DataFrame, learn: Column) -> dict[str, str]:
    """The samples of all languages of the admitted rows."""
    return samples_of([r for r in labelled_texts(documents, learn) if r[1] % CHECK_EVERY])


def usual_entropy(samples: dict[str, str], rows: list[tuple[str, int, str]]) -> float | None:
    """The highest of the languages' median entropies over texts that the samples do not hold; None without such texts."""
    parser, own = CrossParser(samples), {}
    for lang, _, text in rows:
        n, entropy = parser.entropies([text])
        if lang in samples and n[0] >= CHECK_LETTERS:
            own.setdefault(lang, []).append(entropy[0, parser.langs.index(lang)])
    return max((float(np.median(e)) for e in own.values()), default=None)


def learned(documents: DataFrame, learn: Column) -> str:
    """The samples and their usual entropy, packed for the workers."""
    rows = labelled_texts(documents, learn)
    samples = samples_of([r for r in rows if r[1] % CHECK_EVERY])
    usual = usual_entropy(samples, [r for r in rows if r[1] % CHECK_EVERY == 0])
    return json.dumps({"samples": samples, "usual": usual}, sort_keys=True)


def _parser(packed: str) -> CrossParser:
    return worker_model(("cross-parser", packed), lambda: CrossParser(**json.loads(packed)))


def identify(documents: DataFrame, packed: str) -> DataFrame:
    """The documents' own columns plus ``lang_pred``, ``score`` and ``is_foreign``, one row per document.

    Own columns of these names are replaced.
    """
    documents = documents.drop("lang_pred", "score", "is_foreign")
    names = documents.columns

    def parse(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                pred, score, foreign = _parser(packed).classify(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(foreign)],
                                                 names=[*names, "lang_pred", "score", "is_foreign"])

    schema = T.StructType([*documents.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("is_foreign", T.BooleanType())])
    return documents.mapInArrow(parse, schema)


def predict(documents: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Contract form: learn outside the held-out fold, predict every document."""
    packed = learned(documents, fold_of("doc_id", folds) != held)
    # keep columns of the caller out of the parser; the fold is no input of the prediction
    judged = identify(documents.select("doc_id", "text"), packed)
    return judged.select("doc_id", (fold_of("doc_id", folds) == held).alias("held_out"), "lang_pred", "score", "is_foreign")


def keep_identified(documents: DataFrame) -> DataFrame:
    """Pipeline form: rows whose language is determined and none of the unlearned ones, columns unchanged."""
    # positional names: columns of the caller may have any name
    names = documents.columns
    inner = documents.toDF(*[f"c{i}" for i in range(len(names))])
    inner = inner.withColumnRenamed(f"c{names.index('text')}", "text")
    judged = identify(inner, learned(documents, fold_of("doc_id", 3) != 1))
    kept = judged.filter((F.col("lang_pred") != UNDETERMINED) & ~F.col("is_foreign"))
    return kept.drop("lang_pred", "score", "is_foreign").toDF(*names)
