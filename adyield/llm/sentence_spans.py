"""Substring deduplication by sliding spans of sentences.

A text is cut into sentences: behind ``. ! ?`` before white space and behind the
full stops, question and exclamation marks of other scripts, all with closing
quotes and brackets, and behind lines. White space belongs to the sentence
before it, so every sentence has words. Where no stop comes for more than
``MAX_WORDS`` words the sentence is cut on, before words chosen by their hashes
alone (the least of any ``WINDOW`` consecutive ones), so that a passage inside
longer text or without stops is cut alike wherever it stands. For every such
unit, the shortest run of at least ``MIN_UNITS`` consecutive units with at
least ``MIN_WORDS`` words that begins with it, and the one that ends with it,
are hashed (words only, A-Z lower-cased; in scripts written without blanks
every letter is hashed and counts as half a word). Runs are joined over all
documents; the first occurrence (smallest doc_id, then first position) stays,
and every unit that a later occurrence covers is removed.

A repeated passage is found from ``MIN_WORDS`` words in whole units on; shorter
common phrases, headings and lines are left alone.

The join moves one (hash, doc_id, text hash) row per distinct run of a
document; hot runs are counted by map-side aggregation and their join is split
by AQE. Null texts have no units and come back null with 0 removed; null ids
come after all others. Every row is a document of its own: rows that share an
id (or have none) follow one another by text hash, and of rows equal in both
one is the first and the others lose every run. Only the latter, rows equal in
id and text, are numbered in one task (sorted, not collected).
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import Words, forget_model, mix, slices

MIN_UNITS, MIN_WORDS = 2, 36
MAX_WORDS = 16               # sentences of more words are cut on
WINDOW = 12                  # of any so many consecutive words of such a sentence, the one with the least hash begins a unit
_ASCII = ".!?"
# Full stops, question and exclamation marks and verse ends of other scripts, which need no white space after them.
_OTHER = ("\u037E\u0589\u061D-\u061F\u06D4\u0700-\u0702\u07F9\u0837\u0839\u083D\u083E\u0964\u0965\u0DF4\u0E5A\u0E5B\u0F08"
          "\u0F0D-\u0F12\u104A\u104B\u1362\u1367\u1368\u166E\u1735\u1736\u17D4\u17D5\u1803\u1809\u1944\u1945\u1AA8-\u1AAB"
          "\u1B5A\u1B5B\u1B5E\u1B5F\u1C3B\u1C3C\u1C7E\u1C7F\u203C\u203D\u2026\u2047-\u2049\u2E2E\u2E3C\u2E53\u2E54\u3002\uA4FF"
          "\uA60E\uA60F\uA6F3\uA6F7\uA876\uA877\uA8CE\uA8CF\uA92F\uA9C8\uA9C9\uAA5D-\uAA5F\uAAF0\uAAF1\uABEB\uFE12\uFE15"
          "\uFE16\uFE19\uFE52\uFE56\uFE57\uFF01\uFF0E\uFF1F\uFF61\U00010A56\U00010A57\U00011047\U00011048\U000110BE-\U000110C1"
          "\U00011141-\U00011143\U000111C5\U000111C6\U000111DE\U000111DF\U00011238-\U0001123C\U0001144B-\U0001144D"
          "\U000115C2-\U000115C5\U00011641\U00011642\U0001E95E\U0001E95F")
_LINE = "\n\r\x85\u2028\u2029"
_CLOSE = "\"'" + "".join(re.escape(chr(c)) for c in range(0x10000) if unicodedata.category(chr(c)) in ("Pe", "Pf", "Pi"))
# a run of ASCII stops is looked at from its first only, so that long runs cost no more than their length
_END = re.compile(rf"[{_ASCII}{_OTHER}{_LINE}](?:(?<=[{_LINE}])\s*|(?<=[{_OTHER}])[{_ASCII}{_OTHER}]*[{_CLOSE}]*\s*"
                  rf"|(?<![{_ASCII}][{_ASCII}])[{_ASCII}]*[{_CLOSE}]*\s+)")


def _sentences(text: str) -> list[str]:
    """The text cut behind stops and lines; white space stays with what it follows, at the start with the first unit."""
    out, at = [], 0
    for m in _END.finditer(text, len(text) - len(text.lstrip(" \t\n\v\f\r"))):
        out.append(text[at: m.end()])
        at = m.end()
    if at < len(text):
        out.append(text[at:])
    return out


class Units:
    """The units of several texts: ``upto`` words and ``weight`` before each unit, ``first`` unit of each text."""

    def __init__(self, texts: list[str | None]):
        whole = [_sentences(t or "") for t in texts]
        self.flat = [u for text in whole for u in text]
        self.sizes = np.array([len(t) for t in whole], np.int64)
        self.words = words = Words(self.flat, unspaced=True)
        weight = np.concatenate([[0], np.cumsum(2 - words.letter)]).astype(np.int64)
        self.begins = begins = self._cuts(weight)
        unit = words.text[begins]
        self.cuts = np.searchsorted(unit, np.arange(len(self.flat) + 1))       # of begins, by sentence
        self.upto = np.append(np.sort(np.concatenate([words.first[:-1], begins])), len(words.hash)).astype(np.int64)
        self.weight = weight[self.upto]
        text = np.repeat(np.arange(len(texts)), self.sizes)
        self.first = np.concatenate([[0], np.cumsum(self.sizes + np.bincount(text[unit], minlength=len(texts)))]).astype(np.int64)
        self.sentence = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    def _cuts(self, weight: np.ndarray) -> np.ndarray:
        """Words inside long sentences that begin a unit: the least hash of some WINDOW words (the last of equal ones)."""
        words = self.words
        long = np.diff(weight[words.first]) > 2 * MAX_WORDS
        at = np.flatnonzero(long[words.text])
        own, h = words.text[at], words.hash[at]
        reach = np.ones(len(at), np.int8)
        left, right = np.ones(len(at), bool), np.ones(len(at), bool)
        for k in range(1, min(WINDOW, len(at))):
            same, least = own[k:] == own[:-k], h[k:] <= h[:-k]
            left[k:] &= same & least
            left[:k] = False
            right[:-k] &= same & ~least
            right[-k:] = False
            reach += left
            reach += right
        return at[(reach >= WINDOW) & (at > words.first[own])]

    def strings(self, i: int) -> list[str]:
        """The units of text i; joined they give the text."""
        out = []
        for k in range(self.sentence[i], self.sentence[i + 1]):
            if self.cuts[k] == self.cuts[k + 1]:
                out.append(self.flat[k])
                continue
            raw = self.flat[k].encode("utf-8", "surrogatepass")
            at = (self.words.starts[self.begins[self.cuts[k]: self.cuts[k + 1]]] - self.words.offsets[k]).tolist()
            out += [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *at], [*at, len(raw)])]
        return out


def cut(text: str) -> list[str]:
    """The units of a text, ends and following white space included; joined they give the text."""
    return Units([text]).strings(0)


def runs(units: Units) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For each text: the start unit, end unit (exclusive) and hash of every run."""
    first, upto, weight, words = units.first, units.upto, units.weight, units.words
    size = len(upto) - 1
    # running polynomial over all words: the hash of any word range is a difference, freed from its offset
    n = len(words.hash)
    step = np.full(n + 1, 0xD6E8FEB86659FD93 | 1, np.uint64)
    step[0] = 1
    up = np.multiply.accumulate(step)
    step[1:] = pow(0xD6E8FEB86659FD93 | 1, -1, 1 << 64)
    down = np.multiply.accumulate(step)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash * up[:n], dtype=np.uint64)])
    unit = np.arange(size)
    ends = np.maximum(np.searchsorted(weight, weight[:-1] + 2 * MIN_WORDS, "left"), unit + MIN_UNITS)
    starts = np.minimum(np.searchsorted(weight, weight[1:] - 2 * MIN_WORDS, "right") - 1, unit + 1 - MIN_UNITS)
    out = ([], [], [])
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        own = unit[a:b]
        ahead, back = own[ends[a:b] <= b], own[starts[a:b] >= a]
        pairs = np.unique(np.concatenate([ahead * (size + 1) + ends[ahead], starts[back] * (size + 1) + back + 1]))
        s, e = pairs // (size + 1), pairs % (size + 1)
        h = mix((run[upto[e]] - run[upto[s]]) * down[upto[s]] + (upto[e] - upto[s]).astype(np.uint64))
        for part, v in zip(out, (s - a, e - a, h)):
            part.append(v)
    return out


def _parts(batches):
    forget_model()
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            yield part, Units(part.column("text").to_pylist())


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def run_hashes(documents: DataFrame) -> DataFrame:
    """(hash, doc_id, text_hash): the distinct runs of every document."""
    kind = dict(documents.dtypes)["doc_id"]

    def spans(batches):
        for part, units in _parts(batches):
            _, _, hashes = runs(units)
            own = [np.unique(h) for h in hashes]
            ids = pa.array(np.repeat(np.arange(len(own)), [len(h) for h in own]))
            yield pa.RecordBatch.from_pydict({
                "hash": pa.array(np.concatenate(own).view(np.int64)), "doc_id": part.column("doc_id").take(ids),
                "text_hash": part.column("text_hash").take(ids)})

    return _texts(documents).mapInArrow(spans, f"hash long, doc_id {kind}, text_hash long")


def _key(rows: DataFrame) -> list[Column]:
    """A row's id (null apart from empty) and text hash, never null."""
    return [rows["doc_id"].isNull().alias("none"), F.coalesce(rows["doc_id"].cast("string"), F.lit("")).alias("id_text"),
            rows["text_hash"]]


def later_runs(documents: DataFrame) -> DataFrame:
    """(none, id_text, text_hash, hashes): the runs of a document that an earlier document with another id or text holds."""
    hashes = run_hashes(documents)
    none = F.col("doc_id").isNull().alias("none")
    # written, so that the join below has a plain shuffle on either side and a hot passage's rows can be split
    firsts = cut_lineage(hashes.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct(none, "doc_id", "text_hash")).alias("first"))
                         .filter("n > 1").select("hash", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_text")),
                         "span-firsts")
    later = hashes.join(firsts, "hash").filter(
        ~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_text"))))
    # bounded by the runs of one text
    return later.select(*_key(later), "hash").groupBy("none", "id_text", "text_hash").agg(F.collect_set("hash").alias("hashes"))


def dedup(documents: DataFrame) -> DataFrame:
    """The documents' columns with repeated passages removed from ``text``, plus n_units and n_removed.

    Own columns of these two names are replaced.
    """
    names = [c for c in documents.columns if c not in ("n_units", "n_removed")]
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    own = documents.select([F.col(f"`{c}`") for c in names]).toDF(*[f"c{i}" for i in range(len(names))])
    own = own.withColumnsRenamed({f"c{names.index('text')}": "text", f"c{names.index('doc_id')}": "doc_id"})
    later = cut_lineage(later_runs(documents), "span-later")
    key = ["none", "id_text", "text_hash"]
    # equal rows by their other columns, where these can be hashed
    others = [c for c in own.columns if c not in ("doc_id", "text") and "map<" not in dict(own.dtypes)[c]]
    rows = own.withColumn("text_hash", F.xxhash64("text"))
    rows = rows.select(*own.columns, *_key(rows), F.xxhash64(*others).alias("rest") if others else F.lit(0).alias("rest"))
    # numbered before the join, by its key: one exchange serves both
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy(*key).orderBy("rest")))
    rows = rows.join(later, key, "left").drop(*key, "rest")
    kept = own.columns

    def rewrite(batches):
        for part, units in _parts(batches):
            starts, ends, hashes = runs(units)
            texts, removed = [], []
            copies = part.column("copy").to_pylist()
            for i, seen in enumerate(part.column("hashes").to_pylist()):
                gone = np.zeros(units.first[i + 1] - units.first[i] + 1, np.int64)
                h = hashes[i]
                again = np.ones(len(h), bool)
                again[np.unique(h, return_index=True)[1]] = False          # later in the same text: runs come by start
                if copies[i] > 1:
                    again[:] = True
                elif seen:
                    again |= np.isin(h, np.array(seen, np.int64).view(np.uint64))
                np.add.at(gone, starts[i][again], 1)
                np.add.at(gone, ends[i][again], -1)
                drop = np.cumsum(gone)[:-1] > 0
                removed.append(int(drop.sum()))
                text = part.column("text")[i].as_py()
                texts.append("".join(u for u, d in zip(units.strings(i), drop) if not d) if drop.any() else text)
            columns = {c: part.column(c) if c != "text" else pa.array(texts, pa.string()) for c in kept}
            yield pa.RecordBatch.from_pydict(columns | {
                "n_units": pa.array(np.diff(units.first), pa.int64()), "n_removed": pa.array(removed, pa.int64())})

    where = dict(zip(own.columns, names))
    schema = ", ".join(f"{c} {kinds[where[c]]}" for c in kept) + ", n_units long, n_removed long"
    return rows.mapInArrow(rewrite, schema).toDF(*names, "n_units", "n_removed")


def without_repeats(documents: DataFrame) -> DataFrame:
    """Pipeline form: texts without repeated passages, columns unchanged; n_chars follows the new text.

    A document of which nothing is left goes.
    """
    names = documents.columns
    done = dedup(documents).filter("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    if "n_chars" in names:
        kind = dict(documents.dtypes)["n_chars"]
        done = done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(kind))
                               .otherwise(F.col("n_chars")))
    return done.select([F.col(f"`{c}`") for c in names])
