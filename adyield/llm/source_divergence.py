"""Source divergence audit: how far each source's wording lies from its language's other sources.

Texts are lowered and blanked by one ``bytes.translate`` table (A-Z to a-z, every other ASCII byte that is no
letter to a blank; bytes of longer UTF-8 sequences stay), cut by ``bytes.split`` and counted by a ``Counter`` per
document. A worker adds the documents of a (lang, source) group up before anything is shuffled, so what moves is
sparse: one row per group and term that occurs. Texts of any length are counted in pieces cut at blanks.

A language keeps the terms found in at least ``LEAST_DOCS`` of its documents (rows). With V kept terms, every group and
every language gives each of them the smoothed share ``p = 1 + floor(SCALE * (count + 2) / (N + 2 * V))``; a pair's
surprise at a term is ``floor((p - q)^2 / (p + q))``. All of it is integer arithmetic (decimals where products pass
64 bits).

Pairs of sources are compared in tiles: ``TILE`` sources a side, ``TERMS`` terms deep, each tile a small dense matrix
whose cells default to the share of a count of 0; tiles give one sum per pair of sources. Terms that neither side of a
tile holds enter by their number. Neither a hot language nor a hot source meets in one task.

Nulls in text, lang and source count as empty text. Repeated rows are documents of their own. Groups without terms take
part with counts of 0; a language without kept terms has pairs of value 0 and no terms. Ties rank by the item's bytes.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.common import broadcast_if_small
from ..session import cut_lineage
from .common import forget_model, slices

LEAST_DOCS = 10
TOP = 10                     # ranks of the part ``term``
SCALE = 1_000_000_000
TILE = 128                   # sources on either side of a tile
TERMS = 1_024                # terms of a tile
PIECE = 1 << 22              # bytes split at once
HELD = 400_000               # terms that a worker adds up before it hands them on
_TIMES = 40                  # a sum holds a term's documents in its lowest bits, its occurrences above

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
TABLE = bytes(b + 32 if 65 <= b < 91 else b if b in _LETTERS else 32 for b in range(256))


def split_pieces(raw: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces of about ``size`` bytes that end at blanks."""
    raw, at = raw.translate(TABLE), 0
    while len(raw) - at > size:
        cut = raw.rfind(b" ", at, at + size)
        if cut <= at:
            cut = raw.find(b" ", at + size)
        if cut < 0:
            break
        yield raw[at:cut].split()
        at = cut
    yield raw[at:].split()


def term_counts(raw: bytes) -> Counter:
    """Occurrences of every term of one text."""
    found: Counter = Counter()
    for terms in split_pieces(raw):
        found.update(terms)
    return found


def cells(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group that holds it."""
    texts = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def run(batches):
        forget_model()
        held: dict[tuple[str, str], dict[bytes, int]] = {}

        def rows():
            for (lang, source), sums in held.items():
                both = np.fromiter(sums.values(), object, len(sums))
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(sums), pa.string()), "source": pa.array([source] * len(sums), pa.string()),
                    "term": pa.array(list(sums), pa.binary()), "n": pa.array(both >> _TIMES, pa.int64()),
                    "docs": pa.array(both & ((1 << _TIMES) - 1), pa.int64())})
            held.clear()

        size = 0
        for batch in batches:
            for part in slices(batch, "text"):
                groups = zip(part.column("lang").to_pylist(), part.column("source").to_pylist())
                for key, raw in zip(groups, part.column("text").cast(pa.binary()).to_pylist()):
                    sums = held.setdefault(key, {})
                    before, get = len(sums), sums.get
                    for term, times in term_counts(raw).items():
                        sums[term] = get(term, 0) + (times << _TIMES) + 1
                    size += len(sums) - before
                if size > HELD:
                    yield from rows()
                    size = 0
        yield from rows()

    found = texts.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    # the workers have added up what meets in a task; a second sum before the shuffle would find next to nothing
    return (found.withColumn("term", F.col("term").cast("string")).repartition("lang", "source", "term")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share(n: str, total: str, kept: str):
    """p of a count: exact at any size of the counts."""
    return F.expr(f"1 + cast(((cast({n} as decimal(20, 0)) + 2) * {SCALE}) "
                  f"div greatest(cast({total} as decimal(20, 0)) + 2 * {kept}, 1) as long)")


def surprise(p: str, q: str):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _tile(rows: pa.Table) -> pa.Table:
    """Sums over one block of terms for the pairs of sources of one tile.

    Rows without a term name the tile's sources (their share of a count of 0, their side and the block's number of terms).
    """
    lang, block, a, b = (rows.column(c)[0] for c in ("lang", "block", "a", "b"))
    named, found = rows.filter(rows.column("term").is_null()), rows.filter(rows.column("term").is_valid())
    names = named.column("source").to_pylist()
    own = {s: i for i, s in enumerate(names)}
    terms: dict[str, int] = {}
    columns = [terms.setdefault(t, len(terms)) for t in found.column("term").to_pylist()]
    zero = named.column("p").to_numpy()
    p = np.repeat(zero[:, None], len(terms) + 1, 1)             # the last column: terms that nobody here holds
    p[[own[s] for s in found.column("source").to_pylist()], columns] = found.column("p").to_numpy()
    weight = np.ones(len(terms) + 1, np.int64)
    weight[-1] = named.column("n_terms")[0].as_py() - len(terms)
    tile = named.column("tile").to_numpy()
    left, right = np.flatnonzero(tile == a.as_py()), np.flatnonzero(tile == b.as_py())
    x, y, value = [], [], []
    for i in left:
        others = right if a != b else right[right > i]
        gap = p[others] - p[i]
        sums = (gap * gap // (p[others] + p[i])) @ weight
        x += [names[i]] * len(others)
        y += [names[j] for j in others]
        value += sums.tolist()
    return pa.table({"lang": pa.array([lang.as_py()] * len(x), pa.string()), "x": pa.array(x, pa.string()),
                     "y": pa.array(y, pa.string()), "value": pa.array(value, pa.int64())})


def _pairs(groups: DataFrame, terms: DataFrame, held: DataFrame) -> DataFrame:
    """(lang, source, item, value) of both directions of every pair of sources of a language."""
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    tiled = groups.join(broadcast_if_small(cut_lineage(tiles, "divergence-tiles")), "lang").withColumn(
        "tile", F.pmod(F.xxhash64("source"), "tiles"))
    placed = terms.withColumn("block", F.pmod(F.xxhash64("term"), F.ceil(F.col("kept") / TERMS)))
    blocks = placed.groupBy("lang", "block").agg(F.count("*").alias("n_terms"))
    other = lambda df: (df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
                        .withColumn("a", F.least("tile", "other")).withColumn("b", F.greatest("tile", "other")))
    columns = ["lang", "block", "a", "b", "source", "tile", "term", "p", "n_terms"]
    # every block names every source of the tile, whether it holds one of the block's terms or not
    named = other(tiled.join(blocks, "lang", "left")).select(
        "lang", F.coalesce("block", F.lit(0)).alias("block"), "a", "b", "source", "tile", F.lit(None).cast("string").alias("term"),
        F.col("zero").alias("p"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"))
    where = tiled.select("lang", "source", "tile", "tiles")
    found = other(held.withColumn("block", F.pmod(F.xxhash64("term"), F.ceil(F.col("kept") / TERMS)))
                  .join(where, ["lang", "source"])).select(
        "lang", "block", "a", "b", "source", "tile", "term", "p", F.lit(0).cast("long").alias("n_terms"))
    sums = (named.select(columns).unionByName(found.select(columns)).groupBy("lang", "block", "a", "b")
            .applyInArrow(_tile, "lang string, x string, y string, value long")
            .groupBy("lang", "x", "y").agg(F.sum("value").alias("value")))
    ways = F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")),
                   F.struct(F.col("y").alias("source"), F.col("x").alias("item")))
    return sums.select("lang", F.explode(ways).alias("way"), "value").select("lang", "way.source", "way.item", "value")


def audit(documents: DataFrame) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank: see the module's text."""
    found = cut_lineage(cells(documents), "divergence-cells")
    terms = found.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).filter(
        F.col("docs") >= LEAST_DOCS).select("lang", "term", F.col("n").alias("lang_n"))
    terms = cut_lineage(terms, "divergence-terms")
    # one row per language
    langs = broadcast_if_small(cut_lineage(terms.groupBy("lang").agg(
        F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total")), "divergence-langs"))
    terms = terms.join(langs, "lang").withColumn("q", share("lang_n", "lang_total", "kept"))
    held = cut_lineage(found.join(terms.select("lang", "term", "kept", "q"), ["lang", "term"])
                       .select("lang", "source", "term", "n", "kept", "q"), "divergence-held")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = (every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
              .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("group_kept"))
              .withColumn("zero", share("0", "total", "group_kept")))
    groups = cut_lineage(groups, "divergence-groups")
    held = (held.join(broadcast_if_small(groups.select("lang", "source", "total")), ["lang", "source"])
            .withColumn("p", share("n", "total", "kept")))
    words = (held.filter("p > q").select("lang", "source", F.col("term").alias("item"), surprise("p", "q").alias("value")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = words.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    pairs = _pairs(groups, terms, held).withColumn("rank", F.row_number().over(order))
    out = pairs.withColumn("part", F.lit("pair")).unionByName(top.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def oracle() -> str:
    """The same audit in DuckDB SQL over ``documents``."""
    p = f"1 + (CAST({SCALE} AS HUGEINT) * (n + 2)) // (total + 2 * v)"
    f = "(p - q) * (p - q) // (p + q)"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
occ AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM occ GROUP BY 1, 2 HAVING count(DISTINCT r) >= {LEAST_DOCS}),
langs AS (SELECT lang, term, n, sum(n) OVER (PARTITION BY lang) AS total, count(*) OVER (PARTITION BY lang) AS v FROM kept),
langq AS (SELECT lang, term, v, {p} AS q FROM langs),
counts AS (SELECT lang, source, term, count(*) AS n FROM occ GROUP BY 1, 2, 3),
dense AS (
  SELECT g.lang, g.source, k.term, k.v, k.q, coalesce(c.n, 0) AS n
  FROM groups g JOIN langq k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (
  SELECT lang, source, term, n, q, {p} AS p
  FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total FROM dense)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
words AS (SELECT lang, source, term AS item, {f} AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT *, 'term' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM words)
WHERE part = 'pair' OR rank <= {TOP}"""
