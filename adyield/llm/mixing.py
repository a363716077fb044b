"""Mix sources to target weights by fixed-length token blocks.

Every source's words are laid end to end in document order and cut into
blocks of ``BLOCK`` words. The mix is a sequence of output shards of
``SHARD_BLOCKS`` slots; the number of slots that a shard gives each source is
drawn from a multinomial over what the sources still owe. The draws halve the
range of shards again and again, each half seeded by its bounds, so any task
can draw the shards it needs and the totals still meet the targets. Slot i of
a source maps through a pseudorandom permutation of its block numbers (one
per pass over the source) to a block, and slots join blocks by (source,
block). The result is read from the joined rows (shard, place, words). A
source's last slot is cut to the words that it still owes, so what it gives is
its target rounded to a word, and a block is taken at most once per pass, so no
document exceeds ``MAX_EPOCHS`` times its size.

Sources by code point, null last, weigh ``WEIGHTS`` in turn and share all
words; a target stops at ``MAX_EPOCHS`` times its source's size and the
excess is shared again by weight. A null source is a source of its own, a
null text has size 0 and takes nothing. Repeated rows are documents of their
own. Documents are laid out by a hash chunk, then id and text hash, so
reruns agree whatever the partitioning. An empty table gives an empty mix.
Other columns are carried by ``mixed`` and not read. Numbers per source (one
small row per source) are the only thing that the driver and the tasks hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.common import broadcast_if_small
from ..session import cut_lineage
from .common import WORD, forget_model, row_key, slices

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK = 64
SHARD_BLOCKS = 4096          # slots of an output shard
DRAWN = 16                   # shards drawn from one row
CHUNK_ROWS = 2_000          # documents of a chunk of the layout: the number of chunks follows the table
SALTED = 1_000               # copies of a row that stay together


def targets(sizes: list[int], weights=WEIGHTS, cap: int = MAX_EPOCHS) -> list[float]:
    """Shares of the total by weight, stopped at ``cap`` times the size; the excess goes by weight to the rest."""
    n = len(sizes)
    w = [weights[i % len(weights)] for i in range(n)]
    out, free, left = [0.0] * n, set(range(n)), float(sum(sizes))
    while free:
        unit = left / sum(w[i] for i in free)
        over = [i for i in sorted(free) if unit * w[i] > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = unit * w[i]
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            left -= out[i]
            free.discard(i)
    return out


def _split(owed: np.ndarray, want: int, rng: np.random.Generator) -> np.ndarray:
    """``want`` slots drawn from a multinomial over what is owed; what a source cannot give is drawn again."""
    got = np.zeros_like(owed)
    while want > 0:
        rest = owed - got
        draw = np.minimum(rng.multinomial(want, rest / rest.sum()), rest)
        got += draw
        want -= int(draw.sum())
    return got


def shard_draws(owed: np.ndarray, shards: int, seed: int, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, slots per source before it, slots per source) of the shards ``first`` to ``last`` - 1."""
    owed = np.asarray(owed, np.int64)
    total = int(owed.sum())
    todo = [(0, shards, owed, np.zeros_like(owed))]
    while todo:
        low, high, mine, before = todo.pop()
        if high <= first or low >= last:
            continue
        if high - low == 1:
            yield low, before, mine
            continue
        mid = (low + high) // 2
        left = _split(mine, total * mid // shards - total * low // shards, np.random.default_rng([seed, low, high]))
        todo += [(mid, high, mine - left, before + left), (low, mid, left, before)]


def _round(half_word: np.ndarray, key: np.ndarray, r: int, mask: np.ndarray) -> np.ndarray:
    f = (half_word + key + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
    f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (f >> np.uint64(32)) & mask


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """A keyed permutation of 0..size-1 applied elementwise (``back``: its inverse): four Feistel rounds, walked until
    inside."""
    size = np.maximum(size, 1)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    key = key.astype(np.uint64)
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for r in reversed(range(4)) if back else range(4):
            if back:
                left, right = right ^ _round(left, key[todo], r, mask[todo]), left
            else:
                left, right = right, left ^ _round(right, key[todo], r, mask[todo])
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def pass_key(source_no, turn, seed: int):
    """The key of a source's permutation in one pass."""
    return (source_no * 1_000_003 + turn) * 7919 + seed


def slots_owed(sizes: list[int], want: list[float], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Per source: the slots that give its target in words, and the words of the last of them.

    A pass gives the source once; the last, incomplete one takes slots until the words suffice, wherever its
    permutation puts the source's last, shorter block.
    """
    size = np.array(sizes, np.int64)
    owed = np.minimum(MAX_EPOCHS * size, np.rint(want).astype(np.int64))
    blocks = -(-size // BLOCK)
    short = blocks * BLOCK - size
    turns, rest = owed // np.maximum(size, 1), owed % np.maximum(size, 1)
    at = permute(np.maximum(blocks - 1, 0), blocks, pass_key(np.arange(len(size)), turns, seed), back=True) if len(size) else size
    given = lambda n: n * BLOCK - np.where(at < n, short, 0)
    more = -(-rest // BLOCK)
    more += given(more) < rest
    # a source without a rest ends with a whole block: no slot is cut
    return turns * blocks + more, np.where(rest > 0, rest - given(np.maximum(more - 1, 0)), BLOCK)


def _positional(documents: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table under names that cannot clash, and the new names of the columns that the mix reads."""
    names = documents.columns
    return documents.toDF(*[f"c{i}" for i in range(len(names))]), {c: f"c{i}" for i, c in enumerate(names)}


def layout(documents: DataFrame) -> DataFrame:
    """Every row's id, source, size and the place of its first word in its source, numbered (``row``), written.

    Rows that are equal in all columns are laid out as one entry of ``copies`` times its size and then spread, so
    that no task gathers them.
    """
    own, at = _positional(documents)
    words = F.coalesce(F.regexp_count(at["text"], F.lit(WORD)), F.lit(0)).cast("long")
    entry = ["rkey", "doc_id", "source", "size", "text_hash"]
    entries = own.select(row_key(*own.columns).alias("rkey"), F.col(at["doc_id"]).alias("doc_id"), F.col(at["source"]).alias("source"),
                         words.alias("size"), F.xxhash64(at["text"]).alias("text_hash")).groupBy(*entry).agg(F.count("*").alias("copies"))
    entries = cut_lineage(entries, "mix-sizes")
    chunks = max(1, -(-entries.count() // CHUNK_ROWS))
    entries = entries.withColumn("chunk", F.pmod(F.xxhash64("rkey"), F.lit(chunks)).cast("int"))
    length = F.col("size") * F.col("copies")
    # at most ``chunks`` rows per source
    totals = entries.groupBy("source", "chunk").agg(F.sum(length).alias("chunk_size"))
    upto = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("s"), F.col("chunk").alias("c"),
                           F.coalesce(F.sum("chunk_size").over(upto), F.lit(0)).alias("chunk_first"))
    within = (Window.partitionBy("source", "chunk").orderBy("doc_id", "text_hash", "rkey")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = entries.withColumn("before", F.coalesce(F.sum(length).over(within), F.lit(0)))
    placed = placed.join(totals, (placed["chunk"] == totals["c"]) & placed["source"].eqNullSafe(totals["s"])).withColumn(
        "entry_first", F.col("chunk_first") + F.col("before"))
    # a large group of copies is cut into runs that are dealt out before they are spread
    cut = lambda df, size: df.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(size).cast("long"))))
    each = F.explode(F.sequence("copy", F.least(F.col("copies"), F.col("copy") + SALTED) - 1))
    many = cut(placed.filter(F.col("copies") > SALTED), SALTED).repartition("rkey", "copy").withColumn("copy", each)
    found = cut(placed.filter(F.col("copies") <= SALTED), 1).unionByName(many)
    return cut_lineage(found.select("doc_id", "source", "size", "rkey", "copies", "copy",
                                    (F.col("entry_first") + F.col("copy") * F.col("size")).alias("first_word"))
                       .withColumn("row", F.monotonically_increasing_id()), "mix-layout")


def slots(sources: list[tuple[int, float]], spark, seed: int = 7) -> DataFrame:
    """The mix in output order, (shard, place, source_no, turn, block, words), for the sources' (size, target).

    ``words``: how many of the block's words are taken, from its first on; less than the block has only in a source's
    last slot.
    """
    size = np.array([s for s, _ in sources], np.int64)
    blocks = -(-size // BLOCK)
    owed, last = slots_owed([s for s, _ in sources], [t for _, t in sources], seed)
    shards = -(-int(owed.sum()) // SHARD_BLOCKS)

    def draw(batches):
        forget_model()
        for batch in batches:
            for first in batch.column("id").to_pylist():
                for shard, before, n in shard_draws(owed, shards, seed, first * DRAWN, (first + 1) * DRAWN):
                    no = np.repeat(np.arange(len(n)), n)
                    slot = np.arange(len(no)) - np.repeat(np.cumsum(n) - n, n) + before[no]
                    turn = slot // blocks[no]
                    block = permute(slot % blocks[no], blocks[no], pass_key(no, turn, seed))
                    whole = np.minimum(BLOCK, size[no] - block * BLOCK)
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array(np.full(len(no), shard), pa.int64()),
                        "place": pa.array(np.random.default_rng([seed, shard]).permutation(len(no)), pa.int32()),
                        "source_no": pa.array(no, pa.int32()), "turn": pa.array(turn, pa.int32()), "block": pa.array(block, pa.int64()),
                        "words": pa.array(np.where(slot == owed[no] - 1, np.minimum(whole, last[no]), whole), pa.int32())})

    # a set number of partitions: the rows are few until they are drawn, and adaptive planning would put them in one task
    parts = max(1, min(-(-shards // DRAWN), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.range(0, -(-shards // DRAWN), 1, parts).mapInArrow(
        draw, "shard long, place int, source_no int, turn int, block long, words int")


def mix(documents: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(rows, mix).

    ``rows``: the layout with each row's source_size and target. ``mix``: (shard, place, row, turn, begin, words), the
    blocks of the mix in output order, joined to the documents that they are cut from: ``words`` words of the
    document from its word ``begin`` on.
    """
    spark = documents.sparkSession
    placed = layout(documents)
    # one row per source
    found = placed.groupBy("source").agg(F.sum("size").cast("long").alias("size")).collect()
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    want = targets(sizes)
    # an Arrow table goes to the JVM as it is: no Python worker takes part
    sources = spark.createDataFrame(pa.table({
        "s": pa.array([r["source"] for r in found], pa.string()), "source_no": pa.array(range(len(found)), pa.int32()),
        "source_size": pa.array(sizes, pa.int64()), "target": pa.array(want, pa.float64())}))
    rows = placed.join(broadcast_if_small(sources), placed["source"].eqNullSafe(sources["s"])).drop("s", "source")
    last = F.col("first_word") + F.col("size") - 1
    cut = rows.filter("size > 0").select("row", "source_no", "first_word", last.alias("last_word"), F.explode(
        F.sequence(F.floor(F.col("first_word") / BLOCK), F.floor(last / BLOCK))).alias("block"))
    drawn = slots(list(zip(sizes, want)), spark, seed)
    begin = F.greatest("first_word", F.col("block") * BLOCK)
    end = F.least(F.col("last_word") + 1, F.col("block") * BLOCK + F.col("words"))
    # a block holds at most ``BLOCK`` documents with words and is drawn at most ``MAX_EPOCHS`` times
    # merged: the planner knows the rows that slots are drawn from, not how many come of them
    joined = cut.hint("merge").join(drawn, ["source_no", "block"]).filter(end > begin).select(
        "shard", "place", "row", "turn", (begin - F.col("first_word")).alias("begin"), (end - begin).alias("words"))
    return rows, joined


def taken(documents: DataFrame, seed: int = 7) -> DataFrame:
    """One row per document: size, source_size, target and the words that the mix takes of it."""
    rows, found = mix(documents, seed)
    got = found.groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(got, "row", "left").select("doc_id", "size", "source_size", "target",
                                                F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def passages(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    """The parts of a text that the mix takes, from (turn, first word, words): neighbours within a turn are one part."""
    at = [m.span() for m in re.finditer(WORD, text)]
    runs: list[list[int]] = []
    for turn, begin, words in sorted(spans):
        if runs and runs[-1][0] == turn and runs[-1][2] == begin:
            runs[-1][2] = begin + words
        else:
            runs.append([turn, begin, begin + words])
    return [text if a == 0 and b == len(at) else text[at[a][0]: at[b - 1][1]] for _, a, b in runs]


def mixed(documents: DataFrame, seed: int = 7) -> DataFrame:
    """Pipeline form: the mix as rows of documents (columns unchanged).

    A document taken whole keeps its text; otherwise every run of neighbouring blocks of a turn is a row with the
    document's id and the run's text, and further turns repeat it. ``n_chars`` follows the text.

    Rows meet their places by a key over all columns. Rows that are equal in all of them share a key: their text is
    kept once and meets all their places, ``SALTED`` of them a task, so a large group of equal rows is never gathered.
    """
    names = documents.columns
    rows, found = mix(documents, seed)
    # bounded by the blocks of one document
    spans = found.groupBy("row").agg(F.collect_list(F.struct("turn", "begin", "words")).alias("spans"))
    place = rows.select("row", "rkey", "copies", "copy").join(spans, "row").withColumn("salt", F.floor(F.col("copy") / SALTED))
    repeated = cut_lineage(rows.filter("copies > 1 and copy = 0").select(
        "rkey", F.ceil(F.col("copies") / SALTED).alias("salts")), "mix-repeated")
    few = broadcast_if_small(repeated)
    own, at = _positional(documents)
    columns = own.columns
    own = own.withColumn("rkey", row_key(*columns))
    single = own.join(few, "rkey", "left_anti").join(place.filter("copies = 1"), "rkey").select(*columns, "spans")
    once = own.join(few, "rkey").groupBy("rkey", "salts").agg(F.first(F.struct(*columns)).alias("own"))
    once = once.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    joined = single.union(once.join(place.filter("copies > 1"), ["rkey", "salt"]).select("own.*", "spans"))
    joined = joined.withColumnRenamed(at["text"], "text")
    kept = [c for c in joined.columns if c != "spans"]
    chars = at.get("n_chars")

    def run(batches):
        forget_model()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                source, texts = [], []
                for i, (text, mine) in enumerate(zip(part.column("text").to_pylist(), part.column("spans").to_pylist())):
                    got = passages(text, [(b["turn"], b["begin"], b["words"]) for b in mine])
                    texts += got
                    source += [i] * len(got)
                take = pa.array(source, pa.int64())
                out = {c: part.column(c).take(take) for c in kept} | {"text": pa.array(texts, pa.string())}
                if chars:
                    out[chars] = pa.array([len(t) for t in texts], pa.int64()).cast(out[chars].type)
                yield pa.RecordBatch.from_pydict({c: out[c] for c in kept})

    schema = joined.select(kept).schema
    return joined.mapInArrow(run, schema).toDF(*names)
