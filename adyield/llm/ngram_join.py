"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document's set holds its distinct word shingles. Equal sets collapse into
one class first. Shingles are ordered rare to frequent by a counting sketch
of fixed size over all documents (any total order is correct; the sketch only
steers cost). Two sets with Jaccard similarity of at least t share at least l
shingles among their first ``n - ceil(t n) + l``; each class picks the l from
1 to ``MAX_MATCHES`` whose prefix has the least estimated cost (postings to
scan plus candidates to verify), and a pair must share as many prefix
shingles as the smaller l of the two before it is verified. Positions are
checked against the pair's own overlap bound, so a shingle that comes too
late in either set makes no candidate.

Links are transitive for the classes wanted here, so pairs inside one
component need no second look: every class is first compared with the leader
of each of its prefix shingles (the member that has it earliest), verified
links join classes into components, and the full join then runs between
different components only. No link that would join two components is lost,
and no group's pairs are all emitted.

Null, empty and blank texts have no shingles and link with nothing. Rows that
repeat (null ids and repeated ids included) stay rows of their own. A class
without any id has a null component.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import components, forget_model, row_key, shingle_sets, slices

SHINGLE = 5
PERCENT = 80                 # similarity threshold, in hundredths
SKETCH_BITS = 19             # counters of the sketch (4 MB when summed): fixed whatever the input
PART = 1 << 14
MAX_MATCHES = 4
SCAN_COST, VERIFY_COST = 1.0, 4.0


def profiles(documents: DataFrame) -> DataFrame:
    """One row per document (rkey, doc_id, n_shingles, signature), and each task's counters in parts."""
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches):
        forget_model()
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text").to_pylist(), SHINGLE)
                every = np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)
                counts += np.bincount(every.astype(np.int64), minlength=len(counts))
                yield pa.RecordBatch.from_pydict({
                    "rkey": part.column("rkey"), "doc_id": part.column("doc_id"),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "signature": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    "part": pa.nulls(len(sets), pa.int32()), "counts": pa.nulls(len(sets), pa.binary())})
        for k in range(0, len(counts), PART):
            if counts[k: k + PART].any():
                yield pa.RecordBatch.from_pydict({
                    "rkey": pa.nulls(1, pa.binary()), "doc_id": pa.nulls(1, batch.column("doc_id").type),
                    "n_shingles": pa.nulls(1, pa.int64()), "signature": pa.nulls(1, pa.binary()),
                    "part": pa.array([k // PART], pa.int32()),
                    "counts": pa.array([counts[k: k + PART].astype("<i4").tobytes()], pa.binary())})

    rows = documents.select(row_key("doc_id", "text").alias("rkey"), "doc_id", "text")
    return rows.mapInArrow(run, f"rkey binary, doc_id {kind}, n_shingles long, signature binary, part int, counts binary")


def _sum_parts(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(PART, np.int64)
    for width, data in zip(rows["width"], rows["counts"]):
        total += np.frombuffer(data, f"<i{width}")
    return pd.DataFrame({"part": [key[0]], "counts": [total.tobytes()]})


def sketch(parts: DataFrame) -> np.ndarray:
    """The tasks' counters summed in two steps (no group grows beyond 1/256 of the tasks, or 256 rows)."""
    some = (parts.select("part", "counts", F.lit(4).alias("width"), F.pmod(F.xxhash64("counts"), F.lit(256)).alias("salt"))
            .groupBy("part", "salt").applyInPandas(_sum_parts, "part int, counts binary"))
    rows = (some.withColumn("width", F.lit(8)).groupBy("part")
            .applyInPandas(_sum_parts, "part int, counts binary").collect())     # 2^SKETCH_BITS counters: fixed
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in rows:
        out[r["part"] * PART: (r["part"] + 1) * PART] = np.frombuffer(r["counts"], "<i8")
    return out


def least_overlap(total: int) -> int:
    """Least intersection of two sets of ``total`` elements together that are similar enough."""
    return -(-PERCENT * total // (100 + PERCENT))


def choose_prefix(tokens: np.ndarray, excess: np.ndarray) -> tuple[np.ndarray, int]:
    """The prefix in global order and the number of shared shingles that it asks for."""
    level = np.floor(np.log2(excess)).astype(np.int64)
    order = np.lexsort((tokens, level))
    tokens, cost = tokens[order], np.cumsum(excess[order])
    n = len(tokens)
    first = n - -(-PERCENT * n // 100) + 1
    best, matches = None, 1
    for m in range(1, MAX_MATCHES + 1):
        size = first + m - 1
        if size > n:
            break
        price = cost[size - 1] * (SCAN_COST + VERIFY_COST / m)
        if best is None or price < best:
            best, matches = price, m
    return tokens[: first + matches - 1], matches


def prefixes(documents: DataFrame, counts: np.ndarray) -> DataFrame:
    """(rkey, n, matches, tokens): the chosen prefix of every document."""
    background = int(np.median(counts)) if len(counts) else 0
    shared = documents.sparkSession.sparkContext.broadcast(counts.astype(np.int64))   # 2^SKETCH_BITS numbers

    def run(batches):
        forget_model()
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text").to_pylist(), SHINGLE)
                keep = [i for i, s in enumerate(sets) if len(s)]
                chosen = []
                for i in keep:
                    seen = shared.value[(sets[i] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    chosen.append(choose_prefix(sets[i], np.maximum(seen - background, 1)))
                yield pa.RecordBatch.from_pydict({
                    "rkey": part.column("rkey").take(pa.array(keep, pa.int64())),
                    "n": pa.array([len(sets[i]) for i in keep], pa.int32()),
                    "matches": pa.array([m for _, m in chosen], pa.int32()),
                    "tokens": pa.array([t.view(np.int64) for t, _ in chosen], pa.list_(pa.int64()))})

    rows = documents.select(row_key("doc_id", "text").alias("rkey"), "text")
    return rows.mapInArrow(run, "rkey binary, n int, matches int, tokens array<long>")


def _overlap(x: str, y: str):
    """Least overlap of a pair as a column, in whole numbers."""
    return F.expr(f"cast(({PERCENT}L * ({x} + {y}) + {100 + PERCENT - 1}) div {100 + PERCENT} as int)")


def _admits(a: str, b: str):
    """Size and position conditions of one shared prefix shingle of classes a and b."""
    need = F.least(f"{a}_matches", f"{b}_matches") - _overlap(f"{a}_n", f"{b}_n")
    return ((F.least(f"{a}_n", f"{b}_n") * 100 >= F.greatest(f"{a}_n", f"{b}_n") * PERCENT)
            & (F.col(f"{a}_pos") < F.col(f"{a}_n") + need) & (F.col(f"{b}_pos") < F.col(f"{b}_n") + need))


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose sets are similar enough, from their texts."""
    t = texts.select("class_no", "text")
    rows = (pairs.join(t.withColumnsRenamed({"class_no": "b", "text": "text_b"}), "b")
            .join(t.withColumnsRenamed({"class_no": "a", "text": "text_a"}), "a").select("a", "b", "text_a", "text_b"))

    def run(batches):
        forget_model()
        last, kept = None, None
        for batch in batches:
            for part in slices(batch, "text_b", 1 << 20):
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                sets = shingle_sets(part.column("text_b").to_pylist(), SHINGLE)
                ok = []
                for i, s in enumerate(sets):
                    if a[i] != last:
                        last, kept = a[i], shingle_sets([part.column("text_a")[i].as_py()], SHINGLE)[0]
                    both = len(np.intersect1d(kept, s, assume_unique=True))
                    if 100 * both >= PERCENT * (len(kept) + len(s) - both):
                        ok.append(i)
                yield pa.RecordBatch.from_pydict({"a": pa.array([a[i] for i in ok], pa.int64()),
                                                  "b": pa.array([b[i] for i in ok], pa.int64())})

    return rows.mapInArrow(run, "a long, b long")


def linked(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    return resolved(documents).select("doc_id", "n_shingles", "component_id")


def resolved(documents: DataFrame) -> DataFrame:
    """As ``linked``, with the row's key and whether the row stays as its component's representative."""
    table = cut_lineage(profiles(documents), "ngram-profiles")
    rows = table.filter("part is null").drop("part", "counts")
    counts = sketch(table.filter("part is not null"))
    classes = cut_lineage(
        rows.filter("n_shingles > 0").groupBy("signature")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rkey")).alias("pick"))
        .withColumn("class_no", F.monotonically_increasing_id()), "ngram-classes")
    picks = classes.select("pick.rkey", "class_no")

    # postings of prefix shingles that at least two classes hold, each with its shingle's leader
    chosen = prefixes(documents, counts).join(picks, "rkey").dropDuplicates(["rkey"])
    postings = chosen.select("class_no", "n", "matches", F.posexplode("tokens").alias("pos", "token"))
    by = Window.partitionBy("token").orderBy("pos", "class_no")
    lead = F.first(F.struct("class_no", "n", "matches", "pos")).over(by)
    shared = cut_lineage(
        postings.withColumn("rank", F.row_number().over(by)).withColumn("lead", lead).filter("`rank` > 1")
        .select("token", *[F.col(c).alias(f"a_{c}") for c in ("class_no", "n", "matches", "pos")],
                *[F.col(f"lead.{c}").alias(f"b_{c}") for c in ("class_no", "n", "matches", "pos")]), "ngram-shared")

    members = shared.select(F.explode(F.array("a_class_no", "b_class_no")).alias("class_no")).distinct()
    texts = cut_lineage(
        documents.select(row_key("doc_id", "text").alias("rkey"), "text")
        .join(picks.join(members, "class_no"), "rkey").dropDuplicates(["rkey"]).select("class_no", "text"), "ngram-texts")

    star = candidates(shared.filter(_admits("a", "b")))
    links = cut_lineage(verify(star, texts), "ngram-links")
    joined = components(links, "ngram-components")

    # what is left: prefix shingles whose classes lie in different components
    cols = ["class_no", "n", "matches", "pos"]
    own = shared.select("token", *[F.col(f"a_{c}").alias(c) for c in cols])
    lead = shared.select("token", *[F.col(f"b_{c}").alias(c) for c in cols]).distinct()
    held = own.union(lead).join(joined.withColumnRenamed("node", "class_no"), "class_no", "left").withColumn(
        "component", F.coalesce("component", "class_no"))
    split = cut_lineage(held.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
                        .filter("low < high").select("token"), "ngram-split")
    held = cut_lineage(held.join(split, "token"), "ngram-held")
    small = held.filter(F.col("pos") < F.col("n") - _overlap("n", "n") + F.col("matches"))
    a = small.select("token", *[F.col(c).alias(f"a_{c}") for c in [*cols, "component"]])
    b = held.select("token", *[F.col(c).alias(f"b_{c}") for c in [*cols, "component"]])
    cross = a.join(b, "token").filter(
        ((F.col("a_n") < F.col("b_n")) | (F.col("a_n") == F.col("b_n")) & (F.col("a_class_no") < F.col("b_class_no")))
        & (F.col("a_component") != F.col("b_component")) & _admits("a", "b"))
    more = cut_lineage(verify(candidates(cross), texts), "ngram-more-links")
    final = components(links.union(more), "ngram-final")

    named = classes.join(final.withColumnRenamed("node", "class_no"), "class_no", "left").select(
        "signature", "pick", F.coalesce("component", "class_no").alias("component"))
    lowest = named.groupBy("component").agg(F.min("pick").alias("lowest"))
    by_signature = named.join(lowest, "component").select("signature", "lowest")
    full = F.col("n_shingles") > 0
    return (rows.withColumn("signature", F.when(full, F.col("signature"))).join(by_signature, "signature", "left")
            .select("rkey", "doc_id", "n_shingles",
                    F.when(full, F.col("lowest.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
                    F.when(full, F.col("rkey") == F.col("lowest.rkey")).otherwise(F.lit(True)).alias("stays")))


def candidates(matches: DataFrame) -> DataFrame:
    """Pairs that share as many admitted prefix shingles as the smaller number asked for."""
    x, y = F.least("a_class_no", "b_class_no"), F.greatest("a_class_no", "b_class_no")
    return (matches.groupBy(x.alias("a"), y.alias("b"))
            .agg(F.count("*").alias("hits"), F.max(F.least("a_matches", "b_matches")).alias("need"))
            .filter("hits >= need").select("a", "b"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """Pipeline form: one document of each group stays (the smallest id), columns unchanged.

    Rows equal in id and text are one document; documents without shingles are in no group and stay.
    """
    names = documents.columns
    rows = documents.toDF(*[f"c{i}" for i in range(len(names))])
    key = row_key(*[f"c{names.index(c)}" for c in ("doc_id", "text")])
    stay = resolved(documents).filter("stays").select(F.col("rkey").alias("key")).distinct()
    return (rows.withColumn("key", key).join(stay, "key").dropDuplicates(["key"]).drop("key").toDF(*names))
