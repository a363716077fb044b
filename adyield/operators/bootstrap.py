"""Residual bootstrap intervals.

The reference reseeds before every draw, so the 1,000 drawn positions depend
only on the pool size n. ``draws`` builds (n, k, idx) once per distinct pool
size; resolving it against the pools gives one array of 1,000 drawn
residuals per (pool, target). Every scenario row then reads its pool's array
and computes its quantiles with array expressions (sort + interpolation),
inside the JVM and without multiplying rows by the number of draws.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip
from .models import GLOBAL_POOL, TARGETS, pool_key

# Draws per interval, seed, smallest usable own pool, quantiles.
N_DRAWS = 1000
SEED = 42
MIN_POOL = 30
QUANTILES = [0.1, 0.5, 0.9]
# Linear congruential draws (SQL-reproducible mode).
LCG_A, LCG_C, LCG_M = 1103515245, 12345, 2147483648
ROAS_MAX = 50.0


def _numpy_draws(n_draws: int, seed: int):
    def draw(batches):
        for pdf in batches:
            for n in pdf["n"].tolist():
                idx = np.random.RandomState(seed).choice(int(n), size=n_draws, replace=True)
                yield pd.DataFrame({"n": np.full(n_draws, n, dtype="int64"),
                                    "k": np.arange(n_draws, dtype="int64"), "idx": idx.astype("int64")})
    return draw


def draws(sizes: DataFrame, mode: str = "numpy", n_draws: int = N_DRAWS, seed: int = SEED) -> DataFrame:
    """(n, k, idx): the k-th drawn position in a pool of size n (M9).

    ``numpy``: the reference's stream, ``RandomState(seed).choice(n, n_draws)``.
    ``lcg``: ((k * 1103515245 + 12345) mod 2^31) mod n, reproducible in SQL.
    """
    distinct = sizes.select(F.col("n").cast("long").alias("n")).distinct()
    if mode == "numpy":
        return distinct.mapInPandas(_numpy_draws(n_draws, seed), "n long, k long, idx long")
    if mode == "lcg":
        k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_draws - 1).cast("long"))).alias("k")
        return distinct.select("n", k).withColumn(
            "idx", F.pmod(F.pmod(F.col("k") * F.lit(LCG_A) + F.lit(LCG_C), F.lit(LCG_M)), F.col("n")))
    raise ValueError(f"unknown draw mode {mode!r}")


def pool_sizes(residuals: DataFrame) -> DataFrame:
    return residuals.groupBy("pool", "target").agg(F.count(F.lit(1)).alias("n"))


def pool_choice(rows: DataFrame, sizes: DataFrame, min_pool: int = MIN_POOL) -> DataFrame:
    """Per (group, target): own pool if it has >= 30 residuals, else the global pool."""
    own = sizes.where(F.col("pool") != GLOBAL_POOL).select(
        F.col("pool").alias("_own"), F.col("target").alias("_t"), F.col("n").alias("_own_n"))
    glob = sizes.where(F.col("pool") == GLOBAL_POOL).select(F.col("target").alias("_gt"), F.col("n").alias("_glob_n"))
    j = (rows.join(own, (pool_key() == F.col("_own")) & (F.col("target") == F.col("_t")), "left")
         .join(F.broadcast(glob), F.col("target") == F.col("_gt"), "left"))
    use_own = F.coalesce(F.col("_own_n"), F.lit(0)) >= min_pool
    return (j.withColumn("pool", F.when(use_own, F.col("_own")).otherwise(F.lit(GLOBAL_POOL)))
            .withColumn("pool_n", F.when(use_own, F.col("_own_n")).otherwise(F.col("_glob_n")))
            .drop("_own", "_t", "_own_n", "_gt", "_glob_n"))


def sampled_residuals(residuals: DataFrame, mode: str = "numpy", n_draws: int = N_DRAWS,
                      seed: int = SEED) -> DataFrame:
    """(pool, target, samples): the drawn residuals of every pool as one array (M9).

    The draw table is joined on (n, k), so pools that share a size are spread
    over the k keys instead of meeting in one task. Percentiles do not depend
    on the order of the samples, so the array is not ordered by k.
    """
    sizes = pool_sizes(residuals)
    d = draws(sizes, mode, n_draws, seed)
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_draws - 1).cast("long"))).alias("k")
    picks = sizes.select("pool", "target", "n", k).join(d, ["n", "k"], "inner") \
        .select("pool", "target", F.col("idx").alias("pool_idx"))
    picked = picks.join(residuals, ["pool", "target", "pool_idx"], "inner")
    return picked.groupBy("pool", "target").agg(F.collect_list("residual").alias("samples"))


def _quantile(sorted_values: F.Column, n: int, q: float) -> F.Column:
    """Linear interpolation between order statistics at position q * (n - 1).

    The weight is known when the plan is built, so the same two-sided form as
    ``numpy.percentile`` is chosen statically: a + (b - a) t below one half,
    b - (b - a)(1 - t) from one half on.
    """
    pos = q * (n - 1)
    lo = int(pos // 1)
    t = pos - lo
    a = F.element_at(sorted_values, lo + 1)
    if t == 0 or lo + 1 >= n:
        return a
    b = F.element_at(sorted_values, lo + 2)
    if t >= 0.5:
        return b - (b - a) * F.lit(1.0 - t)
    return a + (b - a) * F.lit(t)


def intervals(scored: DataFrame, residuals: DataFrame, keys: list[str], mode: str = "numpy",
              n_draws: int = N_DRAWS, seed: int = SEED, min_pool: int = MIN_POOL,
              samples: DataFrame | None = None) -> DataFrame:
    """p10/p50/p90 of revenue over the horizon and of the ratio, per scenario row.

    revenue: (prediction + residual) * horizon, clipped at 0 (T18);
    ratio:   prediction + residual clipped to [0, 50].
    ``scored`` carries ``keys``, forecast_period_days, pred_revenue, pred_roas.

    Each (scenario row, target) meets its pool's array of drawn residuals in
    one join and the quantiles are array expressions, so no row is multiplied
    by the number of draws. Rows that fall back to the global pool (possibly
    most of them) join a two-row broadcast table; own pools are used by one
    group's 15 rows each, so their shuffle join is uniform.
    """
    sizes = pool_sizes(residuals)
    per_target = scored.select(
        *keys, F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"pred_{t}").alias("pred"))
                                   for t in TARGETS])).alias("_p"))
    per_target = per_target.select(*keys, "_p.target", "_p.pred")
    chosen = pool_choice(per_target, sizes, min_pool).select(*keys, "target", "pred", "pool")
    if samples is None:
        samples = sampled_residuals(residuals, mode, n_draws, seed)
    is_global = F.col("pool") == GLOBAL_POOL
    with_global = chosen.where(is_global).join(F.broadcast(samples.where(is_global)), ["pool", "target"], "inner")
    with_own = chosen.where(~is_global).join(samples.where(~is_global), ["pool", "target"], "inner")
    j = with_global.unionByName(with_own)
    horizon = F.col("forecast_period_days").cast("double")
    values = F.array_sort(F.transform(
        "samples",
        lambda r: F.when(F.col("target") == "revenue", F.greatest((F.col("pred") + r) * horizon, F.lit(0.0)))
        .otherwise(clip(F.col("pred") + r, 0.0, ROAS_MAX))))
    names = ["p10", "p50", "p90"]
    ordered = j.select(*keys, "target", values.alias("_sorted"))
    q = ordered.select(*keys, "target",
                       *[_quantile(F.col("_sorted"), n_draws, x).alias(n) for x, n in zip(QUANTILES, names)])
    return q.groupBy(*keys).agg(
        *[F.max(F.when(F.col("target") == t, F.col(n))).alias(f"{t}_{n}") for t in TARGETS for n in names])
