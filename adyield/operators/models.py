"""Forecast models, model lookup and residual pools.

Two model families share one interface (``FittedModels``):

* ``fit_boosted``: the default. The fallback models for revenue and ratio are fitted by
  Spark ML on all rows: exact column medians fill missing values, then VectorAssembler ->
  StandardScaler once for both targets, then a GBTRegressor per target (M1-M3). Groups with
  at least 60 rows get dedicated models, fitted per group with
  ``groupBy().applyInPandas`` by a replaceable learner (M4); a group's rows are bounded by
  its days. The fits are written to the shared folder, so a lost executor does not refit.
* ``fit_linear``: a verification stand-in whose predictions SQL can
  reproduce: per group ``regr_intercept + regr_slope * spend`` (SURVEY 7.3).

Residual pools (M5, M6) are long tables ``(pool, target, pool_idx, residual)``:
one pool per group in date order, plus pool ``__global__`` holding the
fallback residuals of all rows in (channel, campaign_type, date) order.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Callable

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from . import gbt
from .aggregate import GROUP_KEYS

TARGETS = ["revenue", "roas"]
GLOBAL_POOL = "__global__"
# A group needs this many rows for its own model.
DEDICATED_MIN_ROWS = 60
FRAME_KEYS = GROUP_KEYS + ["forecast_period_days", "budget_scenario"]


@dataclass
class FittedModels:
    kind: str
    group_models: DataFrame            # channel, campaign_type, rows, dedicated
    residuals: DataFrame               # pool, target, pool_idx, residual
    score: Callable[[DataFrame], DataFrame]   # adds pred_revenue, pred_roas
    tables: dict = field(default_factory=dict)     # model state as DataFrames (saved with the bundle)
    fallback: dict = field(default_factory=dict)   # target -> fitted Spark ML PipelineModel (boosted)
    feature_cols: list = field(default_factory=list)
    _samples: dict = field(default_factory=dict, repr=False)

    def samples(self, mode: str = "numpy") -> DataFrame:
        """Drawn residuals per (pool, target) as arrays; written once per draw mode.

        Bounded by pools x 2 rows of 1,000 doubles, and read by every forecast,
        what-if and yield plan of this model set.
        """
        if mode not in self._samples:
            from .bootstrap import sampled_residuals
            self._samples[mode] = cut_lineage(sampled_residuals(self.residuals, mode), f"samples-{mode}")
        return self._samples[mode]


def pool_key(channel: str = "channel", campaign_type: str = "campaign_type") -> F.Column:
    """``channel__type``; where that could be read in two ways, the channel's length goes in front."""
    c, t = F.col(channel), F.col(campaign_type)
    unclear = c.contains("__") | t.contains("__") | c.endswith("_") | t.startswith("_")
    return F.concat(F.when(unclear, F.concat(F.length(c).cast("string"), F.lit(":"))).otherwise(F.lit("")), c, F.lit("__"), t)


def _stack_targets(df: DataFrame, residual_cols: dict[str, F.Column]) -> DataFrame:
    """(row) -> one row per target with its residual, in a single pass."""
    arr = F.array(*[F.struct(F.lit(t).alias("target"), c.cast("double").alias("residual"))
                    for t, c in residual_cols.items()])
    return df.select(*GROUP_KEYS, "date", F.explode(arr).alias("_r")).select(
        *GROUP_KEYS, "date", "_r.target", "_r.residual")


def residual_pools(group_residuals: DataFrame, global_residuals: DataFrame) -> DataFrame:
    """Index pools: group pool by date; global pool by (channel, campaign_type, date).

    The global index is a per-group offset (a running count over the small
    group table) plus the row number inside the group, so no window runs
    over all rows in one partition.
    """
    by_date = Window.partitionBy(*GROUP_KEYS, "target").orderBy("date")
    grp = group_residuals.select(
        pool_key().alias("pool"), "target",
        (F.row_number().over(by_date) - 1).cast("long").alias("pool_idx"), "residual")
    counts = global_residuals.groupBy(*GROUP_KEYS, "target").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_offset", F.coalesce(F.sum("_n").over(
            Window.partitionBy("target").orderBy(*GROUP_KEYS).rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0))).drop("_n")
    glob = (global_residuals.withColumn("_i", F.row_number().over(by_date) - 1)
            .join(offsets, GROUP_KEYS + ["target"], "inner")
            .select(F.lit(GLOBAL_POOL).alias("pool"), "target",
                    (F.col("_offset") + F.col("_i")).cast("long").alias("pool_idx"), "residual"))
    return grp.unionByName(glob)


def group_table(features: DataFrame, dedicated_min_rows: int = DEDICATED_MIN_ROWS) -> DataFrame:
    """Model lookup table: which groups get a dedicated model."""
    return features.groupBy(*GROUP_KEYS).agg(F.count(F.lit(1)).alias("rows")) \
        .withColumn("dedicated", F.col("rows") >= dedicated_min_rows)


# ----------------------------------------------------------------------------- linear stand-in

def _coef(y: str, prefix: str) -> list[F.Column]:
    slope = F.regr_slope(F.col(y), F.col("spend"))
    icpt = F.regr_intercept(F.col(y), F.col("spend"))
    return [F.when(slope.isNull(), F.avg(y)).otherwise(icpt).alias(f"{prefix}_a"),
            F.coalesce(slope, F.lit(0.0)).alias(f"{prefix}_b")]


def fit_linear(features: DataFrame, dedicated_min_rows: int = DEDICATED_MIN_ROWS) -> FittedModels:
    """Per-group least squares of each target on spend; thin groups use the all-rows fit."""
    coef_cols = [c for t in TARGETS for c in _coef(t, t)]
    per_group = features.groupBy(*GROUP_KEYS).agg(F.count(F.lit(1)).alias("rows"), *coef_cols)
    overall = features.agg(*[c for t in TARGETS for c in _coef(t, f"g_{t}")])
    dedicated = F.col("rows") >= dedicated_min_rows
    models = per_group.crossJoin(F.broadcast(overall)).select(
        *GROUP_KEYS, "rows", dedicated.alias("dedicated"),
        *[F.when(dedicated, F.col(f"{t}_{p}")).otherwise(F.col(f"g_{t}_{p}")).alias(f"{t}_{p}")
          for t in TARGETS for p in ("a", "b")])
    in_sample = features.join(models, GROUP_KEYS, "inner")
    group_res = _stack_targets(in_sample, {t: F.col(t) - (F.col(f"{t}_a") + F.col(f"{t}_b") * F.col("spend"))
                                           for t in TARGETS})
    fb = features.crossJoin(F.broadcast(overall))
    global_res = _stack_targets(fb, {t: F.col(t) - (F.col(f"g_{t}_a") + F.col(f"g_{t}_b") * F.col("spend"))
                                     for t in TARGETS})
    residuals = cut_lineage(residual_pools(group_res, global_res), "residuals")
    tables = {"coefficients": cut_lineage(models, "coefficients"), "overall": cut_lineage(overall, "overall")}
    return restore_linear(tables, residuals)


def linear_scorer(coefficients: DataFrame, overall: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Score frames with per-group coefficients; unknown groups use the all-rows fit."""
    def score(frame: DataFrame) -> DataFrame:
        j = frame.join(coefficients.drop("rows", "dedicated"), GROUP_KEYS, "left").crossJoin(F.broadcast(overall))
        preds = [(F.coalesce(F.col(f"{t}_a"), F.col(f"g_{t}_a"))
                  + F.coalesce(F.col(f"{t}_b"), F.col(f"g_{t}_b")) * F.col("spend")).alias(f"pred_{t}")
                 for t in TARGETS]
        return j.select(*frame.columns, *preds)
    return score


def restore_linear(tables: dict, residuals: DataFrame) -> FittedModels:
    coefficients = tables["coefficients"]
    return FittedModels("linear", coefficients.select(*GROUP_KEYS, "rows", "dedicated"), residuals,
                        linear_scorer(coefficients, tables["overall"]), tables=tables)


# ----------------------------------------------------------------------------- boosted trees

FILLED, SCALED = "_filled", "_scaled"


# Values of a column that one aggregate may hold; above, a column's middle is narrowed first.
MEDIAN_VALUES = 100_000
BRACKET = 0.01               # share of a bracket's values that the next one keeps on either side of the middle


def median_surrogates(features: DataFrame, feature_cols: list[str], most: int = MEDIAN_VALUES) -> DataFrame:
    """(feature, median): the exact median that fills a column's missing values; 0 for an all-null column (M2).

    Every column has a bracket that holds its two middle places, open at first. While one of them lies strictly inside
    a bracket of more than ``most`` inner values, a pass over the table counts what lies below, on and inside it and takes
    mergeable approximate quantiles just around the middle as the next bracket: all columns in the same pass, some fifty
    times fewer values each time, however often a value repeats. No task holds more than ``most`` values of a column.
    Per feature, the driver holds a bracket.
    """
    value = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in feature_cols}
    bracket = {c: (float("-inf"), float("inf")) for c in feature_cols}
    inner = lambda c: F.when((value[c] > bracket[c][0]) & (value[c] < bracket[c][1]), value[c])
    medians: dict[str, float] = dict.fromkeys(feature_cols, 0.0)
    few: dict[str, list] = {}                      # per column: for either middle place a value, or a place in the inner values
    todo = list(feature_cols)
    while todo:
        got = features.agg(*[x.alias(f"{k}{i}") for i, c in enumerate(todo) for k, x in (
            ("n", F.count(value[c])), ("below", F.count(F.when(value[c] < bracket[c][0], 1))),
            ("low", F.count(F.when(value[c] == bracket[c][0], 1))), ("inner", F.count(inner(c))))]).first()
        wide = {}
        for i, c in enumerate(todo):
            n, below, at_low, inside = (got[f"{k}{i}"] for k in ("n", "below", "low", "inner"))
            if not n:
                continue
            # places among the inner values; before them the lower end, behind them the upper one
            places = [p - below - at_low for p in ((n - 1) // 2, n // 2)]
            if inside <= most or not any(0 <= p < inside for p in places):
                few[c] = [bracket[c][0] if p < 0 else bracket[c][1] if p >= inside else p for p in places]
            else:
                wide[c] = (places, inside)
        shares = {c: [max(0.0, p[0] / n - BRACKET), min(1.0, p[1] / n + BRACKET)] for c, (p, n) in wide.items()}
        near = features.agg(*[F.percentile_approx(inner(c), shares[c], int(4 / BRACKET)).alias(f"q{i}")
                              for i, c in enumerate(wide)]).first() if wide else None
        for i, (c, (places, inside)) in enumerate(wide.items()):
            low, high = near[f"q{i}"]
            bracket[c] = (bracket[c][0] if places[0] < 0 else low, bracket[c][1] if places[1] >= inside else high)
        todo = list(wide)
    # at most ``most`` values of a column whose middle lies among them
    held = {c: F.array_sort(F.collect_list(inner(c))) for c, ends in few.items() if any(isinstance(e, int) for e in ends)}
    found = features.agg(*[F.array(*[F.get(held[c], F.lit(e)) for e in few[c] if isinstance(e, int)]).alias(f"m{i}")
                           for i, c in enumerate(held)]).first() if held else None
    at = {c: iter(found[f"m{i}"]) for i, c in enumerate(held)}
    medians |= {c: sum(next(at[c]) if isinstance(e, int) else e for e in ends) / 2 for c, ends in few.items()}
    return features.sparkSession.createDataFrame([(c, float(medians[c])) for c in feature_cols], "feature string, median double")


def fill_medians(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """The columns as doubles, missing values replaced."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(m))
                           for c, m in medians.items()})


def preparation(feature_cols: list[str]):
    """Assemble and standardise the filled columns, once for both targets (M3)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    return Pipeline(stages=[VectorAssembler(inputCols=feature_cols, outputCol=FILLED),
                            StandardScaler(inputCol=FILLED, outputCol=SCALED, withMean=True, withStd=True)])


def fallback_regressor(target: str, params: gbt.BoostParams):
    """The fallback model of one target (M1)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import GBTRegressor
    return Pipeline(stages=[GBTRegressor(
        featuresCol=SCALED, labelCol=target, predictionCol=f"pred_{target}", maxIter=params.n_estimators,
        stepSize=params.learning_rate, maxDepth=params.max_depth, minInstancesPerNode=params.min_samples_leaf,
        subsamplingRate=params.subsample, maxBins=params.max_bins, seed=params.seed)])


def _fallback_score(fallback: dict, medians: DataFrame, df: DataFrame) -> DataFrame:
    # one row per feature: small
    surrogates = {r["feature"]: r["median"] for r in medians.collect()}
    # the filled columns stay inside: the caller's columns come back as they were
    out = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("_row"), *surrogates)
    out = fallback["prepare"].transform(fill_medians(out, surrogates)).select("_row", SCALED)
    for t in TARGETS:
        out = fallback[t].transform(out)
    return out.select("_row.*", *[F.col(f"pred_{t}") for t in TARGETS])


def _group_fitter(feature_cols: list[str], params: gbt.BoostParams, learner):
    def fit_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", kind="stable")
        x, rows = pdf[feature_cols].to_numpy(dtype=float), []
        for t in TARGETS:
            y = pdf[t].to_numpy(dtype=float)
            model = learner.fit(x, y, params)
            rows.append(("model", t, None, None, model))
            rows += [("residual", t, d, r, None) for d, r in zip(pdf["date"], (y - learner.predict(model, x)).tolist())]
        out = pd.DataFrame(rows, columns=["kind", "target", "date", "residual", "model"])
        return out.assign(channel=pdf["channel"].iloc[0], campaign_type=pdf["campaign_type"].iloc[0])
    return fit_group


def _group_scorer(feature_cols: list[str], out_cols: list[str], learner):
    def score_group(frame: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        if frame.empty:
            return pd.DataFrame(columns=out_cols)
        x, out = frame[feature_cols].to_numpy(dtype=float), frame.copy()
        for t in TARGETS:
            out[f"pred_{t}"] = learner.predict(models.loc[models["target"] == t, "model"].iloc[0], x)
        return out[out_cols]
    return score_group


def fit_boosted(features: DataFrame, feature_cols: list[str], params: gbt.BoostParams = gbt.BoostParams(),
                dedicated_min_rows: int = DEDICATED_MIN_ROWS, learner=gbt) -> FittedModels:
    """Fallback Spark ML models on all rows plus dedicated per-group models (M1-M6)."""
    groups = group_table(features, dedicated_min_rows)
    medians = cut_lineage(median_surrogates(features, feature_cols), "medians")
    # Partitions and row order follow from the table: the boosting's row sampling follows both.
    ordered = features.select(*GROUP_KEYS, "date", *TARGETS, F.struct(*feature_cols).alias("_x"))
    parts = max(1, -(-features.count() // params.partition_rows))
    ordered = ordered.repartition(parts, *GROUP_KEYS, "date").sortWithinPartitions(*GROUP_KEYS, "date")
    filled = fill_medians(ordered.select(*[F.col(t).alias(f"_y_{t}") for t in TARGETS], "_x.*"),
                          {r["feature"]: r["median"] for r in medians.collect()})
    prepare = preparation(feature_cols).fit(filled)
    scaled = prepare.transform(filled).select(*[F.col(f"_y_{t}").alias(t) for t in TARGETS], SCALED)
    scaled = scaled.persist(StorageLevel.MEMORY_AND_DISK)
    ded_rows = features.join(groups.where("dedicated").select(*GROUP_KEYS), GROUP_KEYS, "left_semi")
    own_cols = [c for c in feature_cols if c not in (*GROUP_KEYS, "date", *TARGETS)]
    schema = f"channel string, campaign_type string, kind string, target string, date date, residual double, model {learner.MODEL}"
    grouped_fit = (ded_rows.select(*GROUP_KEYS, "date", *TARGETS, *own_cols)
                   .groupBy(*GROUP_KEYS).applyInPandas(_group_fitter(feature_cols, params, learner), schema))
    # The two fallback fits and the grouped fit are independent jobs: submit them together.
    with ThreadPoolExecutor(max_workers=len(TARGETS) + 1) as pool:
        futures = {t: pool.submit(fallback_regressor(t, params).fit, scaled) for t in TARGETS}
        fitted = pool.submit(cut_lineage, grouped_fit, "group-models").result()
        fallback = {t: f.result() for t, f in futures.items()} | {"prepare": prepare}
    scaled.unpersist()
    models = fitted.where(F.col("kind") == "model").select(*GROUP_KEYS, "target", "model")
    ded_res = fitted.where(F.col("kind") == "residual").select(*GROUP_KEYS, "date", "target", "residual")

    fb_all = _fallback_score(fallback, medians, features.select(*GROUP_KEYS, "date", *TARGETS, *own_cols))
    fb_stacked = cut_lineage(_stack_targets(fb_all, {t: F.col(t) - F.col(f"pred_{t}") for t in TARGETS}), "fallback-residuals")
    thin = fb_stacked.join(groups.where(~F.col("dedicated")).select(*GROUP_KEYS), GROUP_KEYS, "left_semi")
    residuals = cut_lineage(residual_pools(ded_res.unionByName(thin), fb_stacked), "residuals")

    tables = {"groups": cut_lineage(groups, "groups"), "group_models": models, "medians": medians}
    return restore_boosted(tables, residuals, fallback, feature_cols, learner)


def boosted_scorer(tables: dict, fallback: dict, feature_cols: list[str], learner=gbt) -> Callable[[DataFrame], DataFrame]:
    """Dedicated groups: cogroup with their model rows (each model shipped once); others: fallback."""
    groups, models = tables["groups"], tables["group_models"]

    def score(frame: DataFrame) -> DataFrame:
        flagged = frame.join(groups.select(*GROUP_KEYS, "dedicated"), GROUP_KEYS, "left")
        own = flagged.where(F.coalesce(F.col("dedicated"), F.lit(False))).drop("dedicated")
        rest = flagged.where(~F.coalesce(F.col("dedicated"), F.lit(False))).drop("dedicated")
        out_schema = T.StructType(frame.schema.fields + [T.StructField(f"pred_{t}", T.DoubleType()) for t in TARGETS])
        scored_own = own.groupBy(*GROUP_KEYS).cogroup(models.groupBy(*GROUP_KEYS)).applyInPandas(
            _group_scorer(feature_cols, out_schema.fieldNames(), learner), out_schema)
        return scored_own.unionByName(_fallback_score(fallback, tables["medians"], rest))
    return score


def restore_boosted(tables: dict, residuals: DataFrame, fallback: dict, feature_cols: list[str], learner=gbt) -> FittedModels:
    return FittedModels("boosted", tables["groups"].select(*GROUP_KEYS, "rows", "dedicated"), residuals,
                        boosted_scorer(tables, fallback, feature_cols, learner),
                        tables=tables, fallback=fallback, feature_cols=list(feature_cols))


def fit_models(features: DataFrame, feature_cols: list[str], kind: str = "boosted", **kw) -> FittedModels:
    if kind == "linear":
        return fit_linear(features, kw.get("dedicated_min_rows", DEDICATED_MIN_ROWS))
    if kind == "boosted":
        return fit_boosted(features, feature_cols, **kw)
    raise ValueError(f"unknown model kind {kind!r}")
