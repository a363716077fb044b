"""End-to-end jobs: features, training, forecast, what-if (the reference's three programs as one session).

The feature table is the boundary between ingest and modelling, as in the
reference (a Parquet file between two processes). Here it is materialised
once per session and source in the shared checkpoint directory: the
modelling plans then start from a short lineage (fast planning, and a lost
executor re-reads files instead of re-running ingest).
"""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.aggregate import GROUP_KEYS, training_metadata
from ..operators.features import build_features, feature_columns, feature_values, observed_values
from ..operators.forecast import predictions, sort_predictions, what_if, yield_curve
from ..operators.gbt import BoostParams
from ..operators.models import TARGETS, FittedModels, fit_models, restore_boosted, restore_linear
from ..operators.normalize import Ingest, ingest, unify
from ..operators.quality import check, validation_rules
from ..operators.scenarios import base_rows, channel_multipliers
from ..operators.stats import group_anomalies, group_stats, summaries
from ..session import cut_lineage, fingerprint, path_exists, prepare, table_path
from ..sources import sinks
from ..sources.fixtures import raw_dialects

_MEMO: dict[tuple, object] = {}


SOURCE_TABLES = ["lineitem", "part"]


def _key(spark: SparkSession, what: str, sf_dir: str, *parts) -> tuple:
    """Memo key: the session, the source and the state of its files, so changed data is read again."""
    state = fingerprint(spark, [table_path(sf_dir, t) for t in SOURCE_TABLES])
    return (spark.sparkContext.applicationId, what, sf_dir, state, *parts)


def canonical_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver tables -> three dialects -> canonical union."""
    prepare(spark)
    return unify(raw_dialects(spark, sf_dir))


def ingested(spark: SparkSession, sf_dir: str) -> Ingest:
    """One pass over the driver tables' raw rows: daily table, validation figures, report."""
    prepare(spark)
    return ingest(raw_dialects(spark, sf_dir))


def daily_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingested(spark, sf_dir).daily


def feature_table(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """The feature table for a source directory, materialised once per session."""
    prepare(spark)
    key = _key(spark, "features", sf_dir)
    if materialize and key in _MEMO:
        return _MEMO[key]
    if not materialize:
        return build_features(daily_table(spark, sf_dir))
    # The daily table (days x groups rows) is read three times by the feature build (one-hot
    # values, the global first date, the windows): write it once instead of re-running A1.
    f = build_features(cut_lineage(daily_table(spark, sf_dir), "daily"))
    f = cut_lineage(f.repartition(*GROUP_KEYS).sortWithinPartitions(*GROUP_KEYS, "date"), "features")
    _MEMO[key] = f
    return f


@dataclass
class TrainedBundle:
    """What training produces: models, residual pools, stats-based summaries, column list."""
    features: DataFrame
    feature_cols: list[str]
    models: FittedModels
    summaries: DataFrame
    stats: DataFrame
    anomalies: DataFrame              # channel, campaign_type, date: one row per anomaly
    min_date: str | None = None       # first date of the training table; None: ``features`` is that table
    _base: DataFrame | None = None

    def base_rows(self) -> DataFrame:
        """Per-group base rows (trailing-row means), written once and shared by every forecast plan."""
        if self._base is None:
            self._base = cut_lineage(base_rows(self.features, self.feature_cols), "base-rows")
        return self._base


def train(features: DataFrame, kind: str = "boosted", params: BoostParams = BoostParams()) -> TrainedBundle:
    """Fit models and residual pools, build the summary table (train.main)."""
    cols = feature_columns(features)
    kw = {"params": params} if kind == "boosted" else {}
    models = fit_models(features, cols, kind, **kw)
    summ = cut_lineage(summaries(features), "summaries")
    return TrainedBundle(features, cols, models, summ, cut_lineage(group_stats(features), "group-stats"),
                         cut_lineage(group_anomalies(features), "group-anomalies"))


def trained(spark: SparkSession, sf_dir: str, kind: str = "boosted",
            params: BoostParams = BoostParams()) -> TrainedBundle:
    """Memoised ``train`` over the session's feature table."""
    key = _key(spark, "bundle", sf_dir, kind, params)
    if key not in _MEMO:
        _MEMO[key] = train(feature_table(spark, sf_dir), kind, params)
    return _MEMO[key]


def forecast(bundle: TrainedBundle, draws: str = "numpy", sort: bool = True) -> DataFrame:
    """Predictions table: groups x 3 horizons x 5 scenarios + portfolio rollup (predict.main)."""
    p = predictions(bundle.features, bundle.feature_cols, bundle.models, bundle.summaries, draws,
                    base=bundle.base_rows(), min_date=bundle.min_date)
    return sort_predictions(p) if sort else p


def simulate(bundle: TrainedBundle, multipliers: dict[str, float], horizon: int = 60,
             draws: str = "numpy") -> DataFrame:
    """What-if table under per-channel spend multipliers (budget page)."""
    spark = bundle.features.sparkSession
    return what_if(bundle.features, bundle.feature_cols, bundle.models,
                   channel_multipliers(spark, multipliers), horizon, draws, base=bundle.base_rows(),
                   min_date=bundle.min_date)


def curve(bundle: TrainedBundle, horizon: int = 60, draws: str = "numpy") -> DataFrame:
    return yield_curve(bundle.features, bundle.feature_cols, bundle.models, horizon, draws,
                       base=bundle.base_rows(), min_date=bundle.min_date)


def clear_memo() -> None:
    _MEMO.clear()


# ----------------------------------------------------------------------------- bundle and jobs

MODEL_TABLES = {"linear": ("coefficients", "overall"), "boosted": ("groups", "group_models", "medians")}


def save_trained(bundle: TrainedBundle, path: str) -> None:
    """Bundle directory: residuals, group models, summaries, statistics, metadata, model tables, fallback.

    Everything goes to a version folder of its own, which readers see once its manifest is written, last of all: a run
    that ends early leaves the bundle before it in place.
    """
    spark = bundle.features.sparkSession
    m = bundle.models
    values = [v for v in feature_values(*observed_values(bundle.features)) if v[0] in set(bundle.feature_cols)]
    meta = (spark.createDataFrame([(m.kind, list(bundle.feature_cols), values)], "kind string, feature_columns array<string>, "
                                  "feature_values array<struct<feature: string, key: string, value: string>>")
            .crossJoin(training_metadata(bundle.features)))
    version = sinks.new_version(spark, path)
    sinks.save_bundle(version, {"residuals": m.residuals, "group_models": m.group_models, "summaries": bundle.summaries,
                                "group_stats": bundle.stats, "anomalies": bundle.anomalies, "metadata": meta})
    sinks.save_bundle(os.path.join(version, "model_tables"), m.tables)
    for name, pipeline_model in m.fallback.items():
        pipeline_model.write().overwrite().save(os.path.join(version, "fallback", name))
    sinks.commit_version(spark, version, {"kind": m.kind, "tables": [*sinks.BUNDLE_TABLES, *m.tables], "fallback": list(m.fallback)})


def load_trained(spark: SparkSession, path: str, features: DataFrame) -> TrainedBundle:
    """Rebuild a trained bundle (scoring included) from ``save_trained`` output, to score ``features``."""
    path = sinks.current_version(spark, path)
    t = sinks.load_bundle(spark, path, path)
    meta = t["metadata"].first()
    kind, cols = meta["kind"], list(meta["feature_columns"])
    tables = {n: spark.read.parquet(os.path.join(path, "model_tables", n)) for n in MODEL_TABLES[kind]}
    if kind == "linear":
        models = restore_linear(tables, t["residuals"])
    else:
        from pyspark.ml import PipelineModel
        fallback = {n: PipelineModel.load(os.path.join(path, "fallback", n)) for n in ("prepare", *TARGETS)}
        models = restore_boosted(tables, t["residuals"], fallback, cols)
    return TrainedBundle(features, cols, models, t["summaries"], t["group_stats"], t["anomalies"], meta["min_date"])


def load_source(spark: SparkSession, source: str) -> dict[str, DataFrame]:
    """Raw dialect tables: the driver tables when ``source`` holds them, else a directory of CSV exports, whose files
    ``ingest`` judges."""
    from ..sources import csv as csvsrc
    if path_exists(spark, table_path(source, "lineitem")):
        return raw_dialects(spark, source)
    return csvsrc.load_directory(spark, source, check_rows=False)


def features_job(spark: SparkSession, source: str, out: str, exact_medians: bool = True) -> DataFrame:
    """Ingest, validate, aggregate, build features, write Parquet (the reference's feature program).

    Skipped files, dropped dates, unreadable numbers and validation warnings go to stderr.
    """
    prepare(spark)
    found = ingest(load_source(spark, source), exact_medians)
    for r in found.report.orderBy("channel").collect():          # one row per channel
        if r["rows_dropped"] or r["unreadable"]:
            print(f"{r['channel']}: {r['rows_dropped']} of {r['rows_read']} rows dropped for their date, "
                  f"{r['unreadable']} unreadable numbers filled", file=sys.stderr)
    for warning in check(validation_rules(found.grain)):
        print(f"warning: {warning}", file=sys.stderr)
    daily = cut_lineage(found.daily, "daily")
    sinks.write_features(build_features(daily), out)
    return sinks.read_features(spark, out)


def train_job(spark: SparkSession, features_path: str, bundle_out: str, kind: str = "boosted") -> TrainedBundle:
    """Fit models, residual pools and summaries; save the bundle (the reference's training program)."""
    prepare(spark)
    bundle = train(sinks.read_features(spark, features_path), kind)
    save_trained(bundle, bundle_out)
    return bundle


def predict_job(spark: SparkSession, features_path: str, bundle_path: str, output: str,
                draws: str = "numpy") -> DataFrame:
    """Load features and bundle, forecast, write the predictions CSV (the reference's predict program).

    ``output`` is one file in the predictions' order if its name ends in ``.csv``, else a folder of part files.
    """
    prepare(spark)
    features = sinks.read_features(spark, features_path)
    pred = forecast(load_trained(spark, bundle_path, features), draws=draws)
    sinks.write_predictions_csv(pred, output)
    return sinks.read_predictions_csv(spark, output)
