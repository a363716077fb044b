"""Forecast inputs: trailing rows, base feature row, scenario expansion.

The frame builders take an optional precomputed ``base`` (one row per group),
so a session that forecasts, simulates and draws yield curves computes the
trailing-row window once.

The base row of every group is one aggregate after one window (both keyed by
group, so they share a single exchange). Horizons and multipliers are literal
tables of a fixed size and are broadcast; the result has 15 rows per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import budget_ratio_forecast, calendar_columns
from .aggregate import GROUP_KEYS
from .features import CALENDAR_FEATURES
from .common import one_row

# Horizons (days), budget scenarios and their spend multipliers.
HORIZONS = [30, 60, 90]
SCENARIOS = [("minus_30pct", 0.7), ("minus_15pct", 0.85), ("base", 1.0), ("plus_15pct", 1.15), ("plus_30pct", 1.3)]
TRAILING_DAYS = 30
TRAILING_ROWS = 30
# Yield grid = 10 evenly spaced multipliers from 0.5 to 2.0; channels drawn.
YIELD_LO, YIELD_HI, YIELD_POINTS = 0.5, 2.0, 10
YIELD_CHANNELS = ["google", "meta", "bing"]
WHAT_IF_HORIZON = 60


def anchors(features: DataFrame, min_date: str | None = None) -> DataFrame:
    """One row: forecast anchor (last date of the scored table) and first date of the training table.

    ``min_date`` is the training table's first date as kept with a bundle; without one the scored table is
    the training table. ``days_since_start`` counts from it, so a model meets the same origin it learnt.
    """
    first = F.min("date") if min_date is None else F.lit(min_date).cast("date")
    return features.agg(F.max("date").alias("anchor_date"), first.alias("min_date"))


def trailing_rows(features: DataFrame, anchor: DataFrame | None = None) -> DataFrame:
    """Rows after anchor - 30 days; a group with none keeps its last 30 rows."""
    anchor = anchors(features) if anchor is None else anchor
    f = features.crossJoin(one_row(anchor.select("anchor_date")))
    recent = F.col("date") > F.date_sub(F.col("anchor_date"), TRAILING_DAYS)
    by_group = Window.partitionBy(*GROUP_KEYS)
    newest_first = Window.partitionBy(*GROUP_KEYS).orderBy(F.col("date").desc())
    f = (f.withColumn("_recent", recent)
         .withColumn("_n_recent", F.sum(F.col("_recent").cast("int")).over(by_group))
         .withColumn("_rn", F.row_number().over(newest_first)))
    keep = F.col("_recent") | ((F.col("_n_recent") == 0) & (F.col("_rn") <= TRAILING_ROWS))
    return (f.where(keep)
            .withColumn("trailing_branch", F.when(F.col("_n_recent") > 0, F.lit("recent")).otherwise(F.lit("last_rows")))
            .drop("_recent", "_n_recent", "_rn", "anchor_date"))


def base_rows(features: DataFrame, feature_cols: list[str], anchor: DataFrame | None = None) -> DataFrame:
    """Per group: mean spend, mean budget and the mean of every training column.

    Training columns absent from ``features`` are 0 (T12: the reference would fail).
    """
    t = trailing_rows(features, anchor)
    present = set(features.columns)
    means = [(F.avg(F.col(f"`{c}`")) if c in present else F.lit(0.0)).cast("double").alias(c)
             for c in feature_cols]
    return t.groupBy(*GROUP_KEYS).agg(
        F.avg("spend").alias("base_spend"),
        F.avg("daily_budget").alias("base_daily_budget"),
        F.count(F.lit(1)).alias("trailing_rows"),
        *means)


def horizons_df(spark: SparkSession, horizons: list[int] = HORIZONS) -> DataFrame:
    return spark.createDataFrame([(h,) for h in horizons], "forecast_period_days long")


def scenarios_df(spark: SparkSession, scenarios=SCENARIOS) -> DataFrame:
    return spark.createDataFrame(list(scenarios), "budget_scenario string, multiplier double")


def yield_grid_df(spark: SparkSession) -> DataFrame:
    """(point, multiplier) for the yield curve: linspace(0.5, 2.0, 10)."""
    step = (YIELD_HI - YIELD_LO) / (YIELD_POINTS - 1)
    grid = spark.range(YIELD_POINTS).select(F.col("id").alias("point"))
    m = F.when(F.col("point") == YIELD_POINTS - 1, F.lit(YIELD_HI)).otherwise(
        F.lit(YIELD_LO) + F.col("point").cast("double") * F.lit(step))
    return grid.select("point", m.alias("multiplier"))


def future_rows(base: DataFrame, anchor: DataFrame, feature_cols: list[str]) -> DataFrame:
    """Base row with the calendar of the horizon midpoint, anchor + horizon/2.

    ``base`` must carry ``forecast_period_days`` and ``multiplier``; the spend
    feature and the budget ratio follow the scenario spend (F8, T14, T32).
    """
    b = base.crossJoin(one_row(anchor))
    mid = F.date_add(F.col("anchor_date"), (F.col("forecast_period_days") / 2).cast("int"))
    b = b.withColumn("midpoint_date", mid)
    cal = calendar_columns("midpoint_date", "min_date")
    new_spend = F.col("base_spend") * F.col("multiplier")
    out = [F.col(c) for c in b.columns if c not in set(CALENDAR_FEATURES) | {"spend", "spend_vs_budget_ratio"}]
    out += [cal[c].cast("double").alias(c) for c in CALENDAR_FEATURES if c in feature_cols]
    out += [new_spend.alias("new_spend"), new_spend.alias("spend"),
            budget_ratio_forecast(new_spend, F.col("base_daily_budget")).alias("spend_vs_budget_ratio"),
            (new_spend * F.col("forecast_period_days")).alias("spend_input")]
    return b.select(*out).drop("anchor_date", "min_date")


def scenario_frame(features: DataFrame, feature_cols: list[str], horizons: list[int] = HORIZONS,
                   scenarios=SCENARIOS, base: DataFrame | None = None, min_date: str | None = None) -> DataFrame:
    """Groups x horizons x scenarios with their feature rows (J4, M10, M11 inputs)."""
    spark = features.sparkSession
    anchor = anchors(features, min_date)
    base = base_rows(features, feature_cols, anchor) if base is None else base
    expanded = (base.crossJoin(F.broadcast(horizons_df(spark, horizons)))
                .crossJoin(F.broadcast(scenarios_df(spark, scenarios))))
    return future_rows(expanded, anchor, feature_cols)


def channel_multipliers(spark: SparkSession, multipliers: dict[str, float]) -> DataFrame:
    """Parameter table (channel, multiplier) for the what-if page."""
    return spark.createDataFrame([(k, float(v)) for k, v in multipliers.items()], "channel string, multiplier double")


def what_if_frame(features: DataFrame, feature_cols: list[str], multipliers: DataFrame,
                  horizon: int = WHAT_IF_HORIZON, base: DataFrame | None = None,
                  min_date: str | None = None) -> DataFrame:
    """One horizon, one user multiplier per channel; channels not listed keep 1.0."""
    spark = features.sparkSession
    anchor = anchors(features, min_date)
    base = base_rows(features, feature_cols, anchor) if base is None else base
    m = multipliers.select("channel", F.col("multiplier").alias("_m"))
    expanded = (base.join(F.broadcast(m), "channel", "left")
                .withColumn("multiplier", F.coalesce(F.col("_m"), F.lit(1.0))).drop("_m")
                .crossJoin(F.broadcast(horizons_df(spark, [horizon])))
                .withColumn("budget_scenario", F.lit("what_if")))
    return future_rows(expanded, anchor, feature_cols)


def yield_frame(features: DataFrame, feature_cols: list[str], horizon: int = WHAT_IF_HORIZON,
                channels: list[str] = YIELD_CHANNELS, base: DataFrame | None = None,
                min_date: str | None = None) -> DataFrame:
    """Groups of the drawn channels x 10 grid multipliers, one horizon (J8, A13 input)."""
    spark = features.sparkSession
    anchor = anchors(features, min_date)
    # Base rows are per group against the global anchor, so filtering before or after is the same.
    base = (base_rows(features.where(F.col("channel").isin(*channels)), feature_cols, anchor) if base is None
            else base.where(F.col("channel").isin(*channels)))
    expanded = (base.crossJoin(F.broadcast(yield_grid_df(spark)))
                .crossJoin(F.broadcast(horizons_df(spark, [horizon])))
                .withColumn("budget_scenario", F.concat(F.lit("grid_"), F.col("point").cast("string"))))
    return future_rows(expanded, anchor, feature_cols)
