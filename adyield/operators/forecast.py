"""Forecast tables: predictions, portfolio rollup, what-if, yield curve, marginal return, report views.

(M11, M12, M13, A6, A11, A13, J6, U2, O3, P13, P14, P16)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip
from ..functions.text import MISSING_PORTFOLIO_SUMMARY, report_label
from .aggregate import GROUP_KEYS
from .bootstrap import intervals
from .models import FRAME_KEYS, FittedModels
from .scenarios import (HORIZONS, SCENARIOS, WHAT_IF_HORIZON, YIELD_CHANNELS, scenario_frame,
                        what_if_frame, yield_frame)
from .stats import summary_lookup

# The columns of the predictions table, in order.
PREDICTION_COLUMNS = ["forecast_period_days", "channel", "campaign_type", "revenue_p10", "revenue_p50",
                      "revenue_p90", "roas_p10", "roas_p50", "roas_p90", "spend_input", "budget_scenario",
                      "causal_summary"]
# Marginal return compares the curve points nearest these multipliers.
MARGINAL_BASE, MARGINAL_HIGH = 1.0, 1.15
REPORT_CHANNELS = ["google", "bing", "meta"]


def scored_intervals(frame: DataFrame, models: FittedModels, draws: str = "numpy") -> DataFrame:
    """Scenario rows -> point predictions -> bootstrap intervals, joined back to spend_input."""
    keys = FRAME_KEYS + ["spend_input", "base_spend", "multiplier"]
    scored = models.score(frame)
    return intervals(scored.select(*keys, "pred_revenue", "pred_roas"), models.residuals, keys, draws,
                     samples=models.samples(draws))


def predictions(features: DataFrame, feature_cols: list[str], models: FittedModels,
                summary_table: DataFrame | None = None, draws: str = "numpy",
                base: DataFrame | None = None, min_date: str | None = None) -> DataFrame:
    """Groups x horizons x scenarios plus the portfolio rollup (M11, U2); sort at the sink (O3)."""
    frame = scenario_frame(features, feature_cols, HORIZONS, SCENARIOS, base, min_date)
    return with_rollup(scored_intervals(frame, models, draws), summary_table)


def with_rollup(rows: DataFrame, summary_table: DataFrame | None = None) -> DataFrame:
    """Group rows plus 'all'/'all' rows per (horizon, scenario) in one aggregate (A6), predictions schema.

    GROUPING SETS ((horizon, scenario, channel, type), (horizon, scenario)): a
    group-level set has exactly one row, so its sums are the row's own values
    and its ratios are taken as they are; the (horizon, scenario) set is the
    portfolio rollup, whose ratios come from the sums (T19).
    """
    keys = ["forecast_period_days", "budget_scenario", "channel", "campaign_type"]
    g = rows.groupingSets([keys, keys[:2]], *keys).agg(
        F.grouping("channel").alias("_portfolio"),
        F.sum("spend_input").alias("spend_input"),
        *[F.sum(f"revenue_{p}").alias(f"revenue_{p}") for p in ("p10", "p50", "p90")],
        *[F.first(f"roas_{p}").alias(f"_roas_{p}") for p in ("p10", "p50", "p90")])
    top = F.col("_portfolio") == 1
    ratio = {p: F.when(top, F.when(F.col("spend_input") > 0, clip(F.coalesce(
        F.col(f"revenue_{p}") / F.col("spend_input"), F.lit(0.0)), 0.0, 50.0)).otherwise(F.lit(0.0)))
        .otherwise(F.col(f"_roas_{p}")) for p in ("p10", "p50", "p90")}
    out = g.select("forecast_period_days",
                   F.when(top, F.lit("all")).otherwise(F.col("channel")).alias("channel"),
                   F.when(top, F.lit("all")).otherwise(F.col("campaign_type")).alias("campaign_type"),
                   "revenue_p10", "revenue_p50", "revenue_p90",
                   *[ratio[p].alias(f"roas_{p}") for p in ("p10", "p50", "p90")],
                   "spend_input", "budget_scenario")
    if summary_table is None:
        out = out.withColumn("causal_summary", F.when(F.col("channel") == "all", F.lit(MISSING_PORTFOLIO_SUMMARY))
                             .otherwise(F.lit(None).cast("string")))
        return out.select(*PREDICTION_COLUMNS)
    return summary_lookup(out, summary_table).select(*PREDICTION_COLUMNS)


def sort_predictions(pred: DataFrame) -> DataFrame:
    """forecast_period_days, channel, campaign_type, budget_scenario; 'all' sorts by bytes."""
    return pred.orderBy("forecast_period_days", "channel", "campaign_type", "budget_scenario")


def what_if(features: DataFrame, feature_cols: list[str], models: FittedModels, multipliers: DataFrame,
            horizon: int = WHAT_IF_HORIZON, draws: str = "numpy", base: DataFrame | None = None,
            min_date: str | None = None) -> DataFrame:
    """Per group: spend_input and revenue p10/p50/p90, ratio p50 under per-channel multipliers."""
    frame = what_if_frame(features, feature_cols, multipliers, horizon, base, min_date)
    rows = scored_intervals(frame, models, draws)
    return rows.select(*GROUP_KEYS, "spend_input", "revenue_p10", "revenue_p50", "revenue_p90", "roas_p50")


def what_if_totals(sim: DataFrame) -> DataFrame:
    """Portfolio totals of a what-if table; ratio = p50 / spend, 0 without spend, not clipped."""
    t = sim.agg(F.sum("spend_input").alias("total_spend"), F.sum("revenue_p10").alias("total_revenue_p10"),
                F.sum("revenue_p50").alias("total_revenue_p50"), F.sum("revenue_p90").alias("total_revenue_p90"))
    return t.withColumn("total_roas", F.when(F.col("total_spend") > 0,
                                             F.col("total_revenue_p50") / F.col("total_spend")).otherwise(F.lit(0.0)))


def yield_curve(features: DataFrame, feature_cols: list[str], models: FittedModels,
                horizon: int = WHAT_IF_HORIZON, draws: str = "numpy", channels=YIELD_CHANNELS,
                base: DataFrame | None = None, min_date: str | None = None) -> DataFrame:
    """Per (channel, multiplier): summed revenue p50 and spend; points without spend dropped."""
    frame = yield_frame(features, feature_cols, horizon, channels, base, min_date)
    rows = scored_intervals(frame, models, draws)
    curve = rows.groupBy("channel", "multiplier").agg(
        F.sum(F.col("base_spend") * F.col("multiplier") * F.col("forecast_period_days")).alias("spend"),
        F.sum("revenue_p50").alias("revenue_p50"))
    return curve.where(F.col("spend") > 0)


def nearest_points(curve: DataFrame, targets=(MARGINAL_BASE, MARGINAL_HIGH)) -> DataFrame:
    """Per channel, the curve point nearest each target multiplier; ties -> smaller multiplier."""
    out = curve.groupBy("channel").agg(
        F.count(F.lit(1)).alias("points"),
        *[F.min_by(F.struct("multiplier", "spend", "revenue_p50"),
                   F.struct(F.abs(F.col("multiplier") - F.lit(t)).alias("d"), F.col("multiplier").alias("m"))
                   ).alias(f"near_{i}") for i, t in enumerate(targets)])
    return out


def marginal_return(curve: DataFrame) -> DataFrame:
    """dR/dS between the points nearest 1.0 and 1.15 (really 1.1667, T20); channels with >= 2 points."""
    n = nearest_points(curve).where(F.col("points") >= 2)
    ds = F.col("near_1.spend") - F.col("near_0.spend")
    dr = F.col("near_1.revenue_p50") - F.col("near_0.revenue_p50")
    return n.select(F.upper("channel").alias("channel"), F.col("near_0.spend").alias("base_spend"),
                    ds.alias("incremental_spend"), dr.alias("incremental_revenue"),
                    F.when(ds > 0, dr / ds).otherwise(F.lit(0.0)).alias("marginal_roas"))


def report_filter(pred: DataFrame, horizon: int = 60, channels=REPORT_CHANNELS) -> DataFrame:
    """Rows of one horizon, chosen channels, base scenario."""
    return pred.where((F.col("forecast_period_days") == horizon) & F.col("channel").isin(*channels)
                      & (F.col("budget_scenario") == "base"))


def error_bars(view: DataFrame) -> DataFrame:
    """Chart label and asymmetric error bars p90 - p50, p50 - p10."""
    return view.select(
        report_label("channel", "campaign_type").alias("label"), "channel", "campaign_type",
        "revenue_p50", (F.col("revenue_p90") - F.col("revenue_p50")).alias("revenue_err_plus"),
        (F.col("revenue_p50") - F.col("revenue_p10")).alias("revenue_err_minus"),
        "roas_p50", (F.col("roas_p90") - F.col("roas_p50")).alias("roas_err_plus"),
        (F.col("roas_p50") - F.col("roas_p10")).alias("roas_err_minus"))


def report_table(view: DataFrame) -> DataFrame:
    """Detailed forecast summary projection."""
    return view.select("forecast_period_days", "channel", "campaign_type", "spend_input", "revenue_p10",
                       "revenue_p50", "revenue_p90", "roas_p10", "roas_p50", "roas_p90")
