"""Period statistics, trend, anomalies, risk flags and summaries.

``scope_stats`` runs the reference's per-scope statistics for every scope at
once: one aggregate per scope (anchor date, mean, sample std), joined back to
the rows for the period sums and the z-scores. Each scope keeps its own
anchor (T16). Scopes are groups, channels (rows at date x type grain, T17)
or the portfolio (daily sums).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import capitalize, clip
from ..functions.text import (MISSING_CHANNEL_SUMMARY, MISSING_INSIGHT, MISSING_NARRATIVE, MISSING_PORTFOLIO_SUMMARY,
                              prompt_text, template_summary)
from ..session import cut_lineage
from .aggregate import GROUP_KEYS, portfolio_daily
from .common import broadcast_if_small

# Trend thresholds, anomaly z-score, risk ratio, horizons.
TREND_UP = 1.05
TREND_DOWN = 0.95
ANOMALY_Z = 2.5
RISK_ROAS = 1.5
HORIZONS = [30, 60, 90]
MAX_PROMPT_ANOMALIES = 5
ANOMALY_ISSUE = "Revenue Z-Score > 2.5 (Volume Anomaly)"
# Scopes and horizon of the insight page.
INSIGHT_SCOPES = ["all", "google", "meta", "bing"]
INSIGHT_HORIZON = 60


def _anchored(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their scope's anchor date, mean and sample std.

    A scope can be a whole channel (a third of the rows each): the one-row-per-
    scope side is broadcast after a size check, so no scope becomes one task.
    """
    per_scope = rows.groupBy(*keys).agg(
        F.max("date").alias("_last"),
        F.avg("revenue").alias("_mean"),
        F.stddev_samp("revenue").alias("_std"))
    return rows.join(broadcast_if_small(cut_lineage(per_scope, "scopes")), keys, "inner")


def _is_anomaly() -> F.Column:
    z = (F.col("revenue") - F.col("_mean")) / F.col("_std")
    return (F.col("_std") > 0) & (F.abs(z) > ANOMALY_Z)


def anomaly_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose revenue z-score over the whole scope exceeds 2.5 in absolute value."""
    return _anchored(rows, keys).where(_is_anomaly()).select(*keys, "date")


def first_anomalies(anchored: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, anomaly_flags): the first ``most`` anomaly dates of every scope that has any.

    The rank limit drops the others before the shuffle and before dates are put together, so neither a task nor an
    array grows with a scope's anomalies.
    """
    by_date = Window.partitionBy(*keys).orderBy("date")
    found = anchored.where(_is_anomaly()).select(*keys, "date").withColumn("_n", F.row_number().over(by_date)).where(F.col("_n") <= most)
    return found.groupBy(*keys).agg(F.array_sort(F.collect_list("date")).alias("anomaly_flags"))


def scope_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per scope: 30/90-day ratios and totals, trend, number of anomalies and the first ``MAX_PROMPT_ANOMALIES`` of their
    dates (A3, A4, W8, I1); ``anomaly_rows`` has all of them.

    ``rows`` has ``keys``, date, revenue, spend.
    """
    a = _anchored(rows, keys)
    last = F.col("_last")
    in30 = F.col("date") > F.date_sub(last, 30)
    in90 = F.col("date") > F.date_sub(last, 90)
    prior = (F.col("date") <= F.date_sub(last, 30)) & (F.col("date") > F.date_sub(last, 60))
    s = a.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(in30, F.col("revenue"))), F.lit(0.0)).alias("revenue_last_30d"),
        F.coalesce(F.sum(F.when(in30, F.col("spend"))), F.lit(0.0)).alias("spend_last_30d"),
        F.coalesce(F.sum(F.when(in90, F.col("revenue"))), F.lit(0.0)).alias("total_revenue_last_90d"),
        F.coalesce(F.sum(F.when(in90, F.col("spend"))), F.lit(0.0)).alias("total_spend_last_90d"),
        F.coalesce(F.sum(F.when(prior, F.col("revenue"))), F.lit(0.0)).alias("revenue_prior_30d"),
        F.count(F.when(_is_anomaly(), 1)).alias("anomalies"),
        F.first("_mean").alias("revenue_mean"),
        F.first("_std").alias("revenue_std"),
        F.count(F.lit(1)).alias("rows"),
    )
    ratio30 = F.when(F.col("spend_last_30d") > 0,
                     clip(F.col("revenue_last_30d") / F.col("spend_last_30d"), 0.0, 50.0)).otherwise(0.0)
    ratio90 = F.when(F.col("total_spend_last_90d") > 0,
                     clip(F.col("total_revenue_last_90d") / F.col("total_spend_last_90d"), 0.0, 50.0)).otherwise(0.0)
    trend = (F.when(F.col("revenue_last_30d") > F.col("revenue_prior_30d") * TREND_UP, F.lit("up"))
             .when(F.col("revenue_last_30d") < F.col("revenue_prior_30d") * TREND_DOWN, F.lit("down"))
             .otherwise(F.lit("flat")))
    # one row per scope that has anomalies, at most MAX_PROMPT_ANOMALIES dates each
    first = first_anomalies(a, keys, MAX_PROMPT_ANOMALIES)
    s = s.join(broadcast_if_small(cut_lineage(first, "first-anomalies")), keys, "left").withColumn(
        "anomaly_flags", F.coalesce("anomaly_flags", F.array().cast("array<date>")))
    return s.select(*keys, ratio30.alias("avg_roas_last_30d"), ratio90.alias("avg_roas_last_90d"),
                    "total_revenue_last_90d", "total_spend_last_90d", trend.alias("trend_direction"),
                    "anomalies", "anomaly_flags", "revenue_last_30d", "revenue_prior_30d", "revenue_mean",
                    "revenue_std", "rows")


def with_empty_defaults(scopes: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Scopes without rows get 0 ratios and totals, 'flat', no anomalies."""
    j = scopes.select(*keys).distinct().join(stats, keys, "left")
    return j.select(
        *keys,
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in
          ("avg_roas_last_30d", "avg_roas_last_90d", "total_revenue_last_90d", "total_spend_last_90d")],
        F.coalesce(F.col("trend_direction"), F.lit("flat")).alias("trend_direction"),
        F.coalesce("anomalies", F.lit(0)).alias("anomalies"),
        F.coalesce(F.col("anomaly_flags"), F.array().cast("array<date>")).alias("anomaly_flags"))


def group_stats(features: DataFrame) -> DataFrame:
    """Stats per (channel, campaign_type) over the group's daily rows (I3, group grain)."""
    return scope_stats(features.select(*GROUP_KEYS, "date", "revenue", "spend"), GROUP_KEYS)


def group_anomalies(features: DataFrame) -> DataFrame:
    """Every anomaly date of every (channel, campaign_type), one row each."""
    return anomaly_rows(features.select(*GROUP_KEYS, "date", "revenue"), GROUP_KEYS)


def channel_stats(features: DataFrame) -> DataFrame:
    """Stats per channel over its (date, type) rows, not daily totals."""
    return scope_stats(features.select("channel", "date", "revenue", "spend"), ["channel"])


def portfolio_stats(features: DataFrame) -> DataFrame:
    """Stats of the daily portfolio sums, scope 'all' (I3)."""
    p = portfolio_daily(features).withColumn("scope", F.lit("all"))
    return scope_stats(p.select("scope", "date", "revenue", "spend"), ["scope"])


def top_campaign_type(features: DataFrame, by_channel: bool = True) -> DataFrame:
    """Campaign type with the largest summed revenue; ties -> smallest name."""
    keys = ["channel"] if by_channel else []
    sums = features.groupBy(*keys, "campaign_type").agg(F.sum("revenue").alias("_rev"))
    pick = F.min_by("campaign_type", F.struct((-F.col("_rev")).alias("r"), F.col("campaign_type").alias("t")))
    return sums.groupBy(*keys).agg(pick.alias("top_campaign_type"))


def campaign_type_lists(features: DataFrame) -> DataFrame:
    """Types per channel (sorted) and overall in order of first appearance by channel (A10)."""
    per_channel = features.groupBy(F.col("channel").alias("scope")).agg(
        F.array_sort(F.collect_set("campaign_type")).alias("campaign_types"))
    first_seen = features.groupBy("campaign_type").agg(F.min("channel").alias("_ch"))
    ordered = first_seen.agg(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("_ch").alias("c"), F.col("campaign_type").alias("t")))),
        lambda s: s["t"]).alias("campaign_types")).withColumn("scope", F.lit("all"))
    return per_channel.unionByName(ordered.select("scope", "campaign_types"))


def scope_inputs(features: DataFrame) -> DataFrame:
    """One row per channel plus 'all': the statistics that feed the summary text (I4)."""
    ch = channel_stats(features).withColumnRenamed("channel", "scope")
    pf = portfolio_stats(features)
    stats = ch.unionByName(pf)
    tops = (top_campaign_type(features, True).withColumnRenamed("channel", "scope")
            .unionByName(top_campaign_type(features, False).withColumn("scope", F.lit("all"))))
    return stats.join(tops, "scope", "left").join(campaign_type_lists(features), "scope", "left")


def summaries(features: DataFrame, horizons: list[int] = HORIZONS) -> DataFrame:
    """Summary table (scope, horizon, summary, prompt) for channels and the portfolio."""
    base = scope_inputs(features)
    hz = features.sparkSession.createDataFrame([(h,) for h in horizons], "horizon long")
    first5 = F.transform("anomaly_flags", lambda d: F.date_format(d, "yyyy-MM-dd"))
    return base.crossJoin(F.broadcast(hz)).select(
        "scope", "horizon",
        template_summary("scope", "avg_roas_last_30d", "trend_direction", "top_campaign_type").alias("summary"),
        prompt_text("scope", "campaign_types", "avg_roas_last_30d", "avg_roas_last_90d", "trend_direction",
                    "top_campaign_type", "total_revenue_last_90d", "horizon", first5).alias("prompt"))


def summary_lookup(rows: DataFrame, summary_table: DataFrame) -> DataFrame:
    """Attach ``causal_summary`` by (channel, horizon); 'all' rows read the portfolio entry."""
    s = summary_table.select(F.col("scope").alias("_scope"), F.col("horizon").alias("_h"),
                             F.col("summary").alias("_summary"))
    scope = F.when(F.col("channel") == "all", F.lit("all")).otherwise(F.col("channel"))
    j = rows.join(s, (scope == F.col("_scope")) & (F.col("forecast_period_days") == F.col("_h")), "left")
    default = F.when(F.col("channel") == "all", F.lit(MISSING_PORTFOLIO_SUMMARY)).otherwise(F.lit(MISSING_CHANNEL_SUMMARY))
    return j.withColumn("causal_summary", F.coalesce(F.col("_summary"), default)).drop("_scope", "_h", "_summary")


def insight_texts(summary_table: DataFrame, scopes: list[str] = INSIGHT_SCOPES, horizon: int = INSIGHT_HORIZON) -> DataFrame:
    """(scope, summary) of the insight page: one row per shown scope, with that page's own defaults."""
    shown = summary_table.sparkSession.createDataFrame([(s,) for s in scopes], "scope string")
    found = summary_table.where(F.col("horizon") == horizon).select("scope", "summary")
    default = F.when(F.col("scope") == "all", F.lit(MISSING_NARRATIVE)).otherwise(
        F.replace(F.lit(MISSING_INSIGHT), F.lit("{channel}"), capitalize("scope")))
    return shown.join(found, "scope", "left").select("scope", F.coalesce("summary", default).alias("summary"))


def anomaly_table(anomalies: DataFrame) -> DataFrame:
    """One row per (group, anomaly date, issue), from the groups' anomaly rows (fresh or a bundle's)."""
    return anomalies.select(F.concat_ws("__", "channel", "campaign_type").alias("group"),
                            F.date_format("date", "yyyy-MM-dd").alias("date"), F.lit(ANOMALY_ISSUE).alias("issue"))


def risk_flags(stats: DataFrame) -> DataFrame:
    """Declining trend and 30-day ratio below 1.5, one row per flag."""
    g = F.concat_ws("__", "channel", "campaign_type").alias("group")
    down = stats.where(F.col("trend_direction") == "down").select(
        g, F.lit("declining_trend").alias("risk"), F.col("avg_roas_last_30d"))
    low = stats.where(F.col("avg_roas_last_30d") < RISK_ROAS).select(
        g, F.lit("low_roas").alias("risk"), F.col("avg_roas_last_30d"))
    return down.unionByName(low)
