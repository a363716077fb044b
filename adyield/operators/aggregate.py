"""Aggregations over canonical and daily tables.

A1 is the only step whose input grows with the raw data: it is a hash
aggregate with map-side partial sums, so a hot (date, channel, type) key is
combined inside each map task before the shuffle. Everything downstream of
A1 scales with days x groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import safe_ratio

DAILY_KEYS = ["date", "channel", "campaign_type"]
GROUP_KEYS = ["channel", "campaign_type"]
DAILY_COLUMNS = DAILY_KEYS + ["spend", "revenue", "clicks", "impressions", "conversions", "daily_budget", "roas"]


def daily_aggregate(canonical: DataFrame) -> DataFrame:
    """Sum six measures per (date, channel, campaign_type), ratio from the sums (A1).

    NULL google spend sums to 0 as in pandas (T8).
    """
    g = canonical.groupBy(*DAILY_KEYS).agg(
        F.coalesce(F.sum("spend"), F.lit(0.0)).alias("spend"),
        F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"),
        F.coalesce(F.sum("clicks"), F.lit(0)).cast("long").alias("clicks"),
        F.coalesce(F.sum("impressions"), F.lit(0)).cast("long").alias("impressions"),
        F.coalesce(F.sum("conversions"), F.lit(0.0)).alias("conversions"),
        F.coalesce(F.sum("daily_budget"), F.lit(0.0)).alias("daily_budget"),
    )
    return g.withColumn("roas", safe_ratio("revenue", "spend")).select(*DAILY_COLUMNS)


def portfolio_daily(daily: DataFrame) -> DataFrame:
    """Revenue and spend summed over all channels per date (A2)."""
    return daily.groupBy("date").agg(F.sum("revenue").alias("revenue"), F.sum("spend").alias("spend"))


def channel_status(canonical: DataFrame) -> DataFrame:
    """Rows, spend and revenue per channel."""
    return canonical.groupBy("channel").agg(
        F.count(F.lit(1)).alias("records"),
        F.coalesce(F.sum("spend"), F.lit(0.0)).alias("spend"),
        F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"))


def training_metadata(features: DataFrame) -> DataFrame:
    """min date, max date, rows of the training table."""
    return features.agg(
        F.date_format(F.min("date"), "yyyy-MM-dd").alias("min_date"),
        F.date_format(F.max("date"), "yyyy-MM-dd").alias("max_date"),
        F.count(F.lit(1)).alias("num_rows"))
