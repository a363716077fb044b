"""Calendar, lag, rolling, budget and one-hot features (F1-F10, W1-W7, O2, S5 schema).

All window features share one specification, partitioned by (channel,
campaign_type) and ordered by date, so the plan has a single exchange and a
single sort for the whole family. A group holds one row per day after A1, so
a partition stays bounded by the number of days whatever the raw volume.
Frames count rows, not days (T10), and the rolling frames include the
current row (T11), as the reference does.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import budget_ratio_feature, calendar_columns
from .aggregate import GROUP_KEYS
from .common import one_row

# Feature names in the order the models consume them.
CALENDAR_FEATURES = ["month", "week_of_year", "day_of_week", "quarter", "is_q4", "is_november",
                     "is_december", "days_since_start"]
LAG_FEATURES = ["lag_7d_revenue", "lag_14d_revenue", "lag_30d_revenue", "lag_7d_spend", "lag_30d_spend",
                "lag_7d_roas", "lag_30d_roas"]
ROLLING_FEATURES = ["rolling_7d_revenue_mean", "rolling_30d_revenue_mean", "rolling_7d_spend_mean",
                    "rolling_30d_spend_mean", "rolling_7d_roas_mean", "rolling_30d_roas_mean",
                    "rolling_7d_revenue_std"]
BUDGET_FEATURES = ["spend", "spend_vs_budget_ratio"]
GUARANTEED_CHANNELS = ["google", "bing", "meta"]
CHANNEL_DUMMIES = [f"channel_{c}" for c in GUARANTEED_CHANNELS]
BASE_FEATURE_COLUMNS = CALENDAR_FEATURES + LAG_FEATURES + ROLLING_FEATURES + BUDGET_FEATURES + CHANNEL_DUMMIES
TYPE_PREFIX = "campaign_type_"

# Fixed values: (source column, lag in rows) and (source column, window rows).
LAGS = [("revenue", 7), ("revenue", 14), ("revenue", 30), ("spend", 7), ("spend", 30), ("roas", 7), ("roas", 30)]
ROLLING_MEANS = [("revenue", 7), ("revenue", 30), ("spend", 7), ("spend", 30), ("roas", 7), ("roas", 30)]
ROLLING_STD_ROWS = 7


def group_window():
    return Window.partitionBy(*GROUP_KEYS).orderBy("date")


def lag_column(src: str, n: int) -> F.Column:
    """Value n rows earlier in the group, missing -> 0."""
    return F.coalesce(F.lag(src, n).over(group_window()), F.lit(0.0))


def rolling_mean(src: str, n: int) -> F.Column:
    """Mean of the last n rows including the current one, min 1 row."""
    return F.avg(src).over(group_window().rowsBetween(-(n - 1), 0))


def rolling_std(src: str, n: int) -> F.Column:
    """Sample std of the last n rows, fewer than 2 rows -> 0."""
    return F.coalesce(F.stddev_samp(src).over(group_window().rowsBetween(-(n - 1), 0)), F.lit(0.0))


def observed_values(daily: DataFrame) -> tuple[list[str], list[str]]:
    """Distinct channels and campaign types (F9, F10): the values that become columns."""
    found = [sorted(r[0] for r in daily.select(c).where(F.col(c).isNotNull()).distinct().collect()) for c in GROUP_KEYS]
    return found[0], found[1]


def dummy_name(prefix: str, value: str, plain: str) -> str:
    """Column name of a one-hot value: a function of the value alone, so training and scoring tables agree.

    Values of ``plain`` characters (one letter case) keep their own name. Any other value, which could clash with
    another in a case-insensitive schema or need quoting, has odd characters replaced and a digest appended.
    """
    if re.fullmatch(plain, value):
        return prefix + value
    return f"{prefix}{re.sub('[^A-Za-z0-9_]', '_', value)}_{hashlib.md5(value.encode()).hexdigest()[:10]}"


def type_column(campaign_type: str) -> str:
    return dummy_name(TYPE_PREFIX, campaign_type, "[A-Z0-9_]+")


def channel_column(channel: str) -> str:
    return dummy_name("channel_", channel, "[a-z0-9_]+")


def channel_dummies(channels: list[str]) -> dict[str, str]:
    """Column -> channel: observed channels in sorted order, then any guaranteed channel not observed."""
    names = {channel_column(c): c for c in sorted(channels)}
    return names | {channel_column(c): c for c in GUARANTEED_CHANNELS if channel_column(c) not in names}


def feature_values(channels: list[str], types: list[str]) -> list[tuple[str, str, str]]:
    """(feature, key column, value) of every one-hot column: the name-to-value table kept with a bundle."""
    return ([(n, "channel", c) for n, c in channel_dummies(channels).items()]
            + [(type_column(t), "campaign_type", t) for t in sorted(types)])


def build_features(daily: DataFrame, channels: list[str] | None = None,
                   types: list[str] | None = None) -> DataFrame:
    """Daily table -> feature table (the Parquet schema of S5).

    ``channels``/``types`` fix the one-hot columns; by default they are the
    observed values (one small collect per key column). ``daily``
    is read for those values, for the global first date and for the windows,
    so pass a materialised table (``plans.pipeline`` does) rather than a plan
    over raw data.
    """
    if channels is None or types is None:
        obs_channels, obs_types = observed_values(daily)
        channels = obs_channels if channels is None else channels
        types = obs_types if types is None else types
    min_date = daily.agg(F.min("date").alias("_min_date"))
    df = daily.crossJoin(one_row(min_date))
    cal = calendar_columns("date", "_min_date")
    cols = [F.col(c) for c in daily.columns]
    cols += [cal[name].alias(name) for name in CALENDAR_FEATURES]
    cols += [lag_column(src, n).alias(f"lag_{n}d_{src}") for src, n in LAGS]
    cols += [rolling_mean(src, n).alias(f"rolling_{n}d_{src}_mean") for src, n in ROLLING_MEANS]
    cols.append(rolling_std("revenue", ROLLING_STD_ROWS).alias("rolling_7d_revenue_std"))
    cols.append(budget_ratio_feature("spend", "daily_budget").alias("spend_vs_budget_ratio"))
    for name, key, value in feature_values(channels, types):
        cols.append((F.col(key) == F.lit(value)).cast("long").alias(name))
    return df.select(*cols)


def feature_columns(features: DataFrame) -> list[str]:
    """Training columns: fixed names plus every ``campaign_type_*`` column."""
    types = [c for c in features.columns if c.startswith(TYPE_PREFIX)]
    return BASE_FEATURE_COLUMNS + types


def feature_sort(features: DataFrame) -> DataFrame:
    """Feature order channel, campaign_type, date (O2), within partitions before a write."""
    return features.sortWithinPartitions(*GROUP_KEYS, "date")


def last_rows(features: DataFrame, n: int = 30) -> DataFrame:
    """Last n rows of every group by date."""
    w = Window.partitionBy(*GROUP_KEYS).orderBy(F.col("date").desc())
    return features.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
