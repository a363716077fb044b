"""Input validation and data-quality tables.

Each check is an aggregate returned as rows of a table, so callers decide
whether to abort; only ``check`` collects its four rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import is_typed_date
from ..session import cut_lineage
from .common import one_row
from .normalize import CANONICAL_COLUMNS

# Validation thresholds.
MIN_ROWS = 100
MAX_NONPOSITIVE_REVENUE_SHARE = 0.5
EXPECTED_CHANNELS = ["google", "bing", "meta"]
PREVIEW_ROWS = 20


def quality_metrics(canonical: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Null cells, share of revenue <= 0, calendar gaps, distinct campaigns.

    The raw rows are reduced once, to one row per (date, campaign), which is written; both distinct counts and
    the sums read that table. ``approx_distinct`` counts campaigns with HyperLogLog in a single aggregate instead.
    """
    nulls = sum((F.col(c).isNull().cast("long") for c in CANONICAL_COLUMNS), F.lit(0))
    nonpositive = F.sum(F.when(F.col("revenue") <= 0, 1).otherwise(0))
    if approx_distinct:
        m = canonical.agg(F.sum(nulls).alias("missing"), nonpositive.alias("nonpositive"), F.count(F.lit(1)).alias("rows"),
                          F.min("date").alias("_min"), F.max("date").alias("_max"),
                          F.approx_count_distinct("date").alias("dates"),
                          F.approx_count_distinct("campaign_id").alias("campaigns"))
    else:
        base = cut_lineage(canonical.groupBy("date", "campaign_id").agg(
            F.sum(nulls).alias("missing"), nonpositive.alias("nonpositive"), F.count(F.lit(1)).alias("rows")), "per-campaign")
        m = base.agg(F.sum("missing").alias("missing"), F.sum("nonpositive").alias("nonpositive"), F.sum("rows").alias("rows"),
                     F.min("date").alias("_min"), F.max("date").alias("_max"))
        for column, name in (("date", "dates"), ("campaign_id", "campaigns")):
            m = m.crossJoin(one_row(base.select(column).distinct().agg(F.count(column).alias(name))))
    rows = F.coalesce("rows", F.lit(0))
    return m.select(
        F.coalesce(F.col("missing"), F.lit(0)).cast("long").alias("missing_values"),
        F.when(rows > 0, F.col("nonpositive") / rows).alias("nonpositive_revenue_share"),
        (F.datediff("_max", "_min") + 1 - F.col("dates")).cast("long").alias("date_gaps"),
        F.col("campaigns").cast("long").alias("active_campaigns"), rows.alias("rows"))


def expected_channels(canonical: DataFrame, expected=EXPECTED_CHANNELS) -> DataFrame:
    """Expected channels absent from the data (J7): anti join of the list against distinct channels."""
    spark = canonical.sparkSession
    exp = spark.createDataFrame([(c,) for c in expected], "channel string")
    present = canonical.select("channel").distinct()
    return exp.join(present, "channel", "left_anti")


def has_typed_dates(df: DataFrame) -> bool:
    """Whether the table's ``date`` is a date or timestamp; text, a number or no such column is not."""
    return "date" in df.columns and is_typed_date(df.schema["date"].dataType)


def channel_counts(canonical: DataFrame) -> DataFrame:
    """Rows and rows with revenue <= 0 per channel, and whether dates are dates: what the validation rules need."""
    return canonical.groupBy("channel").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("revenue") <= 0, 1).otherwise(0)).alias("nonpositive"),
        F.lit(has_typed_dates(canonical)).alias("typed_dates"))


def validation_rules(counts: DataFrame) -> DataFrame:
    """Rule table (rule, value, level): row count, date type, revenue share, missing channels.

    ``counts`` is ``channel_counts`` of canonical rows, or any table that sums up to it and has their ``date``
    (``Ingest.grain``): one aggregate over it gives all rules.
    """
    typed = F.coalesce(F.bool_and("typed_dates"), F.lit(True)) if "typed_dates" in counts.columns else F.lit(has_typed_dates(counts))
    present = F.collect_set(F.when(F.col("channel").isin(*EXPECTED_CHANNELS), F.col("channel")))
    a = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("double").alias("rows"),
                   F.coalesce(F.sum("nonpositive"), F.lit(0)).cast("double").alias("nonpositive"),
                   (F.lit(len(EXPECTED_CHANNELS)) - F.size(present)).cast("double").alias("missing"), typed.alias("typed"))
    share = F.when(F.col("rows") > 0, F.col("nonpositive") / F.col("rows")).otherwise(0.0)

    def rule(name: str, value: Column, level: str, when: Column) -> Column:
        return F.struct(F.lit(name).alias("rule"), value.cast("double").alias("value"),
                        F.when(when, level).otherwise("ok").alias("level"))

    rules = F.array(
        rule("min_rows", F.col("rows"), "abort", F.col("rows") < MIN_ROWS),
        rule("date_type", F.col("typed"), "abort", ~F.col("typed")),
        rule("nonpositive_revenue_share", share, "warn", share > MAX_NONPOSITIVE_REVENUE_SHARE),
        rule("missing_channels", F.col("missing"), "warn", F.col("missing") > 0))
    return a.select(F.explode(rules).alias("r")).select("r.*")


def check(rules: DataFrame) -> list[str]:
    """Raise when any rule is at level 'abort'; return the warnings (the rule table has four rows)."""
    rows = rules.where(F.col("level") != "ok").collect()
    failed = [r for r in rows if r["level"] == "abort"]
    if failed:
        raise ValueError("input validation failed: " + ", ".join(f"{r['rule']}={r['value']}" for r in failed))
    return [f"{r['rule']}={r['value']}" for r in rows]


def preview(canonical: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """First n rows in canonical order (O4). Remaining columns break ties so the pick is deterministic."""
    return canonical.orderBy("date", "channel", "campaign_type", "campaign_name", "campaign_id",
                             "spend", "revenue", "daily_budget", "clicks", "impressions").limit(n)
