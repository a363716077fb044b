"""Raw ad-platform dialects derived from the driver tables (FIXTURES.md section 3).

The driver tables hold no ad data, so ``lineitem JOIN part`` is re-labelled as
three platform exports. Each dialect keeps the column names and value forms of
the platform (google micros, bing PascalCase, meta ``<type>_<name>``), so the
normalisers run exactly as they would on the exported files.

Plan shape: one pruned scan of ``lineitem`` and ``part`` per dialect, the
``l_returnflag`` filter is pushed into the Parquet scan, and the join is done
by broadcast only while the counted rows of ``part`` stay under a bound: a broadcast
goes through the driver, once per scan of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import BROADCAST_MAX_BYTES, row_bytes
from ..session import prepare, table_path

# Which return flag plays which platform.
DIALECT_FLAGS = {"google": "A", "bing": "N", "meta": "R"}

# Meta campaign-name prefix per part type; other types keep their own name.
META_PREFIX = {"PROMO": "Prospecting", "STANDARD": "Remarketing", "LARGE": "Generic"}

# Every 997th order carries an unparseable date ("n/a").
BAD_DATE_ORDER_STEP = 997
GOOGLE_VIDEO_FROM = "2001-09-20"   # SMALL parts become VIDEO campaigns from this day
BING_LARGE_FROM = "2001-06-01"     # ECONOMY parts become LARGE campaigns from this day

# Largest ``part`` (counted rows times the width of a row) that is broadcast.
PART_BROADCAST_BYTES = BROADCAST_MAX_BYTES


def _base(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    li = (spark.read.parquet(table_path(sf_dir, "lineitem"))
          .where(F.col("l_returnflag") == flag)
          .select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
                  "l_extendedprice", "l_discount", "l_tax", "l_shipdate"))
    part = spark.read.parquet(table_path(sf_dir, "part")).select(
        "p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    # without a hint Spark would broadcast a larger table too, as long as its compressed file is small
    small = part.count() * row_bytes(part) <= PART_BROADCAST_BYTES
    return (li.join(part.hint("broadcast" if small else "merge"), li.l_partkey == part.p_partkey, "inner")
            .withColumn("d", F.to_date("l_shipdate")))


def _date_text() -> F.Column:
    # the cast writes the same text without a formatter, as long as the year has four digits
    plain = F.col("d").between(F.lit("0001-01-01").cast("date"), F.lit("9999-12-31").cast("date"))
    return (F.when(F.col("l_orderkey") % BAD_DATE_ORDER_STEP == 0, F.lit("n/a")).when(plain, F.col("d").cast("string"))
            .otherwise(F.date_format("d", "yyyy-MM-dd")))


def _budget() -> F.Column:
    return F.when(F.col("l_tax") == 0, F.lit(None).cast("double")).otherwise(F.col("p_retailprice"))


def raw_google(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _base(spark, sf_dir, DIALECT_FLAGS["google"])
    ctype = (F.when((F.col("p_type") == "SMALL") & (F.col("d") >= F.lit(GOOGLE_VIDEO_FROM).cast("date")),
                    F.lit("VIDEO"))
             .when(F.col("p_size") == 50, F.lit(None).cast("string"))
             .otherwise(F.col("p_type")))
    return b.select(
        F.col("l_partkey").cast("string").alias("campaign_id"),
        F.col("p_brand").alias("campaign_name"),
        ctype.alias("campaign_advertising_channel_type"),
        _budget().alias("campaign_budget_amount"),
        _date_text().alias("segments_date"),
        (F.col("l_extendedprice") * F.col("l_discount") * F.lit(1e6)).alias("metrics_cost_micros"),
        F.col("l_quantity").cast("long").alias("metrics_clicks"),
        (F.col("l_quantity") * F.col("p_size")).cast("long").alias("metrics_impressions"),
        F.lit(0).cast("long").alias("metrics_video_views"),
        F.col("l_linenumber").cast("double").alias("metrics_conversions"),
        F.col("l_extendedprice").alias("metrics_conversions_value"),
    )


def raw_bing(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _base(spark, sf_dir, DIALECT_FLAGS["bing"])
    ctype = (F.when((F.col("p_type") == "ECONOMY") & (F.col("d") >= F.lit(BING_LARGE_FROM).cast("date")),
                    F.lit("LARGE"))
             .otherwise(F.col("p_type")))
    return b.select(
        F.col("l_partkey").cast("string").alias("CampaignId"),
        F.col("p_brand").alias("CampaignName"),
        ctype.alias("CampaignType"),
        _date_text().alias("TimePeriod"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("Spend"),
        F.col("l_extendedprice").alias("Revenue"),
        F.col("l_quantity").cast("long").alias("Clicks"),
        (F.col("l_quantity") * F.col("p_size")).cast("long").alias("Impressions"),
        F.col("l_linenumber").cast("double").alias("Conversions"),
        _budget().alias("DailyBudget"),
    )


def raw_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _base(spark, sf_dir, DIALECT_FLAGS["meta"])
    prefix = F.col("p_type")
    for ptype, name in reversed(list(META_PREFIX.items())):
        prefix = F.when(F.col("p_type") == ptype, F.lit(name)).otherwise(prefix)
    return b.select(
        F.col("l_partkey").cast("string").alias("campaign_id"),
        F.concat(prefix, F.lit("_"), F.col("p_brand")).alias("campaign_name"),
        _date_text().alias("date_start"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("spend"),
        F.col("l_extendedprice").alias("conversion"),
        F.col("l_quantity").alias("clicks"),
        (F.col("l_quantity") * F.col("p_size")).alias("impressions"),
        _budget().alias("daily_budget"),
        (F.col("l_extendedprice") / 100).alias("cpc"),
        (F.col("l_extendedprice") / 1000).alias("cpm"),
    )


def raw_dialects(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The three raw platform tables, keyed by channel."""
    prepare(spark)
    return {"google": raw_google(spark, sf_dir), "bing": raw_bing(spark, sf_dir),
            "meta": raw_meta(spark, sf_dir)}


def events_canonical(spark: SparkSession, sf_dir: str, by_weekday: bool = False) -> DataFrame:
    """Second source: the ``events`` table as canonical rows of channel 'web'.

    campaign_type = event_type (``by_weekday``: and the weekday's number, Monday 0, so that a group has a few
    days only), date = day of ts, revenue = value; the stream carries no spend, clicks or budget, so those are 0.
    """
    prepare(spark)
    ev = spark.read.parquet(table_path(sf_dir, "events")).select("ts", "event_type", "value", "user_id")
    from ..operators.normalize import finish_canonical
    kind = F.coalesce(F.col("event_type"), F.lit("Unknown"))
    if by_weekday:
        kind = F.concat(kind, F.lit("_"), F.weekday(F.to_date("ts")).cast("string"))
    return finish_canonical(ev.select(
        F.to_date("ts").alias("date"),
        F.lit("web").alias("channel"),
        kind.alias("campaign_type"),
        F.coalesce(F.col("event_type"), F.lit("Unknown")).alias("campaign_name"),
        F.lit(0.0).alias("spend"),
        F.coalesce(F.col("value"), F.lit(0.0)).alias("revenue"),
        F.lit(0).cast("long").alias("clicks"),
        F.lit(0).cast("long").alias("impressions"),
        F.lit(0.0).alias("conversions"),
        F.lit(0.0).alias("daily_budget"),
        F.col("user_id").cast("string").alias("campaign_id"),
    ).where(F.col("date").isNotNull()))
