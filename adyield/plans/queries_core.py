"""Registered queries: sources, projections, aggregations, windows, sorts, sets, scalars, insights."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from ..functions.exprs import clip, parse_date, text_shape
from ..functions.text import group_key, report_label
from ..operators import aggregate as agg
from ..operators import features as feats
from ..operators import normalize as norm
from ..operators import quality, stats
from ..operators.models import group_table
from ..session import cut_lineage, table_path
from ..sources import csv as csvsrc
from ..sources import sinks
from ..sources.fixtures import events_canonical, raw_dialects
from . import oracle as O
from . import pipeline
from .pipeline import canonical_table, feature_table
from .registry import register

CANON_COLS = norm.CANONICAL_COLUMNS
FIXED_FEATURES = (agg.DAILY_COLUMNS + feats.CALENDAR_FEATURES + feats.LAG_FEATURES + feats.ROLLING_FEATURES
                  + ["spend_vs_budget_ratio"] + feats.CHANNEL_DUMMIES)
MONEY2 = {c: 2 for c in ("rolling_7d_revenue_mean", "rolling_30d_revenue_mean", "rolling_7d_spend_mean",
                         "rolling_30d_spend_mean", "rolling_7d_revenue_std")}
CANON_DBL = {c: 4 for c in ("spend", "revenue", "roas", "conversions", "daily_budget")}
DAILY_DBL = dict(CANON_DBL)
FEAT_DBL = {**DAILY_DBL, **{c: 4 for c in feats.LAG_FEATURES + feats.ROLLING_FEATURES + ["spend_vs_budget_ratio"]},
            **MONEY2}


def _canon(spark, sf):
    return canonical_table(spark, sf)


def _feat(spark, sf):
    return feature_table(spark, sf)


def _cols(names):
    return ", ".join(names)


# ======================================================================= 2.1 sources and sinks

def _export_dir(spark, sf):
    """The dialects as a directory of mixed exports: with and without the index column, columns in another order, an
    unused column left out, quoted names with commas and doubled quotes, missing values as NA."""
    d = sinks.scratch_dir(spark, "dialect-csv")

    def export(item):
        ch, raw = item
        name = "CampaignName" if ch == "bing" else "campaign_name"
        # written once: three exports read it, without the scan and join behind it
        dealt = cut_lineage(raw.withColumn("_part", F.pmod(F.hash(*raw.columns), F.lit(3))), "export")
        quoted = F.concat(F.col(name), F.lit('_"Brand", US'))
        left_out = ("metrics_video_views", "cpm")       # a meta file without its mark is known by its name
        sinks.export_csv(dealt.where("_part = 0").drop("_part"), f"{d}/{ch}_0.csv", with_index=True)
        sinks.export_csv(dealt.where("_part = 1").withColumn(name, quoted).select(raw.columns[::-1]), f"{d}/{ch}_1.csv",
                         with_index=False, null_text="NA")
        sinks.export_csv(dealt.where("_part = 2").select([c for c in raw.columns if c not in left_out]), f"{d}/{ch}_2.csv",
                         with_index=False)

    # the dialects' exports are independent jobs: submit them together, so the last tasks of one leave no core idle
    raws = raw_dialects(spark, sf)
    with ThreadPoolExecutor(max_workers=len(raws)) as pool:
        list(pool.map(export, raws.items()))
    return d


@register("s1_csv_directory_scan", O.q("SELECT * FROM daily", "daily"), DAILY_DBL)
def s1_csv_directory_scan(spark, sf):
    """Driver tables exported as mixed platform CSVs, scanned back by header detection, through the one-pass ingest."""
    return norm.ingest(csvsrc.load_directory(spark, _export_dir(spark, sf), check_rows=False)).daily


@register("s2_csv_pattern_read", O.q("SELECT channel, count(*) AS rows FROM canon GROUP BY channel", "canon"))
def s2_csv_pattern_read(spark, sf):
    """First export matching a pattern, one per dialect, detected by its columns and normalised; rows per channel."""
    d, out = sinks.scratch_dir(spark, "pattern-csv"), None
    for ch, raw in raw_dialects(spark, sf).items():
        sinks.export_csv(raw, f"{d}/{ch.upper()}_export.csv")
    for pattern in ("GOOGLE*.csv", "BING*.csv", "META*.csv"):
        raw = csvsrc.load_by_pattern(spark, d, pattern)
        part = norm.normalize(raw, csvsrc.detect_dialect(raw.columns)).groupBy("channel").agg(F.count(F.lit(1)).alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out


@register("s3_dialect_detection", O.q("""
SELECT 'google' AS dialect, count(*) AS rows FROM g_raw UNION ALL
SELECT 'bing', count(*) FROM b_raw UNION ALL SELECT 'meta', count(*) FROM m_raw""", "g_raw", "b_raw", "m_raw"))
def s3_dialect_detection(spark, sf):
    """Dialect decided per exported file (header, then name); data lines per dialect."""
    d = _export_dir(spark, sf)
    parts = [p for f in csvsrc.csv_files(spark, d) for p in csvsrc.part_files(spark, f)]
    kinds = spark.createDataFrame([(p.rsplit("/", 1)[-1], k) for p, *_, k in csvsrc.detected(spark, parts)],
                                  "file string, dialect string")
    lines = spark.read.text(parts).groupBy(F.col("_metadata.file_name").alias("file")).agg((F.count(F.lit(1)) - 1).alias("n"))
    return kinds.join(lines, "file").groupBy("dialect").agg(F.sum("n").alias("rows"))


@register("s4_file_choice", O.q("""
SELECT 'google' AS channel, count(*) AS rows_read FROM g_raw UNION ALL
SELECT 'bing', count(*) FROM b_raw UNION ALL SELECT 'meta', count(*) FROM m_raw""", "g_raw", "b_raw", "m_raw"))
def s4_file_choice(spark, sf):
    """All files of a dialect are read together: raw rows per channel."""
    raws = csvsrc.load_directory(spark, _export_dir(spark, sf))
    out = None
    for ch, df in raws.items():
        part = df.agg(F.lit(ch).alias("channel"), F.count(F.lit(1)).alias("rows_read"))
        out = part if out is None else out.unionByName(part)
    return out


_LOST, _CUT = "Brand#11", "Brand#12"      # campaigns whose export files hold too wide, or too short rows


def _malformed_dir(spark, sf):
    """The dialects as exports of raw lines: ``kept`` files, ``short`` files whose rows lack the last field, and
    ``long`` files in which every other row has a field too many."""
    d = sinks.scratch_dir(spark, "malformed-csv")
    for ch, raw in raw_dialects(spark, sf).items():
        name, last = ("CampaignName", "Conversions") if ch == "bing" else ("campaign_name", "metrics_conversions" if ch == "google" else "impressions")
        columns = [c for c in raw.columns if c != last] + [last]
        text = lambda cs: F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cs])
        brand = F.substring_index(name, "_", -1)
        kinds = {"kept": (~brand.isin(_LOST, _CUT), F.array(text(columns))), "short": (brand == _CUT, F.array(text(columns[:-1]))),
                 "long": (brand == _LOST, F.array(text(columns), F.concat(text(columns), F.lit(",1"))))}
        for kind, (chosen, lines) in kinds.items():
            # one column whose name is the header: no separator of its own, so lines stay as they are
            (raw.where(chosen).select(F.explode(lines).alias(",".join(columns))).write.option("header", True)
             .option("sep", "\x01").csv(f"{d}/{ch}_{kind}.csv"))
    return d


@register("s1_row_integrity", O.q(f"""
SELECT channel, date, count(*) AS rows, sum(revenue) AS revenue,
       CAST(sum(CASE WHEN channel = 'meta' AND campaign_name LIKE '%{_CUT}' THEN 0 ELSE impressions END) AS BIGINT) AS impressions,
       sum(CASE WHEN channel <> 'meta' AND campaign_name LIKE '%{_CUT}' THEN 0 ELSE conversions END) AS conversions
FROM canon WHERE campaign_name NOT LIKE '%{_LOST}' GROUP BY 1, 2""", "canon"), {"revenue": 2, "conversions": 2})
def s1_row_integrity(spark, sf):
    """Exports with short and over-long rows through the one-pass ingest: short rows are filled, files with wider rows
    are left out as a whole."""
    found = norm.ingest(csvsrc.load_directory(spark, _malformed_dir(spark, sf), check_rows=False), exact_medians=False)
    sums = found.grain.groupBy("channel", "date").agg(*[F.sum(c).alias(c) for c in ("rows", "revenue", "impressions", "conversions")])
    return sums.withColumn("impressions", F.col("impressions").cast("long"))


@register("s4_skipped_files", O.q(f"""
SELECT channel, kind, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(long) AS BIGINT) AS long_rows, CAST(sum(short) AS BIGINT) AS short_rows,
       kind = 'long' AS skipped
FROM (SELECT channel, CASE WHEN name LIKE '%{_LOST}' THEN 'long' WHEN name LIKE '%{_CUT}' THEN 'short' ELSE 'kept' END AS kind,
             CASE WHEN name LIKE '%{_LOST}' THEN 2 ELSE 1 END AS rows, CASE WHEN name LIKE '%{_LOST}' THEN 1 ELSE 0 END AS long,
             CASE WHEN name LIKE '%{_CUT}' THEN 1 ELSE 0 END AS short
      FROM (SELECT 'google' AS channel, campaign_name AS name FROM g_raw UNION ALL SELECT 'bing', CampaignName FROM b_raw
            UNION ALL SELECT 'meta', campaign_name FROM m_raw))
GROUP BY 1, 2""", "g_raw", "b_raw", "m_raw"))
def s4_skipped_files(spark, sf):
    """The report of the same exports, file by file: rows, long and short rows, skipped; summed per kind of file."""
    found = norm.ingest(csvsrc.load_directory(spark, _malformed_dir(spark, sf), check_rows=False), exact_medians=False)
    kind = F.regexp_extract("file", r"_([a-z]+)\.csv/[^/]*$", 1).alias("kind")
    return found.files.groupBy("channel", kind).agg(
        *[F.sum(c).alias(c) for c in ("rows", "long_rows", "short_rows")], F.bool_and("skipped").alias("skipped"))


@register("s5_features_parquet", O.q(f"SELECT {_cols(FIXED_FEATURES)} FROM feat", "feat"), FEAT_DBL)
def s5_features_parquet(spark, sf):
    """Features written as Parquet partitioned by channel and read back."""
    path = sinks.scratch_dir(spark, "features")
    sinks.write_features(_feat(spark, sf), path)
    return sinks.read_features(spark, path).select(*FIXED_FEATURES)


@register("s9_events_source", O.q("SELECT * FROM ev_daily", "ev_daily"), DAILY_DBL)
def s9_events_source(spark, sf):
    """Second source: the events table as channel 'web' rows, through the daily aggregate (A1)."""
    return agg.daily_aggregate(events_canonical(spark, sf))


@register("w1_w7_events_features", O.q(f"SELECT {_cols(FIXED_FEATURES)} FROM ev_feat", "ev_feat"), FEAT_DBL)
def w1_w7_events_features(spark, sf):
    """Window and calendar features over the events source (every group is short: all fallback)."""
    return feats.build_features(agg.daily_aggregate(events_canonical(spark, sf))).select(*FIXED_FEATURES)


# ======================================================================= 2.2 projections, filters

def _dialect_query(ch):
    def q(spark, sf):
        return norm.normalize(raw_dialects(spark, sf)[ch], ch)
    return q


for _i, (_ch, _p) in enumerate((("google", "g"), ("bing", "b"), ("meta", "m")), start=1):
    register(f"p{_i}_normalize_{_ch}", O.q(f"SELECT * FROM {_p}_canon", f"{_p}_canon"), CANON_DBL)(_dialect_query(_ch))


@register("p4_invalid_dates", O.q("""
SELECT 'google' AS channel, count(*) AS rows_read, count(*) FILTER (WHERE date IS NULL) AS rows_dropped FROM g_typed
UNION ALL SELECT 'bing', count(*), count(*) FILTER (WHERE date IS NULL) FROM b_typed
UNION ALL SELECT 'meta', count(*), count(*) FILTER (WHERE date IS NULL) FROM m_typed""", "g_typed", "b_typed", "m_typed"))
def p4_invalid_dates(spark, sf):
    return norm.invalid_date_counts(raw_dialects(spark, sf))


# A text form per layout, by order number.
_DATE_TEXTS = ["yyyy-MM-dd", "M/d/yyyy", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss.SSS", "MM/dd/yy", "MMM d, yyyy",
               "d-MMM-yyyy", "yyyy/MM/dd", "yyyyMMdd", "yyyy-MM-dd'T'HH:mm:ss'+05:30'", "MMMM d, yyyy", "yyyy-M-d"]


@register("p4_date_layouts", O.q("""
SELECT CAST(l_shipdate AS DATE) AS date, l_orderkey % 12 AS layout, count(*) AS rows FROM lineitem GROUP BY 1, 2"""))
def p4_date_layouts(spark, sf):
    """Every ship date written in one of twelve layouts and parsed back."""
    li = spark.read.parquet(table_path(sf, "lineitem")).select("l_orderkey", "l_shipdate")
    text, layout = F.lit(None).cast("string"), F.col("l_orderkey") % len(_DATE_TEXTS)
    for k, form in enumerate(_DATE_TEXTS):
        text = F.when(layout == k, F.date_format(F.to_timestamp(F.to_date("l_shipdate")), form)).otherwise(text)
    return li.select(parse_date(text).alias("date"), layout.cast("long").alias("layout")).groupBy("date", "layout").agg(
        F.count(F.lit(1)).alias("rows"))


# Freer forms, by order number; the last is a layout that nobody knows.
_FREE_TEXTS = ["EEE, dd MMM yyyy", "yyyyMMdd'T'HHmmss", "dd-MMM-yy", "MMM-dd-yyyy", "yyyy-MM", "MMM yyyy",
               "yyyy-MM-dd HH:mm:ss 'America/New_York'", "'day' D 'of' yyyy"]


@register("p4_free_dates", O.q("""
SELECT CASE WHEN form IN (4, 5) THEN strftime(d, '%Y-%m-01') WHEN form < 7 THEN strftime(d, '%Y-%m-%d') END AS date, form,
       CASE WHEN form = 7 THEN 'a 9 a 9' END AS shape, count(*) AS rows
FROM (SELECT CAST(l_shipdate AS DATE) AS d, l_orderkey % 8 AS form FROM lineitem) GROUP BY 1, 2, 3"""))
def p4_free_dates(spark, sf):
    """Every ship date written in one of eight free forms and parsed back; the unknown form is counted by its shape."""
    li = spark.read.parquet(table_path(sf, "lineitem")).select("l_orderkey", "l_shipdate")
    text, kind = F.lit(None).cast("string"), F.col("l_orderkey") % len(_FREE_TEXTS)
    for k, form in enumerate(_FREE_TEXTS):
        text = F.when(kind == k, F.date_format(F.to_timestamp(F.to_date("l_shipdate")), form)).otherwise(text)
    rows = li.select(text.alias("text"), kind.cast("long").alias("form")).withColumn("date", parse_date("text").cast("string"))
    return rows.groupBy("date", "form", F.when(F.col("date").isNull(), text_shape("text")).alias("shape")).agg(
        F.count(F.lit(1)).alias("rows"))


@register("p4_day_first", O.q("""
SELECT channel, date, count(*) AS rows, sum(revenue) AS revenue FROM canon GROUP BY 1, 2""", "canon"), {"revenue": 2})
def p4_day_first(spark, sf):
    """Google and meta exports that write the day first, bing the month: each is read in its own order."""
    raws = raw_dialects(spark, sf)
    for ch, column, form in (("google", "segments_date", "dd/MM/yyyy"), ("meta", "date_start", "d.M.yyyy"), ("bing", "TimePeriod", "MM/dd/yyyy")):
        raws[ch] = raws[ch].withColumn(column, F.date_format(F.try_to_timestamp(column, F.lit("yyyy-MM-dd")), form))
    return norm.ingest(raws).grain.groupBy("channel", "date").agg(F.sum("rows").alias("rows"), F.sum("revenue").alias("revenue"))


@register("p4_unknown_dates", O.q("""
SELECT channel, 'a/a' AS shape, count(*) AS rows FROM (
  SELECT channel, date FROM g_typed UNION ALL SELECT channel, date FROM b_typed UNION ALL SELECT channel, date FROM m_typed)
WHERE date IS NULL GROUP BY 1""", "g_typed", "b_typed", "m_typed"))
def p4_unknown_dates(spark, sf):
    """Date texts of no known layout by their shape, from the one-pass ingest."""
    return pipeline.ingested(spark, sf).unknown_dates


@register("p5_null_fill", O.q("""
SELECT channel, campaign_type, count(*) AS rows, count(*) FILTER (WHERE campaign_name = 'Unknown') AS unknown_names,
       CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions,
       sum(conversions) AS conversions, count(*) FILTER (WHERE spend IS NULL) AS null_spend
FROM canon GROUP BY channel, campaign_type""", "canon"), {"conversions": 2})
def p5_null_fill(spark, sf):
    """Per group after the fills: defaults in names and types, filled counts."""
    return _canon(spark, sf).groupBy("channel", "campaign_type").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(F.col("campaign_name") == "Unknown", 1)).alias("unknown_names"),
        F.sum("clicks").cast("long").alias("clicks"), F.sum("impressions").cast("long").alias("impressions"),
        F.sum("conversions").alias("conversions"),
        F.count(F.when(F.col("spend").isNull(), 1)).alias("null_spend"))


@register("p6_micros_to_currency", O.q("SELECT date, campaign_id, campaign_type, spend FROM g_canon", "g_canon"), {"spend": 4})
def p6_micros_to_currency(spark, sf):
    return norm.normalize(raw_dialects(spark, sf)["google"], "google").select(
        "date", "campaign_id", "campaign_type", "spend")


@register("p7_budget_imputation", O.q("""
SELECT f.channel, f.campaign_type, count(*) AS rows, count(*) FILTER (WHERE f.budget IS NULL) AS null_before,
       any_value(t.tmed) AS type_median, sum(coalesce(f.budget1, gm.gmed, 0.0)) AS budget_after
FROM (SELECT * FROM g_fill UNION ALL SELECT * FROM m_fill) AS f
JOIN (SELECT 'google' AS channel, * FROM g_tmed UNION ALL SELECT 'meta', * FROM m_tmed) AS t
  ON t.channel = f.channel AND t.campaign_type = f.campaign_type
JOIN (SELECT 'google' AS channel, gmed FROM g_gmed UNION ALL SELECT 'meta', gmed FROM m_gmed) AS gm
  ON gm.channel = f.channel
GROUP BY f.channel, f.campaign_type""", "g_fill", "m_fill", "g_tmed", "m_tmed", "g_gmed", "m_gmed"),
          {"budget_after": 2, "type_median": 4})
def p7_budget_imputation(spark, sf):
    """Type median, then median of the filled column, then 0, for google and meta."""
    found = norm.ingest(raw_dialects(spark, sf))
    g = found.grain.where(F.col("channel").isin("google", "meta"))
    full = g.join(found.type_medians, ["channel", "campaign_type"], "left").join(found.filled_medians, "channel", "left")
    fill = F.coalesce("type_median", "filled_median", F.lit(0.0)) * F.col("missing")
    return full.groupBy("channel", "campaign_type").agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("null_before"), F.first("type_median").alias("type_median"),
        F.sum(F.coalesce("daily_budget", F.lit(0.0)) + fill).alias("budget_after"))


@register("p7_sketched_medians", O.q("""
SELECT channel, campaign_type, count(budget) AS budgets, TRUE AS within
FROM (SELECT * FROM g_fill UNION ALL SELECT * FROM m_fill) AS f GROUP BY 1, 2 HAVING count(budget) > 0
UNION ALL
SELECT channel, '*filled*', count(budget1), TRUE
FROM (SELECT * FROM g_fill UNION ALL SELECT * FROM m_fill) AS f GROUP BY 1""", "g_fill", "m_fill"))
def p7_sketched_medians(spark, sf):
    """The one-pass ingest's medians: the middle rank lies among those of the median within the stated error."""
    raws, rows = raw_dialects(spark, sf), None
    found = norm.ingest(raws, exact_medians=False)
    for ch in ("google", "meta"):
        part = norm.PARSERS[ch](raws[ch]).where(F.col("date").isNotNull()).select("channel", "campaign_type", "daily_budget")
        rows = part if rows is None else rows.unionByName(part)
    filled = rows.join(found.type_medians, ["channel", "campaign_type"]).join(found.filled_medians, "channel")

    def judged(scope, value, median, error):
        low, high = F.sum(F.when(value < median, 1).otherwise(0)), F.sum(F.when(value <= median, 1).otherwise(0))
        return filled.where(value.isNotNull()).groupBy("channel", scope).agg(
            F.count(value).alias("budgets"),
            ((low <= F.count(value) * (0.5 + error)) & (high >= F.count(value) * (0.5 - error))).alias("within"))

    own, every = F.col("daily_budget"), F.coalesce("daily_budget", "type_median")
    return judged(F.col("campaign_type"), own, F.col("type_median"), norm.SKETCH_RANK_ERROR).unionByName(
        judged(F.lit("*filled*").alias("campaign_type"), every, F.col("filled_median"),
               norm.SKETCH_RANK_ERROR + 1 / norm.SKETCH_POINTS))


@register("p8_meta_campaign_type", O.q("""
SELECT split_part(campaign_name, '_', 1) AS name_prefix, campaign_type, count(*) AS rows
FROM m_canon GROUP BY 1, 2""", "m_canon"))
def p8_meta_campaign_type(spark, sf):
    m = norm.normalize(raw_dialects(spark, sf)["meta"], "meta")
    return m.groupBy(F.split_part("campaign_name", F.lit("_"), F.lit(1)).alias("name_prefix"), "campaign_type") \
        .agg(F.count(F.lit(1)).alias("rows"))


@register("p9_roas_ratio", O.q("""
SELECT channel, count(*) FILTER (WHERE roas = 0) AS zero_ratio, count(*) FILTER (WHERE roas = 50) AS capped_ratio,
       sum(roas) AS ratio_sum, count(*) FILTER (WHERE spend <= 0) AS no_spend
FROM canon GROUP BY channel""", "canon"), {"ratio_sum": 2})
def p9_roas_ratio(spark, sf):
    return _canon(spark, sf).groupBy("channel").agg(
        F.count(F.when(F.col("roas") == 0, 1)).alias("zero_ratio"),
        F.count(F.when(F.col("roas") == 50, 1)).alias("capped_ratio"),
        F.sum("roas").alias("ratio_sum"), F.count(F.when(F.col("spend") <= 0, 1)).alias("no_spend"))


@register("p10_proxy_conversions", O.q("""
SELECT campaign_type, sum(conversions) AS conversions, sum(revenue) / 100 AS revenue_over_100
FROM m_canon GROUP BY campaign_type""", "m_canon"), {"conversions": 2, "revenue_over_100": 2})
def p10_proxy_conversions(spark, sf):
    m = norm.normalize(raw_dialects(spark, sf)["meta"], "meta")
    return m.groupBy("campaign_type").agg(F.sum("conversions").alias("conversions"),
                                          (F.sum("revenue") / 100).alias("revenue_over_100"))


@register("p11_canonical_projection", O.q("SELECT * FROM canon", "canon"), CANON_DBL)
def p11_canonical_projection(spark, sf):
    return _canon(spark, sf)


@register("p17_input_validation", O.q("""
SELECT 'min_rows' AS rule, CAST(count(*) AS DOUBLE) AS value, CASE WHEN count(*) < 100 THEN 'abort' ELSE 'ok' END AS level FROM canon
UNION ALL SELECT 'date_type', 1.0, 'ok'
UNION ALL SELECT 'nonpositive_revenue_share', avg(CASE WHEN revenue <= 0 THEN 1.0 ELSE 0.0 END),
       CASE WHEN avg(CASE WHEN revenue <= 0 THEN 1.0 ELSE 0.0 END) > 0.5 THEN 'warn' ELSE 'ok' END FROM canon
UNION ALL SELECT 'missing_channels', CAST(count(*) AS DOUBLE), CASE WHEN count(*) > 0 THEN 'warn' ELSE 'ok' END
FROM (SELECT * FROM (VALUES ('google'), ('bing'), ('meta')) AS e(channel)
      WHERE channel NOT IN (SELECT DISTINCT channel FROM canon)) AS m""", "canon"), {"value": 4})
def p17_input_validation(spark, sf):
    return quality.validation_rules(pipeline.ingested(spark, sf).grain)


@register("p17_validation_events", O.q("""
SELECT 'min_rows' AS rule, CAST(count(*) AS DOUBLE) AS value, CASE WHEN count(*) < 100 THEN 'abort' ELSE 'ok' END AS level FROM ev_canon
UNION ALL SELECT 'date_type', 1.0, 'ok'
UNION ALL SELECT 'nonpositive_revenue_share', avg(CASE WHEN revenue <= 0 THEN 1.0 ELSE 0.0 END),
       CASE WHEN avg(CASE WHEN revenue <= 0 THEN 1.0 ELSE 0.0 END) > 0.5 THEN 'warn' ELSE 'ok' END FROM ev_canon
UNION ALL SELECT 'missing_channels', 3.0, 'warn'""", "ev_canon"), {"value": 4})
def p17_validation_events(spark, sf):
    """The rules over a source that lacks every expected channel."""
    return quality.validation_rules(quality.channel_counts(events_canonical(spark, sf)))


@register("p17_text_dates", O.q("""
SELECT 'min_rows' AS rule, CAST(count(*) AS DOUBLE) AS value, CASE WHEN count(*) < 100 THEN 'abort' ELSE 'ok' END AS level FROM canon
UNION ALL SELECT 'date_type', 0.0, 'abort'
UNION ALL SELECT 'nonpositive_revenue_share', avg(CASE WHEN revenue <= 0 THEN 1.0 ELSE 0.0 END),
       CASE WHEN avg(CASE WHEN revenue <= 0 THEN 1.0 ELSE 0.0 END) > 0.5 THEN 'warn' ELSE 'ok' END FROM canon
UNION ALL SELECT 'missing_channels', 3.0 - count(DISTINCT channel), CASE WHEN count(DISTINCT channel) < 3 THEN 'warn' ELSE 'ok' END FROM canon""",
                              "canon"), {"value": 4})
def p17_text_dates(spark, sf):
    """The rules over canonical rows whose dates are still text: the run aborts."""
    return quality.validation_rules(quality.channel_counts(_canon(spark, sf).withColumn("date", F.col("date").cast("string"))))


@register("p4_ingest_report", O.q("""
SELECT 'google' AS channel, count(*) AS rows_read, count(*) FILTER (WHERE date IS NULL) AS rows_dropped, CAST(0 AS BIGINT) AS unreadable FROM g_typed
UNION ALL SELECT 'bing', count(*), count(*) FILTER (WHERE date IS NULL), 0 FROM b_typed
UNION ALL SELECT 'meta', count(*), count(*) FILTER (WHERE date IS NULL), 0 FROM m_typed""", "g_typed", "b_typed", "m_typed"))
def p4_ingest_report(spark, sf):
    """Rows read, rows dropped for their date and unreadable numbers, from the one-pass ingest."""
    return pipeline.ingested(spark, sf).report


_P18_FIXED = " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS feature"
                                for i, c in enumerate(feats.BASE_FEATURE_COLUMNS))


@register("p18_training_columns", O.q(f"""
{_P18_FIXED}
UNION ALL
SELECT {len(feats.BASE_FEATURE_COLUMNS)} + row_number() OVER (ORDER BY campaign_type) - 1 AS position,
       {O.type_column('campaign_type')} AS feature
FROM (SELECT DISTINCT campaign_type FROM feat) AS t""", "feat"))
def p18_training_columns(spark, sf):
    """Training column list: fixed names plus every campaign_type_* column, with positions."""
    cols = feats.feature_columns(_feat(spark, sf))
    return spark.createDataFrame(list(enumerate(cols)), "position long, feature string")


# ======================================================================= 2.3 joins (non-forecast)

@register("j7_expected_channels", O.q("""
SELECT s.source, e.channel
FROM (VALUES ('platforms'), ('events')) AS s(source) CROSS JOIN (VALUES ('google'), ('bing'), ('meta')) AS e(channel)
WHERE (s.source = 'platforms' AND e.channel NOT IN (SELECT DISTINCT channel FROM canon))
   OR (s.source = 'events' AND e.channel NOT IN (SELECT DISTINCT channel FROM ev_canon))""", "canon", "ev_canon"))
def j7_expected_channels(spark, sf):
    """Expected channels that a source lacks: none for the platforms, all three for the events."""
    both = {"platforms": _canon(spark, sf), "events": events_canonical(spark, sf)}
    parts = [quality.expected_channels(df).select(F.lit(name).alias("source"), "channel") for name, df in both.items()]
    return parts[0].unionByName(parts[1])


# ======================================================================= 2.4 aggregations

@register("a1_daily_aggregate", O.q("SELECT * FROM daily", "daily"), DAILY_DBL)
def a1_daily_aggregate(spark, sf):
    return agg.daily_aggregate(_canon(spark, sf))


@register("a2_portfolio_daily", O.q("SELECT date, sum(revenue) AS revenue, sum(spend) AS spend FROM feat GROUP BY date", "feat"), {"revenue": 4, "spend": 4})
def a2_portfolio_daily(spark, sf):
    return agg.portfolio_daily(_feat(spark, sf))


_GS_COLS = ["avg_roas_last_30d", "avg_roas_last_90d", "total_revenue_last_90d", "total_spend_last_90d",
            "trend_direction", "revenue_last_30d", "revenue_prior_30d"]
_GS_DIG = {"total_revenue_last_90d": 2, "total_spend_last_90d": 2, "revenue_last_30d": 2, "revenue_prior_30d": 2,
           "avg_roas_last_30d": 4, "avg_roas_last_90d": 4}


@register("a3_period_stats", O.rounded(f"""
SELECT g.channel, g.campaign_type, {_cols('f.' + c for c in _GS_COLS)}
FROM gs_final AS f JOIN (SELECT DISTINCT channel || '__' || campaign_type AS gkey, channel, campaign_type FROM feat) AS g
  ON g.gkey = f.gkey""", _GS_DIG, "gs_final", "feat"), _GS_DIG)
def a3_period_stats(spark, sf):
    return stats.group_stats(_feat(spark, sf)).select("channel", "campaign_type", *_GS_COLS)


@register("a4_revenue_mean_std", O.rounded("""
SELECT channel, campaign_type, avg(revenue) AS revenue_mean, stddev_samp(revenue) AS revenue_std
FROM feat GROUP BY channel, campaign_type""", {"revenue_mean": 2, "revenue_std": 2}, "feat"),
          {"revenue_mean": 2, "revenue_std": 2})
def a4_revenue_mean_std(spark, sf):
    return stats.group_stats(_feat(spark, sf)).select("channel", "campaign_type", "revenue_mean", "revenue_std")


@register("a7_top_campaign_type", O.q("SELECT scope, top_campaign_type FROM scope_top", "scope_top"))
def a7_top_campaign_type(spark, sf):
    f = _feat(spark, sf)
    per = stats.top_campaign_type(f, True).withColumnRenamed("channel", "scope")
    return per.unionByName(stats.top_campaign_type(f, False).withColumn("scope", F.lit("all")))


@register("a8_quality_metrics", O.q("""
SELECT CAST(sum((date IS NULL)::INT + (channel IS NULL)::INT + (campaign_type IS NULL)::INT + (campaign_name IS NULL)::INT
       + (spend IS NULL)::INT + (revenue IS NULL)::INT + (roas IS NULL)::INT + (clicks IS NULL)::INT
       + (impressions IS NULL)::INT + (conversions IS NULL)::INT + (daily_budget IS NULL)::INT
       + (campaign_id IS NULL)::INT) AS BIGINT) AS missing_values,
       avg(CASE WHEN revenue <= 0 THEN 1.0 ELSE 0.0 END) AS nonpositive_revenue_share,
       CAST((max(date) - min(date)) + 1 - count(DISTINCT date) AS BIGINT) AS date_gaps,
       CAST(count(DISTINCT campaign_id) AS BIGINT) AS active_campaigns, count(*) AS rows
FROM canon""", "canon"), {"nonpositive_revenue_share": 4})
def a8_quality_metrics(spark, sf):
    return quality.quality_metrics(_canon(spark, sf))


@register("a9_channel_status", O.q("""
SELECT channel, count(*) AS records, coalesce(sum(spend), 0.0) AS spend, coalesce(sum(revenue), 0.0) AS revenue
FROM canon GROUP BY channel""", "canon"), {"spend": 2, "revenue": 2})
def a9_channel_status(spark, sf):
    return agg.channel_status(_canon(spark, sf))


@register("a10_distinct_values", O.q("SELECT scope, types_txt AS campaign_types FROM scope_types", "scope_types"))
def a10_distinct_values(spark, sf):
    t = stats.campaign_type_lists(_feat(spark, sf))
    return t.select("scope", F.array_join("campaign_types", ", ").alias("campaign_types"))


@register("a12_training_metadata", O.q("""
SELECT strftime(min(date), '%Y-%m-%d') AS min_date, strftime(max(date), '%Y-%m-%d') AS max_date, count(*) AS num_rows
FROM feat""", "feat"))
def a12_training_metadata(spark, sf):
    return agg.training_metadata(_feat(spark, sf))


@register("a15_group_size", O.q("""
SELECT channel, campaign_type, count(*) AS rows, count(*) >= 60 AS dedicated FROM feat GROUP BY 1, 2""", "feat"))
def a15_group_size(spark, sf):
    return group_table(_feat(spark, sf))


@register("a16_median", O.q("""
SELECT 'google' AS channel, campaign_type, tmed AS budget_median FROM g_tmed
UNION ALL SELECT 'meta', campaign_type, tmed FROM m_tmed
UNION ALL SELECT 'google', '*filled*', gmed FROM g_gmed
UNION ALL SELECT 'meta', '*filled*', gmed FROM m_gmed""", "g_tmed", "m_tmed", "g_gmed", "m_gmed"), {"budget_median": 4})
def a16_median(spark, sf):
    """Exact medians: per campaign type of the raw budget, and of the filled column."""
    found = norm.ingest(raw_dialects(spark, sf))
    per_type, filled = found.type_medians, found.filled_medians
    return per_type.withColumnRenamed("type_median", "budget_median").unionByName(filled.select(
        "channel", F.lit("*filled*").alias("campaign_type"), F.col("filled_median").alias("budget_median")))


# ======================================================================= 2.5 windows

_KEYS = ["date", "channel", "campaign_type"]


def _window_query(key, cols, digits=None):
    digits = {c: (digits or {}).get(c, 4) for c in cols}
    sql = O.rounded(f"SELECT {_cols(_KEYS + cols)} FROM feat", digits, "feat")

    @register(key, sql, digits)
    def q(spark, sf):
        return _feat(spark, sf).select(*_KEYS, *cols)
    return q


_window_query("w1_lag_revenue", ["lag_7d_revenue", "lag_14d_revenue", "lag_30d_revenue"])
_window_query("w2_lag_spend", ["lag_7d_spend", "lag_30d_spend"])
_window_query("w3_lag_roas", ["lag_7d_roas", "lag_30d_roas"])
_window_query("w4_rolling_revenue_mean", ["rolling_7d_revenue_mean", "rolling_30d_revenue_mean"], MONEY2)
_window_query("w5_rolling_spend_mean", ["rolling_7d_spend_mean", "rolling_30d_spend_mean"], MONEY2)
_window_query("w6_rolling_roas_mean", ["rolling_7d_roas_mean", "rolling_30d_roas_mean"])
_window_query("w7_rolling_revenue_std", ["rolling_7d_revenue_std"], MONEY2)


@register("w8_zscore_anomalies", O.q("""
SELECT split_part(gkey, '__', 1) AS channel, split_part(gkey, '__', 2) AS campaign_type, date FROM gs_anom""", "gs_anom"))
def w8_zscore_anomalies(spark, sf):
    f = _feat(spark, sf)
    return stats.anomaly_rows(f.select("channel", "campaign_type", "date", "revenue"), ["channel", "campaign_type"])


@register("w9_groupwise_median", O.q("""
SELECT channel, campaign_type, date, campaign_id, coalesce(budget1, gmed, 0.0) AS daily_budget
FROM (SELECT * FROM g_fill CROSS JOIN g_gmed UNION ALL SELECT * FROM m_fill CROSS JOIN m_gmed) AS f
WHERE budget IS NULL""", "g_fill", "g_gmed", "m_fill", "m_gmed"), {"daily_budget": 4})
def w9_groupwise_median(spark, sf):
    """Rows whose budget came from the group median broadcast back to them."""
    raws = raw_dialects(spark, sf)
    out = None
    for ch in ("google", "meta"):
        typed = norm.PARSERS[ch](raws[ch]).where(F.col("date").isNotNull())
        filled = norm.impute_budget(typed.withColumn("_was_null", F.col("daily_budget").isNull()))
        part = filled.where("_was_null").select("channel", "campaign_type", "date", "campaign_id", "daily_budget")
        out = part if out is None else out.unionByName(part)
    return out


@register("w10_last_rows", O.q("""
SELECT channel, campaign_type, date, revenue FROM (
  SELECT channel, campaign_type, date, revenue,
         row_number() OVER (PARTITION BY channel, campaign_type ORDER BY date DESC) AS rn FROM feat) AS t
WHERE rn <= 30""", "feat"), {"revenue": 4})
def w10_last_rows(spark, sf):
    return feats.last_rows(_feat(spark, sf), 30).select("channel", "campaign_type", "date", "revenue")


# ======================================================================= 2.6 sorts, limits

@register("o1_canonical_sort", O.q("SELECT * FROM canon ORDER BY date, channel, campaign_type, campaign_name", "canon"), CANON_DBL)
def o1_canonical_sort(spark, sf):
    return norm.canonical_sort(_canon(spark, sf))


@register("o2_feature_sort", O.q("SELECT channel, campaign_type, date, revenue FROM feat ORDER BY 1, 2, 3", "feat"), {"revenue": 4})
def o2_feature_sort(spark, sf):
    return _feat(spark, sf).select("channel", "campaign_type", "date", "revenue").orderBy("channel", "campaign_type", "date")


@register("o4_preview", O.q("""
SELECT * FROM canon ORDER BY date, channel, campaign_type, campaign_name, campaign_id, spend, revenue,
         daily_budget, clicks, impressions LIMIT 20""", "canon"), CANON_DBL)
def o4_preview(spark, sf):
    return quality.preview(_canon(spark, sf))


@register("o5_first_anomalies", O.q("SELECT scope, anom_txt AS first_anomalies FROM scope_anom5", "scope_anom5"))
def o5_first_anomalies(spark, sf):
    s = stats.scope_inputs(_feat(spark, sf))
    first5 = F.transform("anomaly_flags", lambda d: F.date_format(d, "yyyy-MM-dd"))
    return s.where("anomalies > 0").select("scope", F.array_join(first5, ", ").alias("first_anomalies"))


@register("o6_top1", O.rounded("""
SELECT channel, first(campaign_type ORDER BY rev DESC, campaign_type) AS top_campaign_type, max(rev) AS top_revenue
FROM (SELECT channel, campaign_type, sum(revenue) AS rev FROM feat GROUP BY channel, campaign_type) AS t
GROUP BY channel""", {"top_revenue": 2}, "feat"))
def o6_top1(spark, sf):
    """Top-1 campaign type per channel with its revenue (idxmax; ties -> smallest name)."""
    f = _feat(spark, sf)
    sums = f.groupBy("channel", "campaign_type").agg(F.sum("revenue").alias("rev"))
    return sums.groupBy("channel").agg(
        F.min_by("campaign_type", F.struct((-F.col("rev")).alias("r"), F.col("campaign_type").alias("t"))).alias("top_campaign_type"),
        F.max("rev").alias("top_revenue"))


# ======================================================================= 2.7 set operations

@register("u1_union_channels", O.q("""
SELECT channel, count(*) AS rows, sum(revenue) AS revenue FROM canon GROUP BY channel""", "canon"), {"revenue": 2})
def u1_union_channels(spark, sf):
    return _canon(spark, sf).groupBy("channel").agg(F.count(F.lit(1)).alias("rows"), F.sum("revenue").alias("revenue"))


# ======================================================================= 2.8 scalar functions

def _calendar_query(key, cols):
    @register(key, O.q(f"SELECT DISTINCT date, {_cols(cols)} FROM feat", "feat"))
    def q(spark, sf):
        return _feat(spark, sf).select("date", *cols).distinct()
    return q


_calendar_query("f1_month_quarter", ["month", "quarter"])
_calendar_query("f2_iso_week", ["week_of_year"])
_calendar_query("f3_day_of_week", ["day_of_week"])
_calendar_query("f4_q4_flags", ["is_q4", "is_november", "is_december"])
_calendar_query("f5_days_since_start", ["days_since_start"])


@register("f7_budget_ratio_feature", O.q("SELECT date, channel, campaign_type, spend_vs_budget_ratio FROM feat", "feat"),
          {"spend_vs_budget_ratio": 4})
def f7_budget_ratio_feature(spark, sf):
    return _feat(spark, sf).select("date", "channel", "campaign_type", "spend_vs_budget_ratio")


@register("f9_channel_onehot", O.q("""
SELECT channel, CAST(sum(channel_google) AS BIGINT) AS channel_google, CAST(sum(channel_bing) AS BIGINT) AS channel_bing,
       CAST(sum(channel_meta) AS BIGINT) AS channel_meta FROM feat GROUP BY channel""", "feat"))
def f9_channel_onehot(spark, sf):
    return _feat(spark, sf).groupBy("channel").agg(*[F.sum(c).cast("long").alias(c) for c in
                                                     ("channel_google", "channel_bing", "channel_meta")])


@register("f10_campaign_type_onehot", O.q(f"""
SELECT f.channel, f.campaign_type, t.feature, CAST(sum(CASE WHEN f.campaign_type = t.campaign_type THEN 1 ELSE 0 END) AS BIGINT) AS ones
FROM feat AS f CROSS JOIN (SELECT DISTINCT campaign_type, {O.type_column('campaign_type')} AS feature FROM feat) AS t
GROUP BY f.channel, f.campaign_type, t.feature""", "feat"))
def f10_campaign_type_onehot(spark, sf):
    """The sum of every one-hot column per group: its rows in their own type's column, 0 elsewhere."""
    f = _feat(spark, sf)
    columns = [c for c in f.columns if c.startswith(feats.TYPE_PREFIX)]
    sums = f.groupBy("channel", "campaign_type").agg(*[F.sum(c).cast("long").alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("ones")) for c in columns])).alias("_p")
    return sums.select("channel", "campaign_type", pairs).select("channel", "campaign_type", "_p.feature", "_p.ones")


@register("f11_clip", O.q("""
SELECT channel, count(*) FILTER (WHERE spend > 0 AND revenue / spend > 50) AS clipped_high,
       min(roas) AS min_ratio, max(roas) AS max_ratio FROM canon GROUP BY channel""", "canon"),
          {"min_ratio": 4, "max_ratio": 4})
def f11_clip(spark, sf):
    c = _canon(spark, sf)
    return c.groupBy("channel").agg(
        F.count(F.when((F.col("spend") > 0) & (F.col("revenue") / F.col("spend") > 50), 1)).alias("clipped_high"),
        F.min("roas").alias("min_ratio"), F.max("roas").alias("max_ratio"))


@register("f12_group_key", O.q("SELECT DISTINCT channel || '__' || campaign_type AS group_key FROM feat", "feat"))
def f12_group_key(spark, sf):
    return _feat(spark, sf).select(group_key("channel", "campaign_type").alias("group_key")).distinct()


@register("f13_date_text", O.q("""
SELECT channel, campaign_type, strftime(min(date), '%Y-%m-%d') AS first_date, strftime(max(date), '%Y-%m-%d') AS last_date
FROM feat GROUP BY 1, 2""", "feat"))
def f13_date_text(spark, sf):
    return _feat(spark, sf).groupBy("channel", "campaign_type").agg(
        F.date_format(F.min("date"), "yyyy-MM-dd").alias("first_date"),
        F.date_format(F.max("date"), "yyyy-MM-dd").alias("last_date"))


@register("f14_template_summary", O.q("SELECT scope, horizon, summary FROM summ", "summ"))
def f14_template_summary(spark, sf):
    return stats.summaries(_feat(spark, sf)).select("scope", "horizon", "summary")


@register("f15_prompt_text", O.q("SELECT scope, horizon, prompt FROM summ", "summ"))
def f15_prompt_text(spark, sf):
    return stats.summaries(_feat(spark, sf)).select("scope", "horizon", "prompt")


@register("f16_report_label", O.q("SELECT DISTINCT upper(channel) || ' - ' || campaign_type AS label FROM feat", "feat"))
def f16_report_label(spark, sf):
    return _feat(spark, sf).select(report_label("channel", "campaign_type").alias("label")).distinct()


# ======================================================================= 2.10 insights

@register("i1_trend", O.rounded("""
SELECT g.channel, g.campaign_type, f.revenue_last_30d, f.revenue_prior_30d, f.trend_direction
FROM gs_final AS f JOIN (SELECT DISTINCT channel || '__' || campaign_type AS gkey, channel, campaign_type FROM feat) AS g
  ON g.gkey = f.gkey""", {"revenue_last_30d": 2, "revenue_prior_30d": 2}, "gs_final", "feat"),
          {"revenue_last_30d": 2, "revenue_prior_30d": 2})
def i1_trend(spark, sf):
    return stats.group_stats(_feat(spark, sf)).select("channel", "campaign_type", "revenue_last_30d",
                                                     "revenue_prior_30d", "trend_direction")


_I2_DIG = {"total_revenue_last_90d": 2, "total_spend_last_90d": 2, "avg_roas_last_30d": 4, "avg_roas_last_90d": 4}


@register("i2_empty_scope_defaults", O.rounded("""
SELECT c.channel, t.campaign_type, coalesce(f.avg_roas_last_30d, 0.0) AS avg_roas_last_30d,
       coalesce(f.avg_roas_last_90d, 0.0) AS avg_roas_last_90d,
       coalesce(f.total_revenue_last_90d, 0.0) AS total_revenue_last_90d,
       coalesce(f.total_spend_last_90d, 0.0) AS total_spend_last_90d,
       coalesce(f.trend_direction, 'flat') AS trend_direction, coalesce(f.n_anomalies, 0) AS anomalies
FROM (VALUES ('google'), ('bing'), ('meta')) AS c(channel) CROSS JOIN (SELECT DISTINCT campaign_type FROM feat) AS t
LEFT JOIN gs_final AS f ON f.gkey = c.channel || '__' || t.campaign_type""", _I2_DIG, "feat", "gs_final"), _I2_DIG)
def i2_empty_scope_defaults(spark, sf):
    """Every expected channel with every type; pairs with no rows get the empty-scope defaults."""
    f = _feat(spark, sf)
    expected = F.array(*[F.lit(c) for c in quality.EXPECTED_CHANNELS])
    scopes = f.select("campaign_type").distinct().select(F.explode(expected).alias("channel"), "campaign_type")
    s = stats.with_empty_defaults(scopes, stats.group_stats(f), ["channel", "campaign_type"])
    return s.select("channel", "campaign_type", "avg_roas_last_30d", "avg_roas_last_90d", "total_revenue_last_90d",
                    "total_spend_last_90d", "trend_direction", "anomalies")


_I3_DIG = {"total_revenue_last_90d": 2, "total_spend_last_90d": 2, "avg_roas_last_30d": 4, "avg_roas_last_90d": 4}


@register("i3_stats_three_grains", O.rounded("""
SELECT 'group' AS grain, gkey AS scope, avg_roas_last_30d, avg_roas_last_90d, total_revenue_last_90d,
       total_spend_last_90d, trend_direction, n_anomalies AS anomalies FROM gs_final
UNION ALL SELECT 'channel', scope, avg_roas_last_30d, avg_roas_last_90d, total_revenue_last_90d,
       total_spend_last_90d, trend_direction, n_anomalies FROM cs_final
UNION ALL SELECT 'portfolio', scope, avg_roas_last_30d, avg_roas_last_90d, total_revenue_last_90d,
       total_spend_last_90d, trend_direction, n_anomalies FROM ps_final""", _I3_DIG, "gs_final", "cs_final", "ps_final"),
          _I3_DIG)
def i3_stats_three_grains(spark, sf):
    f = _feat(spark, sf)
    cols = ["avg_roas_last_30d", "avg_roas_last_90d", "total_revenue_last_90d", "total_spend_last_90d",
            "trend_direction", "anomalies"]
    g = stats.group_stats(f).select(F.lit("group").alias("grain"), group_key("channel", "campaign_type").alias("scope"), *cols)
    c = stats.channel_stats(f).select(F.lit("channel").alias("grain"), F.col("channel").alias("scope"), *cols)
    p = stats.portfolio_stats(f).select(F.lit("portfolio").alias("grain"), "scope", *cols)
    return g.unionByName(c).unionByName(p)


@register("i4_summary_table", O.q("SELECT scope, horizon, summary, prompt FROM summ", "summ"))
def i4_summary_table(spark, sf):
    return stats.summaries(_feat(spark, sf))


def _loaded(spark, sf):
    bundle = pipeline.trained(spark, sf, "linear")
    path = sinks.scratch_dir(spark, "bundle")
    pipeline.save_trained(bundle, path)
    return pipeline.load_trained(spark, path, bundle.features)


@register("i5_anomaly_table", O.q("""
SELECT gkey AS "group", strftime(date, '%Y-%m-%d') AS date, 'Revenue Z-Score > 2.5 (Volume Anomaly)' AS issue
FROM gs_anom""", "gs_anom"))
def i5_anomaly_table(spark, sf):
    """Anomalies from the statistics of a loaded bundle."""
    return stats.anomaly_table(_loaded(spark, sf).anomalies)


@register("i6_risk_flags", O.q("""
SELECT gkey AS "group", 'declining_trend' AS risk, avg_roas_last_30d FROM gs_final WHERE trend_direction = 'down'
UNION ALL SELECT gkey, 'low_roas', avg_roas_last_30d FROM gs_final WHERE avg_roas_last_30d < 1.5""", "gs_final"),
          {"avg_roas_last_30d": 4})
def i6_risk_flags(spark, sf):
    """Risk flags from the statistics of a loaded bundle."""
    return stats.risk_flags(_loaded(spark, sf).stats)
