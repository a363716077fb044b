"""Dialect normalisers, budget imputation and the canonical union.

Each normaliser is one projection of column expressions over the raw table,
followed by the date filter and the budget imputation. Types are coerced with
``try_cast`` so the same code serves text columns from CSV and typed columns
from Parquet.

``ingest`` is the production path: it sums the raw rows per (date, channel,
type), missing budgets apart. The fill (a constant per type), the daily table
(A1), the validation figures, the counts of dropped dates and unreadable
numbers and the report of malformed files all come from that table; budget
medians come from counts of (type, budget), or from sketches beside the sums.

Date texts are read once per distinct text (``read_dates``), not once per row:
rows are summed or counted by their text first, and meet its date by a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import date_order, day_text, is_typed_date, other_reading, parse_date, safe_ratio, text_shape, to_double, to_long
from ..session import cut_lineage
from ..sources.csv import ROW_EXTRA, ROW_FILE, file_report, require, row_marks, warn_skipped, without_files
from .aggregate import DAILY_COLUMNS, DAILY_KEYS
from .common import broadcast_if_small, one_row

# The canonical column order of every normalised table.
CANONICAL_COLUMNS = [
    "date", "channel", "campaign_type", "campaign_name", "spend", "revenue",
    "roas", "clicks", "impressions", "conversions", "daily_budget", "campaign_id",
]

CANONICAL_TYPES = {
    "date": "date", "channel": "string", "campaign_type": "string", "campaign_name": "string",
    "spend": "double", "revenue": "double", "roas": "double", "clicks": "bigint",
    "impressions": "bigint", "conversions": "double", "daily_budget": "double", "campaign_id": "string",
}

# Meta campaign types recognised as the first '_' token of the name.
META_TYPES = ["Prospecting", "Remarketing", "Generic"]

# Defaults used when the platform leaves a field empty.
UNKNOWN_NAME = "Unknown"
GOOGLE_DEFAULT_TYPE = "SEARCH"
BING_DEFAULT_TYPE = "Search"
MICROS = 1_000_000.0


# Columns that parsed rows carry until the order of day and month in their file is known.
DAY_FIRST, ORDER, SHAPE = "_date_day_first", "_date_order", "_date_shape"
# The text of a date that is not read yet.
DATE_TEXT = "_date_text"


def _getter(df: DataFrame):
    cols = set(df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}

    def get(name: str) -> Column:
        return F.col(f"`{name}`") if name in cols else F.lit(None)

    def dtype(name: str):
        return types.get(name)

    return get, dtype, cols


def _text(c: Column) -> Column:
    return c.cast("string")


# Distinct (key, value) counts up to which medians are taken in memory; a count takes some 50 bytes of a task's map.
COUNTED_MAX = 1_000_000
# KLL sketches: size parameter, its rank error (single-sided, 99 %), and the points that a sketch is read at.
SKETCH_K = 800
SKETCH_RANK_ERROR = 0.0055
SKETCH_POINTS = 1_000


def weighted_median(counts: DataFrame, keys: list[str], value: str, n: str = "n", counted: int | None = None) -> DataFrame:
    """Exact median of ``value`` (each counted ``n`` times, nulls ignored) per key: (keys, median).

    ``counted``: a checked bound on the rows of ``counts``. Up to ``COUNTED_MAX`` the built-in percentile reads them.
    Beyond, the (key, value) rows are range-partitioned and each partition's total is carried to the later ones (one
    row per key and partition), so running counts need no task that holds all values of a key. The median is
    the mean of the values at the two middle places either way.
    """
    present = counts.where(F.col(value).isNotNull())
    if counted is not None and counted <= COUNTED_MAX:
        return present.groupBy(*keys).agg(F.percentile(value, F.lit(0.5), F.col(n)).alias("median"))
    rows = present.groupBy(*keys, value).agg(F.sum(n).alias("_n"))
    ranged = cut_lineage(rows.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()), "ranged")
    by_key = Window.partitionBy(*keys)
    totals = ranged.groupBy(*keys, "_part").agg(F.sum("_n").alias("_here")).select(
        *keys, "_part", F.sum("_here").over(by_key).alias("_total"),
        (F.sum("_here").over(by_key.orderBy("_part")) - F.col("_here")).alias("_before"))
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy(value)) + F.col("_before")
    placed = ranged.join(totals, [*keys, "_part"]).withColumn("_upto", upto)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_upto") > place) & (F.col("_upto") - F.col("_n") <= place), F.col(value)))

    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    return placed.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias("median"))


def budget_medians(counts: DataFrame, keys: list[str], type_col: str = "campaign_type",
                   budget_col: str = "daily_budget") -> tuple[DataFrame, DataFrame]:
    """Medians that fill missing budgets (T7), from a written table of ``(keys, type, budget, n)`` counts.

    Returns (keys, type, type_median) and (keys, filled_median): the median of the type, and the median of the
    column after that first fill.
    """
    counted = counts.count()
    per_type = cut_lineage(weighted_median(counts, [*keys, type_col], budget_col, counted=counted).withColumnRenamed(
        "median", "type_median"), "type-medians")
    filled = counts.join(broadcast_if_small(per_type), [*keys, type_col], "left").withColumn(
        "_filled", F.coalesce(budget_col, "type_median"))
    return per_type, weighted_median(filled, keys, "_filled", counted=counted).withColumnRenamed("median", "filled_median")


def sketched_medians(sketches: DataFrame, keys: list[str], type_col: str = "campaign_type") -> tuple[DataFrame, DataFrame]:
    """``budget_medians`` from mergeable sketches: rows (keys, type, sketch, missing), any number per type.

    A type's median lies within ``SKETCH_RANK_ERROR`` of the middle rank. The filled column is read from the key's
    merged sketch at ``SKETCH_POINTS`` ranks, beside each type's median counted as often as its budget is missing, which adds
    ``1 / SKETCH_POINTS`` to the error.
    """
    n, points = F.kll_sketch_get_n_double("_sketch"), F.lit(SKETCH_POINTS)
    merged = [F.kll_merge_agg_double("sketch", SKETCH_K).alias("_sketch"), F.sum("missing").alias("_missing")]
    at = lambda rank: F.when(n > 0, F.kll_sketch_get_quantile_double("_sketch", rank))
    per_type = cut_lineage(sketches.groupBy(*keys, type_col).agg(*merged).select(
        *keys, type_col, at(F.lit(0.5)).alias("type_median"), "_missing"), "type-medians")
    ranks = F.array(*[F.lit((i + 0.5) / SKETCH_POINTS) for i in range(SKETCH_POINTS)])
    read = sketches.groupBy(*keys).agg(*merged).select(*keys, n.alias("n"), F.explode(at(ranks)).alias("value"))
    masses = per_type.where("type_median is not null and _missing > 0").select(
        *keys, (F.col("_missing") * points).alias("n"), F.col("type_median").alias("value"))
    # SKETCH_POINTS rows per key and one per type
    filled = weighted_median(read.unionByName(masses), keys, "value", counted=0).withColumnRenamed("median", "filled_median")
    return per_type.drop("_missing"), filled


def impute_budget_approx(df: DataFrame, type_col: str = "campaign_type", budget_col: str = "daily_budget",
                         accuracy: int = 10_000) -> DataFrame:
    """``impute_budget`` with ``percentile_approx`` (relative rank error 1/accuracy) instead of counted values."""
    per_type = cut_lineage(df.groupBy("channel", type_col).agg(
        F.percentile_approx(budget_col, 0.5, accuracy).alias("type_median")), "type-medians")
    with_type = df.join(broadcast_if_small(per_type), ["channel", type_col], "left")
    filled = with_type.groupBy("channel").agg(
        F.percentile_approx(F.coalesce(budget_col, "type_median"), 0.5, accuracy).alias("filled_median"))
    return _filled(with_type, cut_lineage(filled, "filled-medians"), budget_col)


def _filled(with_type: DataFrame, filled: DataFrame, budget_col: str) -> DataFrame:
    return (with_type.join(broadcast_if_small(filled), "channel", "left")
            .withColumn(budget_col, F.coalesce(budget_col, "type_median", "filled_median", F.lit(0.0)))
            .drop("type_median", "filled_median"))


def impute_budget(df: DataFrame, type_col: str = "campaign_type", budget_col: str = "daily_budget") -> DataFrame:
    """Median of the channel's campaign type, then median of its already filled column, then 0 (P7, T7), row by row.

    Runs jobs when called: one raw pass counts (channel, type, budget) with map-side combine and writes them to
    the shared folder, and the medians come from that table. The returned plan is the fill: the medians meet
    the raw rows by broadcast while their checked size allows, else by a join whose skewed partitions AQE
    splits, so a type that holds a third of the rows is never one task.
    """
    counts = cut_lineage(df.groupBy("channel", type_col, budget_col).agg(F.count(F.lit(1)).alias("n")), "budget-counts")
    per_type, filled = budget_medians(counts, ["channel"], type_col, budget_col)
    with_type = df.join(broadcast_if_small(per_type), ["channel", type_col], "left")
    return _filled(with_type, cut_lineage(filled, "filled-medians"), budget_col)


def finish_canonical(df: DataFrame) -> DataFrame:
    """Add the ratio (P9) and project the 12 canonical columns in order."""
    df = df.withColumn("roas", safe_ratio("revenue", "spend"))
    return df.select(*[F.col(c).cast(CANONICAL_TYPES[c]).alias(c) for c in CANONICAL_COLUMNS])


def meta_campaign_type(name: Column) -> Column:
    """First '_' token of the name if it is a known type, else "Unknown" (P8, T13)."""
    token = F.substring_index(F.coalesce(name, F.lit("")), "_", 1)      # one search; a split would build all tokens
    return F.when(token.isin(*META_TYPES), token).otherwise(F.lit(UNKNOWN_NAME))


def _dates(c: Column, dtype, late: bool = False) -> list[Column]:
    """The date, its other reading and what it tells about the order of day and month in its file, and the shape of a
    text that is no date. ``late``: a text stays as it is, for ``read_dates``, and the date is NULL."""
    if late:
        return [F.to_date(c).alias("date")] if is_typed_date(dtype) else [
            F.lit(None).cast("date").alias("date"), day_text(c).alias(DATE_TEXT)]
    date = parse_date(c, dtype)
    if is_typed_date(dtype):
        return [date.alias("date"), date.alias(DAY_FIRST), F.lit(None).cast("string").alias(ORDER),
                F.when(date.isNull(), "(missing)").alias(SHAPE)]
    return [date.alias("date"), other_reading(c, date).alias(DAY_FIRST), date_order(c).alias(ORDER),
            F.when(date.isNull(), text_shape(c)).alias(SHAPE)]


def read_dates(texts: DataFrame) -> DataFrame:
    """The distinct ``DATE_TEXT`` of ``texts`` with ``_dates`` of each, written: no text is read twice."""
    found = texts.select(DATE_TEXT).where(F.col(DATE_TEXT).isNotNull()).distinct()
    return cut_lineage(found.select(DATE_TEXT, *_dates(F.col(DATE_TEXT), found.schema[DATE_TEXT].dataType)), "date-texts")


def with_dates(rows: DataFrame, read: DataFrame) -> DataFrame:
    """Rows with what ``read_dates`` found in their ``DATE_TEXT``; a typed date stays."""
    known = read.withColumnRenamed("date", "_read")
    return (rows.join(broadcast_if_small(known), DATE_TEXT, "left")
            .withColumn("date", F.coalesce("date", "_read")).withColumn(DAY_FIRST, F.coalesce(DAY_FIRST, "date"))
            .withColumn(SHAPE, F.when(F.col("date").isNull(), F.coalesce(SHAPE, F.lit("(missing)"))))
            .drop(DATE_TEXT, "_read"))


def _marks(raw: DataFrame) -> list[Column]:
    """The file and the surplus fields of rows that come from CSV files not judged yet."""
    return [F.col(c) for c in (ROW_FILE, ROW_EXTRA) if c in raw.columns]


def _unreadable(get, names: list[str]) -> Column:
    """Cells of the named fields that hold text which is no number (they become NULL and are filled, T31)."""
    return sum((F.when(get(n).isNotNull() & get(n).try_cast("double").isNull(), 1).otherwise(0) for n in names),
               F.lit(0)).alias("unreadable")


def parsed_google(raw: DataFrame, late_dates: bool = False) -> DataFrame:
    """Typed google rows before the date filter."""
    get, dtype, cols = _getter(raw)
    spend = (to_double(get("metrics_cost_micros")) / F.lit(MICROS)
             if "metrics_cost_micros" in cols else F.lit(0.0))
    return raw.select(
        *_dates(get("segments_date"), dtype("segments_date"), late_dates),
        F.lit("google").alias("channel"),
        F.coalesce(_text(get("campaign_advertising_channel_type")), F.lit(GOOGLE_DEFAULT_TYPE)).alias("campaign_type"),
        F.coalesce(_text(get("campaign_name")), F.lit(UNKNOWN_NAME)).alias("campaign_name"),
        spend.alias("spend"),
        F.coalesce(to_double(get("metrics_conversions_value")), F.lit(0.0)).alias("revenue"),
        F.coalesce(to_long(get("metrics_clicks")), F.lit(0)).alias("clicks"),
        F.coalesce(to_long(get("metrics_impressions")), F.lit(0)).alias("impressions"),
        F.coalesce(to_double(get("metrics_conversions")), F.lit(0.0)).alias("conversions"),
        to_double(get("campaign_budget_amount")).alias("daily_budget"),
        _text(get("campaign_id")).alias("campaign_id"),
        _unreadable(get, ["metrics_cost_micros", "metrics_conversions_value", "metrics_clicks", "metrics_impressions",
                          "metrics_conversions", "campaign_budget_amount"]),
        *_marks(raw),
    )


def parsed_bing(raw: DataFrame, late_dates: bool = False) -> DataFrame:
    """Typed bing rows before the date filter (P2, P5); budget NULL -> 0, no median."""
    get, dtype, _ = _getter(raw)
    return raw.select(
        *_dates(get("TimePeriod"), dtype("TimePeriod"), late_dates),
        F.lit("bing").alias("channel"),
        F.coalesce(_text(get("CampaignType")), F.lit(BING_DEFAULT_TYPE)).alias("campaign_type"),
        F.coalesce(_text(get("CampaignName")), F.lit(UNKNOWN_NAME)).alias("campaign_name"),
        F.coalesce(to_double(get("Spend")), F.lit(0.0)).alias("spend"),
        F.coalesce(to_double(get("Revenue")), F.lit(0.0)).alias("revenue"),
        F.coalesce(to_long(get("Clicks")), F.lit(0)).alias("clicks"),
        F.coalesce(to_long(get("Impressions")), F.lit(0)).alias("impressions"),
        F.coalesce(to_double(get("Conversions")), F.lit(0.0)).alias("conversions"),
        F.coalesce(to_double(get("DailyBudget")), F.lit(0.0)).alias("daily_budget"),
        _text(get("CampaignId")).alias("campaign_id"),
        _unreadable(get, ["Spend", "Revenue", "Clicks", "Impressions", "Conversions", "DailyBudget"]),
        *_marks(raw),
    )


def parsed_meta(raw: DataFrame, late_dates: bool = False) -> DataFrame:
    """Typed meta rows before the date filter."""
    get, dtype, _ = _getter(raw)
    name = F.coalesce(_text(get("campaign_name")), F.lit(UNKNOWN_NAME))
    revenue = F.coalesce(to_double(get("conversion")), F.lit(0.0))
    return raw.select(
        *_dates(get("date_start"), dtype("date_start"), late_dates),
        F.lit("meta").alias("channel"),
        meta_campaign_type(name).alias("campaign_type"),
        name.alias("campaign_name"),
        F.coalesce(to_double(get("spend")), F.lit(0.0)).alias("spend"),
        revenue.alias("revenue"),
        F.coalesce(to_long(get("clicks")), F.lit(0)).alias("clicks"),
        F.coalesce(to_long(get("impressions")), F.lit(0)).alias("impressions"),
        (revenue / F.lit(100.0)).alias("conversions"),
        to_double(get("daily_budget")).alias("daily_budget"),
        _text(get("campaign_id")).alias("campaign_id"),
        _unreadable(get, ["spend", "conversion", "clicks", "impressions", "daily_budget"]),
        *_marks(raw),
    )


PARSERS = {"google": parsed_google, "bing": parsed_bing, "meta": parsed_meta}
IMPUTES_BUDGET = {"google": True, "bing": False, "meta": True}


# Share of a file's numeric dates that must be readable day first only. Of evenly spread days 60 % are; one stray date
# among month-first ones does not turn a file.
DAY_FIRST_SHARE = 1 / 3


def day_first_scopes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys (channel, file) whose numeric dates put the day first: more than ``DAY_FIRST_SHARE`` of them (counted by
    ``rows``) can be read no other way, and none only month first. One row per such file."""
    seen = lambda *orders: F.sum(F.when(F.col(ORDER).isin(*orders), F.col("rows")).otherwise(0))
    return rows.where(F.col(ORDER).isNotNull()).groupBy(*keys).agg(
        seen("day").alias("_day"), seen("month").alias("_month"), seen("day", "either").alias("_all")).where(
        (F.col("_month") == 0) & (F.col("_day") > F.col("_all") * DAY_FIRST_SHARE)).select(*keys, F.lit(True).alias("_flip"))


def settle_dates(rows: DataFrame, scopes: DataFrame, keys: list[str]) -> DataFrame:
    """``date`` as the rows' file writes it; the columns of the decision go. ``scopes`` must be a written table."""
    if scopes.count():
        named = scopes.toDF(*[f"_{k}" for k in keys], "_flip")
        same = [rows[k].eqNullSafe(named[f"_{k}"]) for k in keys]
        on = same[0] if len(same) == 1 else same[0] & same[1]
        rows = rows.join(broadcast_if_small(named), on, "left").withColumn(
            "date", F.when(F.col("_flip"), F.col(DAY_FIRST)).otherwise(F.col("date"))).drop("_flip", *[f"_{k}" for k in keys])
    return rows.drop(DAY_FIRST, ORDER)


def dated(raw: DataFrame, channel: str) -> DataFrame:
    """Parsed rows with a settled date, the others dropped.

    Texts take a pass over the dates alone, which counts each text per file; what a text says, and whether its file writes
    the day or the month first, come from these counts.
    """
    rows = PARSERS[channel](raw, late_dates=True)
    if DATE_TEXT not in rows.columns:
        return rows.where(F.col("date").isNotNull())
    keys = ["channel", *[c for c in (ROW_FILE,) if c in rows.columns]]
    counts = cut_lineage(rows.where(F.col(DATE_TEXT).isNotNull()).groupBy(*keys, DATE_TEXT).agg(
        F.count(F.lit(1)).alias("rows")), "text-counts")
    read = read_dates(counts)
    scopes = cut_lineage(day_first_scopes(counts.join(broadcast_if_small(read), DATE_TEXT), keys), "date-orders")
    known = cut_lineage(read.where(F.col("date").isNotNull()).drop(SHAPE), "dates")
    return settle_dates(rows.drop("date").join(broadcast_if_small(known), DATE_TEXT).drop(DATE_TEXT), scopes, keys)


def normalize(raw: DataFrame, channel: str, exact_medians: bool = True) -> DataFrame:
    """Raw dialect table -> canonical rows (P1-P11). Rows with no valid date are dropped.

    ``exact_medians=False`` fills budgets with approximate medians (bounded
    memory per campaign type whatever the number of distinct budgets).
    """
    typed = dated(raw, channel)
    if IMPUTES_BUDGET[channel]:
        typed = impute_budget(typed) if exact_medians else impute_budget_approx(typed)
    return finish_canonical(typed)


def normalize_google(raw: DataFrame) -> DataFrame:
    return normalize(raw, "google")


def normalize_bing(raw: DataFrame) -> DataFrame:
    return normalize(raw, "bing")


def normalize_meta(raw: DataFrame) -> DataFrame:
    return normalize(raw, "meta")


def _present(raws: dict[str, DataFrame]) -> list[str]:
    missing = [ch for ch in PARSERS if ch not in raws]
    if missing:
        raise FileNotFoundError(f"no input identified for channel(s): {', '.join(missing)}")
    return list(PARSERS)


def unify(raws: dict[str, DataFrame], exact_medians: bool = True) -> DataFrame:
    """Union-all of the normalised dialects (U1); missing dialect is an error.

    The budgets of all channels that impute them are counted in one pass.
    """
    filled, plain = None, None
    for ch in _present(raws):
        part = dated(raws[ch], ch)
        if IMPUTES_BUDGET[ch]:
            filled = part if filled is None else filled.unionByName(part)
        else:
            plain = part if plain is None else plain.unionByName(part)
    filled = impute_budget(filled) if exact_medians else impute_budget_approx(filled)
    return finish_canonical(filled.unionByName(plain))


@dataclass
class Ingest:
    """What the raw rows yield."""
    grain: DataFrame             # date, channel, campaign_type (and file) with sums, row counts and missing budgets
    daily: DataFrame             # A1, budgets filled
    report: DataFrame            # channel, rows_read, rows_dropped, unreadable
    type_medians: DataFrame      # channel, campaign_type, type_median
    filled_medians: DataFrame    # channel, filled_median
    unknown_dates: DataFrame     # channel, shape, rows: date texts of no known layout
    files: DataFrame | None = None     # channel, file, rows, long_rows, short_rows, skipped (CSV sources)


def ingest(raws: dict[str, DataFrame], exact_medians: bool = True) -> Ingest:
    """Raw dialects -> daily table and reports.

    One pass over the raw rows sums them per (date text, channel, type) with map-side combine, missing budgets apart: the
    fill is a constant per type, so the daily budget is ``sum + missing x median`` and what is shuffled and written has
    days x groups rows (times the files that a day is spread over, for CSV sources). Exact medians take a second pass
    over three columns, which counts (type, budget); ``exact_medians=False`` keeps a quantile sketch beside the sums
    instead (rank error ``SKETCH_RANK_ERROR``) and reads the raw rows once.

    A file whose numeric dates put the day first (``day_first_scopes``) is read so.
    Files with a row wider than their header and first row are left out as a whole, as an unreadable file is.
    """
    typed, marks = None, [ROW_FILE] if any(ROW_FILE in df.columns for df in raws.values()) else []
    for ch in _present(raws):
        part = PARSERS[ch](raws[ch], late_dates=True).drop("campaign_name", "campaign_id")
        typed = part if typed is None else typed.unionByName(part, allowMissingColumns=True)
    if DATE_TEXT not in typed.columns:
        typed = typed.withColumn(DATE_TEXT, F.lit(None).cast("string"))
    imputes = F.col("channel").isin(*[ch for ch, yes in IMPUTES_BUDGET.items() if yes])
    budget = F.when(imputes, F.col("daily_budget"))
    aggregates = [
        F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("revenue") <= 0, 1).otherwise(0)).alias("nonpositive"),
        F.sum("unreadable").alias("unreadable"), F.count(F.when(F.col("daily_budget").isNull(), 1)).alias("missing"),
        *[F.sum(c).alias(c) for c in ("spend", "revenue", "clicks", "impressions", "conversions", "daily_budget")]]
    if marks:
        typed = typed.select("*", *[c for c in row_marks()[1:]])
        aggregates += [F.sum(c).alias(c) for c in ("long_rows", "short_rows")]
    if not exact_medians:
        aggregates.append(F.kll_sketch_agg_double(budget, SKETCH_K).alias("sketch"))
    keys = [*DAILY_KEYS, DATE_TEXT, *marks]
    grain, files = cut_lineage(typed.groupBy(*keys).agg(*aggregates), "grain"), None
    skipped = False
    if marks:
        files = cut_lineage(file_report(grain.where(F.col(ROW_FILE).isNotNull()), ["channel"]), "csv-files")
        warn_skipped(files)
        skipped = files.where("skipped").count() > 0
    if skipped:
        grain = cut_lineage(without_files(grain, files), "grain")
        require([r["channel"] for r in grain.select("channel").distinct().collect()], "the given files")    # three at most
    read = read_dates(grain)
    grain = with_dates(grain, read)
    scope = ["channel", *marks]
    scopes = cut_lineage(day_first_scopes(grain, scope), "date-orders")
    grain = settle_dates(grain, scopes, scope)
    shapes = grain.where(F.col("date").isNull()).groupBy("channel", F.col(SHAPE).alias("shape")).agg(F.sum("rows").alias("rows"))
    report = grain.groupBy("channel").agg(
        F.sum("rows").alias("rows_read"),
        F.sum(F.when(F.col("date").isNull(), F.col("rows")).otherwise(0)).alias("rows_dropped"),
        F.sum("unreadable").alias("unreadable"))
    grain = grain.where(F.col("date").isNotNull()).drop(SHAPE)
    if exact_medians:
        bad = cut_lineage(read.where(F.col("date").isNull()).select(DATE_TEXT), "bad-dates")
        valid = typed.where(imputes & (F.col("date").isNotNull() | F.col(DATE_TEXT).isNotNull())).join(
            broadcast_if_small(bad), DATE_TEXT, "left_anti")
        counts = valid.groupBy(*marks, "channel", "campaign_type", "daily_budget").agg(F.count(F.lit(1)).alias("n"))
        counts = cut_lineage(without_files(counts, files) if skipped else counts, "budget-counts")
        per_type, filled = budget_medians(counts, ["channel"])
    else:
        per_type, filled = sketched_medians(grain.where(imputes), ["channel"])
    filled = cut_lineage(filled, "filled-medians")
    fill = F.coalesce("type_median", "filled_median", F.lit(0.0)) * F.col("missing")
    full = (grain.join(broadcast_if_small(per_type), ["channel", "campaign_type"], "left")
            .join(broadcast_if_small(filled), "channel", "left"))
    daily = full.groupBy(*DAILY_KEYS).agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("spend", "revenue")],
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("clicks", "impressions")],
        F.coalesce(F.sum("conversions"), F.lit(0.0)).alias("conversions"),
        F.sum(F.coalesce("daily_budget", F.lit(0.0)) + fill).alias("daily_budget"))
    daily = daily.withColumn("roas", safe_ratio("revenue", "spend")).select(*DAILY_COLUMNS)
    return Ingest(grain, daily, report, per_type, filled, shapes, files)


def invalid_date_counts(raws: dict[str, DataFrame]) -> DataFrame:
    """Rows dropped by the date parse, per channel (P4 report), without the rest of ``ingest``."""
    out = None
    for ch, raw in raws.items():
        part = PARSERS[ch](raw).select("date").agg(
            F.lit(ch).alias("channel"),
            F.count(F.lit(1)).alias("rows_read"),
            F.sum(F.when(F.col("date").isNull(), 1).otherwise(0)).cast("long").alias("rows_dropped"))
        out = part if out is None else out.unionByName(part)
    return out


def canonical_sort(df: DataFrame, with_name: bool = True) -> DataFrame:
    """Canonical order (O1): date, channel, campaign_type[, campaign_name]. Sink-side only.

    The remaining columns and a row id break ties: the range partitioner sends
    equal keys to one partition, so without them one hot key would be one task.
    The order among rows equal on the canonical keys is unspecified, as in the
    reference.
    """
    keys = ["date", "channel", "campaign_type"] + (["campaign_name"] if with_name else [])
    rest = [c for c in ("campaign_id", "spend", "revenue", "daily_budget", "clicks", "impressions")
            if c in df.columns and c not in keys]
    return df.orderBy(*keys, *rest, F.monotonically_increasing_id())
