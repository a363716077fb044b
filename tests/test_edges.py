"""Literal edge tables (FIXTURES.md section 4): expected outputs typed by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from adyield.functions.exprs import budget_ratio_feature, budget_ratio_forecast, safe_ratio, to_double
from adyield.operators import normalize as norm
from adyield.operators.aggregate import daily_aggregate
from adyield.operators.features import build_features
from adyield.operators.stats import group_stats, top_campaign_type

D = dt.date


def test_ratio_edges(spark):
    rows = [("zero", "0", "10"), ("null", None, "10"), ("neg", "-5", "10"), ("norev", "10", "0"),
            ("cap", "1", "100"), ("nan", "NaN", "10"), ("plain", "4", "10")]
    df = spark.createDataFrame(rows, "k string, spend string, revenue string")
    got = dict(df.select("k", safe_ratio(to_double("revenue"), to_double("spend")).alias("r")).collect())
    assert got == {"zero": 0.0, "null": 0.0, "neg": 0.0, "norev": 0.0, "cap": 50.0, "nan": 0.0, "plain": 2.5}


def test_budget_edges(spark):
    rows = [("a", 5.0, 0.0), ("b", 0.0, 0.0), ("c", -1.0, 0.0), ("d", 10.0, 2.0), ("e", 1.0, 2.0), ("f", 1.0, None)]
    df = spark.createDataFrame(rows, "k string, spend double, budget double")
    feat = dict(df.select("k", budget_ratio_feature("spend", "budget")).collect())
    assert feat == {"a": 3.0, "b": 1.0, "c": 0.0, "d": 3.0, "e": 0.5, "f": 1.0}
    rows = [("a", 5.0, 0.0), ("b", 5.0, -1.0), ("c", 1.0, 4.0), ("d", 12.0, 2.0), ("e", 1.0, None)]
    df = spark.createDataFrame(rows, "k string, spend double, budget double")
    fc = dict(df.select("k", budget_ratio_forecast("spend", "budget")).collect())
    assert fc == {"a": 1.0, "b": 1.0, "c": 0.25, "d": 3.0, "e": 1.0}


def _google(spark, rows):
    schema = ("campaign_id string, campaign_name string, campaign_advertising_channel_type string, "
              "campaign_budget_amount string, segments_date string, metrics_cost_micros string, "
              "metrics_clicks string, metrics_impressions string, metrics_conversions string, "
              "metrics_conversions_value string")
    return spark.createDataFrame(rows, schema)


def test_median_edges(spark):
    def row(t, b, i):
        return (str(i), "n", t, b, "2024-01-01", "1000000", "1", "1", "1", "1")
    data = [("A", "10"), ("A", "20"), ("A", None), ("B", None), ("B", None),
            ("C", "1"), ("C", "2"), ("C", "3"), ("C", "4")]
    out = norm.normalize_google(_google(spark, [row(t, b, i) for i, (t, b) in enumerate(data)]))
    got = sorted((r["campaign_type"], r["daily_budget"]) for r in out.collect())
    # A's median 15; B has none -> median of the filled column (1,2,3,4,10,15,20) = 4; C even count.
    assert got == sorted([("A", 10.0), ("A", 20.0), ("A", 15.0), ("B", 4.0), ("B", 4.0),
                          ("C", 1.0), ("C", 2.0), ("C", 3.0), ("C", 4.0)])
    all_null = norm.normalize_google(_google(spark, [row("A", None, 1), row("B", None, 2)]))
    assert [r["daily_budget"] for r in all_null.collect()] == [0.0, 0.0]


def test_type_edges(spark):
    names = ["Prospecting_x_y", "Generic", "generic_x", "", None, "_x", "Remarketing_"]
    raw = spark.createDataFrame([(str(i), n, "2024-01-01", "1", "1", "1", "1", "1", "1", "1")
                                 for i, n in enumerate(names)],
                                "campaign_id string, campaign_name string, date_start string, spend string, "
                                "conversion string, clicks string, impressions string, daily_budget string, "
                                "cpc string, cpm string")
    got = {r["campaign_id"]: r["campaign_type"] for r in norm.normalize_meta(raw).collect()}
    assert got == {"0": "Prospecting", "1": "Generic", "2": "Unknown", "3": "Unknown", "4": "Unknown",
                   "5": "Unknown", "6": "Remarketing"}


def test_date_edges(spark):
    dates = ["2024-01-15", "2024-13-01", None, "2024-03-05 10:30:00", "2024-12-30", "n/a"]
    rows = [(str(i), "n", "SEARCH", "1", d, "1000000", "1", "1", "1", "1") for i, d in enumerate(dates)]
    raw = _google(spark, rows)
    out = norm.normalize_google(raw)
    got = {r["campaign_id"]: r["date"] for r in out.collect()}
    assert got == {"0": D(2024, 1, 15), "3": D(2024, 3, 5), "4": D(2024, 12, 30)}
    counts = norm.invalid_date_counts({"google": raw}).collect()[0]
    assert (counts["rows_read"], counts["rows_dropped"]) == (6, 3)
    f = build_features(daily_aggregate(out))
    r = f.where(F.col("date") == D(2024, 12, 30)).collect()[0]
    assert (r["week_of_year"], r["day_of_week"], r["month"], r["quarter"], r["is_q4"], r["is_december"]) == (1, 0, 12, 4, 1, 1)


def test_date_layouts_and_the_report(spark):
    texts = {"1/5/2024": D(2024, 1, 5), "2024-01-05T00:00:00Z": D(2024, 1, 5), "2024-01-05 00:00:00.000": D(2024, 1, 5),
             "01/05/24": D(2024, 1, 5), "Jan 5, 2024": D(2024, 1, 5), "5-Jan-2024": D(2024, 1, 5), "20240105": D(2024, 1, 5),
             "25/12/2023": D(2023, 12, 25), "2024-01-05T23:30:00+05:30": D(2024, 1, 5), "January 5, 2024 10:30 PM": D(2024, 1, 5),
             "2024-02-30": None, "Foo 5, 2024": None, "5": None}
    rows = [(t, "n", "SEARCH", "1", t, "1000000", "1", "1", "1", "one") for t in texts]
    raw = _google(spark, rows)
    got = {r["campaign_id"]: r["date"] for r in norm.normalize_google(raw).collect()}
    assert got == {t: d for t, d in texts.items() if d}
    empty = {"bing": raw.where("false"), "meta": raw.where("false")}
    found = norm.ingest({"google": raw} | empty)
    report = found.report.collect()
    assert [(r["rows_read"], r["rows_dropped"], r["unreadable"]) for r in report] == [(len(texts), 3, len(texts))]


def test_free_date_texts(spark):
    from adyield.functions.exprs import parse_date, text_shape
    day = D(2024, 1, 5)
    texts = {"Fri, 05 Jan 2024": day, "20240105T103000": day, "05-Jan-24": day, "Jan-05-2024": day, "2024-01": D(2024, 1, 1),
             "Jan 2024": D(2024, 1, 1), "2024-01-05 10:30:00 America/New_York": day, "Friday, January 5th, 2024": day,
             "Fri, 05 Jan 2024 10:30:00 GMT": day, "Fri, 05 Jan 2024 10:30:00 +0100 (CET)": day, "2024-Jan-05": day, "5 sept 2024": D(2024, 9, 5),
             "05JAN2024": day, "2024.01.05": day, "01/2024": D(2024, 1, 1), "1/5/2024 10:30 PM": day, "2024-01-05T10:30:00.123456Z": day,
             "2024-01-05 10:30:00-05:00": day, "Marble 5, 2024": None, "Maybe 2024": None, "2024-13-45": None, "99": None, "": None, None: None,
             "2024-01-05 later": None, "week 3 of 2024": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_date("t").alias("d"), text_shape("t").alias("s")).collect()
    assert {r["t"]: r["d"] for r in rows} == texts
    shape = {r["t"]: r["s"] for r in rows}
    assert shape["week 3 of 2024"] == "a 9 a 9" and shape["2024-13-45"] == "9-9-9" and shape[None] == "(missing)"


def test_a_file_tells_the_order_of_day_and_month(spark):
    def google(texts):
        return _google(spark, [(str(i), "n", "SEARCH", "1", t, "1000000", "1", "1", "1", "1") for i, t in enumerate(texts)])

    empty = google([]).where("false")
    cases = [(["5/1/2024", "25/12/2023"], [D(2024, 1, 5), D(2023, 12, 25)]), (["5/1/2024", "12/25/2023"], [D(2024, 5, 1), D(2023, 12, 25)]),
             (["5/1/2024"], [D(2024, 5, 1)]), (["5/1/2024", "12/25/2023", "25/12/2023"], [D(2024, 5, 1), D(2023, 12, 25), D(2023, 12, 25)])]
    for texts, want in cases:
        raw = google(texts)
        got = {r["campaign_id"]: r["date"] for r in norm.normalize_google(raw).collect()}
        assert [got[str(i)] for i in range(len(texts))] == want
        found = norm.ingest({"google": raw, "bing": empty, "meta": empty})
        assert sorted(r["date"] for r in found.daily.collect()) == sorted(set(want)) and not found.unknown_dates.collect()
    found = norm.ingest({"google": google(["n/a", "week 3", "week 14", None, "2024-01-05"]), "bing": empty, "meta": empty})
    assert {(r["shape"], r["rows"]) for r in found.unknown_dates.collect()} == {("a/a", 1), ("a 9", 2), ("(missing)", 1)}


def test_ingest_equals_the_row_level_path(spark):
    from adyield.sources.fixtures import raw_dialects
    raws = raw_dialects(spark, "/root/testdata/sf0.001")
    key = lambda r: (r["date"], r["channel"], r["campaign_type"])
    a = {key(r): r for r in norm.ingest(raws).daily.collect()}
    b = {key(r): r for r in daily_aggregate(norm.unify(raws)).collect()}
    assert a.keys() == b.keys()
    for k in a:
        for c in ("spend", "revenue", "clicks", "impressions", "conversions", "daily_budget", "roas"):
            assert a[k][c] == pytest.approx(b[k][c], rel=1e-9)


def test_weighted_median_is_exact(spark):
    import random
    import statistics
    rng = random.Random(4)
    rows = [(k, float(rng.randrange(50)) if rng.random() > 0.1 else None, rng.randrange(1, 9)) for k in "abc" for _ in range(40)]
    rows += [("one", 3.0, 1), ("two", 3.0, 1), ("two", 4.0, 1), ("none", None, 5)]
    got = {r["k"]: r["median"] for r in norm.weighted_median(spark.createDataFrame(rows, "k string, v double, n long"), ["k"], "v").collect()}
    for k in ("a", "b", "c", "one", "two"):
        assert got[k] == statistics.median([v for kk, v, n in rows if kk == k and v is not None for _ in range(n)])
    assert "none" not in got


def test_feature_names_survive_awkward_types(spark, tmp_path):
    """Types that differ only by case, or hold a dot, blank or backtick: features, training, saving, loading, scoring."""
    from adyield.operators.features import feature_columns, type_column
    from adyield.operators.gbt import BoostParams
    from adyield.plans import pipeline as P
    from adyield.sources import sinks
    types = ["SEARCH", "Search", "P.Max", "Two Words", "tick`s", "a__b"]
    rows = [(D(2024, 1, 1) + dt.timedelta(days=i), ch, t, 1.0 + i % 7, 10.0 + i % 11 + k)
            for k, t in enumerate(types) for ch in ("google", "bing") for i in range(65 if k % 2 else 40)]
    path = str(tmp_path / "features")
    sinks.write_features(build_features(_daily(spark, rows)), path)
    f = sinks.read_features(spark, path)
    columns = [c for c in feature_columns(f) if c.startswith("campaign_type_")]
    assert len({c.lower() for c in columns}) == len(types) and "campaign_type_SEARCH" in columns
    for t in types:
        assert f.where(F.col(type_column(t)) == 1).select("campaign_type").distinct().collect() == [(t,)]
    for kind in ("linear", "boosted"):
        bundle = P.train(f, kind, BoostParams(n_estimators=2))
        P.save_trained(bundle, str(tmp_path / kind))
        loaded = P.load_trained(spark, str(tmp_path / kind), f)
        assert P.forecast(loaded).count() == 15 * len(types) * 2 + 15
    meta = sinks.load_bundle(spark, str(tmp_path / "linear"))["metadata"].first()
    assert {(v["feature"], v["value"]) for v in meta["feature_values"] if v["key"] == "campaign_type"} == {
        (type_column(t), t) for t in types}


def test_loaded_bundle_counts_days_from_its_training_table(spark, tmp_path):
    from adyield.operators import scenarios as sc
    from adyield.plans import pipeline as P
    rows = [(D(2023, 1, 1) + dt.timedelta(days=i), "google", "A", 1.0, 10.0 + i % 5) for i in range(400)]
    f = build_features(_daily(spark, rows))
    P.save_trained(P.train(f, "linear"), str(tmp_path))
    late = P.load_trained(spark, str(tmp_path), f.where(F.col("date") >= D(2024, 1, 1)))
    frame = sc.scenario_frame(late.features, late.feature_cols, [30], min_date=late.min_date)
    last = D(2023, 1, 1) + dt.timedelta(days=399)
    assert {r["days_since_start"] for r in frame.collect()} == {float((last - D(2023, 1, 1)).days + 15)}
    assert late.stats.count() == 1


def _daily(spark, rows):
    df = spark.createDataFrame(rows, "date date, channel string, campaign_type string, spend double, revenue double")
    return df.select("date", "channel", "campaign_type", "spend", "revenue",
                     F.lit(0).cast("long").alias("clicks"), F.lit(0).cast("long").alias("impressions"),
                     F.lit(0.0).alias("conversions"), F.lit(1.0).alias("daily_budget"),
                     F.lit(1.0).alias("roas"))


def test_gap_series(spark):
    gap = [(D(2024, 1, 1), "g", "gap", 1.0, 10.0), (D(2024, 1, 2), "g", "gap", 1.0, 20.0),
           (D(2024, 1, 5), "g", "gap", 1.0, 30.0)]
    one = [(D(2024, 1, 1), "g", "one", 1.0, 7.0)]
    long = [(D(2024, 1, 1) + dt.timedelta(days=i), "g", "long", 1.0, float(i + 1)) for i in range(31)]
    f = build_features(_daily(spark, gap + one + long), channels=["g"], types=["gap", "one", "long"])
    rows = {(r["campaign_type"], r["date"]): r for r in f.collect()}
    g3 = rows[("gap", D(2024, 1, 5))]
    assert g3["lag_7d_revenue"] == 0.0 and g3["rolling_7d_revenue_mean"] == 20.0  # rows, not days (T10)
    g2 = rows[("gap", D(2024, 1, 2))]
    assert math.isclose(g2["rolling_7d_revenue_std"], math.sqrt(50.0))
    assert rows[("gap", D(2024, 1, 1))]["rolling_7d_revenue_std"] == 0.0
    o = rows[("one", D(2024, 1, 1))]
    assert (o["rolling_30d_revenue_mean"], o["rolling_7d_revenue_std"], o["lag_30d_revenue"]) == (7.0, 0.0, 0.0)
    last = rows[("long", D(2024, 1, 31))]
    assert last["lag_30d_revenue"] == 1.0 and last["lag_7d_revenue"] == 24.0
    assert last["rolling_30d_revenue_mean"] == pytest.approx(sum(range(2, 32)) / 30)


def test_trend_edges(spark):
    last = D(2024, 6, 30)
    prior = last - dt.timedelta(days=40)
    rows = []
    for t, recent, before in (("up5", 105.0, 100.0), ("down5", 95.0, 100.0), ("new", 5.0, 0.0), ("zero", 0.0, 0.0),
                              ("down", 50.0, 100.0)):
        rows += [(last, "c", t, 1.0, recent), (prior, "c", t, 1.0, before)]
    got = {r["campaign_type"]: r["trend_direction"] for r in group_stats(_daily(spark, rows)).collect()}
    assert got == {"up5": "flat", "down5": "flat", "new": "up", "zero": "flat", "down": "down"}


def test_anomaly_edges(spark):
    base = D(2024, 1, 1)
    rows = []
    for t, vals in (("high", [100.0] * 19 + [1000.0]), ("low", [100.0] * 19 + [-800.0]),
                    ("flat", [5.0] * 10), ("single", [3.0])):
        rows += [(base + dt.timedelta(days=i), "c", t, 1.0, v) for i, v in enumerate(vals)]
    got = {r["campaign_type"]: r["anomaly_flags"] for r in group_stats(_daily(spark, rows)).collect()}
    assert got["high"] == [base + dt.timedelta(days=19)]
    assert got["low"] == [base + dt.timedelta(days=19)]
    assert got["flat"] == [] and got["single"] == []


def test_tie_edges(spark):
    rows = [(D(2024, 1, 1), "c", "Zeta", 1.0, 50.0), (D(2024, 1, 1), "c", "Alpha", 1.0, 50.0),
            (D(2024, 1, 1), "c", "Beta", 1.0, 10.0)]
    got = top_campaign_type(_daily(spark, rows)).collect()[0]["top_campaign_type"]
    assert got == "Alpha"


def test_approx_medians_close_to_exact(spark):
    from adyield.sources.fixtures import raw_dialects
    raw = raw_dialects(spark, "/root/testdata/sf0.001")["google"]
    exact = {r["campaign_id"] + str(r["date"]): r["daily_budget"] for r in norm.normalize(raw, "google").collect()}
    approx = {r["campaign_id"] + str(r["date"]): r["daily_budget"]
              for r in norm.normalize(raw, "google", exact_medians=False).collect()}
    assert exact.keys() == approx.keys()
    diffs = [abs(exact[k] - approx[k]) / max(abs(exact[k]), 1.0) for k in exact]
    assert max(diffs) < 0.01


def test_dates_that_are_no_dates_abort(spark):
    from adyield.operators import quality
    rows = spark.range(150).selectExpr("'google' as channel", "1.0D as revenue", "date'2024-01-01' as date")
    for df, level in ((rows, "ok"), (rows.selectExpr("*", "cast(date as timestamp) as d").drop("date").withColumnRenamed("d", "date"), "ok"),
                      (rows.withColumn("date", F.col("date").cast("string")), "abort"), (rows.drop("date"), "abort")):
        rules = quality.validation_rules(quality.channel_counts(df))
        assert {r["rule"]: r["level"] for r in rules.collect()}["date_type"] == level
        if level == "abort":
            with pytest.raises(ValueError):
                quality.check(rules)


def test_a_time_of_day_does_not_make_a_text_of_its_own(spark):
    """Texts of one day differ by their time only: they become one text, which says the same as each of them."""
    from adyield.functions.exprs import date_order, day_text, other_reading, parse_date, text_shape
    groups = [["2024-01-05 10:30:00.5", "2024-01-05 23:59:59.123"], ["2024-01-05T01:02:03Z", "2024-01-05T21:32:53Z"],
              ["25/12/2023 9:05", "25/12/2023 10:55"], ["5/1/2024, 1:30 PM", "5/1/2024, 11:45 PM"],
              ["Jan 2024 05:30", "Jan 2024 06:31"], ["2024-01-05T23:30:00+05:30", "2024-01-05T01:30:59+05:45"],
              ["20 24 01 05:30", "20 24 01 06:31"], ["week 3 at 10:30", "week 3 at 11:31"]]
    alone = ["2024-01-05", "n/a", "", "1:2", "5/1/24:30", "2024-01-05 1:2:3", "2024-01-05 10:30:00,5 x", "x" * 210 + " 10:30:00.12345"]
    rows = spark.createDataFrame([(i, t) for i, g in enumerate(groups + [[t] for t in alone]) for t in g], "g int, t string")
    said = lambda c: F.struct(parse_date(c), other_reading(c, parse_date(c)), date_order(c), text_shape(c))
    found = rows.select("g", day_text("t").alias("u"), "t").withColumn("same", said("u").eqNullSafe(said("t"))).collect()
    assert not [r for r in found if not r["same"]]
    assert all(len({r["u"] for r in found if r["g"] == i}) == 1 for i in range(len(groups)))


def test_times_of_day_neither_multiply_the_sums_nor_the_reads(spark):
    times = [f"2024-01-0{1 + i % 2} {i % 24:02d}:{i % 60:02d}:{(7 * i) % 60:02d}" for i in range(500)]
    raw = _google(spark, [(str(i), "n", "SEARCH", "1", t, "1000000", "1", "1", "1", "1") for i, t in enumerate(times)])
    found = norm.ingest({"google": raw, "bing": raw.where("false"), "meta": raw.where("false")})
    assert found.grain.count() == 2
    assert {r["date"]: r["clicks"] for r in found.daily.collect()} == {D(2024, 1, 1): 250, D(2024, 1, 2): 250}
    assert norm.normalize_google(raw).groupBy("date").count().count() == 2


def test_typed_and_text_dates_together(spark):
    """One dialect with typed dates, one with texts: each is read in its own way, NULL is missing in both."""
    typed = _google(spark, [(str(i), "n", "SEARCH", "1", t, "1000000", "1", "1", "1", "1") for i, t in enumerate(
        ["2024-01-05", None])]).withColumn("segments_date", F.col("segments_date").cast("date"))
    bing = spark.createDataFrame([("a", "n", "Search", t, 1.0) for t in ("25/12/2023", "5/1/2024", None, "n/a")],
                                 "CampaignId string, CampaignName string, CampaignType string, TimePeriod string, Spend double")
    meta = spark.createDataFrame([], "campaign_id string, campaign_name string, date_start string")
    raws = {"google": typed, "bing": bing, "meta": meta}
    want = [("bing", D(2023, 12, 25)), ("bing", D(2024, 1, 5)), ("google", D(2024, 1, 5))]
    found = norm.ingest(raws)
    assert sorted((r["channel"], r["date"]) for r in found.daily.collect()) == want
    assert sorted((r["channel"], r["date"]) for r in norm.unify(raws).collect()) == want
    assert {(r["channel"], r["shape"], r["rows"]) for r in found.unknown_dates.collect()} == {
        ("google", "(missing)", 1), ("bing", "(missing)", 1), ("bing", "a/a", 1)}
