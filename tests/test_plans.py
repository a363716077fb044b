"""Plan-shape checks: the physical plans keep the properties the design relies on at scale."""

import re

import pytest

from pyspark.sql import functions as F

from adyield.operators import normalize as norm
from adyield.operators.aggregate import daily_aggregate
from adyield.operators.features import build_features
from adyield.operators.models import FRAME_KEYS
from adyield.operators import scenarios as sc
from adyield.operators.bootstrap import intervals
from adyield.plans.pipeline import trained
from adyield.session import cut_lineage
from adyield.sources.fixtures import raw_dialects

from .conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_dialect_scan_pushes_filter_and_prunes(spark):
    text = _formatted(raw_dialects(spark, SF_SMALL)["google"])
    assert "EqualTo(l_returnflag,A)" in text
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    li = [s for s in schemas if "l_orderkey" in s][0]
    assert "l_suppkey" not in li and "l_linestatus" not in li


def test_budget_medians_join_is_broadcast(spark):
    out = norm.normalize(raw_dialects(spark, SF_SMALL)["google"], "google")
    text = _formatted(out)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_window_features_one_exchange_one_window(spark):
    daily = cut_lineage(daily_aggregate(norm.unify(raw_dialects(spark, SF_SMALL))), "daily-test")
    plan = _plan(build_features(daily))
    assert len(re.findall(r"\bWindow\b", plan)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\(channel", plan)) == 1


@pytest.mark.parametrize("exact", [False, True])
def test_ingest_reads_the_raw_rows_once_and_the_budgets_once_more(spark, monkeypatch, exact):
    """Validation, budget fill and A1 together: one raw pass whose shuffle is keyed by day and group; exact medians
    count (type, budget) in a second one over fewer columns."""
    raws, seen = raw_dialects(spark, SF_SMALL), []
    original = norm.cut_lineage
    monkeypatch.setattr(norm, "cut_lineage", lambda df, name="table": seen.append(_plan(df)) or original(df, name))
    found = norm.ingest(raws, exact)
    from adyield.operators.quality import validation_rules
    seen += [_plan(found.daily), _plan(validation_rules(found.grain)), _plan(found.report)]
    raw = [p for p in seen if "l_returnflag" in p]
    assert len(raw) == 1 + exact
    assert all(len(re.findall(r"FileScan parquet \[l_orderkey", p)) == 3 - (i > 0) for i, p in enumerate(raw))
    key = re.search(r"Exchange hashpartitioning\((date#\d+, channel#\d+, campaign_type#\d+.*)\)", raw[0]).group(1)
    assert "budget" not in key
    assert not any("Expand" in p for p in seen) and not any("percentile" in p for p in raw)
    if exact:
        assert "l_extendedprice" not in raw[1]


def test_quality_metrics_need_no_expand(spark):
    from adyield.operators.quality import quality_metrics
    assert "Expand" not in _plan(quality_metrics(norm.unify(raw_dialects(spark, SF_SMALL))))


def test_intervals_do_not_multiply_rows_by_draws(spark):
    b = trained(spark, SF_SMALL, "linear")
    frame = sc.scenario_frame(b.features, b.feature_cols)
    keys = FRAME_KEYS + ["spend_input", "base_spend", "multiplier"]
    scored = b.models.score(frame).select(*keys, "pred_revenue", "pred_roas")
    iv = intervals(scored, b.models.residuals, keys, "lcg", samples=b.models.samples("lcg"))
    text = _formatted(iv)
    assert "sequence(" not in text          # no explode over the 1,000 draws
    assert "array_sort" in text             # quantiles are array expressions


def _written_plans(monkeypatch, run) -> list[str]:
    """Plans of the tables that ``run`` writes in the normaliser, and of what it returns."""
    seen, original = [], norm.cut_lineage
    monkeypatch.setattr(norm, "cut_lineage", lambda df, name="table": seen.append(_plan(df)) or original(df, name))
    return seen + [_plan(run())]


@pytest.mark.parametrize("exact", [False, True])
def test_raw_rows_are_not_matched_against_date_layouts(spark, monkeypatch, exact):
    """Layouts are tried per distinct text: no pass over the raw rows, in the one-pass ingest and row by row, has them."""
    raws = raw_dialects(spark, SF_SMALL)
    for run in (lambda: norm.ingest(raws, exact).daily, lambda: norm.unify(raws, exact)):
        raw = [p for p in _written_plans(monkeypatch, run) if "l_returnflag" in p]
        assert raw and not any("regexp_extract" in p or "RLIKE" in p for p in raw)
        monkeypatch.undo()


def test_a_part_table_over_the_bound_is_not_broadcast(spark, monkeypatch):
    from adyield.sources import fixtures
    small = _plan(raw_dialects(spark, SF_SMALL)["meta"])
    assert "BroadcastHashJoin" in small
    monkeypatch.setattr(fixtures, "PART_BROADCAST_BYTES", 1 << 10)
    large = raw_dialects(spark, SF_SMALL)
    assert all("SortMergeJoin" in _plan(df) and "Broadcast" not in _plan(df) for df in large.values())


def test_no_raw_row_is_split_or_goes_through_a_date_formatter(spark):
    """Per raw row, the campaign type is one search and a four-digit year's date a plain cast; the values are as before."""
    from adyield.sources import fixtures
    raw = raw_dialects(spark, SF_SMALL)["meta"]
    assert "split" not in _plan(norm.parsed_meta(raw, late_dates=True))
    assert "cast(d as string)" in str(fixtures._date_text()).lower()
    days = ["-0004-03-01", "0000-12-31", "0001-01-01", "1999-02-28", "9999-12-31", "+10000-01-01"]
    rows = spark.createDataFrame([(1, x) for x in days] + [(1, None), (997, days[3])], "l_orderkey long, t string").withColumn(
        "d", F.col("t").cast("date"))
    got = rows.select(fixtures._date_text().alias("new"), F.when(F.col("l_orderkey") == 997, "n/a").otherwise(
        F.date_format("d", "yyyy-MM-dd")).alias("old")).collect()
    assert len(got) == 8 and all(r["new"] == r["old"] for r in got)
    names = spark.createDataFrame([(x,) for x in ("Generic_a_b", "Generic", "_Generic", "generic_a", "", None)], "n string")
    assert [r[0] for r in names.select(norm.meta_campaign_type(F.col("n"))).collect()] == ["Generic", "Generic"] + ["Unknown"] * 4


def test_the_exports_of_the_dialects_are_written_together(spark, monkeypatch):
    """No dialect waits for another one's files: the first export of each is under way at the same time."""
    import threading

    from adyield.plans import queries_core
    together, original = threading.Barrier(3, timeout=120), queries_core.sinks.export_csv

    def export_csv(df, path, **kw):
        if "_0.csv" in path:
            together.wait()
        return original(df, path, **kw)

    monkeypatch.setattr(queries_core.sinks, "export_csv", export_csv)
    found = queries_core.s4_file_choice(spark, SF_SMALL)
    rows = {r["channel"]: r["rows_read"] for r in found.collect()}
    assert rows == {ch: raw.count() for ch, raw in raw_dialects(spark, SF_SMALL).items()}
