"""The three jobs end to end: features -> train (save bundle) -> predict (load bundle, write CSV)."""

import pytest
from pyspark.sql import functions as F

from adyield.operators.gbt import BoostParams
from adyield.plans import pipeline as P
from adyield.sources import sinks

from .conftest import SF_SMALL


def test_jobs_boosted_round_trip(spark, tmp_path, monkeypatch):
    feats_path, bundle_path, out = str(tmp_path / "features"), str(tmp_path / "bundle"), str(tmp_path / "pred")
    features = P.features_job(spark, SF_SMALL, feats_path)
    groups = features.select("channel", "campaign_type").distinct().count()
    # Few trees keep the test short; the default stays 200.
    original = P.train
    monkeypatch.setattr(P, "train", lambda f, kind="boosted", params=BoostParams(): original(
        f, kind, BoostParams(n_estimators=4)))
    trained = P.train_job(spark, feats_path, bundle_path, "boosted")
    direct = {(r["forecast_period_days"], r["channel"], r["campaign_type"], r["budget_scenario"]): r
              for r in P.forecast(trained, draws="numpy").collect()}
    pred = P.predict_job(spark, feats_path, bundle_path, out, draws="numpy").collect()
    assert len(pred) == 15 * groups + 15
    for r in pred:
        d = direct[(r["forecast_period_days"], r["channel"], r["campaign_type"], r["budget_scenario"])]
        assert r["revenue_p50"] == pytest.approx(d["revenue_p50"], rel=1e-9)
        assert r["roas_p90"] == pytest.approx(d["roas_p90"], rel=1e-9)
        assert r["causal_summary"] == d["causal_summary"]


def test_features_job_from_csv_directory(spark, tmp_path):
    from adyield.sources.fixtures import raw_dialects
    src = str(tmp_path / "csv")
    sinks.export_dialect_csv(raw_dialects(spark, SF_SMALL), src)
    from_csv = P.features_job(spark, src, str(tmp_path / "f_csv"))
    from_tables = P.feature_table(spark, SF_SMALL)
    cols = ["date", "channel", "campaign_type", "revenue", "spend", "rolling_7d_revenue_mean", "lag_30d_roas"]
    a = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in from_csv.select(*cols).collect())
    b = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in from_tables.select(*cols).collect())
    assert a == b


def test_predictions_are_one_ordered_file(spark, tmp_path):
    import csv
    b = P.trained(spark, SF_SMALL, "linear")
    P.save_trained(b, str(tmp_path / "bundle"))
    sinks.write_features(b.features, str(tmp_path / "features"))
    out = str(tmp_path / "out" / "predictions.csv")
    for _ in range(2):                                       # the second run replaces the file
        got = P.predict_job(spark, str(tmp_path / "features"), str(tmp_path / "bundle"), out, draws="lcg")
    assert (tmp_path / "out" / "predictions.csv").is_file() and len(list((tmp_path / "out").glob("pred*"))) == 1
    want = P.forecast(b, draws="lcg")
    with open(out, newline="") as f:
        rows = list(csv.reader(f))
    assert rows[0] == want.columns
    keys = [want.columns.index(c) for c in ("forecast_period_days", "channel", "campaign_type", "budget_scenario")]
    assert [tuple(r[i] for i in keys) for r in rows[1:]] == [tuple(str(r[i]) for i in keys) for r in want.collect()]
    assert got.count() == len(rows) - 1


def test_a_bundle_becomes_visible_as_a_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "bundle")
    with pytest.raises(FileNotFoundError):
        sinks.current_version(spark, path)
    b = P.trained(spark, SF_SMALL, "linear")
    P.save_trained(b, path)
    first = sinks.current_version(spark, path)
    original, written = sinks.save_bundle, []

    def fail_at_the_third(folder, tables):
        for name, df in tables.items():
            if len(written) == 2:
                raise OSError("executor lost")
            original(folder, {name: df})
            written.append(name)

    monkeypatch.setattr(sinks, "save_bundle", fail_at_the_third)
    with pytest.raises(OSError):
        P.save_trained(b, path)
    monkeypatch.undo()
    assert len(written) == 2 and sinks.current_version(spark, path) == first
    assert P.load_trained(spark, path, b.features).summaries.count() == b.summaries.count()
    for _ in range(3):
        P.save_trained(b, path)
    versions = sinks._versions(spark, path)
    assert sinks.current_version(spark, path) == versions[-1][0] > first
    assert sum(done for _, done in versions) == sinks.KEPT_VERSIONS and first not in [f for f, _ in versions]


def test_anomalies_beyond_the_listed_ones(spark):
    import datetime as dt

    from adyield.operators import stats
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), "c", "t", 1.0, 1000.0 if i % 40 == 7 else 100.0 + i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "date date, channel string, campaign_type string, spend double, revenue double")
    r = stats.group_stats(df).first()
    every = sorted(x["date"] for x in stats.anomaly_table(stats.group_anomalies(df)).collect())
    assert r["anomalies"] == len(every) == 10
    assert [str(d) for d in r["anomaly_flags"]] == every[:stats.MAX_PROMPT_ANOMALIES]
