"""CSV directory round trip (S1-S4): dialects, index column, bad dates, decoy, name-only file."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from adyield.operators.normalize import unify
from adyield.sources import csv as csvsrc


def _write(tmp_path):
    google = pd.DataFrame({
        "campaign_id": [1, 2, 3], "campaign_name": ["g1", None, "g3"],
        "campaign_advertising_channel_type": ["SEARCH", None, "VIDEO"], "campaign_budget_amount": [10.0, None, 30.0],
        "segments_date": ["2024-01-01", "bad", "2024-01-02"], "metrics_cost_micros": [1_000_000, 2_500_000, None],
        "metrics_clicks": [1, 2, 3], "metrics_impressions": [10, 20, 30], "metrics_video_views": [0, 0, 0],
        "metrics_conversions": [1.0, 2.0, 3.0], "metrics_conversions_value": [10.0, 20.0, 30.0]})
    google.iloc[:2].to_csv(tmp_path / "export_a.csv")
    google.iloc[2:].to_csv(tmp_path / "export_b.csv")
    bing = pd.DataFrame({"CampaignId": [5], "CampaignName": ["b"], "CampaignType": [None], "TimePeriod": ["2024-01-01"],
                         "Spend": [2.0], "Revenue": [8.0], "Clicks": [1], "Impressions": [2], "Conversions": [1.0],
                         "DailyBudget": [None]})
    bing.to_csv(tmp_path / "bing_report.csv")
    meta = pd.DataFrame({"campaign_id": [7, 8], "campaign_name": ["Generic_x", "Other_y"],
                         "date_start": ["2024-01-01", "2024-01-03"], "spend": [1.0, 0.0], "conversion": [100.0, 5.0],
                         "clicks": [1.9, 2.0], "impressions": [5.0, 6.0], "daily_budget": [4.0, None], "cpm": [1, 1]})
    meta.to_csv(tmp_path / "facebook_ads.csv")   # no cpc column: known only by its name
    pd.DataFrame({"note": ["x"]}).to_csv(tmp_path / "notes.csv")   # decoy, ignored


def test_directory_round_trip(spark, tmp_path):
    _write(tmp_path)
    kinds = [k for *_, k in csvsrc.detected(spark, csvsrc.csv_files(spark, str(tmp_path)))]
    assert sorted(map(str, kinds)) == ["None", "bing", "google", "google", "meta"]
    raws = csvsrc.load_directory(spark, str(tmp_path))
    assert "_c0" not in raws["google"].columns
    canon = unify(raws)
    rows = {(r["channel"], r["campaign_id"]): r for r in canon.collect()}
    assert set(rows) == {("google", "1"), ("google", "3"), ("bing", "5"), ("meta", "7"), ("meta", "8")}
    assert rows[("google", "3")]["spend"] is None            # T8: google spend stays NULL
    assert rows[("google", "1")]["spend"] == 1.0
    assert rows[("bing", "5")]["campaign_type"] == "Search" and rows[("bing", "5")]["daily_budget"] == 0.0
    assert rows[("meta", "7")]["campaign_type"] == "Generic" and rows[("meta", "8")]["campaign_type"] == "Unknown"
    assert rows[("meta", "7")]["clicks"] == 1 and rows[("meta", "7")]["conversions"] == 1.0
    assert rows[("meta", "8")]["daily_budget"] == 4.0        # median of the filled column
    last = csvsrc.load_directory(spark, str(tmp_path), duplicates="last")
    assert last["google"].count() == 1


def test_missing_dialect_raises(spark, tmp_path):
    _write(tmp_path)
    (tmp_path / "bing_report.csv").unlink()
    with pytest.raises(FileNotFoundError):
        csvsrc.load_directory(spark, str(tmp_path))


def test_upper_case_extension_only_when_no_lower(spark, tmp_path):
    pd.DataFrame({"a": [1]}).to_csv(tmp_path / "X.CSV")
    assert [p.rsplit("/", 1)[-1] for p in csvsrc.csv_files(spark, str(tmp_path))] == ["X.CSV"]
    pd.DataFrame({"a": [1]}).to_csv(tmp_path / "y.csv")
    assert [p.rsplit("/", 1)[-1] for p in csvsrc.csv_files(spark, str(tmp_path))] == ["y.csv"]


HEAD = "campaign_id,campaign_name,campaign_advertising_channel_type,campaign_budget_amount,segments_date,metrics_cost_micros,metrics_clicks,metrics_impressions,metrics_conversions,metrics_conversions_value"


def test_every_file_is_read_under_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("," + HEAD + '\n0,1,plain,SEARCH,5,2024-01-01,1000000,1,2,3,4\n')
    (tmp_path / "b.csv").write_text(HEAD + '\n2,"Brand ""X"", US",NA,N/A,2024-01-02,2000000,1,2,3,null\n')
    order = HEAD.split(",")[::-1]
    (tmp_path / "c.csv").write_text(",".join(order) + '\n9,8,7,6,3000000,2024-01-03,5,"",turned,3\n')
    short = [c for c in HEAD.split(",") if c != "campaign_budget_amount"]
    (tmp_path / "d.csv").write_text(",".join(short) + '\n4,"two\nlines",VIDEO,2024-01-04,4000000,1,2,3,4\n')
    paths = csvsrc.csv_files(spark, str(tmp_path))
    raw = csvsrc.read_groups(spark, [f[:3] for f in csvsrc.detected(spark, paths)], multi_line=True)
    got = {r["campaign_id"]: r for r in raw.collect()}
    assert set(got) == {"1", "2", "3", "4"}
    assert (got["1"]["campaign_name"], got["1"]["segments_date"], got["1"]["metrics_conversions_value"]) == ("plain", "2024-01-01", "4")
    assert got["2"]["campaign_name"] == 'Brand "X", US' and got["2"]["segments_date"] == "2024-01-02"
    assert got["2"]["campaign_advertising_channel_type"] is None and got["2"]["campaign_budget_amount"] is None
    assert got["2"]["metrics_conversions_value"] is None
    assert (got["3"]["campaign_name"], got["3"]["metrics_cost_micros"], got["3"]["campaign_advertising_channel_type"]) == ("turned", "3000000", None)
    assert got["4"]["campaign_name"] == "two\nlines" and got["4"]["campaign_budget_amount"] is None


def test_folder_of_part_files_counts_as_a_file(spark, tmp_path):
    from adyield.sources import sinks
    df = spark.range(100).selectExpr("cast(id as string) as campaign_id", "'x' as TimePeriod", "'y' as CampaignType").repartition(4)
    sinks.export_csv(df, str(tmp_path / "Export.csv"))
    assert csvsrc.load_by_pattern(spark, str(tmp_path), "Ex*.csv").count() == 100
    assert {k for *_, k in csvsrc.detected(spark, csvsrc.part_files(spark, str(tmp_path / "Export.csv")))} == {"bing"}


ROW = ["7", "name", "SEARCH", "5", "2024-01-06", "2000000", "1", "2", "3", "7"]


def _google_files(tmp_path, files):
    """Google exports by name beside one good file each of the other dialects."""
    for name, lines in files.items():
        (tmp_path / f"{name}.csv").write_text("\n".join([HEAD, *[",".join(x) for x in lines]]) + "\n")
    (tmp_path / "bing.csv").write_text("TimePeriod,CampaignType,Spend\n2024-01-01,a,1\n")
    (tmp_path / "meta.csv").write_text("date_start,cpc,cpm,conversion,spend\n2024-01-01,1,1,5,1\n")
    return str(tmp_path)


def test_a_file_with_a_wider_row_is_skipped_as_a_whole(spark, tmp_path, capfd):
    from adyield.operators.normalize import ingest
    wide = ROW[:1] + ["b", " c"] + ROW[2:]                       # an unquoted comma in the name
    d = _google_files(tmp_path, {"good": [ROW], "bad": [ROW, wide, ROW], "short": [ROW, ROW[:6]], "quoted": [ROW, [*ROW[:1], '"b, c"', *ROW[2:]]]})
    raws = csvsrc.load_directory(spark, d)
    rows = raws["google"].collect()
    assert len(rows) == 5 and {r["campaign_name"] for r in rows} == {"name", "b, c"}
    assert [r["metrics_conversions_value"] for r in rows].count(None) == 1
    assert csvsrc.ROW_FILE not in raws["google"].columns and "bad.csv" in capfd.readouterr().err
    for exact in (True, False):
        found = ingest(csvsrc.load_directory(spark, d, check_rows=False), exact)
        files = {r["file"].rsplit("/", 1)[-1]: (r["rows"], r["long_rows"], r["short_rows"], r["skipped"]) for r in found.files.collect()}
        assert files == {"good.csv": (1, 0, 0, False), "bad.csv": (3, 1, 0, True), "short.csv": (2, 0, 1, False),
                         "quoted.csv": (2, 0, 0, False), "bing.csv": (1, 0, 0, False), "meta.csv": (1, 0, 0, False)}
        daily = {r["channel"]: r for r in found.daily.collect()}
        assert daily["google"]["revenue"] == 28.0 and daily["google"]["spend"] == 10.0 and daily["google"]["daily_budget"] == 25.0
        assert {r["channel"]: r["rows_read"] for r in found.report.collect()} == {"google": 5, "bing": 1, "meta": 1}


def test_no_readable_file_of_a_dialect_raises(spark, tmp_path):
    from adyield.operators.normalize import ingest
    d = _google_files(tmp_path, {"bad": [ROW, [*ROW, "1"]]})
    with pytest.raises(FileNotFoundError):
        csvsrc.load_directory(spark, d)
    with pytest.raises(FileNotFoundError):
        ingest(csvsrc.load_directory(spark, d, check_rows=False))
    with pytest.raises(ValueError):
        csvsrc.load_by_pattern(spark, d, "bad*.csv")


def test_the_last_readable_file_is_kept(spark, tmp_path):
    d = _google_files(tmp_path, {"a": [ROW], "b": [["9", *ROW[1:]]], "c": [ROW, [*ROW, "1"]]})
    assert [r["campaign_id"] for r in csvsrc.load_directory(spark, d, duplicates="last")["google"].collect()] == ["9"]


def test_fields_before_the_first_name_are_an_index(spark, tmp_path):
    d = _google_files(tmp_path, {"index": [["0", "x", *ROW], ["1", "y", *ROW], ["2", "z", *ROW[:5]]]})
    rows = csvsrc.load_directory(spark, d)["google"].collect()
    assert [r["campaign_id"] for r in rows] == ["7"] * 3 and [r["segments_date"] for r in rows] == ["2024-01-06"] * 3
    assert rows[2]["metrics_cost_micros"] is None and len(rows[0]) == len(ROW)


def test_long_headers_and_repeated_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(csvsrc, "HEADER_BYTES", 16)
    (tmp_path / "a.csv").write_text("a,b,A,,b\n1,2,3,4,5\n" + "6,7\n" * 50)
    (path, line, lead, _), = csvsrc.detected(spark, [str(tmp_path / "a.csv")])
    df = csvsrc.read_groups(spark, [(path, line, lead)])
    assert (line, lead) == ("a,b,A,,b", 0) and df.columns[:5] == ["a", "b", "A.1", "Unnamed: 3", "b.1"]
    assert tuple(df.first())[:5] == ("1", "2", "3", "4", "5") and df.count() == 51
