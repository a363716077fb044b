"""Brute-force check of the numpy-draw forecast path: a draw table per pool size, one matrix of scenario values per group.

Point predictions use the SQL stand-in predictor (least squares on spend; thin groups use the fit of all rows)
on both sides.
"""

import numpy as np
import pandas as pd
import pytest

from adyield.plans.pipeline import feature_table, forecast, trained

from .conftest import SF_SMALL

SCENARIO_GRID = pd.MultiIndex.from_product(
    [[30, 60, 90], ["minus_30pct", "minus_15pct", "base", "plus_15pct", "plus_30pct"]]).to_frame(index=False, name=["days", "name"])
SCENARIO_GRID["factor"] = SCENARIO_GRID["name"].map(
    {"minus_30pct": 0.7, "minus_15pct": 0.85, "base": 1.0, "plus_15pct": 1.15, "plus_30pct": 1.3})


def line(x, y):
    """(slope, intercept); a constant x has slope 0."""
    var = np.mean((x - x.mean()) ** 2)
    slope = np.mean((x - x.mean()) * (y - y.mean())) / var if var > 0 else 0.0
    return slope, y.mean() - slope * x.mean()


def expected(f: pd.DataFrame) -> pd.DataFrame:
    """One row per group and scenario with six quantiles and the spend."""
    draw = {}
    shared = {t: line(f["spend"], f[t]) for t in ("revenue", "roas")}
    shared_pool = {t: (f[t] - shared[t][0] * f["spend"] - shared[t][1]).to_numpy() for t in shared}
    newest, parts = f["date"].max(), []
    for key, rows in f.groupby(["channel", "campaign_type"]):
        recent = rows[rows["date"] > newest - pd.Timedelta(days=30)]
        trailing = recent if len(recent) else rows.nlargest(30, "date")
        daily = trailing["spend"].mean() * SCENARIO_GRID["factor"].to_numpy()
        days = SCENARIO_GRID["days"].to_numpy()
        out = SCENARIO_GRID.assign(channel=key[0], campaign_type=key[1], spend_input=daily * days)
        for t in shared:
            slope, base = line(rows["spend"], rows[t]) if len(rows) >= 60 else shared[t]
            pool = (rows[t] - slope * rows["spend"] - base).to_numpy() if len(rows) >= 30 else shared_pool[t]
            places = draw.setdefault(len(pool), np.random.RandomState(42).choice(len(pool), 1000))
            values = (base + slope * daily)[:, None] + pool[places][None, :]
            values = np.maximum(values * days[:, None], 0) if t == "revenue" else np.clip(values, 0, 50)
            out[[f"{t}_p10", f"{t}_p50", f"{t}_p90"]] = np.quantile(values, [0.1, 0.5, 0.9], axis=1).T
        parts.append(out)
    return pd.concat(parts)


def test_numpy_path_matches_brute_force(spark):
    f = feature_table(spark, SF_SMALL).select("date", "channel", "campaign_type", "spend", "revenue", "roas").toPandas()
    f = f.assign(date=pd.to_datetime(f["date"])).sort_values(["channel", "campaign_type", "date"]).reset_index(drop=True)
    want = expected(f)
    got = forecast(trained(spark, SF_SMALL, "linear"), draws="numpy").toPandas()
    both = want.merge(got, left_on=["days", "channel", "campaign_type", "name"],
                      right_on=["forecast_period_days", "channel", "campaign_type", "budget_scenario"], suffixes=("", "_got"))
    assert len(both) == len(want) == len(got) - 15
    for c in ["spend_input", *[f"{t}_{q}" for t in ("revenue", "roas") for q in ("p10", "p50", "p90")]]:
        # two least-squares solvers: allow their last digits
        assert both[f"{c}_got"].to_numpy() == pytest.approx(both[c].to_numpy(), rel=1e-9, abs=1e-6)
