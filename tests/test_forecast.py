
import pytest
from pyspark.sql import functions as F

from adyield.operators.bootstrap import draws, pool_choice, pool_sizes
from adyield.operators import gbt
from adyield.operators.forecast import predictions, with_rollup
from adyield.operators.gbt import BoostParams
from adyield.operators.models import GLOBAL_POOL, fit_boosted
from adyield.plans.pipeline import feature_table, forecast, trained

from .conftest import SF_SMALL


def test_pool_edges(spark):
    res = ([("c__p29", "revenue", i, 1.0) for i in range(29)] + [("c__p30", "revenue", i, 1.0) for i in range(30)]
           + [(GLOBAL_POOL, "revenue", i, 1.0) for i in range(100)])
    sizes = pool_sizes(spark.createDataFrame(res, "pool string, target string, pool_idx long, residual double"))
    rows = spark.createDataFrame([("c", "p29", "revenue"), ("c", "p30", "revenue"), ("c", "none", "revenue")],
                                 "channel string, campaign_type string, target string")
    got = {r["campaign_type"]: (r["pool"], r["pool_n"]) for r in pool_choice(rows, sizes).collect()}
    assert got == {"p29": (GLOBAL_POOL, 100), "p30": ("c__p30", 30), "none": (GLOBAL_POOL, 100)}


def test_rollup_edges(spark):
    rows = [(30, "base", "c", "a", 0.0, 10.0, 20.0, 30.0), (30, "base", "c", "b", 0.0, 1.0, 2.0, 3.0),
            (60, "base", "c", "a", 1.0, 100.0, 200.0, 300.0)]
    df = spark.createDataFrame(rows, "forecast_period_days long, budget_scenario string, channel string, "
                                     "campaign_type string, spend_input double, revenue_p10 double, "
                                     "revenue_p50 double, revenue_p90 double")
    df = df.withColumns({f"roas_{q}": F.lit(7.0) for q in ("p10", "p50", "p90")})
    every = with_rollup(df).collect()
    assert len(every) == 5 and all(r["roas_p50"] == 7.0 for r in every if r["channel"] == "c")
    got = {r["forecast_period_days"]: r for r in every if r["channel"] == "all"}
    assert (got[30]["spend_input"], got[30]["revenue_p50"], got[30]["roas_p50"]) == (0.0, 22.0, 0.0)
    assert (got[60]["roas_p10"], got[60]["roas_p50"], got[60]["roas_p90"]) == (50.0, 50.0, 50.0)
    assert got[30]["channel"] == "all" and got[30]["campaign_type"] == "all"


def test_lcg_draws(spark):
    sizes = spark.createDataFrame([(7,)], "n long")
    d = {r["k"]: r["idx"] for r in draws(sizes, "lcg").collect()}
    assert len(d) == 1000 and d[0] == 12345 % 7 and d[1] == (1103515245 + 12345) % 2147483648 % 7


def test_numpy_draws_match_reference_stream(spark):
    import numpy as np
    sizes = spark.createDataFrame([(31,), (500,)], "n long")
    got = {}
    for r in draws(sizes, "numpy").collect():
        got.setdefault(r["n"], {})[r["k"]] = r["idx"]
    for n in (31, 500):
        np.random.seed(42)
        expected = np.random.choice(np.arange(n), size=1000, replace=True)
        assert [got[n][k] for k in range(1000)] == expected.tolist()


@pytest.fixture(scope="module")
def linear_predictions(spark):
    return forecast(trained(spark, SF_SMALL, "linear"), draws="numpy").collect()


def test_prediction_invariants(spark, linear_predictions):
    rows = linear_predictions
    groups = feature_table(spark, SF_SMALL).select("channel", "campaign_type").distinct().count()
    assert len(rows) == 15 * groups + 15
    for r in rows:
        assert r["revenue_p10"] <= r["revenue_p50"] <= r["revenue_p90"]
        assert r["roas_p10"] <= r["roas_p50"] <= r["roas_p90"]
        assert r["revenue_p10"] >= 0 and 0 <= r["roas_p10"] and r["roas_p90"] <= 50
        assert r["causal_summary"]
    for h in (30, 60, 90):
        for s in ("minus_30pct", "base", "plus_30pct"):
            part = [r for r in rows if r["forecast_period_days"] == h and r["budget_scenario"] == s]
            total = [r for r in part if r["channel"] == "all"][0]
            groups_part = [r for r in part if r["channel"] != "all"]
            assert total["revenue_p50"] == pytest.approx(sum(r["revenue_p50"] for r in groups_part))
            assert total["spend_input"] == pytest.approx(sum(r["spend_input"] for r in groups_part))


def test_sorted_with_all_first(linear_predictions):
    keys = [(r["forecast_period_days"], r["channel"], r["campaign_type"], r["budget_scenario"])
            for r in linear_predictions]
    assert keys == sorted(keys)
    assert keys[0][1] == "all"


def test_residual_rows_per_group(spark):
    b = trained(spark, SF_SMALL, "linear")
    sizes = {(r["pool"], r["target"]): r["n"] for r in pool_sizes(b.models.residuals).collect()}
    rows = {f"{r['channel']}__{r['campaign_type']}": r["count"]
            for r in b.features.groupBy("channel", "campaign_type").count().collect()}
    for g, n in rows.items():
        assert sizes[(g, "revenue")] == n and sizes[(g, "roas")] == n
    assert sizes[(GLOBAL_POOL, "revenue")] == sum(rows.values())


def test_same_seed_same_output_and_partition_independence(spark, linear_predictions):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = forecast(trained(spark, SF_SMALL, "linear"), draws="numpy").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    key = lambda r: (r["forecast_period_days"], r["channel"], r["campaign_type"], r["budget_scenario"])
    a = {key(r): r for r in linear_predictions}
    b = {key(r): r for r in again}
    assert a.keys() == b.keys()
    for k in a:
        for c in ("revenue_p10", "revenue_p50", "revenue_p90", "roas_p50"):
            assert a[k][c] == pytest.approx(b[k][c], rel=1e-9)


def test_boosted_models_small(spark):
    """Boosted path end to end with few trees (the default is 200; lowered here for test time only)."""
    f = feature_table(spark, SF_SMALL)
    from adyield.operators.features import feature_columns
    cols = feature_columns(f)
    models = fit_boosted(f, cols, BoostParams(n_estimators=5))
    kinds = {r["dedicated"] for r in models.group_models.collect()}
    assert kinds == {True, False}
    rows = predictions(f, cols, models, None, "numpy").collect()
    groups = f.select("channel", "campaign_type").distinct().count()
    assert len(rows) == 15 * groups + 15
    assert all(r["revenue_p10"] <= r["revenue_p50"] <= r["revenue_p90"] for r in rows)


def _brute_split(x, r, leaf):
    """Least squared error over every feature and every cut between distinct values, features and cuts in order."""
    import numpy as np
    best = (((r - r.mean()) ** 2).sum() - 1e-9, None)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for low, high in zip(values, values[1:]):
            left = x[:, j] <= low
            if leaf <= left.sum() <= len(r) - leaf:
                error = ((r[left] - r[left].mean()) ** 2).sum() + ((r[~left] - r[~left].mean()) ** 2).sum()
                if error < best[0] - 1e-9:
                    best = (error, (j, low, high))
    return best[1]


def test_splits_are_exact_at_any_number_of_values():
    """Few and very many distinct values take the same search: no bins."""
    import numpy as np
    rng = np.random.default_rng(1)
    for n, distinct in ((40, 5), (300, 10_000), (600, 10_000)):
        x = rng.integers(0, distinct, (n, 3)).astype(float)
        r = np.round(x[:, 1] / distinct + rng.normal(0, 0.3, n), 6)
        want, got = _brute_split(x, r, 5), gbt.best_split(x, r, 5)
        assert got[0] == want[0] and want[1] <= got[1] < want[2]


def test_boosting_fits_and_fills():
    import numpy as np
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(500, 3))
    y = np.where(x[:, 0] > 0.5, 10.0, 2.0) + x[:, 1]
    x[::17, 2] = np.nan
    model = gbt.fit(x, y)
    left = y - gbt.predict(model, x)
    assert (left ** 2).mean() < 0.05 * y.var() and abs(left.mean()) < 0.05 * y.std()
    assert gbt.predict(gbt.fit(x[:1], y[:1]), x[:3]).tolist() == [y[0]] * 3


def test_fitted_models_do_not_follow_the_input_partitions(spark):
    f = feature_table(spark, SF_SMALL)
    from adyield.operators.features import feature_columns
    cols, out = feature_columns(f), []
    for parts in (1, 8):
        m = fit_boosted(f.repartition(parts), cols, BoostParams(n_estimators=4))
        out.append({(r["pool"], r["target"], r["pool_idx"]): r["residual"] for r in m.residuals.collect()})
    assert out[0].keys() == out[1].keys()
    assert all(out[0][k] == pytest.approx(out[1][k], rel=1e-9, abs=1e-9) for k in out[0])


def test_pool_keys_of_awkward_names_differ(spark):
    from adyield.operators.models import pool_key
    pairs = [("a", "b"), ("a__b", "c"), ("a", "b__c"), ("a_", "b"), ("a", "_b"), ("a", "b_"), ("_a", "b")]
    keys = [r[0] for r in spark.createDataFrame(pairs, "channel string, campaign_type string").select(pool_key()).collect()]
    assert len(set(keys)) == len(pairs) and keys[0] == "a__b"


def test_medians_are_narrowed_to_the_exact_middle(spark):
    """Brackets of few values, heavy ties on either side of the middle, missing values and NaN."""
    import random
    import statistics

    from adyield.operators.models import median_surrogates
    rng = random.Random(5)
    n = 3000
    columns = {"even": [rng.gauss(0, 9) for _ in range(n)], "odd": [rng.random() for _ in range(n - 1)] + [None],
               "halves": [0.0, 1.0] * (n // 2), "ones": [1.0] * (n - 40) + [2.0] * 40, "edge": [0.0] * (n // 2) + [rng.random() + 1 for _ in range(n // 2)],
               "edge2": [5.0] * (n // 2) + [-rng.random() for _ in range(n // 2)], "nan": [float("nan")] * 7 + [rng.randint(0, 5) * 1.0 for _ in range(n - 7)],
               "null": [None] * n, "one": [None] * (n - 1) + [4.5], "skew": [10.0 ** rng.randint(0, 300) for _ in range(n)], "a.b": [1.0 * i for i in range(n)]}
    df = spark.createDataFrame([tuple(c[i] for c in columns.values()) for i in range(n)], ", ".join(f"`{c}` double" for c in columns))
    want = {}
    for c, values in columns.items():
        present = [v for v in values if v is not None and v == v]
        want[c] = statistics.median(present) if present else 0.0
    for most in (10, 150, 10_000):
        got = {r["feature"]: r["median"] for r in median_surrogates(df.repartition(5), list(columns), most).collect()}
        assert got == pytest.approx(want, rel=1e-15)
    assert median_surrogates(df.limit(0), ["even"]).first()["median"] == 0.0


def test_partitions_of_the_fallback_follow_the_table(spark, monkeypatch):
    """The same model whatever the cluster: its partitions come from the rows, not from the session."""
    from adyield.operators import models
    from adyield.operators.features import feature_columns
    from adyield.operators.gbt import BoostParams
    f = feature_table(spark, SF_SMALL)
    cols, got = feature_columns(f), []
    for before, shuffles in ((1, "3"), (7, "11")):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        try:
            fitted = models.fit_boosted(f.repartition(before), cols, BoostParams(n_estimators=3, partition_rows=2_000))
            got.append({t: fitted.fallback[t].stages[0].toDebugString.split("\n", 1)[1] for t in models.TARGETS})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got[0] == got[1]
