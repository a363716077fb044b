"""Property-based checks of the shared expressions against plain-Python models of the reference formulas."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adyield.functions.exprs import budget_ratio_feature, budget_ratio_forecast, safe_ratio
from adyield.operators.bootstrap import _quantile

# Signed zeros are normalised: the budget reaching these expressions is an A1 sum, and both pandas and
# Spark sums turn -0.0 into +0.0, so a literal -0.0 budget (numpy: x / -0.0 = -inf -> 0) never occurs.
finite = st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False).map(lambda x: x + 0.0)
maybe = st.one_of(st.none(), finite)


def ref_ratio(rev, spend):
    """np.where(spend > 0, rev / spend, 0) -> nan_to_num -> clip(0, 50), NaN for missing."""
    rev = math.nan if rev is None else rev
    spend = math.nan if spend is None else spend
    r = rev / spend if spend > 0 else 0.0
    r = 0.0 if math.isnan(r) or math.isinf(r) else r
    return min(max(r, 0.0), 50.0)


def ref_budget_feature(spend, budget):
    """clip(spend / budget, 0, 3), then inf -> 1 and NaN -> 1."""
    with np.errstate(all="ignore"):
        r = np.float64(math.nan if spend is None else spend) / np.float64(math.nan if budget is None else budget)
    r = np.clip(r, 0.0, 3.0)
    return 1.0 if (np.isnan(r) or np.isinf(r)) else float(r)


def ref_budget_forecast(new_spend, budget):
    b = math.nan if budget is None else budget
    r = (new_spend / b) if b > 0 else 1.0
    r = min(max(r, 0.0), 3.0)
    return 1.0 if math.isnan(r) else r


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(maybe, maybe), min_size=1, max_size=40))
def test_ratio_and_budget_expressions(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a double, b double")
    rows = df.select("i", safe_ratio("a", "b").alias("r"), budget_ratio_feature("a", "b").alias("f"),
                     budget_ratio_forecast(F.coalesce("a", F.lit(0.0)), "b").alias("g")).collect()
    for r in rows:
        a, b = pairs[r["i"]]
        assert r["r"] == ref_ratio(a, b)
        assert r["f"] == ref_budget_feature(a, b)
        assert r["g"] == ref_budget_forecast(0.0 if a is None else a, b)


@settings(max_examples=10, deadline=None)
@given(st.integers(min_value=0, max_value=2**32 - 1), st.sampled_from(["normal", "ties", "skewed"]))
def test_array_quantiles_match_numpy(spark, seed, shape):
    rng = np.random.RandomState(seed)
    raw = {"normal": rng.normal(0, 1e5, 1000), "ties": np.round(rng.normal(0, 3, 1000)),
           "skewed": rng.lognormal(8, 2, 1000)}[shape]
    values = [float(v) for v in raw]
    df = spark.createDataFrame([(values,)], "v array<double>")
    s = F.array_sort("v")
    got = df.select(*[_quantile(s, 1000, q).alias(str(q)) for q in (0.1, 0.5, 0.9)]).first()
    expected = np.percentile(np.array(values), [10, 50, 90])
    for q, e in zip((0.1, 0.5, 0.9), expected):
        assert got[str(q)] == e   # same order statistics, same interpolation form
