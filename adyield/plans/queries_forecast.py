"""Registered queries: scenario frame, models, residual pools, bootstrap, predictions, what-if.

Most queries use the SQL-expressible stand-in predictor (per-group regression
on spend) and linear-congruential draws. The default path (boosted trees, the
reference's draw stream) runs in ``m1``, ``m4``, ``m9_..._numpy`` and
``m11_..._boosted``; their oracles state what any such fit must satisfy.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as feats
from ..operators import forecast as fc
from ..operators import scenarios as sc
from ..operators.bootstrap import draws, pool_choice, pool_sizes
from ..operators.aggregate import daily_aggregate
from ..operators.models import GLOBAL_POOL, TARGETS, median_surrogates, pool_key
from ..operators.stats import insight_texts
from ..session import cut_lineage
from ..sources import sinks
from ..sources.fixtures import events_canonical
from . import oracle as O
from .pipeline import feature_table, forecast, simulate, train, trained
from .registry import register

WHAT_IF_MULTIPLIERS = {"google": 1.2, "meta": 0.8}
IV_DIG = {"revenue_p10": 2, "revenue_p50": 2, "revenue_p90": 2, "roas_p10": 4, "roas_p50": 4, "roas_p90": 4}
PRED_DIG = {**IV_DIG, "spend_input": 2}
FRAME_DIG = {"new_spend": 2, "spend_input": 2, "multiplier": 4}


def _feat(spark, sf):
    return feature_table(spark, sf)


def _lin(spark, sf):
    return trained(spark, sf, "linear")


def _boosted(spark, sf):
    return trained(spark, sf, "boosted")


def _frame(spark, sf):
    b = _lin(spark, sf)
    return sc.scenario_frame(b.features, b.feature_cols)


def _pred(spark, sf):
    return forecast(_lin(spark, sf), draws="lcg", sort=False)


def _cols(names):
    return ", ".join(names)


# ----------------------------------------------------------------------------- filters and projections

@register("p12_trailing_window", O.q("""
SELECT channel, campaign_type, count(*) AS rows_used, min(date) AS first_date, max(date) AS last_date,
       any_value(trailing_branch) AS trailing_branch FROM trail GROUP BY channel, campaign_type""", "trail"))
def p12_trailing_window(spark, sf):
    t = sc.trailing_rows(_feat(spark, sf))
    return t.groupBy("channel", "campaign_type").agg(
        F.count(F.lit(1)).alias("rows_used"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.first("trailing_branch").alias("trailing_branch"))


_VIEW = "SELECT * FROM predictions WHERE forecast_period_days = 60 AND channel IN ('google', 'bing', 'meta') AND budget_scenario = 'base'"


@register("p13_report_filter", O.rounded(_VIEW, PRED_DIG, "predictions"), PRED_DIG)
def p13_report_filter(spark, sf):
    return fc.report_filter(_pred(spark, sf))


_EB_DIG = {"revenue_p50": 2, "revenue_err_plus": 2, "revenue_err_minus": 2, "roas_p50": 4, "roas_err_plus": 4,
           "roas_err_minus": 4}


@register("p14_error_bars", O.rounded(f"""
SELECT upper(channel) || ' - ' || campaign_type AS label, channel, campaign_type, revenue_p50,
       revenue_p90 - revenue_p50 AS revenue_err_plus, revenue_p50 - revenue_p10 AS revenue_err_minus,
       roas_p50, roas_p90 - roas_p50 AS roas_err_plus, roas_p50 - roas_p10 AS roas_err_minus
FROM ({_VIEW}) AS v""", _EB_DIG, "predictions"), _EB_DIG)
def p14_error_bars(spark, sf):
    return fc.error_bars(fc.report_filter(_pred(spark, sf)))


_P15_BASE = " UNION ALL ".join(
    f"SELECT channel, campaign_type, '{c}' AS feature, CAST(avg({c}) AS DOUBLE) AS value FROM trail "
    f"GROUP BY channel, campaign_type" for c in feats.BASE_FEATURE_COLUMNS)


@register("p15_align_columns", O.rounded(f"""
{_P15_BASE}
UNION ALL
SELECT g.channel, g.campaign_type, {O.type_column('t.campaign_type')} AS feature,
       CASE WHEN g.campaign_type = t.campaign_type THEN 1.0 ELSE 0.0 END AS value
FROM (SELECT DISTINCT channel, campaign_type FROM trail) AS g CROSS JOIN (SELECT DISTINCT campaign_type FROM feat) AS t
UNION ALL
SELECT DISTINCT channel, campaign_type, 'campaign_type_NOT_IN_DATA' AS feature, 0.0 AS value FROM trail""",
                                        {"value": 2}, "trail", "feat"))
def p15_align_columns(spark, sf):
    """Base rows over the stored training columns plus one absent column, which reads 0 (long form)."""
    b = _lin(spark, sf)
    cols = b.feature_cols + [feats.TYPE_PREFIX + "NOT_IN_DATA"]
    wide = sc.base_rows(b.features, cols)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value"))
                                for c in cols])).alias("_kv")
    return wide.select("channel", "campaign_type", pairs).select("channel", "campaign_type", "_kv.feature", "_kv.value")


_REPORT = ["forecast_period_days", "channel", "campaign_type", "spend_input", "revenue_p10", "revenue_p50",
           "revenue_p90", "roas_p10", "roas_p50", "roas_p90"]


@register("p16_report_projection", O.rounded(f"SELECT {_cols(_REPORT)} FROM ({_VIEW}) AS v", PRED_DIG, "predictions"),
          PRED_DIG)
def p16_report_projection(spark, sf):
    return fc.report_table(fc.report_filter(_pred(spark, sf)))


# ----------------------------------------------------------------------------- joins

@register("j1_residual_pool_lookup", O.q("""
SELECT b.channel, b.campaign_type, t.target,
       CASE WHEN coalesce(pn.n, 0) >= 30 THEN b.channel || '__' || b.campaign_type ELSE '__global__' END AS pool,
       CASE WHEN coalesce(pn.n, 0) >= 30 THEN pn.n ELSE g.n END AS pool_n
FROM base AS b CROSS JOIN targets AS t
LEFT JOIN pool_n AS pn ON pn.pool = b.channel || '__' || b.campaign_type AND pn.target = t.target
JOIN pool_n AS g ON g.pool = '__global__' AND g.target = t.target""", "base", "targets", "pool_n"))
def j1_residual_pool_lookup(spark, sf):
    b = _lin(spark, sf)
    groups = sc.base_rows(b.features, []).select("channel", "campaign_type")
    rows = groups.crossJoin(F.broadcast(spark.createDataFrame([(t,) for t in TARGETS], "target string")))
    return pool_choice(rows, pool_sizes(b.models.residuals)).select("channel", "campaign_type", "target", "pool", "pool_n")


@register("j2_model_lookup", O.q("""
SELECT channel, campaign_type, CASE WHEN dedicated THEN 'dedicated' ELSE 'fallback' END AS model FROM lin_model""",
                                "lin_model"))
def j2_model_lookup(spark, sf):
    g = _lin(spark, sf).models.group_models
    return g.select("channel", "campaign_type",
                    F.when(F.col("dedicated"), F.lit("dedicated")).otherwise(F.lit("fallback")).alias("model"))


@register("j3_summary_lookup", O.q("""
SELECT DISTINCT channel, forecast_period_days, causal_summary FROM predictions""", "predictions"))
def j3_summary_lookup(spark, sf):
    return _pred(spark, sf).select("channel", "forecast_period_days", "causal_summary").distinct()


@register("j3_insight_defaults", O.q("""
SELECT e.scope, CASE WHEN e.scope = 'bing' THEN 'Bing summary not available in cache.' ELSE s.summary END AS summary
FROM (VALUES ('all'), ('google'), ('meta'), ('bing')) AS e(scope) JOIN summ AS s ON s.scope = e.scope AND s.horizon = 60""", "summ"))
def j3_insight_defaults(spark, sf):
    """Texts of the insight page when one channel has no summary."""
    return insight_texts(_lin(spark, sf).summaries.where(F.col("scope") != "bing"))


@register("j4_scenario_expansion", O.rounded("""
SELECT channel, campaign_type, forecast_period_days, budget_scenario, multiplier, new_spend, spend_input FROM frame""",
                                            FRAME_DIG, "frame"), FRAME_DIG)
def j4_scenario_expansion(spark, sf):
    return _frame(spark, sf).select("channel", "campaign_type", "forecast_period_days", "budget_scenario",
                                    "multiplier", "new_spend", "spend_input")


@register("j5_scalar_broadcast", O.q("SELECT anchor_date, min_date FROM anchor", "anchor"))
def j5_scalar_broadcast(spark, sf):
    return sc.anchors(_feat(spark, sf))


@register("j6_nearest_multiplier", O.q("SELECT channel, points, m0 AS base_multiplier, m1 AS high_multiplier FROM near", "near"),
          {"base_multiplier": 4, "high_multiplier": 4})
def j6_nearest_multiplier(spark, sf):
    n = fc.nearest_points(fc.yield_curve(_feat(spark, sf), _lin(spark, sf).feature_cols, _lin(spark, sf).models, draws="lcg"))
    return n.select("channel", "points", F.col("near_0.multiplier").alias("base_multiplier"),
                    F.col("near_1.multiplier").alias("high_multiplier"))


@register("j8_yield_grid", O.rounded("""
SELECT channel, campaign_type, budget_scenario, multiplier, spend_input FROM yc_frame""",
                                    {"spend_input": 2, "multiplier": 4}, "yc_frame"))
def j8_yield_grid(spark, sf):
    b = _lin(spark, sf)
    return sc.yield_frame(b.features, b.feature_cols).select("channel", "campaign_type", "budget_scenario",
                                                             "multiplier", "spend_input")


@register("j9_channel_multiplier", O.rounded("""
SELECT channel, campaign_type, multiplier, spend_input FROM wi_frame""", {"spend_input": 2, "multiplier": 4}, "wi_frame"))
def j9_channel_multiplier(spark, sf):
    b = _lin(spark, sf)
    m = sc.channel_multipliers(spark, WHAT_IF_MULTIPLIERS)
    return sc.what_if_frame(b.features, b.feature_cols, m).select("channel", "campaign_type", "multiplier", "spend_input")


# ----------------------------------------------------------------------------- aggregations

_A5_COLS = [c for c in feats.BASE_FEATURE_COLUMNS]
_A5_DIG = {c: 2 for c in _A5_COLS + ["base_spend", "base_daily_budget"]}


@register("a5_base_feature_row", O.rounded(f"""
SELECT channel, campaign_type, avg(spend) AS base_spend, avg(daily_budget) AS base_daily_budget,
       count(*) AS trailing_rows, {_cols(f'CAST(avg({c}) AS DOUBLE) AS {c}' for c in _A5_COLS)}
FROM trail GROUP BY channel, campaign_type""", _A5_DIG, "trail"), _A5_DIG)
def a5_base_feature_row(spark, sf):
    return sc.base_rows(_feat(spark, sf), _A5_COLS)


_ROLL_DIG = dict(PRED_DIG)


@register("a6_prediction_rollup", O.rounded("SELECT * FROM rollup_rows", _ROLL_DIG, "rollup_rows"), _ROLL_DIG)
def a6_prediction_rollup(spark, sf):
    """The portfolio rows of the grouping-sets aggregate that production uses."""
    b = _lin(spark, sf)
    rows = fc.scored_intervals(sc.scenario_frame(b.features, b.feature_cols), b.models, "lcg")
    return fc.with_rollup(rows, b.summaries).where(F.col("channel") == "all")


_TOT_DIG = {"total_spend": 2, "total_revenue_p10": 2, "total_revenue_p50": 2, "total_revenue_p90": 2, "total_roas": 4}


@register("a11_what_if_totals", O.rounded("""
SELECT sum(spend_input) AS total_spend, sum(revenue_p10) AS total_revenue_p10, sum(revenue_p50) AS total_revenue_p50,
       sum(revenue_p90) AS total_revenue_p90,
       CASE WHEN sum(spend_input) > 0 THEN sum(revenue_p50) / sum(spend_input) ELSE 0.0 END AS total_roas FROM wi""",
                                         _TOT_DIG, "wi"), _TOT_DIG)
def a11_what_if_totals(spark, sf):
    return fc.what_if_totals(simulate(_lin(spark, sf), WHAT_IF_MULTIPLIERS, draws="lcg"))


_CURVE_DIG = {"spend": 2, "revenue_p50": 2, "multiplier": 4}


@register("a13_yield_curve", O.rounded("SELECT * FROM curve", _CURVE_DIG, "curve"), _CURVE_DIG)
def a13_yield_curve(spark, sf):
    b = _lin(spark, sf)
    return fc.yield_curve(b.features, b.feature_cols, b.models, draws="lcg")


_IV = ["channel", "campaign_type", "forecast_period_days", "budget_scenario", "revenue_p10", "revenue_p50",
       "revenue_p90", "roas_p10", "roas_p50", "roas_p90"]


@register("a14_percentiles", O.rounded(f"SELECT {_cols(_IV)} FROM grp_pred", IV_DIG, "grp_pred"))
def a14_percentiles(spark, sf):
    b = _lin(spark, sf)
    return fc.scored_intervals(sc.scenario_frame(b.features, b.feature_cols), b.models, "lcg").select(*_IV)


# ----------------------------------------------------------------------------- models, pools, draws

def fit_quality(residuals, features, keys):
    """Per key and target: rows, and whether the fit is unbiased (mean residual within 5 % of the target's
    standard deviation) and no worse than the mean (squared error)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("y")) for t in TARGETS])).alias("_p")
    truth = features.select(*keys, pairs).select(*keys, "_p.target", "_p.y").groupBy(*keys, "target").agg(
        F.count(F.lit(1)).alias("rows"), F.var_pop("y").alias("_var"))
    fit = residuals.groupBy(*keys, "target").agg(F.count(F.lit(1)).alias("residuals"), F.avg("residual").alias("_mean"),
                                                 F.avg(F.col("residual") * F.col("residual")).alias("_mse"))
    return truth.join(fit, [*keys, "target"]).select(
        *keys, "target", "rows", "residuals", (F.abs("_mean") <= 0.05 * F.sqrt("_var") + 1e-9).alias("unbiased"),
        (F.col("_mse") <= F.col("_var") + 1e-9).alias("beats_mean"))


@register("m1_fallback_model", O.q("""
SELECT t.target, count(*) AS rows, count(*) AS residuals, true AS unbiased, true AS beats_mean
FROM feat CROSS JOIN targets AS t GROUP BY t.target""", "feat", "targets"))
def m1_fallback_model(spark, sf):
    """The trained bundle's fallback models (200 trees per target) on all rows."""
    b = _boosted(spark, sf)
    return fit_quality(b.models.residuals.where(F.col("pool") == GLOBAL_POOL), b.features, [])


_M2_FIXED = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(median({c}) AS DOUBLE) AS median FROM feat"
                               for c in feats.BASE_FEATURE_COLUMNS)


@register("m2_median_imputation", O.rounded(f"""
{_M2_FIXED}
UNION ALL
SELECT t.feature, CAST(median(CASE WHEN f.campaign_type = t.campaign_type THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS median
FROM feat AS f CROSS JOIN (SELECT DISTINCT campaign_type, {O.type_column('campaign_type')} AS feature FROM feat) AS t
GROUP BY t.feature""", {"median": 4}, "feat"), {"median": 4})
def m2_median_imputation(spark, sf):
    """The exact median that replaces missing values of every training column."""
    f = _feat(spark, sf)
    return median_surrogates(f, feats.feature_columns(f))


_M3 = feats.BASE_FEATURE_COLUMNS


@register("m3_standardisation", O.rounded(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS std FROM feat" for c in _M3),
    {"mean": 2, "std": 2}, "feat"), {"mean": 2, "std": 2})
def m3_standardisation(spark, sf):
    """Mean and sample std per base feature, as the scaler in the trained bundle's fallback holds them."""
    models = _boosted(spark, sf).models
    scaler = models.fallback["prepare"].stages[-1]
    at = {c: i for i, c in enumerate(models.feature_cols)}
    rows = [(c, float(scaler.mean[at[c]]), float(scaler.std[at[c]])) for c in _M3]
    return spark.createDataFrame(rows, "feature string, mean double, std double")


@register("m4_dedicated_group_models", O.q("""
SELECT f.channel, f.campaign_type, t.target, count(*) AS rows, count(*) AS residuals, true AS unbiased, true AS beats_mean
FROM feat AS f CROSS JOIN targets AS t GROUP BY f.channel, f.campaign_type, t.target HAVING count(*) >= 60""", "feat", "targets"))
def m4_dedicated_group_models(spark, sf):
    """Dedicated boosted models per group with >= 60 rows (grouped fit), judged on their residual pools."""
    b = _boosted(spark, sf)
    own = b.models.group_models.where("dedicated").select("channel", "campaign_type", pool_key().alias("pool"))
    pools = b.models.residuals.join(own, "pool")
    return fit_quality(pools, b.features, ["channel", "campaign_type"])


_RES_DIG = {"min_residual": 2, "max_residual": 2, "abs_residual_sum": 2}


@register("m5_in_sample_residuals", O.rounded("""
SELECT pool, target, count(*) AS n, min(residual) AS min_residual, max(residual) AS max_residual,
       sum(abs(residual)) AS abs_residual_sum FROM pools WHERE pool <> '__global__' GROUP BY pool, target""",
                                             _RES_DIG, "pools"), _RES_DIG)
def m5_in_sample_residuals(spark, sf):
    r = _lin(spark, sf).models.residuals.where(F.col("pool") != GLOBAL_POOL)
    return r.groupBy("pool", "target").agg(F.count(F.lit(1)).alias("n"), F.min("residual").alias("min_residual"),
                                           F.max("residual").alias("max_residual"),
                                           F.sum(F.abs("residual")).alias("abs_residual_sum"))


@register("m6_global_residual_pool", O.rounded("""
SELECT target, pool_idx, residual FROM pools WHERE pool = '__global__'""", {"residual": 2}, "pools"), {"residual": 2})
def m6_global_residual_pool(spark, sf):
    r = _lin(spark, sf).models.residuals
    return r.where(F.col("pool") == GLOBAL_POOL).select("target", "pool_idx", "residual")


_MV = ["channel", "campaign_type", "forecast_period_days", "budget_scenario"]


@register("m7_revenue_what_if", O.rounded(f"""
SELECT {_cols(_MV)}, revenue_p10, revenue_p50, revenue_p90 FROM grp_pred""",
                                         {"revenue_p10": 2, "revenue_p50": 2, "revenue_p90": 2}, "grp_pred"))
def m7_revenue_what_if(spark, sf):
    return a14_percentiles(spark, sf).select(*_MV, "revenue_p10", "revenue_p50", "revenue_p90")


@register("m8_roas_what_if", O.rounded(f"SELECT {_cols(_MV)}, roas_p10, roas_p50, roas_p90 FROM grp_pred",
                                       {"roas_p10": 4, "roas_p50": 4, "roas_p90": 4}, "grp_pred"))
def m8_roas_what_if(spark, sf):
    return a14_percentiles(spark, sf).select(*_MV, "roas_p10", "roas_p50", "roas_p90")


@register("m9_bootstrap_draws", O.q("""
SELECT DISTINCT n, k, ((k * 1103515245 + 12345) % 2147483648) % n AS idx
FROM pool_n CROSS JOIN (SELECT range AS k FROM range(0, 1000)) AS r""", "pool_n"))
def m9_bootstrap_draws(spark, sf):
    return draws(pool_sizes(_lin(spark, sf).models.residuals), "lcg")


@register("m9_bootstrap_draws_numpy", O.q("""
SELECT DISTINCT n, CAST(1000 AS BIGINT) AS draws, CAST(1000 AS BIGINT) AS places, true AS inside FROM pool_n""", "pool_n"))
def m9_bootstrap_draws_numpy(spark, sf):
    """The reference's draw stream per distinct pool size: 1,000 draws, all of them places of the pool."""
    d = draws(pool_sizes(_lin(spark, sf).models.residuals), "numpy")
    return d.groupBy("n").agg(F.count(F.lit(1)).alias("draws"), F.count_distinct("k").alias("places"),
                              F.min((F.col("idx") >= 0) & (F.col("idx") < F.col("n"))).alias("inside"))


_M10 = ["month", "week_of_year", "day_of_week", "quarter", "is_q4", "is_november", "is_december", "days_since_start"]


@register("m10_future_feature_row", O.rounded(f"""
SELECT channel, campaign_type, forecast_period_days, budget_scenario, midpoint_date,
       CAST(month(midpoint_date) AS DOUBLE) AS month, CAST(weekofyear(midpoint_date) AS DOUBLE) AS week_of_year,
       CAST(isodow(midpoint_date) - 1 AS DOUBLE) AS day_of_week, CAST(quarter(midpoint_date) AS DOUBLE) AS quarter,
       CAST(month(midpoint_date) IN (10, 11, 12) AS DOUBLE) AS is_q4,
       CAST(month(midpoint_date) = 11 AS DOUBLE) AS is_november, CAST(month(midpoint_date) = 12 AS DOUBLE) AS is_december,
       CAST(midpoint_date - a.min_date AS DOUBLE) AS days_since_start, new_spend AS spend,
       CASE WHEN base_daily_budget > 0 AND new_spend IS NOT NULL
            THEN least(greatest(new_spend / base_daily_budget, 0.0), 3.0) ELSE 1.0 END AS spend_vs_budget_ratio
FROM frame CROSS JOIN anchor AS a""", {"spend": 2, "spend_vs_budget_ratio": 4, **{c: 4 for c in _M10}}, "frame", "anchor"))
def m10_future_feature_row(spark, sf):
    return _frame(spark, sf).select(*_MV, "midpoint_date", *_M10, "spend", "spend_vs_budget_ratio")


@register("m10_train_origin", O.q("""
SELECT f.channel, f.campaign_type, f.forecast_period_days, f.budget_scenario, f.midpoint_date,
       CAST(f.midpoint_date - a.min_date AS DOUBLE) AS days_since_start
FROM yr_frame AS f CROSS JOIN yr_anchor AS a""", "yr_frame", "yr_anchor"), {"days_since_start": 4})
def m10_train_origin(spark, sf):
    """A bundle trained on all rows scores the last year: days still count from the training table's first date."""
    from .pipeline import load_trained, save_trained
    b = _lin(spark, sf)
    path = sinks.scratch_dir(spark, "bundle")
    save_trained(b, path)
    last = b.features.agg(F.max("date").alias("_last"))
    year = b.features.crossJoin(F.broadcast(last)).where("date > date_sub(_last, 365)").drop("_last")
    loaded = load_trained(spark, path, year)
    frame = sc.scenario_frame(loaded.features, loaded.feature_cols, min_date=loaded.min_date)
    return frame.select(*_MV, "midpoint_date", "days_since_start")


@register("m11_forecast_job", O.rounded("SELECT * FROM predictions", PRED_DIG, "predictions"), PRED_DIG)
def m11_forecast_job(spark, sf):
    return _pred(spark, sf)


@register("m11_forecast_job_boosted", O.rounded("""
SELECT forecast_period_days, channel, campaign_type, budget_scenario, spend_input, true AS ordered, true AS bounded, true AS summed
FROM predictions""", {"spend_input": 2}, "predictions"), {"spend_input": 2})
def m11_forecast_job_boosted(spark, sf):
    """The default forecast (boosted trees, the reference's draws): quantiles in order and in bounds, rollup = sum."""
    p = forecast(_boosted(spark, sf), draws="numpy", sort=False)
    top = p.where("channel = 'all'").select("forecast_period_days", "budget_scenario", F.col("revenue_p50").alias("_top"))
    total = (p.where("channel <> 'all'").groupBy("forecast_period_days", "budget_scenario")
             .agg(F.sum("revenue_p50").alias("_sum")).join(top, ["forecast_period_days", "budget_scenario"]))
    ordered = F.lit(True)
    for m in ("revenue", "roas"):
        ordered = ordered & (F.col(f"{m}_p10") <= F.col(f"{m}_p50")) & (F.col(f"{m}_p50") <= F.col(f"{m}_p90"))
    bounded = (F.col("revenue_p10") >= 0) & (F.col("roas_p10") >= 0) & (F.col("roas_p90") <= 50)
    return p.join(total, ["forecast_period_days", "budget_scenario"]).select(
        "forecast_period_days", "channel", "campaign_type", "budget_scenario", "spend_input", ordered.alias("ordered"),
        bounded.alias("bounded"), (F.abs(F.col("_top") - F.col("_sum")) <= 1e-6 * (1 + F.abs("_sum"))).alias("summed"))


_WI = {"spend_input": 2, "revenue_p10": 2, "revenue_p50": 2, "revenue_p90": 2, "roas_p50": 4}


@register("m12_what_if_job", O.rounded("""
SELECT channel, campaign_type, spend_input, revenue_p10, revenue_p50, revenue_p90, roas_p50 FROM wi""", _WI, "wi"), _WI)
def m12_what_if_job(spark, sf):
    return simulate(_lin(spark, sf), WHAT_IF_MULTIPLIERS, draws="lcg")


_MR = {"base_spend": 2, "incremental_spend": 2, "incremental_revenue": 2, "marginal_roas": 4}


@register("m13_marginal_return", O.rounded("""
SELECT upper(channel) AS channel, s0 AS base_spend, s1 - s0 AS incremental_spend, r1 - r0 AS incremental_revenue,
       CASE WHEN s1 - s0 > 0 THEN (r1 - r0) / (s1 - s0) ELSE 0.0 END AS marginal_roas FROM near WHERE points >= 2""",
                                          _MR, "near"), _MR)
def m13_marginal_return(spark, sf):
    b = _lin(spark, sf)
    return fc.marginal_return(fc.yield_curve(b.features, b.feature_cols, b.models, draws="lcg"))


# ----------------------------------------------------------------------------- sorts, sets, scalars

@register("o3_prediction_sort", O.rounded("""
SELECT * FROM predictions ORDER BY forecast_period_days, channel, campaign_type, budget_scenario""", PRED_DIG,
                                         "predictions"), PRED_DIG)
def o3_prediction_sort(spark, sf):
    return fc.sort_predictions(_pred(spark, sf))


@register("u2_union_rollup", O.rounded("""
SELECT channel, count(*) AS rows, sum(revenue_p50) AS revenue_p50 FROM predictions GROUP BY channel""",
                                      {"revenue_p50": 2}, "predictions"), {"revenue_p50": 2})
def u2_union_rollup(spark, sf):
    return _pred(spark, sf).groupBy("channel").agg(F.count(F.lit(1)).alias("rows"), F.sum("revenue_p50").alias("revenue_p50"))


@register("f6_midpoint_date", O.q("SELECT DISTINCT forecast_period_days, midpoint_date FROM frame", "frame"))
def f6_midpoint_date(spark, sf):
    return _frame(spark, sf).select("forecast_period_days", "midpoint_date").distinct()


@register("f8_budget_ratio_forecast", O.q("""
SELECT channel, campaign_type, forecast_period_days, budget_scenario,
       CASE WHEN base_daily_budget > 0 AND new_spend IS NOT NULL
            THEN least(greatest(new_spend / base_daily_budget, 0.0), 3.0) ELSE 1.0 END AS spend_vs_budget_ratio
FROM frame""", "frame"), {"spend_vs_budget_ratio": 4})
def f8_budget_ratio_forecast(spark, sf):
    return _frame(spark, sf).select(*_MV, "spend_vs_budget_ratio")


# ----------------------------------------------------------------------------- sinks

@register("s6_predictions_csv", O.rounded("SELECT * FROM predictions", PRED_DIG, "predictions"), PRED_DIG)
def s6_predictions_csv(spark, sf):
    """Predictions written as CSV with a header, read back with the declared schema."""
    path = sinks.scratch_dir(spark, "predictions-csv") + ".csv"
    sinks.write_predictions_csv(_pred(spark, sf), path)
    return sinks.read_predictions_csv(spark, path)


@register("s7_predictions_csv_read", O.rounded(f"SELECT {_cols(_REPORT)} FROM ({_VIEW}) AS v", PRED_DIG, "predictions"),
          PRED_DIG)
def s7_predictions_csv_read(spark, sf):
    """Report view over a predictions CSV read with the declared schema."""
    path = sinks.scratch_dir(spark, "predictions-csv")
    sinks.write_predictions_csv(_pred(spark, sf), path)
    return fc.report_table(fc.report_filter(sinks.read_predictions_csv(spark, path)))


@register("s8_bundle_forecast", O.rounded("SELECT * FROM predictions", PRED_DIG, "predictions"))
def s8_bundle_forecast(spark, sf):
    """Train, save the bundle, load it back (models rebuilt from tables) and forecast from the loaded copy."""
    from .pipeline import load_trained, save_trained
    b = _lin(spark, sf)
    path = sinks.scratch_dir(spark, "bundle")
    save_trained(b, path)
    return forecast(load_trained(spark, path, b.features), draws="lcg", sort=False)


@register("s8_bundle_save_load", O.q("SELECT pool, target, n FROM pool_n", "pool_n"))
def s8_bundle_save_load(spark, sf):
    """Bundle saved as Parquet tables and loaded back; residual pool sizes from the loaded table."""
    from .pipeline import save_trained
    path = sinks.scratch_dir(spark, "bundle")
    save_trained(_lin(spark, sf), path)
    return pool_sizes(sinks.load_bundle(spark, path)["residuals"])


# ----------------------------------------------------------------------------- the same plans over the events source

def _events(spark, sf, by_weekday):
    """A linear bundle over the events: by type every group has 30 days (fallback model, own pool); by type and
    weekday a few (fallback model, global pool)."""
    daily = cut_lineage(daily_aggregate(events_canonical(spark, sf, by_weekday)), "events-daily")
    return train(cut_lineage(feats.build_features(daily), "events-features"), "linear")


def _event_queries(name, p, by_weekday):
    @register(f"j1_pool_lookup_{name}", O.q(f"""
SELECT b.channel, b.campaign_type, t.target,
       CASE WHEN coalesce(pn.n, 0) >= 30 THEN b.channel || '__' || b.campaign_type ELSE '__global__' END AS pool,
       CASE WHEN coalesce(pn.n, 0) >= 30 THEN pn.n ELSE g.n END AS pool_n
FROM {p}base AS b CROSS JOIN targets AS t
LEFT JOIN {p}pool_n AS pn ON pn.pool = b.channel || '__' || b.campaign_type AND pn.target = t.target
JOIN {p}pool_n AS g ON g.pool = '__global__' AND g.target = t.target""", f"{p}base", "targets", f"{p}pool_n"))
    def j1(spark, sf):
        b = _events(spark, sf, by_weekday)
        rows = sc.base_rows(b.features, []).select("channel", "campaign_type").crossJoin(
            F.broadcast(spark.createDataFrame([(t,) for t in TARGETS], "target string")))
        return pool_choice(rows, pool_sizes(b.models.residuals)).select("channel", "campaign_type", "target", "pool", "pool_n")

    @register(f"j2_model_lookup_{name}", O.q(f"""
SELECT channel, campaign_type, CASE WHEN dedicated THEN 'dedicated' ELSE 'fallback' END AS model FROM {p}lin_model""",
                                              f"{p}lin_model"))
    def j2(spark, sf):
        return _events(spark, sf, by_weekday).models.group_models.select(
            "channel", "campaign_type", F.when(F.col("dedicated"), "dedicated").otherwise("fallback").alias("model"))

    @register(f"m6_global_pool_{name}", O.rounded(f"""
SELECT target, pool_idx, residual FROM {p}pools WHERE pool = '__global__'""", {"residual": 2}, f"{p}pools"), {"residual": 2})
    def m6(spark, sf):
        r = _events(spark, sf, by_weekday).models.residuals
        return r.where(F.col("pool") == GLOBAL_POOL).select("target", "pool_idx", "residual")

    @register(f"a14_percentiles_{name}", O.rounded(f"SELECT {_cols(_IV)} FROM {p}pred", IV_DIG, f"{p}pred"))
    def a14(spark, sf):
        b = _events(spark, sf, by_weekday)
        return fc.scored_intervals(sc.scenario_frame(b.features, b.feature_cols), b.models, "lcg").select(*_IV)


_event_queries("events", "ev_", False)
_event_queries("events_weekday", "evw_", True)
