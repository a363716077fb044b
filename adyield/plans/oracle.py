"""Oracle SQL (DuckDB dialect) for the correctness check.

the Spark code: dialect views, normalisation, daily table, features,
statistics and the SQL-expressible forecast (linear stand-in predictor with
linear-congruential draws). ``q(sql, *ctes)`` describes a final SELECT and the CTEs it needs;
``Spec.build`` prefixes them in dependency order and rounds double columns.
"""

from __future__ import annotations

_CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    _CTES[name] = (sql.strip(), deps)


def r(expr: str, digits: int = 4) -> str:
    """Snap to 8 decimals, then half-up rounding: the same steps as ``functions.exprs.rnd``."""
    s = f"1e{digits}"
    snapped = f"(CASE WHEN abs({expr}) < 1e10 THEN floor(({expr}) * 1e8 + 0.5) / 1e8 ELSE ({expr}) END)"
    return f"(CASE WHEN abs({snapped}) < 1e11 THEN floor({snapped} * {s} + 0.5) / {s} ELSE {snapped} END)"


class Spec:
    """A final SELECT, the CTEs it needs and the rounding of its double columns.

    Built lazily so the registry can merge the digits it declares and use the
    same dict on the Spark side.
    """

    def __init__(self, final: str, needs: tuple[str, ...], cols: dict[str, int] | None = None):
        self.final, self.needs, self.cols = final, needs, dict(cols or {})

    def build(self, cols: dict[str, int] | None = None) -> str:
        merged = {**self.cols, **(cols or {})}
        if not merged:
            return with_ctes(self.final, *self.needs)
        repl = ", ".join(f"{r(c, d)} AS {c}" for c, d in merged.items())
        return with_ctes(f"SELECT * REPLACE ({repl}) FROM (\n{self.final.strip()}\n) AS oq", *self.needs)


def q(final: str, *needs: str) -> Spec:
    return Spec(final, needs)


def rounded(final: str, cols: dict[str, int], *needs: str) -> Spec:
    """A final SELECT whose listed double columns are rounded (digits per column)."""
    return Spec(final, needs, cols)


def with_ctes(final: str, *needs: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _CTES[n][1]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return final.strip()
    body = ",\n".join(f"{n} AS (\n{_CTES[n][0]}\n)" for n in order)
    return f"WITH {body}\n{final.strip()}"


ROAS_CLIP = ("CASE WHEN {s} > 0 THEN least(greatest(CASE WHEN isinf({r} / {s}) OR isnan({r} / {s}) THEN 0.0 "
             "ELSE coalesce({r} / {s}, 0.0) END, 0.0), 50.0) ELSE 0.0 END")


def roas(rev: str, spend: str) -> str:
    """Row-level ratio: an overflowing quotient becomes 0 before the clip."""
    return ROAS_CLIP.format(r=rev, s=spend)


def scalar_ratio(rev: str, spend: str) -> str:
    """Scope/rollup ratio (scalar division): an overflowing quotient is clipped to 50."""
    return f"CASE WHEN {spend} > 0 THEN least(greatest(coalesce({rev} / {spend}, 0.0), 0.0), 50.0) ELSE 0.0 END"


# ------------------------------------------------------------------ raw dialect views (FIXTURES 3)

cte("src", """
SELECT l.l_orderkey, l.l_partkey, l.l_linenumber, l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax,
       l.l_returnflag, CAST(l.l_shipdate AS DATE) AS d,
       p.p_brand, p.p_type, p.p_size, p.p_retailprice,
       CASE WHEN l.l_orderkey % 997 = 0 THEN 'n/a' ELSE strftime(CAST(l.l_shipdate AS DATE), '%Y-%m-%d') END AS dtxt,
       CASE WHEN l.l_tax = 0 THEN NULL ELSE p.p_retailprice END AS budget_raw
FROM lineitem AS l JOIN part AS p ON p.p_partkey = l.l_partkey""")

cte("g_raw", """
SELECT CAST(l_partkey AS VARCHAR) AS campaign_id, p_brand AS campaign_name,
       CASE WHEN p_type = 'SMALL' AND d >= DATE '2001-09-20' THEN 'VIDEO'
            WHEN p_size = 50 THEN NULL ELSE p_type END AS campaign_advertising_channel_type,
       budget_raw AS campaign_budget_amount, dtxt AS segments_date,
       l_extendedprice * l_discount * 1e6 AS metrics_cost_micros,
       CAST(trunc(l_quantity) AS BIGINT) AS metrics_clicks,
       CAST(trunc(l_quantity * p_size) AS BIGINT) AS metrics_impressions,
       CAST(l_linenumber AS DOUBLE) AS metrics_conversions,
       l_extendedprice AS metrics_conversions_value
FROM src WHERE l_returnflag = 'A'""", "src")

cte("b_raw", """
SELECT CAST(l_partkey AS VARCHAR) AS CampaignId, p_brand AS CampaignName,
       CASE WHEN p_type = 'ECONOMY' AND d >= DATE '2001-06-01' THEN 'LARGE' ELSE p_type END AS CampaignType,
       dtxt AS TimePeriod, l_extendedprice * l_discount AS Spend, l_extendedprice AS Revenue,
       CAST(trunc(l_quantity) AS BIGINT) AS Clicks, CAST(trunc(l_quantity * p_size) AS BIGINT) AS Impressions,
       CAST(l_linenumber AS DOUBLE) AS Conversions, budget_raw AS DailyBudget
FROM src WHERE l_returnflag = 'N'""", "src")

cte("m_raw", """
SELECT CAST(l_partkey AS VARCHAR) AS campaign_id,
       (CASE p_type WHEN 'PROMO' THEN 'Prospecting' WHEN 'STANDARD' THEN 'Remarketing'
                    WHEN 'LARGE' THEN 'Generic' ELSE p_type END) || '_' || p_brand AS campaign_name,
       dtxt AS date_start, l_extendedprice * l_discount AS spend, l_extendedprice AS conversion,
       l_quantity AS clicks, l_quantity * p_size AS impressions, budget_raw AS daily_budget,
       l_extendedprice / 100 AS cpc, l_extendedprice / 1000 AS cpm
FROM src WHERE l_returnflag = 'R'""", "src")

# ------------------------------------------------------------------ normalisation

cte("g_typed", """
SELECT TRY_CAST(segments_date AS DATE) AS date, 'google' AS channel,
       coalesce(campaign_advertising_channel_type, 'SEARCH') AS campaign_type,
       coalesce(campaign_name, 'Unknown') AS campaign_name,
       metrics_cost_micros / 1e6 AS spend,
       coalesce(metrics_conversions_value, 0.0) AS revenue,
       coalesce(metrics_clicks, 0) AS clicks, coalesce(metrics_impressions, 0) AS impressions,
       coalesce(metrics_conversions, 0.0) AS conversions,
       campaign_budget_amount AS budget, campaign_id
FROM g_raw""", "g_raw")

cte("b_typed", """
SELECT TRY_CAST(TimePeriod AS DATE) AS date, 'bing' AS channel,
       coalesce(CampaignType, 'Search') AS campaign_type, coalesce(CampaignName, 'Unknown') AS campaign_name,
       coalesce(Spend, 0.0) AS spend, coalesce(Revenue, 0.0) AS revenue,
       coalesce(Clicks, 0) AS clicks, coalesce(Impressions, 0) AS impressions,
       coalesce(Conversions, 0.0) AS conversions, coalesce(DailyBudget, 0.0) AS budget, CampaignId AS campaign_id
FROM b_raw""", "b_raw")

cte("m_typed", """
SELECT TRY_CAST(date_start AS DATE) AS date, 'meta' AS channel,
       CASE WHEN split_part(coalesce(campaign_name, 'Unknown'), '_', 1) IN ('Prospecting', 'Remarketing', 'Generic')
            THEN split_part(coalesce(campaign_name, 'Unknown'), '_', 1) ELSE 'Unknown' END AS campaign_type,
       coalesce(campaign_name, 'Unknown') AS campaign_name,
       coalesce(spend, 0.0) AS spend, coalesce(conversion, 0.0) AS revenue,
       CAST(trunc(coalesce(clicks, 0)) AS BIGINT) AS clicks,
       CAST(trunc(coalesce(impressions, 0)) AS BIGINT) AS impressions,
       coalesce(conversion, 0.0) / 100.0 AS conversions, daily_budget AS budget, campaign_id
FROM m_raw""", "m_raw")

for _p in ("g", "m"):
    cte(f"{_p}_ok", f"SELECT * FROM {_p}_typed WHERE date IS NOT NULL", f"{_p}_typed")
    cte(f"{_p}_tmed", f"SELECT campaign_type, median(budget) AS tmed FROM {_p}_ok GROUP BY campaign_type", f"{_p}_ok")
    cte(f"{_p}_fill", f"""
SELECT o.*, coalesce(o.budget, t.tmed) AS budget1
FROM {_p}_ok AS o LEFT JOIN {_p}_tmed AS t ON t.campaign_type = o.campaign_type""", f"{_p}_ok", f"{_p}_tmed")
    cte(f"{_p}_gmed", f"SELECT median(budget1) AS gmed FROM {_p}_fill", f"{_p}_fill")
    cte(f"{_p}_canon", f"""
SELECT date, channel, campaign_type, campaign_name, spend, revenue, {roas('revenue', 'spend')} AS roas,
       clicks, impressions, conversions, coalesce(budget1, gmed, 0.0) AS daily_budget, campaign_id
FROM {_p}_fill CROSS JOIN {_p}_gmed""", f"{_p}_fill", f"{_p}_gmed")

cte("b_canon", f"""
SELECT date, channel, campaign_type, campaign_name, spend, revenue, {roas('revenue', 'spend')} AS roas,
       clicks, impressions, conversions, budget AS daily_budget, campaign_id
FROM b_typed WHERE date IS NOT NULL""", "b_typed")

cte("canon", """
SELECT * FROM g_canon UNION ALL SELECT * FROM b_canon UNION ALL SELECT * FROM m_canon""",
    "g_canon", "b_canon", "m_canon")

# ------------------------------------------------------------------ daily table and features

cte("daily", f"""
SELECT date, channel, campaign_type,
       coalesce(sum(spend), 0.0) AS spend, coalesce(sum(revenue), 0.0) AS revenue,
       CAST(coalesce(sum(clicks), 0) AS BIGINT) AS clicks, CAST(coalesce(sum(impressions), 0) AS BIGINT) AS impressions,
       coalesce(sum(conversions), 0.0) AS conversions, coalesce(sum(daily_budget), 0.0) AS daily_budget,
       {roas('coalesce(sum(revenue), 0.0)', 'coalesce(sum(spend), 0.0)')} AS roas
FROM canon GROUP BY date, channel, campaign_type""", "canon")

_W = "PARTITION BY channel, campaign_type ORDER BY date"


def _lag(c: str, n: int) -> str:
    return f"coalesce(lag({c}, {n}) OVER ({_W}), 0.0) AS lag_{n}d_{c}"


def _roll(c: str, n: int) -> str:
    return f"avg({c}) OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS rolling_{n}d_{c}_mean"


def _feat_cte(name: str, daily: str) -> None:
    cte(name, f"""
SELECT {daily}.*,
       CAST(month(date) AS BIGINT) AS month, CAST(weekofyear(date) AS BIGINT) AS week_of_year,
       CAST(isodow(date) - 1 AS BIGINT) AS day_of_week, CAST(quarter(date) AS BIGINT) AS quarter,
       CAST(month(date) IN (10, 11, 12) AS BIGINT) AS is_q4, CAST(month(date) = 11 AS BIGINT) AS is_november,
       CAST(month(date) = 12 AS BIGINT) AS is_december, CAST(date - mn.min_date AS BIGINT) AS days_since_start,
       {_lag('revenue', 7)}, {_lag('revenue', 14)}, {_lag('revenue', 30)}, {_lag('spend', 7)}, {_lag('spend', 30)},
       {_lag('roas', 7)}, {_lag('roas', 30)},
       {_roll('revenue', 7)}, {_roll('revenue', 30)}, {_roll('spend', 7)}, {_roll('spend', 30)},
       {_roll('roas', 7)}, {_roll('roas', 30)},
       coalesce(stddev_samp(revenue) OVER ({_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0.0) AS rolling_7d_revenue_std,
       CASE WHEN spend IS NULL OR daily_budget IS NULL THEN 1.0
            WHEN daily_budget = 0 THEN (CASE WHEN spend > 0 THEN 3.0 WHEN spend < 0 THEN 0.0 ELSE 1.0 END)
            ELSE least(greatest(spend / daily_budget, 0.0), 3.0) END AS spend_vs_budget_ratio,
       CAST(channel = 'bing' AS BIGINT) AS channel_bing, CAST(channel = 'google' AS BIGINT) AS channel_google,
       CAST(channel = 'meta' AS BIGINT) AS channel_meta
FROM {daily} CROSS JOIN (SELECT min(date) AS min_date FROM {daily}) AS mn""", daily)


_feat_cte("feat", "daily")

# ------------------------------------------------------------------ second source: events as channel 'web'


def _events_ctes(p: str, campaign_type: str) -> None:
    cte(f"{p}canon", f"""
SELECT CAST(ts AS DATE) AS date, 'web' AS channel, {campaign_type} AS campaign_type,
       coalesce(event_type, 'Unknown') AS campaign_name, 0.0 AS spend, coalesce(value, 0.0) AS revenue,
       0.0 AS roas, CAST(0 AS BIGINT) AS clicks, CAST(0 AS BIGINT) AS impressions, 0.0 AS conversions,
       0.0 AS daily_budget, CAST(user_id AS VARCHAR) AS campaign_id
FROM events WHERE ts IS NOT NULL""")
    cte(f"{p}daily", f"""
SELECT date, channel, campaign_type, coalesce(sum(spend), 0.0) AS spend, coalesce(sum(revenue), 0.0) AS revenue,
       CAST(coalesce(sum(clicks), 0) AS BIGINT) AS clicks, CAST(coalesce(sum(impressions), 0) AS BIGINT) AS impressions,
       coalesce(sum(conversions), 0.0) AS conversions, coalesce(sum(daily_budget), 0.0) AS daily_budget,
       {roas('coalesce(sum(revenue), 0.0)', 'coalesce(sum(spend), 0.0)')} AS roas
FROM {p}canon GROUP BY date, channel, campaign_type""", f"{p}canon")
    _feat_cte(f"{p}feat", f"{p}daily")


_events_ctes("ev_", "coalesce(event_type, 'Unknown')")
# one type per event type and weekday: a few rows per group
_events_ctes("evw_", "coalesce(event_type, 'Unknown') || '_' || (isodow(CAST(ts AS DATE)) - 1)")

# the last year of the feature table, scored by a bundle that was trained on all of it
cte("yr_feat", "SELECT * FROM feat WHERE date > (SELECT max(date) FROM feat) - 365", "feat")


def type_column(t: str) -> str:
    """Name of a campaign type's one-hot column: plain upper-case names as they are, others with a digest."""
    return (f"'campaign_type_' || CASE WHEN regexp_full_match({t}, '[A-Z0-9_]+') THEN {t} "
            f"ELSE regexp_replace({t}, '[^A-Za-z0-9_]', '_', 'g') || '_' || substr(md5({t}), 1, 10) END")


# ------------------------------------------------------------------ statistics


def _stats_cte(name: str, rows_cte: str, key: str, key_expr: str, rows_sql: str) -> None:
    """Per-scope stats; ``rows_sql`` selects (scope, date, revenue, spend)."""
    cte(f"{name}_rows", rows_sql, rows_cte)
    cte(f"{name}_anchor", f"""
SELECT {key}, max(date) AS last_date, avg(revenue) AS mean_rev, stddev_samp(revenue) AS std_rev
FROM {name}_rows GROUP BY {key}""", f"{name}_rows")
    cte(f"{name}_stats", f"""
SELECT x.{key},
       coalesce(sum(CASE WHEN x.date > a.last_date - 30 THEN x.revenue END), 0.0) AS rev30,
       coalesce(sum(CASE WHEN x.date > a.last_date - 30 THEN x.spend END), 0.0) AS spend30,
       coalesce(sum(CASE WHEN x.date > a.last_date - 90 THEN x.revenue END), 0.0) AS total_revenue_last_90d,
       coalesce(sum(CASE WHEN x.date > a.last_date - 90 THEN x.spend END), 0.0) AS total_spend_last_90d,
       coalesce(sum(CASE WHEN x.date <= a.last_date - 30 AND x.date > a.last_date - 60 THEN x.revenue END), 0.0) AS rev_prior,
       count(*) AS n_rows,
       count(CASE WHEN a.std_rev > 0 AND abs((x.revenue - a.mean_rev) / a.std_rev) > 2.5 THEN 1 END) AS n_anomalies
FROM {name}_rows AS x JOIN {name}_anchor AS a ON a.{key} = x.{key}
GROUP BY x.{key}""", f"{name}_rows", f"{name}_anchor")
    cte(f"{name}_final", f"""
SELECT {key}, {scalar_ratio('rev30', 'spend30')} AS avg_roas_last_30d,
       {scalar_ratio('total_revenue_last_90d', 'total_spend_last_90d')} AS avg_roas_last_90d,
       total_revenue_last_90d, total_spend_last_90d,
       CASE WHEN rev30 > rev_prior * 1.05 THEN 'up' WHEN rev30 < rev_prior * 0.95 THEN 'down' ELSE 'flat' END
           AS trend_direction,
       rev30 AS revenue_last_30d, rev_prior AS revenue_prior_30d, n_rows, n_anomalies
FROM {name}_stats""", f"{name}_stats")
    cte(f"{name}_anom", f"""
SELECT x.{key}, x.date FROM {name}_rows AS x JOIN {name}_anchor AS a ON a.{key} = x.{key}
WHERE a.std_rev > 0 AND abs((x.revenue - a.mean_rev) / a.std_rev) > 2.5""", f"{name}_rows", f"{name}_anchor")


_stats_cte("gs", "feat", "gkey", "", "SELECT channel || '__' || campaign_type AS gkey, channel, campaign_type, date, revenue, spend FROM feat")
_stats_cte("cs", "feat", "scope", "", "SELECT channel AS scope, date, revenue, spend FROM feat")
_stats_cte("ps", "feat", "scope", "", "SELECT 'all' AS scope, date, sum(revenue) AS revenue, sum(spend) AS spend FROM feat GROUP BY date")

cte("scope_top", """
SELECT scope, min(campaign_type) FILTER (WHERE rev = max_rev) AS top_campaign_type FROM (
  SELECT scope, campaign_type, rev, max(rev) OVER (PARTITION BY scope) AS max_rev FROM (
    SELECT channel AS scope, campaign_type, sum(revenue) AS rev FROM feat GROUP BY channel, campaign_type
    UNION ALL
    SELECT 'all' AS scope, campaign_type, sum(revenue) AS rev FROM feat GROUP BY campaign_type) AS s) AS t
GROUP BY scope""", "feat")

cte("scope_types", """
SELECT channel AS scope, string_agg(DISTINCT campaign_type, ', ' ORDER BY campaign_type) AS types_txt
FROM feat GROUP BY channel
UNION ALL
SELECT 'all' AS scope, string_agg(campaign_type, ', ' ORDER BY first_channel, campaign_type) AS types_txt
FROM (SELECT campaign_type, min(channel) AS first_channel FROM feat GROUP BY campaign_type) AS ft""", "feat")

cte("scope_anom5", """
SELECT scope, string_agg(strftime(date, '%Y-%m-%d'), ', ' ORDER BY date) AS anom_txt FROM (
  SELECT scope, date, row_number() OVER (PARTITION BY scope ORDER BY date) AS rn
  FROM (SELECT scope, date FROM cs_anom UNION ALL SELECT scope, date FROM ps_anom) AS a) AS b
WHERE rn <= 5 GROUP BY scope""", "cs_anom", "ps_anom")

cte("scope_stats", """
SELECT * FROM cs_final UNION ALL SELECT * FROM ps_final""", "cs_final", "ps_final")

cte("summ", """
SELECT s.scope, h.horizon,
  CASE WHEN s.scope = 'all' THEN
    'Across all marketing channels, performance shows an overall ' || s.trend_direction ||
    ' trend with a combined average ROAS of ' || printf('%.2f', s.avg_roas_last_30d) ||
    'x over the last 30 days. Q4 historically drives 3-5x revenue — August spend decisions will affect Holiday performance. Strategic budget allocation across Google and Meta is recommended to maximize overall yield.'
  ELSE
    'Based on historical data, ' || upper(substr(s.scope, 1, 1)) || lower(substr(s.scope, 2)) || ' shows a ' ||
    s.trend_direction || ' revenue trend with an average ROAS of ' || printf('%.2f', s.avg_roas_last_30d) ||
    'x over the past 30 days. Monitor ' || t.top_campaign_type ||
    ' campaigns closely as they represent the highest revenue contribution.'
  END AS summary,
  CASE WHEN s.scope = 'all' THEN
    'Channel: Combined Portfolio (All Channels)' || chr(10) || 'Campaign types represented: ' || ty.types_txt || chr(10) ||
    'Combined Avg ROAS last 30 days: ' || printf('%.2f', s.avg_roas_last_30d) || 'x' || chr(10) ||
    'Combined Avg ROAS last 90 days: ' || printf('%.2f', s.avg_roas_last_90d) || 'x' || chr(10) ||
    'Portfolio Revenue trend: ' || s.trend_direction || chr(10) ||
    'Top campaign type overall: ' || t.top_campaign_type || chr(10) ||
    'Total portfolio revenue last 90 days: $' || format('{:,.0f}', s.total_revenue_last_90d) || chr(10) ||
    'Anomaly dates: ' || coalesce(a.anom_txt, 'None detected') || chr(10) ||
    'Forecast window: ' || h.horizon || ' days' || chr(10) || chr(10) ||
    'Provide a 3-4 sentence overall business narrative explaining the portfolio-wide performance, risks, and Q4 preparation opportunities for the next ' || h.horizon || ' days.'
  ELSE
    'Channel: ' || s.scope || chr(10) || 'Campaign types: ' || ty.types_txt || chr(10) ||
    'Avg ROAS last 30 days: ' || printf('%.2f', s.avg_roas_last_30d) || 'x' || chr(10) ||
    'Avg ROAS last 90 days: ' || printf('%.2f', s.avg_roas_last_90d) || 'x' || chr(10) ||
    'Revenue trend: ' || s.trend_direction || chr(10) ||
    'Top campaign type by revenue: ' || t.top_campaign_type || chr(10) ||
    'Total revenue last 90 days: $' || format('{:,.0f}', s.total_revenue_last_90d) || chr(10) ||
    'Anomaly dates: ' || coalesce(a.anom_txt, 'None detected') || chr(10) ||
    'Forecast window: ' || h.horizon || ' days' || chr(10) || chr(10) ||
    'Provide a 2-3 sentence business insight explaining the performance trend and key risks or opportunities for the next ' || h.horizon || ' days. Be specific to this channel''s data.'
  END AS prompt
FROM scope_stats AS s
JOIN scope_top AS t ON t.scope = s.scope
JOIN scope_types AS ty ON ty.scope = s.scope
LEFT JOIN scope_anom5 AS a ON a.scope = s.scope
CROSS JOIN (SELECT CAST(v AS BIGINT) AS horizon FROM (VALUES (30), (60), (90)) AS hv(v)) AS h""",
    "scope_stats", "scope_top", "scope_types", "scope_anom5")

# ------------------------------------------------------------------ forecast inputs

# ------------------------------------------------------------------ fixed tables

cte("horizons", "SELECT CAST(h AS BIGINT) AS forecast_period_days FROM (VALUES (30), (60), (90)) AS v(h)")
cte("scen", """
SELECT budget_scenario, CAST(m AS DOUBLE) AS multiplier FROM (VALUES
  ('minus_30pct', '0.7'), ('minus_15pct', '0.85'), ('base', '1.0'), ('plus_15pct', '1.15'), ('plus_30pct', '1.3')
) AS s(budget_scenario, m)""")

cte("targets", "SELECT * FROM (VALUES ('revenue'), ('roas')) AS t(target)")


# a constant spend has no slope: NaN here, NULL in Spark
SLOPE_revenue = "nullif(regr_slope(revenue, spend), CAST('NaN' AS DOUBLE))"
SLOPE_roas = "nullif(regr_slope(roas, spend), CAST('NaN' AS DOUBLE))"


def forecast_ctes(p: str, feat: str, origin: str) -> None:
    """Forecast inputs, linear stand-in models, residual pools and draws over feature table ``feat``.

    The names of the CTEs begin with ``p``; ``origin`` is the training table whose first date counts.
    """
    cte(f"{p}anchor", f"SELECT max(date) AS anchor_date, (SELECT min(date) FROM {origin}) AS min_date FROM {feat}", feat, origin)

    cte(f"{p}trail", f"""
SELECT f.*, CASE WHEN n_recent > 0 THEN 'recent' ELSE 'last_rows' END AS trailing_branch FROM (
  SELECT {feat}.*, {feat}.date > a.anchor_date - 30 AS recent,
         sum(CASE WHEN {feat}.date > a.anchor_date - 30 THEN 1 ELSE 0 END)
             OVER (PARTITION BY channel, campaign_type) AS n_recent,
         row_number() OVER (PARTITION BY channel, campaign_type ORDER BY {feat}.date DESC) AS rn
  FROM {feat} CROSS JOIN {p}anchor AS a) AS f
WHERE recent OR (n_recent = 0 AND rn <= 30)""", feat, f"{p}anchor")

    cte(f"{p}base", f"""
SELECT channel, campaign_type, avg(spend) AS base_spend, avg(daily_budget) AS base_daily_budget,
       count(*) AS trailing_rows FROM {p}trail GROUP BY channel, campaign_type""", f"{p}trail")

    cte(f"{p}frame", f"""
SELECT b.channel, b.campaign_type, h.forecast_period_days, s.budget_scenario, s.multiplier,
       b.base_spend, b.base_daily_budget,
       b.base_spend * s.multiplier AS new_spend,
       b.base_spend * s.multiplier * h.forecast_period_days AS spend_input,
       CAST(a.anchor_date + CAST(h.forecast_period_days / 2 AS INTEGER) AS DATE) AS midpoint_date
FROM {p}base AS b CROSS JOIN horizons AS h CROSS JOIN scen AS s CROSS JOIN {p}anchor AS a""",
    f"{p}base", "horizons", "scen", f"{p}anchor")

    cte(f"{p}lin_g", f"""
SELECT channel, campaign_type, count(*) AS n_rows,
  CASE WHEN {SLOPE_revenue} IS NULL THEN avg(revenue) ELSE regr_intercept(revenue, spend) END AS ra,
  coalesce({SLOPE_revenue}, 0.0) AS rb,
  CASE WHEN {SLOPE_roas} IS NULL THEN avg(roas) ELSE regr_intercept(roas, spend) END AS sa,
  coalesce({SLOPE_roas}, 0.0) AS sb
FROM {feat} GROUP BY channel, campaign_type""", feat)

    cte(f"{p}lin_all", f"""
SELECT CASE WHEN {SLOPE_revenue} IS NULL THEN avg(revenue) ELSE regr_intercept(revenue, spend) END AS ra,
  coalesce({SLOPE_revenue}, 0.0) AS rb,
  CASE WHEN {SLOPE_roas} IS NULL THEN avg(roas) ELSE regr_intercept(roas, spend) END AS sa,
  coalesce({SLOPE_roas}, 0.0) AS sb
FROM {feat}""", feat)

    cte(f"{p}lin_model", f"""
SELECT g.channel, g.campaign_type, g.n_rows, g.n_rows >= 60 AS dedicated,
  CASE WHEN g.n_rows >= 60 THEN g.ra ELSE a.ra END AS ra, CASE WHEN g.n_rows >= 60 THEN g.rb ELSE a.rb END AS rb,
  CASE WHEN g.n_rows >= 60 THEN g.sa ELSE a.sa END AS sa, CASE WHEN g.n_rows >= 60 THEN g.sb ELSE a.sb END AS sb
FROM {p}lin_g AS g CROSS JOIN {p}lin_all AS a""", f"{p}lin_g", f"{p}lin_all")

    cte(f"{p}pools", f"""
SELECT f.channel || '__' || f.campaign_type AS pool, t.target,
       row_number() OVER (PARTITION BY f.channel, f.campaign_type, t.target ORDER BY f.date) - 1 AS pool_idx,
       CASE WHEN t.target = 'revenue' THEN f.revenue - (m.ra + m.rb * f.spend)
            ELSE f.roas - (m.sa + m.sb * f.spend) END AS residual
FROM {feat} AS f JOIN {p}lin_model AS m ON m.channel = f.channel AND m.campaign_type = f.campaign_type
CROSS JOIN targets AS t
UNION ALL
SELECT '__global__' AS pool, t.target,
       row_number() OVER (PARTITION BY t.target ORDER BY f.channel, f.campaign_type, f.date) - 1 AS pool_idx,
       CASE WHEN t.target = 'revenue' THEN f.revenue - (a.ra + a.rb * f.spend)
            ELSE f.roas - (a.sa + a.sb * f.spend) END AS residual
FROM {feat} AS f CROSS JOIN {p}lin_all AS a CROSS JOIN targets AS t""", feat, f"{p}lin_model", f"{p}lin_all", "targets")

    cte(f"{p}pool_n", f"SELECT pool, target, count(*) AS n FROM {p}pools GROUP BY pool, target", f"{p}pools")

    cte(f"{p}draws", f"""
SELECT pn.pool, pn.target, r.k, ((r.k * 1103515245 + 12345) % 2147483648) % pn.n AS pool_idx
FROM {p}pool_n AS pn CROSS JOIN (SELECT range AS k FROM range(0, 1000)) AS r""", f"{p}pool_n")

    cte(f"{p}sampled", f"""
SELECT d.pool, d.target, d.k, p.residual
FROM {p}draws AS d JOIN {p}pools AS p ON p.pool = d.pool AND p.target = d.target AND p.pool_idx = d.pool_idx""",
    f"{p}draws", f"{p}pools")


forecast_ctes("", "feat", "feat")
forecast_ctes("ev_", "ev_feat", "ev_feat")
forecast_ctes("evw_", "evw_feat", "evw_feat")
forecast_ctes("yr_", "yr_feat", "feat")


def interval_cte(name: str, frame: str, p: str = "") -> None:
    """Bootstrap p10/p50/p90 for the rows of ``frame`` (must have channel, campaign_type,
    forecast_period_days, budget_scenario, new_spend); models and pools are those with prefix ``p``."""
    cte(f"{name}_pred", f"""
SELECT fr.*, t.target,
       CASE WHEN t.target = 'revenue' THEN coalesce(m.ra, la.ra) + coalesce(m.rb, la.rb) * fr.new_spend
            ELSE coalesce(m.sa, la.sa) + coalesce(m.sb, la.sb) * fr.new_spend END AS pred,
       CASE WHEN coalesce(pn.n, 0) >= 30 THEN fr.channel || '__' || fr.campaign_type ELSE '__global__' END AS pool
FROM {frame} AS fr
LEFT JOIN {p}lin_model AS m ON m.channel = fr.channel AND m.campaign_type = fr.campaign_type
CROSS JOIN {p}lin_all AS la CROSS JOIN targets AS t
LEFT JOIN {p}pool_n AS pn ON pn.pool = fr.channel || '__' || fr.campaign_type AND pn.target = t.target""",
        frame, f"{p}lin_model", f"{p}lin_all", "targets", f"{p}pool_n")
    cte(f"{name}_iv", f"""
SELECT p.channel, p.campaign_type, p.forecast_period_days, p.budget_scenario,
  quantile_cont(CASE WHEN p.target = 'revenue' THEN greatest((p.pred + s.residual) * p.forecast_period_days, 0.0) END, 0.1) AS revenue_p10,
  quantile_cont(CASE WHEN p.target = 'revenue' THEN greatest((p.pred + s.residual) * p.forecast_period_days, 0.0) END, 0.5) AS revenue_p50,
  quantile_cont(CASE WHEN p.target = 'revenue' THEN greatest((p.pred + s.residual) * p.forecast_period_days, 0.0) END, 0.9) AS revenue_p90,
  quantile_cont(CASE WHEN p.target = 'roas' THEN least(greatest(p.pred + s.residual, 0.0), 50.0) END, 0.1) AS roas_p10,
  quantile_cont(CASE WHEN p.target = 'roas' THEN least(greatest(p.pred + s.residual, 0.0), 50.0) END, 0.5) AS roas_p50,
  quantile_cont(CASE WHEN p.target = 'roas' THEN least(greatest(p.pred + s.residual, 0.0), 50.0) END, 0.9) AS roas_p90
FROM {name}_pred AS p JOIN {p}sampled AS s ON s.pool = p.pool AND s.target = p.target
GROUP BY p.channel, p.campaign_type, p.forecast_period_days, p.budget_scenario""", f"{name}_pred", f"{p}sampled")
    cte(name, f"""
SELECT fr.*, iv.revenue_p10, iv.revenue_p50, iv.revenue_p90, iv.roas_p10, iv.roas_p50, iv.roas_p90
FROM {frame} AS fr JOIN {name}_iv AS iv
  ON iv.channel = fr.channel AND iv.campaign_type = fr.campaign_type
 AND iv.forecast_period_days = fr.forecast_period_days AND iv.budget_scenario = fr.budget_scenario""",
        frame, f"{name}_iv")


interval_cte("grp_pred", "frame")
interval_cte("ev_pred", "ev_frame", "ev_")
interval_cte("evw_pred", "evw_frame", "evw_")

cte("pred_rows", """
SELECT g.forecast_period_days, g.channel, g.campaign_type, g.revenue_p10, g.revenue_p50, g.revenue_p90,
       g.roas_p10, g.roas_p50, g.roas_p90, g.spend_input, g.budget_scenario,
       coalesce(s.summary, 'Causal summary not available.') AS causal_summary
FROM grp_pred AS g LEFT JOIN summ AS s ON s.scope = g.channel AND s.horizon = g.forecast_period_days""",
    "grp_pred", "summ")

cte("rollup_rows", f"""
SELECT forecast_period_days, 'all' AS channel, 'all' AS campaign_type, rp10 AS revenue_p10, rp50 AS revenue_p50,
       rp90 AS revenue_p90, {scalar_ratio('rp10', 'sp')} AS roas_p10, {scalar_ratio('rp50', 'sp')} AS roas_p50,
       {scalar_ratio('rp90', 'sp')} AS roas_p90, sp AS spend_input, budget_scenario,
       coalesce(s.summary, 'Aggregate causal summary not available.') AS causal_summary
FROM (SELECT forecast_period_days, budget_scenario, sum(spend_input) AS sp, sum(revenue_p10) AS rp10,
             sum(revenue_p50) AS rp50, sum(revenue_p90) AS rp90
      FROM grp_pred GROUP BY forecast_period_days, budget_scenario) AS t
LEFT JOIN summ AS s ON s.scope = 'all' AND s.horizon = t.forecast_period_days""", "grp_pred", "summ")

cte("predictions", "SELECT * FROM pred_rows UNION ALL SELECT * FROM rollup_rows", "pred_rows", "rollup_rows")

# ------------------------------------------------------------------ what-if and yield curve

cte("wi_mult", """
SELECT * FROM (VALUES ('google', CAST('1.2' AS DOUBLE)), ('meta', CAST('0.8' AS DOUBLE))) AS m(channel, multiplier)""")

cte("wi_frame", """
SELECT b.channel, b.campaign_type, CAST(60 AS BIGINT) AS forecast_period_days, 'what_if' AS budget_scenario,
       coalesce(m.multiplier, 1.0) AS multiplier, b.base_spend,
       b.base_spend * coalesce(m.multiplier, 1.0) AS new_spend,
       b.base_spend * coalesce(m.multiplier, 1.0) * 60 AS spend_input
FROM base AS b LEFT JOIN wi_mult AS m ON m.channel = b.channel""", "base", "wi_mult")

interval_cte("wi", "wi_frame")

cte("grid", """
SELECT i AS point, CASE WHEN i = 9 THEN 2.0 ELSE 0.5 + CAST(i AS DOUBLE) * (1.5 / 9) END AS multiplier
FROM (SELECT range AS i FROM range(0, 10)) AS g""")

cte("yc_frame", """
SELECT b.channel, b.campaign_type, CAST(60 AS BIGINT) AS forecast_period_days, 'grid_' || g.point AS budget_scenario,
       g.multiplier, b.base_spend, b.base_spend * g.multiplier AS new_spend,
       b.base_spend * g.multiplier * 60 AS spend_input
FROM base AS b CROSS JOIN grid AS g WHERE b.channel IN ('google', 'meta', 'bing')""", "base", "grid")

interval_cte("yc", "yc_frame")

cte("curve", """
SELECT channel, multiplier, sum(base_spend * multiplier * forecast_period_days) AS spend,
       sum(revenue_p50) AS revenue_p50
FROM yc GROUP BY channel, multiplier HAVING sum(base_spend * multiplier * forecast_period_days) > 0""", "yc")

cte("near", """
SELECT channel, count(*) AS points,
  arg_min(multiplier, (abs(multiplier - 1.0), multiplier)) AS m0,
  arg_min(spend, (abs(multiplier - 1.0), multiplier)) AS s0,
  arg_min(revenue_p50, (abs(multiplier - 1.0), multiplier)) AS r0,
  arg_min(multiplier, (abs(multiplier - 1.15), multiplier)) AS m1,
  arg_min(spend, (abs(multiplier - 1.15), multiplier)) AS s1,
  arg_min(revenue_p50, (abs(multiplier - 1.15), multiplier)) AS r1
FROM curve GROUP BY channel""", "curve")
