"""Summary text as column expressions (F13-F16): templates and model prompts.

Everything is ``concat``/``format_string`` over columns, so a summary table of
any size is built inside the JVM. Ratios use ``%.2f``; Spark rounds the short
decimal form half up where Python rounds the binary value (T6).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import capitalize, col_

# The template summaries (channel scope and whole portfolio).
CHANNEL_TEMPLATE = (
    "Based on historical data, {channel} shows a {trend} revenue trend with "
    "an average ROAS of {roas}x over the past 30 days. Monitor {top} "
    "campaigns closely as they represent the highest revenue contribution."
)
PORTFOLIO_TEMPLATE = (
    "Across all marketing channels, performance shows an overall {trend} trend "
    "with a combined average ROAS of {roas}x over the last 30 days. Q4 historically "
    "drives 3-5x revenue — August spend decisions will affect Holiday performance. Strategic "
    "budget allocation across Google and Meta is recommended to maximize overall yield."
)
PORTFOLIO_SCOPES = ["all", "aggregate"]

# The request texts for a summary model (channel scope and whole portfolio).
CHANNEL_PROMPT = (
    "Channel: {channel}\n"
    "Campaign types: {types}\n"
    "Avg ROAS last 30 days: {roas_30d}x\n"
    "Avg ROAS last 90 days: {roas_90d}x\n"
    "Revenue trend: {trend}\n"
    "Top campaign type by revenue: {top}\n"
    "Total revenue last 90 days: ${revenue_90d}\n"
    "Anomaly dates: {anomalies}\n"
    "Forecast window: {window} days\n\n"
    "Provide a 2-3 sentence business insight explaining the performance trend and key risks or opportunities "
    "for the next {window} days. Be specific to this channel's data."
)
PORTFOLIO_PROMPT = (
    "Channel: Combined Portfolio (All Channels)\n"
    "Campaign types represented: {types}\n"
    "Combined Avg ROAS last 30 days: {roas_30d}x\n"
    "Combined Avg ROAS last 90 days: {roas_90d}x\n"
    "Portfolio Revenue trend: {trend}\n"
    "Top campaign type overall: {top}\n"
    "Total portfolio revenue last 90 days: ${revenue_90d}\n"
    "Anomaly dates: {anomalies}\n"
    "Forecast window: {window} days\n\n"
    "Provide a 3-4 sentence overall business narrative explaining the portfolio-wide performance, "
    "risks, and Q4 preparation opportunities for the next {window} days."
)

# Defaults when no summary exists for a key (J3, per caller).
MISSING_CHANNEL_SUMMARY = "Causal summary not available."
MISSING_PORTFOLIO_SUMMARY = "Aggregate causal summary not available."
NO_ANOMALIES = "None detected"
# The insight page's defaults, per scope.
MISSING_NARRATIVE = "Aggregate narrative not generated in model cache."
MISSING_INSIGHT = "{channel} summary not available in cache."


def ratio2(c: Column | str) -> Column:
    return F.format_string("%.2f", col_(c))


def _fill(template: str, values: dict[str, Column]) -> Column:
    """Split a ``{name}`` template into literal and column parts and concat them."""
    parts: list[Column] = []
    rest = template
    while rest:
        start = rest.find("{")
        if start < 0:
            parts.append(F.lit(rest))
            break
        if start:
            parts.append(F.lit(rest[:start]))
        end = rest.index("}", start)
        parts.append(values[rest[start + 1:end]])
        rest = rest[end + 1:]
    return F.concat(*parts)


def template_summary(scope: Column | str, roas_30d: Column | str, trend: Column | str,
                     top_type: Column | str) -> Column:
    """Template summary per channel, or the portfolio template for 'all'/'aggregate' (F14)."""
    scope, roas_30d, trend, top_type = col_(scope), col_(roas_30d), col_(trend), col_(top_type)
    channel_text = _fill(CHANNEL_TEMPLATE, {"channel": capitalize(scope), "trend": trend,
                                            "roas": ratio2(roas_30d), "top": top_type})
    portfolio_text = _fill(PORTFOLIO_TEMPLATE, {"trend": trend, "roas": ratio2(roas_30d)})
    return F.when(F.lower(scope).isin(*PORTFOLIO_SCOPES), portfolio_text).otherwise(channel_text)


def money0(c: Column | str) -> Column:
    """``{:,.0f}``: thousands separators, no decimals."""
    return F.format_number(col_(c), 0)


def prompt_text(scope: Column | str, types: Column | str, roas_30d: Column | str, roas_90d: Column | str,
                trend: Column | str, top_type: Column | str, revenue_90d: Column | str,
                horizon: Column | str, anomalies: Column | str) -> Column:
    """The request text a summary model would receive, per scope and horizon.

    ``types`` and ``anomalies`` are arrays of strings; empty anomalies -> "None detected".
    """
    scope = col_(scope)
    anom = col_(anomalies)
    values = {
        "channel": scope,
        "types": F.array_join(col_(types), ", "),
        "roas_30d": ratio2(roas_30d),
        "roas_90d": ratio2(roas_90d),
        "trend": col_(trend),
        "top": col_(top_type),
        "revenue_90d": money0(revenue_90d),
        "anomalies": F.when(F.size(anom) > 0, F.array_join(anom, ", ")).otherwise(F.lit(NO_ANOMALIES)),
        "window": col_(horizon).cast("string"),
    }
    return F.when(F.lower(scope).isin(*PORTFOLIO_SCOPES), _fill(PORTFOLIO_PROMPT, values)) \
        .otherwise(_fill(CHANNEL_PROMPT, values))


def report_label(channel: Column | str, campaign_type: Column | str) -> Column:
    """``CHANNEL - type`` chart label (F16)."""
    return F.concat(F.upper(col_(channel)), F.lit(" - "), col_(campaign_type))


def group_key(channel: Column | str, campaign_type: Column | str) -> Column:
    """``channel__type`` display key."""
    return F.concat_ws("__", col_(channel), col_(campaign_type))
