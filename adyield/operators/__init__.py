"""The relational stages, each a function DataFrame -> DataFrame: normalisation, aggregation, window
features, quality, statistics, scenarios, models and residual pools, bootstrap intervals, forecasts."""
