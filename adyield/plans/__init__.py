"""End-to-end jobs (``pipeline``) and the query registry with its DuckDB oracles
(``registry``, ``queries_core``, ``queries_forecast``, ``oracle``)."""
