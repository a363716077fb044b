"""Streaming: intentionally empty.

The reference has no stream, event-time window, watermark or stateful
operator; new data is handled by rerunning the batch jobs. Its statistics
are whole-table quantities (per-type budget medians, the global forecast
anchor, trailing 30-day windows), so an incremental variant would not give
the same results. Refreshing is done by rerunning ``plans.pipeline`` on the
new inputs; the feature table is the materialised boundary to recompute.
"""
