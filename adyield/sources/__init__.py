"""Inputs and outputs: the driver tables as raw platform dialects (``fixtures``), directories of
platform CSV exports (``csv``), and the Parquet/CSV sinks and bundle tables (``sinks``)."""
