"""adyield: marketing performance forecasting as Spark DataFrame transformations.

Every public function takes and returns ``pyspark.sql.DataFrame`` objects, so the
stages compose with other Spark jobs:

    raw dialect tables -> canonical facts -> daily table -> features
        -> models and residual pools -> scenario forecasts -> rollups / what-if

Sub-packages:

* ``functions``  shared column expressions (ratios, clipping, calendar, text)
* ``sources``    raw inputs (CSV directories, driver tables) and sinks
* ``operators``  the relational stages (normalise, aggregate, windows, stats,
                 scenarios, bootstrap, rollup, models)
* ``plans``      end-to-end jobs and the query registry
* ``streaming``  incremental ingest of new raw files
"""

__version__ = "0.1.0"
