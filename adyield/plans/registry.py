"""

Keys are the survey id plus a short name. Every query reads the driver
tables (or tables Spark derives from them) in full. Double columns are
rounded identically on both sides (``rnd`` / ``oracle.r``); the digits are
declared once per query. Queries without an oracle (trained tree models,
file listings) are checked on rows only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.exprs import rnd
from ..session import prepare
from .oracle import Spec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def finish(df: DataFrame, digits: dict[str, int] | None = None) -> DataFrame:
    """Round the declared double columns with the deterministic rounding (same dict as the oracle)."""
    digits = digits or {}
    out = []
    for f in df.schema.fields:
        if f.name in digits and isinstance(f.dataType, DoubleType):
            out.append(rnd(F.col(f"`{f.name}`"), digits[f.name]).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def register(key: str, sql: Spec | None = None, digits: dict[str, int] | None = None):
    """Register a Spark query and its oracle; both round the same declared columns."""
    merged = {**(sql.cols if sql is not None else {}), **(digits or {})}

    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return finish(fn(spark, sf_dir), merged)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        run.digits = merged
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql.build(merged)
        return fn
    return deco


def load_all() -> None:
    """Import the query modules (they register themselves)."""
    from . import queries_core, queries_forecast  # noqa: F401
