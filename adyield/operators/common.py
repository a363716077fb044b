"""Broadcast helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_row(df: DataFrame) -> DataFrame:
    """A global aggregate has exactly one row: a proven bound, so always broadcast."""
    return F.broadcast(df)


# Largest side (bytes) hinted for broadcast, and rows beyond which it is not even measured by its columns.
BROADCAST_MAX_BYTES = 32 << 20
TEXT_BYTES = 256


def row_bytes(df: DataFrame) -> int:
    """Bytes that one row of a reduced table may take: 16 per fixed-width column, ``TEXT_BYTES`` per other one."""
    fixed = {"long", "integer", "double", "float", "short", "byte", "boolean", "date", "timestamp"}
    return sum(16 if f.dataType.typeName() in fixed else TEXT_BYTES for f in df.schema.fields)


def broadcast_if_small(small: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast an aggregated side only after its size is checked (counted rows times the width of a row);
    above the bound the join shuffles and AQE splits skewed partitions. The result is the same either way.

    ``small`` must be a written table (``cut_lineage``): the count then reads file footers, not the plan behind it.
    """
    return F.broadcast(small) if small.count() * row_bytes(small) <= max_bytes else small
