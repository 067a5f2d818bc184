"""Broadcast of tables whose size is bounded by construction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast a table whose size is bounded by construction (a rule list,
    a level list, a fixed-size dimension). Callers state the bound."""
    return F.broadcast(df)
