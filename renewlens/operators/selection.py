"""Projections, filters and predicates.

Column-set logic runs on the driver over the schema only (no job); the
row work is plain ``select`` / ``filter`` / ``na.drop`` that Catalyst prunes
and pushes to the scan.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config


def require_columns(df: DataFrame, required) -> None:
    """Raise when a required column is absent (schema check, no job)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")


def ensure_not_empty(df: DataFrame, what: str = "input") -> None:
    """Raise when a frame has no rows (``isEmpty`` reads one row)."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")


def drop_missing(df: DataFrame, subset) -> DataFrame:
    """Drop rows null (or NaN, for numeric columns) in any listed column."""
    return df.na.drop(how="any", subset=list(subset))


def excluded_columns(target_col: str = config.TARGET_COLUMN, exclude=None) -> list[str]:
    extra = config.FEATURE_EXCLUDE_COLUMNS if exclude is None else list(exclude)
    return [target_col, *config.BASE_EXCLUDE_COLUMNS, *extra]


def select_feature_names(columns, target_col: str = config.TARGET_COLUMN, include=None, exclude=None) -> list[str]:
    """B1: include list (absent names warned and skipped) or every column,
    minus the base and configured excludes; excludes beat includes."""
    drop = set(excluded_columns(target_col, exclude))
    include = config.FEATURE_INCLUDE_COLUMNS if include is None else include
    if include is not None:
        absent = [c for c in include if c not in columns]
        if absent:
            warnings.warn(f"configured feature columns not in the data: {', '.join(absent)}")
        return [c for c in include if c in columns and c not in drop]
    return [c for c in columns if c not in drop]


def align_columns(df: DataFrame, names, types: dict | None = None) -> DataFrame:
    """The stored feature list in stored order; absent columns become
    typed nulls (the evident intent of the original's fill)."""
    types = types or {}
    cols = []
    for name in names:
        if name in df.columns:
            cols.append(F.col(name))
        else:
            dtype = types.get(name, T.DoubleType())
            cols.append(F.lit(None).cast(dtype).alias(name))
    return df.select(*cols)


def check_threshold(threshold: float) -> float:
    """A threshold lies in [0, 1]."""
    if threshold is None or not (0.0 <= float(threshold) <= 1.0):
        raise ValueError("threshold must be between 0 and 1")
    return float(threshold)


def predict_label(prob: Column | str, threshold: float = config.DEFAULT_THRESHOLD) -> Column:
    """P >= t -> 1 else 0 (an explicit t beats the stored one)."""
    p = F.col(prob) if isinstance(prob, str) else prob
    return (p >= F.lit(check_threshold(threshold))).cast("int")


def columns_matching(df: DataFrame, fragments) -> list[str]:
    """Names containing any of the fragments, in frame order."""
    return [c for c in df.columns if any(f in c for f in fragments)]
