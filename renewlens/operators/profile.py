"""Data profile.

Each profile is a single aggregate pass (``count_if`` per column inside one
``agg``: one scan, partial aggregation, a one-row result), then reshaped on
that one row with ``unpivot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.features import is_nonfinite, numeric_columns


def basic_stats(df: DataFrame, target_col: str = config.TARGET_COLUMN) -> DataFrame:
    """Rows, target mean (null when absent), column count and list."""
    mean = F.avg(F.col(target_col).cast("double")) if target_col in df.columns else F.lit(None).cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        mean.alias("target_mean"),
    ).select(
        "n_rows", "target_mean",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(", ".join(df.columns)).alias("column_list"),
    )


def _missing(c: str, dtype) -> F.Column:
    col = F.col(c)
    if dtype in ("double", "float"):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def missing_counts(df: DataFrame, top_n: int | None = 5) -> DataFrame:
    """D2 + F1: missing count and percent per column with any missing values,
    most missing first (name breaks ties), top ``top_n`` (the report's top 5)."""
    types = dict(df.dtypes)
    wide = df.agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(_missing(c, types[c])).alias(c) for c in df.columns],
    )
    long = wide.unpivot("__n", list(df.columns), "column_name", "missing_count")
    out = long.where(F.col("missing_count") > 0).select(
        "column_name",
        F.col("missing_count").cast("long").alias("missing_count"),
        (F.col("missing_count") / F.col("__n") * F.lit(100.0)).alias("missing_pct"),
    ).orderBy(F.desc("missing_count"), F.asc("column_name"))
    return out.limit(top_n) if top_n else out


def split_balance(df: DataFrame, part_col: str, target_col: str = config.TARGET_COLUMN) -> DataFrame:
    """D3: size and positive rate of each part of a split."""
    return df.groupBy(part_col).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.col(target_col).cast("double")).alias("positive_rate"),
    )


def distinct_values(df: DataFrame, columns=None) -> DataFrame:
    """Distinct non-null values of each text column as (column_name, value).

    One pass: each row becomes its (column, value) pairs, then a single
    distinct (partial aggregation first, so repeated values collapse map-side).
    """
    cols = [c for c in (columns or config.CATEGORICAL_COLUMNS) if c in df.columns]
    pairs = F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols
    ]))
    return df.select(pairs).where(F.col("value").isNotNull()).distinct()


def nonfinite_counts(df: DataFrame, columns=None) -> DataFrame:
    """Per numeric column, how many values are +/-inf and how many NaN."""
    cols = numeric_columns(df, columns)
    aggs = []
    for c in cols:
        v = F.col(c).cast("double")
        aggs.append(F.count_if(F.abs(v) == F.lit(float("inf"))).alias(f"{c}__inf"))
        aggs.append(F.count_if(F.isnan(v)).alias(f"{c}__nan"))
    wide = df.agg(*aggs)
    stacked = F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__inf").alias("inf_count"), F.col(f"{c}__nan").alias("nan_count"))
        for c in cols
    ]))
    return wide.select(stacked)


def sanitize_report(df: DataFrame, columns=None) -> DataFrame:
    """H7 summary: per numeric column, values made missing and non-null left."""
    cols = numeric_columns(df, columns)
    aggs = []
    for c in cols:
        v = F.col(c)
        aggs.append(F.count_if(is_nonfinite(v)).alias(f"{c}__fix"))
        aggs.append(F.count_if(v.isNotNull() & ~is_nonfinite(v)).alias(f"{c}__ok"))
    wide = df.agg(*aggs)
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__fix").alias("n_made_missing"),
                 F.col(f"{c}__ok").alias("n_valid"))
        for c in cols
    ])))
