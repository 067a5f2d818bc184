"""File sources and sinks.

* CSV with header and a declared schema: every field is read as text, the
  usual missing-value tokens become null, then each column is converted; values
  that do not read are counted and raise, unless they are allowed.
* JSON request records: one object per line; absent fields become null
  (the original dropped null fields before building its table).
* Sinks: ``DataFrameWriter`` to parquet / CSV, optionally partitioned by a
  low-cardinality column (term) so later reads prune partitions.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .requests import RECORD_SCHEMA, parse_records, read_records  # noqa: F401  the record half of A2

# fixed values: text tokens read as missing (the common CSV reader defaults)
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# training / test table (scoring input may lack is_renewal).
TRAINING_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("city_level", T.StringType()),
    T.StructField("city_score", T.DoubleType()),
    T.StructField("house_price", T.DoubleType()),
    T.StructField("grade", T.IntegerType()),
    T.StructField("refresh_num", T.IntegerType()),
    T.StructField("device", T.StringType()),
    T.StructField("is_enable", T.IntegerType()),
    T.StructField("fns_cnt", T.IntegerType()),
    T.StructField("b2c_term_name", T.StringType()),
    T.StructField("l1_term_name", T.StringType()),
    T.StructField("l1_term_renewal_end_date", T.StringType()),
    T.StructField("is_renewal", T.IntegerType()),
])

def unique_scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def _number(text: Column, dtype: T.DataType) -> Column:
    """Text to a number; whole numbers may be written as floats ("5.0"), as tools do when a column has gaps."""
    d = text.try_cast("double")
    if isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType)):
        return F.coalesce(text.try_cast(dtype), F.when(d == F.floor(d), d).try_cast(dtype))
    return d.cast(dtype) if isinstance(dtype, T.DoubleType) else text.try_cast(dtype)


def read_csv(spark: SparkSession, path: str, schema: T.StructType = TRAINING_SCHEMA, null_tokens=NULL_TOKENS,
             multi_line: bool = True, allow_unreadable: bool = False, infer_other: bool = True) -> DataFrame:
    """A1: header CSV -> typed frame; a missing path raises.

    Columns are matched by header name (not position), in file order; declared columns get
    their declared type. Other columns become numbers where every value is one
    (``infer_other``), else stay text. Quotes are doubled inside quotes. ``multi_line`` lets
    quoted values hold line breaks; files are then not divided between tasks, so turn it off
    for a few huge files without such values. Values that do not read as their type are
    counted in the pass that infers types and raise, unless ``allow_unreadable`` makes them null.
    """
    raw = (spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE")
           .option("quote", '"').option("escape", '"').option("multiLine", multi_line).csv(path))
    tokens = F.array(*[F.lit(t) for t in null_tokens])
    declared = {f.name: f.dataType for f in schema.fields}
    text = {c: F.when(~F.array_contains(tokens, F.col(f"`{c}`")), F.col(f"`{c}`")) for c in raw.columns}
    types = {c: declared.get(c, T.DoubleType() if infer_other else T.StringType()) for c in raw.columns}
    checked = [c for c in raw.columns if not isinstance(types[c], T.StringType)]
    if checked:
        bad = raw.agg(*[F.count_if(text[c].isNotNull() & _number(text[c], types[c]).isNull()).alias(f"n{i}")
                        for i, c in enumerate(checked)]).first()
        lost = {c: bad[i] for i, c in enumerate(checked) if bad[i]}
        types.update({c: T.StringType() for c in lost if c not in declared})
        lost = {c: n for c, n in lost.items() if c in declared}
        if lost and not allow_unreadable:
            raise ValueError("unreadable values: " + ", ".join(f"{c} ({n})" for c, n in sorted(lost.items())))
    return raw.select(*[(text[c] if isinstance(types[c], T.StringType) else _number(text[c], types[c])).alias(c)
                        for c in raw.columns])


def _save(writer: DataFrameWriter, path: str, fmt: str) -> None:
    """CSV as ``read_csv`` reads it: a header, quotes doubled inside quotes, text kept as it is."""
    if fmt == "csv":
        writer = writer.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    writer.format(fmt).save(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    _save(df.write.mode(mode), path, "csv")
    return path


def records_to_json(df: DataFrame, columns=None) -> DataFrame:
    """Rows -> one JSON object per row; null fields are left out."""
    cols = columns or [f.name for f in RECORD_SCHEMA.fields if f.name in df.columns]
    return df.select(F.to_json(F.struct(*[F.col(c) for c in cols])).alias("value"))


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None,
                      mode: str = "overwrite") -> str:
    """A4: input columns + pred_probability, pred_label, level_tag.

    Partitioned output is dealt by the partition columns first (a rebalance, so AQE splits a
    hot value into several files), else every task would write a file per value.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    _save(w, path, fmt)
    return path


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Small result tables (pivots, search results)."""
    _save(df.write.mode(mode), path, fmt)
    return path


def write_json_row(spark: SparkSession, obj: dict, path: str) -> str:
    """A one-row JSON document (best parameters, model metadata)."""
    spark.createDataFrame([(json.dumps(obj, sort_keys=True, default=str),)], "value string") \
        .coalesce(1).write.mode("overwrite").text(path)
    return path


def read_json_row(spark: SparkSession, path: str) -> dict:
    row = spark.read.text(path).first()
    return json.loads(row["value"]) if row else {}


def batch_response(scored: DataFrame, prob_col: str, level_col: str, keep=()) -> tuple[DataFrame, DataFrame]:
    """A10: per-row response (probability, level_tag, success) and the envelope
    counts (total, success_count). Rows stay rows; no list is gathered into one
    record. The jobs refuse an empty batch first (``require_nonempty_batch``)."""
    rows = scored.select(
        *keep,
        F.col(prob_col).cast("double").alias("probability"),
        F.col(level_col).alias("level_tag"),
        F.col(prob_col).isNotNull().alias("success"),
    )
    envelope = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("success_count"))
    return rows, envelope


def require_nonempty_batch(df: DataFrame) -> None:
    if df.isEmpty():
        raise ValueError("the batch of records is empty")
