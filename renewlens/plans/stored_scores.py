"""Scores stored for joining (C1): bucketed and sorted by key, each key once.

The write deals the scores by key, checks them where they lie and notes the key in the table's
properties; a later join needs no exchange and no check of the stored side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config

UNIQUE_KEY = "renewlens.unique_key"


def store_scores(scores: DataFrame, table: str, path: str, key: str = config.ID_COLUMN, buckets: int = 200) -> None:
    """Write ``scores`` as the new bucketed table ``table`` under ``path`` (a shared folder).

    Rows without a key match nothing and are not stored. A key with several scores raises, with the
    number of such keys, and the table is dropped; a table that exists already raises too.
    """
    spark = scores.sparkSession
    dealt = scores.where(F.col(key).isNotNull()).repartition(buckets, key)  # one file for each bucket
    dealt.write.format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    twice = spark.table(table).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").count()
    if twice:
        spark.sql(f"DROP TABLE {table}")
        raise ValueError(f"{twice} keys have more than one score")
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{UNIQUE_KEY}' = '{key}')")


def stored_key(spark: SparkSession, table: str) -> str | None:
    """The key that a table's scores were checked to hold once."""
    found = [r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect() if r["key"] == UNIQUE_KEY]
    return found[0] if found else None


def attach_stored_scores(df: DataFrame, table: str, key: str = config.ID_COLUMN) -> DataFrame:
    """All rows of ``df`` with their stored scores (left); the stored side is read bucket by bucket.

    A table not written by ``store_scores`` for this key, or with another type of key, raises: the
    join would repeat rows or deal the stored side anew.
    """
    spark = df.sparkSession
    if stored_key(spark, table) != key:
        raise ValueError(f"{table} is not known to hold one score for each {key}")
    scores = spark.table(table)
    if df.schema[key].dataType != scores.schema[key].dataType:
        raise ValueError(f"{key} is {df.schema[key].dataType.simpleString()}, stored as {scores.schema[key].dataType.simpleString()}")
    return df.join(scores, key, "left")
