"""Vocabularies as tables, for category columns too wide for a driver-held indexer.

The distinct values of all columns are counted in one pass, dealt by range of (column, value),
and numbered by an offset for each partition plus a place inside it: no list of values passes
through the driver or one task. Rows are encoded by joining the table. Values get the places
that the indexer's sorted vocabulary gives them (by code point); unseen and null values share the
number behind the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Largest vocabulary that is sent to every task (rows); beyond it the table is joined by shuffle.
BROADCAST_VALUES = 10_000
# A value with at least one in so many rows is common: there can be no more such values than this.
COMMON_SHARE = 1_000
# Rows without a value to look up are dealt over so many keys.
SPREAD = 1 << 20


def vocabulary_table(df: DataFrame, columns) -> DataFrame:
    """``column, value, n, position``: every value of the columns, its rows, and its place from 0."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in columns]))
    counts = df.select(cells.alias("cell")).select("cell.*").where("value is not null").groupBy("column", "value")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.agg(F.count(F.lit(1)).alias("n")).repartitionByRange(parts, "column", "value")
    dealt = dealt.withColumn("_part", F.spark_partition_id()).checkpoint(eager=True)
    # One row for each partition and column: the values before it.
    before = Window.partitionBy("column").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("column", "_part").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("column", "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("column", "_part").orderBy("value")) - 1
    numbered = dealt.withColumn("_place", place).join(offsets, ["column", "_part"])
    return numbered.select("column", "value", "n", (F.col("_before") + F.col("_place")).alias("position")).checkpoint(eager=True)


def vocabulary_totals(vocabulary: DataFrame) -> dict[str, tuple[int, int]]:
    """Values and counted rows of each column."""
    rows = vocabulary.groupBy("column").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")).collect()
    return {r["column"]: (r["size"], r["total"]) for r in rows}


def _spread(df: DataFrame) -> Column:
    """A number from 1 that depends on the whole row."""
    cols = [F.col(f"`{n}`") for n, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    return F.pmod(F.xxhash64(*cols), F.lit(SPREAD)) + 1


def encode_by_table(df: DataFrame, vocabulary: DataFrame, columns, suffix: str = "_index",
                    broadcast_values: int = BROADCAST_VALUES) -> DataFrame:
    """``df`` with ``<c><suffix>`` (double): the value's position, or the vocabulary's size for unseen and null.

    A vocabulary of at most ``broadcast_values`` is sent to every task. Of a larger one only the
    common values are (at most ``COMMON_SHARE``, by their counts), so that no common value makes a
    hot key; the others meet the table by shuffle, and rows without one to look up are spread out.
    """
    totals = vocabulary_totals(vocabulary)
    for c in columns:
        size, total = totals.get(c, (0, 0))
        words = vocabulary.where(F.col("column") == c).select(F.col("value").alias("__value"), F.col("position").alias("__at"), "n")
        small = size <= broadcast_values
        common = words if small else words.where(F.col("n") * COMMON_SHARE >= F.lit(total))
        key = F.col(f"`{c}`")
        names = [F.col(f"`{n}`") for n in df.columns]
        out = df.join(F.broadcast(common.drop("n")), key == F.col("__value"), "left")
        if small:
            at = F.col("__at")
        else:
            sought = key.isNotNull() & F.col("__at").isNull()
            out = out.withColumn("__key", F.struct(F.when(sought, key).alias("value"), F.when(sought, 0).otherwise(_spread(df)).alias("spread")))
            rare = words.where(F.col("n") * COMMON_SHARE < F.lit(total))
            rare = rare.select(F.struct(F.col("__value").alias("value"), F.lit(0).cast("bigint").alias("spread")).alias("__word"), F.col("__at").alias("__rare"))
            out = out.join(rare, F.col("__key") == F.col("__word"), "left")
            at = F.coalesce("__at", "__rare")
        df = out.select(*names, F.coalesce(at, F.lit(size)).cast("double").alias(f"{c}{suffix}"))
    return df
