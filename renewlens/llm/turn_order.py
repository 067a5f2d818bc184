"""Positions of rows inside their conversation, without gathering a conversation anywhere.

Rows are dealt by range of (key, order) and sorted where they land, so a key that holds a
third of all rows is spread over many tasks. Each task numbers its rows in one pass; only
keys that reach over a border of two ranges need an offset, at most one a border.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from renewlens.llm.common import python_columns, written


def _numberer():
    """From batches in order to the running number inside each run of equal keys."""
    part = TaskContext.get().partitionId()
    last, seen = None, 0

    def number(batch):
        nonlocal last, seen
        if batch.num_rows == 0:
            return {"_part": pa.array([], pa.int32()), "_local": pa.array([], pa.int64())}
        runs = pc.run_end_encode(batch.column("_key"))
        ends = runs.run_ends.to_numpy().astype(np.int64)
        keys = runs.values
        starts = np.concatenate([[0], ends[:-1]])
        local = np.arange(1, batch.num_rows + 1, dtype=np.int64) - np.repeat(starts, ends - starts)
        if keys[0].as_py() == last:
            local[: ends[0]] += seen
        last, seen = keys[-1].as_py(), int(local[-1])
        return {"_part": pa.array(np.full(batch.num_rows, part, np.int32)), "_local": pa.array(local)}

    return number


def numbered(rows: DataFrame, key: str, order: list[str], keep: list[str], name: str) -> DataFrame:
    """``keep`` of every row with ``_key``, ``_part`` (its range) and ``_n`` (from 1, by ``order``,
    nulls first, inside its key), written as a table. ``key`` holds no null. Rows that agree in key
    and order are dealt by a further running number, so that they are spread too.
    """
    by = [F.col(key).asc(), *[F.col(c).asc_nulls_first() for c in order], F.col("_tie").asc()]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    slim = dealt.select(F.col(key).alias("_key"), *keep)
    table = written(python_columns(slim, _numberer, "_part int, _local long", text=None), name)
    offsets = spans(table, F.max("_local").alias("_rows"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("_key", "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    # At most two rows a range: bounded by the number of partitions.
    met = table.join(F.broadcast(offsets), ["_key", "_part"], "left")
    return met.withColumn("_n", F.col("_local") + F.coalesce("_before", F.lit(0))).drop("_local", "_before")


def spans(table: DataFrame, *sums) -> DataFrame:
    """(_key, _part, sums) of the keys that lie in more than one range: at most two rows a range."""
    each = table.groupBy("_key", "_part").agg(*sums)
    ends = each.groupBy("_part").agg(F.min("_key").alias("a"), F.max("_key").alias("b"))
    # A key in two ranges is the last of one and the first of another.
    several = (ends.select(F.col("a").alias("_key"), "_part").union(ends.select("b", "_part")).distinct()
               .groupBy("_key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("_key"))
    return each.join(F.broadcast(several), "_key", "left_semi")
