"""Exact stratified holdout split and stratified K folds.

Rows of a class are ordered by ``md5(key || '-' || seed)``, then key; the first
n_c of each class form the test part, the ranks after them the folds in turn.
Class test sizes follow the library rule: n_test = ceil(share * n), the training
size n - n_test is shared among classes in proportion to their counts (floors,
then the largest remainders), and each class's test size is what remains. Fold
sizes are the library's, too: training rows dealt in turn, class after class.

Scale: no row is moved and the input is computed twice. The first pass writes (label, key);
cuts are found there by radix selection: counts per (class, first ``hex_digits`` of the hash)
tell the one bucket that holds each cut, that bucket alone is counted by further digits, and
once it has at most ``SMALL_BUCKET`` rows (or the digits part every key from the next) by key.
Nothing but counts is ever sorted, and a key that is repeated in a third of the rows is one
count. The second pass compares every row with its class's cuts (a few values) where it lies.

Missing values: a null label is a class of its own; null keys raise with their
number, as no order would hold them in place. Rows of one key stay together, so a
part can miss its size by their number.
"""

from __future__ import annotations

import math
import uuid
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..session import ensure_checkpoint_dir, scratch_path

PART_TRAIN, PART_TEST = "train", "test"
#: A bucket of at most so many rows is counted by key.
SMALL_BUCKET = 50_000
#: Hash digits that a further count adds, and those that part any keys there are.
STEP_DIGITS, MOST_DIGITS = 4, 16
#: Tables of wanted ranks and of classes up to this size are broadcast.
BROADCAST_ROWS = 10_000


def split_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{int(seed)}")))


def class_test_sizes(class_counts: dict, test_size: float) -> dict:
    """Per-class test sizes (train share first, largest remainders, ties by class)."""
    n = sum(class_counts.values())
    if n == 0:
        return {k: 0 for k in class_counts}
    if isinstance(test_size, float) and test_size < 1:
        n_test = math.ceil(test_size * n)
    else:
        n_test = int(test_size)
    n_train = n - n_test
    classes = sorted(class_counts)
    cont = {c: Fraction(class_counts[c] * n_train, n) for c in classes}
    floors = {c: math.floor(cont[c]) for c in classes}
    need = n_train - sum(floors.values())
    by_rem = sorted(classes, key=lambda c: (-(cont[c] - floors[c]), c))
    for c in by_rem[:need]:
        floors[c] += 1
    return {c: class_counts[c] - floors[c] for c in classes}


def _keys(df: DataFrame, label_col: str, key_col: str, seed: int) -> DataFrame:
    """(_label, _me) of every row, written once; ``_me`` is the sort key (hash, key)."""
    spark = df.sparkSession
    path = scratch_path(spark, f"split-{uuid.uuid4().hex}")
    slim = df.select(F.col(label_col).alias("_label"), F.col(key_col).alias("_key"))
    slim.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(slim.schema).parquet(path).select("_label", _sort_key(F.col("_key"), seed).alias("_me"))


def _sort_key(key: Column, seed: int) -> Column:
    h = split_hash(key, seed)
    return F.struct(h.alias("h"), F.when(h.isNotNull(), key).alias("k"))


def _digits(n: int) -> Column:
    return F.substring("_me.h", 1, n)


def _small(df: DataFrame) -> DataFrame:
    """A table of counts, kept in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _met(df: DataFrame, few: DataFrame, n: int, on) -> DataFrame:
    """Inner join with a table of ``n`` rows (wanted ranks or classes); broadcast while they are few."""
    return df.join(F.broadcast(few) if n <= BROADCAST_ROWS else few, on)


def _bucket_counts(keys: DataFrame, hex_digits: int) -> DataFrame:
    """(_label, _q, _n): rows per (class, hash bucket), at most classes x 16^hex_digits."""
    counts = _small(keys.groupBy("_label", _digits(hex_digits).alias("_q")).agg(F.count(F.lit(1)).alias("_n")))
    lost = counts.where("_q IS NULL").agg(F.sum("_n")).first()[0]
    if lost:
        raise ValueError(f"{lost} rows have no key: they cannot be split reproducibly")
    return counts


def _locate(counts: DataFrame, wanted: DataFrame, n: int, within: list[str]) -> DataFrame:
    """The row of ``counts`` (_label, within, _q, _n) that holds each wanted (_label, within, _rank), as
    (_label, _id, _q, _n, _rank inside it)."""
    before = Window.partitionBy("_label", *within).orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumnsRenamed({c: f"{c}_c" for c in ("_label", *within)})
    on = (F.col("_rank") > F.col("_off")) & (F.col("_rank") <= F.col("_off") + F.col("_n"))
    for c in ("_label", *within):
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_c"))
    return _met(placed, wanted, n, on).select("_label", "_id", "_q", "_n", (F.col("_rank") - F.col("_off")).alias("_rank"))


def _cuts(keys: DataFrame, counts: DataFrame, wanted: DataFrame, label_col: str, digits: int) -> tuple[DataFrame, int]:
    """((_cl, _cuts) per class: the sort keys at the ranks ``wanted`` (class, _rank), ascending; number of classes).

    A rank of 0 gives a key below all rows.
    """
    wanted = _small(wanted.select(F.col(label_col).alias("_label"), "_rank").withColumn("_id", F.monotonically_increasing_id()))
    n, classes = wanted.count(), wanted.select("_label").distinct().count()
    held = _small(_locate(counts, wanted.where("_rank > 0"), n, []))
    while (held.agg(F.max("_n")).first()[0] or 0) > SMALL_BUCKET and digits < MOST_DIGITS:
        inside = _inside(keys, held, n, digits)
        digits = min(digits + STEP_DIGITS, MOST_DIGITS)
        finer = inside.groupBy("_label", "_p", _digits(digits).alias("_q")).agg(F.count(F.lit(1)).alias("_n"))
        held = _small(_locate(finer, held.select("_label", F.col("_q").alias("_p"), "_rank", "_id"), n, ["_p"]))
    by_key = _inside(keys, held, n, digits).groupBy("_label", "_p", F.col("_me").alias("_q")).agg(F.count(F.lit(1)).alias("_n"))
    found = _locate(by_key, held.select("_label", F.col("_q").alias("_p"), "_rank", "_id"), n, ["_p"]).select("_label", F.col("_q").alias("_me"))
    me = keys.schema["_me"].dataType
    lowest = F.struct(F.lit("").alias("h"), F.lit(None).cast(me["k"].dataType).alias("k")).cast(me)
    found = found.union(wanted.where("_rank = 0").select("_label", lowest.alias("_me")))
    return _small(found.groupBy(F.col("_label").alias("_cl")).agg(F.sort_array(F.collect_list("_me")).alias("_cuts"))), classes


def _inside(keys: DataFrame, held: DataFrame, n: int, digits: int) -> DataFrame:
    """The rows of the held buckets, with the bucket ``_p``."""
    spots = held.select(F.col("_label").alias("_hl"), F.col("_q").alias("_p")).distinct()
    return _met(keys, spots, n, F.col("_label").eqNullSafe(F.col("_hl")) & (_digits(digits) == F.col("_p")))


def _at(df: DataFrame, cuts: DataFrame, classes: int, label_col: str, key_col: str, seed: int) -> DataFrame:
    """Adds ``_at``: how many cuts of its class lie below a row (compared where the row lies)."""
    few = F.broadcast(cuts) if classes <= BROADCAST_ROWS else cuts
    rows = df.join(few, F.col(label_col).eqNullSafe(F.col("_cl")), "left").withColumn("_me", _sort_key(F.col(key_col), seed))
    below = F.size(F.filter(F.coalesce("_cuts", F.array().cast(cuts.schema["_cuts"].dataType)), lambda c: c < F.col("_me")))
    return rows.withColumn("_at", below).drop("_cl", "_cuts", "_me")


def _fold_ranks(alloc: DataFrame, label_col: str, n_splits: int, rows: str, offset: str, start) -> DataFrame:
    """(class, _rank): the last rank of every fold but the last, folds being rank ranges.

    Dealt in turn from ``offset``, fold f of a class gets the positions p in
    [offset, offset + rows) with p mod n_splits = f.
    """
    k = n_splits
    end = F.col(offset) + F.col(rows)
    total = None
    ranks = []
    for f in range(k - 1):
        size = F.floor((end - 1 - f + k) / k) - F.floor((F.col(offset) - 1 - f + k) / k)
        total = size if total is None else total + size
        ranks.append((start + total).cast("long"))
    return alloc.select(label_col, F.explode(F.array(*ranks)).alias("_rank")) if ranks else alloc.select(
        label_col, F.lit(0).cast("long").alias("_rank")).where("false")


def class_counts(df: DataFrame, label_col: str) -> dict:
    """Rows per class on the driver (bounded by the class count); for reports and tests."""
    return {r[0]: r[1] for r in df.groupBy(label_col).count().collect()}


def _allocate(c: DataFrame, label_col: str, test_size: float) -> DataFrame:
    """From a class table (label, _c): per class test size and fold offsets."""
    everything = Window.partitionBy(F.lit(0))
    n = F.sum("_c").over(everything)
    if isinstance(test_size, float) and test_size < 1:
        n_test = F.ceil(F.lit(float(test_size)) * n.cast("double")).cast("long")
    else:
        n_test = F.lit(int(test_size)).cast("long")
    t = c.withColumn("_n", n).withColumn("_n_train", F.col("_n") - n_test)
    # exact: c * n_train can pass 2^63 at ~10^10 rows per class, so decimal(38, 0)
    prod = F.col("_c").cast("decimal(38,0)") * F.col("_n_train").cast("decimal(38,0)")
    t = t.withColumn("_prod", prod)
    t = t.withColumn("_fl", F.expr("_prod div CAST(_n AS DECIMAL(38,0))").cast("long")) \
         .withColumn("_rem", F.col("_prod") % F.col("_n").cast("decimal(38,0)"))
    need = F.max("_n_train").over(everything) - F.sum("_fl").over(everything)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("_rem"), F.col(label_col))
    extra = F.when(F.row_number().over(order) <= need, F.lit(1)).otherwise(F.lit(0))
    t = t.withColumn("_n_test", F.col("_c") - F.col("_fl") - extra)
    before = Window.partitionBy(F.lit(0)).orderBy(label_col).rowsBetween(Window.unboundedPreceding, -1)
    return t.select(
        label_col,
        F.col("_c").alias("class_rows"),
        F.col("_n_test").alias("class_test"),
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("class_offset"),
        F.coalesce(F.sum(F.col("_c") - F.col("_n_test")).over(before), F.lit(0)).alias("train_offset"),
    )


def class_allocation(df: DataFrame, label_col: str, test_size: float = config.TEST_SIZE) -> DataFrame:
    """Per class: rows, test size and the offsets folds need, as a lazy frame.

    Same rule as ``class_test_sizes`` in exact integer arithmetic; the windows
    run over the class table (one row per class), never over the rows.
    """
    return _allocate(df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_c")), label_col, test_size)


def stratified_split(df: DataFrame, label_col: str = config.TARGET_COLUMN, key_col: str = config.ID_COLUMN,
                     test_size: float = config.TEST_SIZE, seed: int = config.RANDOM_STATE,
                     part_col: str = "part", hex_digits: int = 4, fold_col: str | None = None,
                     n_splits: int = config.HYPERPARAMETER_TUNING_CONFIG["cv"]) -> DataFrame:
    """E5: adds ``part`` ('train' / 'test') with exact per-class test sizes.

    The input is computed twice: for the labels and keys, and for the comparison. With
    ``fold_col`` the training rows also get their stratified fold from the same cuts (null
    for test rows).
    """
    keys = _keys(df, label_col, key_col, seed)
    counts = _bucket_counts(keys, hex_digits)
    alloc = _allocate(counts.groupBy(F.col("_label").alias(label_col)).agg(F.sum("_n").alias("_c")), label_col, test_size)
    wanted = alloc.select(label_col, F.col("class_test").cast("long").alias("_rank"))
    if fold_col:
        train = alloc.withColumn("_train", F.col("class_rows") - F.col("class_test"))
        wanted = wanted.union(_fold_ranks(train, label_col, n_splits, "_train", "train_offset", F.col("class_test")))
    out = _at(df, *_cuts(keys, counts, wanted, label_col, hex_digits), label_col, key_col, seed)
    out = out.withColumn(part_col, F.when(F.col("_at") == 0, F.lit(PART_TEST)).otherwise(F.lit(PART_TRAIN)))
    if fold_col:
        out = out.withColumn(fold_col, F.when(F.col("_at") > 0, F.col("_at") - 1).cast("int"))
    return out.drop("_at")


def stratified_folds(df: DataFrame, n_splits: int = config.HYPERPARAMETER_TUNING_CONFIG["cv"],
                     label_col: str = config.TARGET_COLUMN, key_col: str = config.ID_COLUMN,
                     seed: int = config.RANDOM_STATE, fold_col: str = "fold", hex_digits: int = 4) -> DataFrame:
    """Folds are ranges of class ranks with the library's per-class counts
    (sizes differ by at most one, per class and overall)."""
    keys = _keys(df, label_col, key_col, seed)
    counts = _bucket_counts(keys, hex_digits)
    alloc = _allocate(counts.groupBy(F.col("_label").alias(label_col)).agg(F.sum("_n").alias("_c")), label_col, 0)
    wanted = _fold_ranks(alloc, label_col, n_splits, "class_rows", "class_offset", F.lit(0))
    out = _at(df, *_cuts(keys, counts, wanted, label_col, hex_digits), label_col, key_col, seed)
    return out.withColumn(fold_col, F.col("_at").cast("int")).drop("_at")


def semi_join_part(df: DataFrame, split_df: DataFrame, key_col: str, part: str, part_col: str = "part") -> DataFrame:
    """Rows of ``df`` whose key is in the given part (left semi join)."""
    keys = split_df.where(F.col(part_col) == part).select(key_col)
    return df.join(keys, key_col, "left_semi")
