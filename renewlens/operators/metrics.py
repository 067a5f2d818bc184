"""Classification metrics.

Confusion counts and the derived rates are one aggregate pass. ROC-AUC and
the ROC curve are exact (ties count half): rows collapse to one row per
distinct score with positive and negative counts (partial aggregation), and
the running count of negatives below each score is a distributed prefix sum:
the distinct scores are dealt by range of (group, score) and checkpointed with
their partition's number, each (group, partition)'s totals give its offset, and a
window inside each adds the local running sum. No step holds a group's scores in
one task, however large the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from .selection import predict_label

def _y(label_col: str) -> Column:
    return F.col(label_col).cast("int")


def confusion_counts(df: DataFrame, label_col: str, pred_col: str) -> DataFrame:
    """One row: tn, fp, fn, tp."""
    y, p = _y(label_col), F.col(pred_col).cast("int")
    return df.agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def confusion_matrix(df: DataFrame, label_col: str, pred_col: str) -> DataFrame:
    """rows = true label, columns = predicted; long form, zero cells kept."""
    c = confusion_counts(df, label_col, pred_col)
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    return c.select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("true_label"), F.lit(p).alias("pred_label"), F.col(n).alias("n")) for t, p, n in cells
    ])))


def _safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def rates_from_counts(c: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 from counts; zero division -> 0."""
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    precision = _safe_div(tp, tp + fp)
    recall = _safe_div(tp, tp + fn)
    return c.select(
        "*",
        _safe_div(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _safe_div(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn).alias("f1_score"),
    )


def score_counts(df: DataFrame, score_col: str, label_col: str, group_cols=()) -> DataFrame:
    """One row per (group, distinct score): positives and negatives at that score."""
    y = _y(label_col)
    return (
        df.where(F.col(score_col).isNotNull() & ~F.isnan(F.col(score_col).cast("double")) & y.isNotNull())
        .groupBy(*group_cols, F.col(score_col).cast("double").alias("score"))
        .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    )


def checkpointed_score_counts(df: DataFrame, score_col: str, label_col: str, group_cols=()) -> DataFrame:
    """``score_counts`` dealt by range of (group, score), with the partition's number as
    ``_bucket``, written once to the shared checkpoint folder."""
    return dealt_counts(score_counts(df, score_col, label_col, group_cols), group_cols)


def dealt_counts(counts: DataFrame, group_cols=()) -> DataFrame:
    """A (group, score, pos, neg) table in the form that ``prefix_below`` takes."""
    from ..session import ensure_checkpoint_dir

    spark = counts.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.repartitionByRange(parts, *group_cols, "score")
    return dealt.withColumn("_bucket", F.spark_partition_id()).checkpoint(eager=True)


def prefix_below(counts: DataFrame, group_cols=()) -> DataFrame:
    """Adds pos_below / neg_below: totals over strictly smaller scores of the group.

    ``counts`` comes from ``checkpointed_score_counts``. Per (group, bucket) totals (at
    most one row per partition and one more per group) give each bucket's offset; a
    window inside each (group, bucket) adds the local sum.
    """
    g = list(group_cols)
    totals = counts.groupBy(*g, "_bucket").agg(F.sum("pos").alias("_pp"), F.sum("neg").alias("_pn"))
    before = Window.partitionBy(*g).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(g)], F.col("_bucket").alias("_ob"),
        F.coalesce(F.sum("_pp").over(before), F.lit(0)).alias("_op"),
        F.coalesce(F.sum("_pn").over(before), F.lit(0)).alias("_on"),
    )
    same = F.col("_bucket") == F.col("_ob")
    for i, c in enumerate(g):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    local = Window.partitionBy(*g, "_bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.join(offsets, same)
        .withColumn("pos_below", F.col("_op") + F.coalesce(F.sum("pos").over(local), F.lit(0)))
        .withColumn("neg_below", F.col("_on") + F.coalesce(F.sum("neg").over(local), F.lit(0)))
        .drop("_bucket", "_op", "_on", "_ob", *[f"_g{i}" for i in range(len(g))])
    )


def auc_from_counts(counts: DataFrame, group_cols=()) -> DataFrame:
    """ROC-AUC per group from a materialized (group, score, pos, neg) table."""
    g = list(group_cols)
    pb = prefix_below(counts, g)
    return pb.groupBy(*g).agg(
        F.sum(F.col("pos").cast("double") * (F.col("neg_below").cast("double") + F.col("neg").cast("double") / 2.0)).alias("_num"),
        F.sum("pos").alias("_p"),
        F.sum("neg").alias("_n"),
    ).select(
        *g,
        F.when((F.col("_p") > 0) & (F.col("_n") > 0),
               F.col("_num") / (F.col("_p").cast("double") * F.col("_n").cast("double"))).alias("roc_auc"),
    )


def roc_auc(df: DataFrame, score_col: str, label_col: str, group_cols=()) -> DataFrame:
    """``roc_auc`` per group (one row without groups); null with one class only."""
    return auc_from_counts(checkpointed_score_counts(df, score_col, label_col, group_cols), group_cols)


def roc_curve(df: DataFrame, score_col: str, label_col: str) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, predicting 1 for score >= threshold."""
    counts = checkpointed_score_counts(df, score_col, label_col)
    total = counts.agg(F.sum("pos"), F.sum("neg")).first()
    pb = prefix_below(counts).withColumns({"_P": F.lit(total[0] or 0), "_N": F.lit(total[1] or 0)})
    return pb.select(
        F.col("score").alias("threshold"),
        _safe_div(F.col("_N") - F.col("neg_below"), F.col("_N")).alias("fpr"),
        _safe_div(F.col("_P") - F.col("pos_below"), F.col("_P")).alias("tpr"),
    )


def confusion_from_counts(counts: DataFrame, threshold: float) -> DataFrame:
    """tn, fp, fn, tp at ``score >= threshold`` from a (score, pos, neg) table."""
    hit = F.col("score") >= F.lit(float(threshold))
    return counts.agg(
        F.coalesce(F.sum(F.when(~hit, F.col("neg"))), F.lit(0)).alias("tn"),
        F.coalesce(F.sum(F.when(hit, F.col("neg"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~hit, F.col("pos"))), F.lit(0)).alias("fn"),
        F.coalesce(F.sum(F.when(hit, F.col("pos"))), F.lit(0)).alias("tp"),
    )


def evaluation_report(df: DataFrame, score_col: str, label_col: str,
                      threshold: float = config.DEFAULT_THRESHOLD) -> DataFrame:
    """Threshold, confusion counts, rates and AUC of one scored table, one row.

    One pass over the rows: the distinct-score table (checkpointed) yields
    both the confusion cells and the AUC.
    """
    predict_label(score_col, threshold)  # validates the threshold
    counts = checkpointed_score_counts(df, score_col, label_col)
    rates = rates_from_counts(confusion_from_counts(counts, threshold))
    auc = auc_from_counts(counts).first()[0]
    return rates.select(F.lit(float(threshold)).alias("threshold"), "*", F.lit(auc).cast("double").alias("roc_auc"))
