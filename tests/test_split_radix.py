"""Cuts by radix selection, also where one key is in a third of the rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from renewlens.operators import split as S


@pytest.fixture(scope="module")
def hot(spark):
    """One key in 30 % of the rows, further repeated keys, three classes and none."""
    return spark.range(4000).selectExpr(
        "CASE WHEN id % 10 < 3 THEN 'hot' WHEN id % 10 = 3 THEN concat('r', id % 50) ELSE concat('u', id) END AS user_id",
        "CASE WHEN id % 11 = 0 THEN NULL ELSE CAST(id % 3 AS INT) END AS is_renewal").checkpoint()


def plain_cuts(hot, sizes):
    """Test rows by plain ranks: rows of one key stay together, at the key that reaches the size."""
    by = Window.partitionBy("is_renewal").orderBy(S.split_hash(F.col("user_id"), 42), "user_id")
    keys = hot.groupBy("is_renewal", "user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("end", F.sum("n").over(by)).collect()
    return {(r["is_renewal"], r["user_id"]) for r in keys if r["end"] - r["n"] < sizes[r["is_renewal"]]}


@pytest.mark.parametrize("small,digits", [(50_000, 4), (1, 0), (1, 4), (100, 1)])
def test_cuts_of_repeated_keys(hot, monkeypatch, small, digits):
    monkeypatch.setattr(S, "SMALL_BUCKET", small)
    sizes = {r["is_renewal"]: r["class_test"] for r in S.class_allocation(hot, "is_renewal").collect()}
    got = S.stratified_split(hot, hex_digits=digits)
    assert got.count() == hot.count()
    test = {(r["is_renewal"], r["user_id"]) for r in got.where("part = 'test'").select("is_renewal", "user_id").distinct().collect()}
    assert test == plain_cuts(hot, sizes)
    assert got.groupBy("is_renewal", "user_id").agg(F.countDistinct("part").alias("n")).where("n > 1").isEmpty()


def test_no_rows_of_a_bucket_are_sorted(hot):
    """Windows run over counts only: none has the input's rows below it without an aggregate between."""
    keys = S._keys(hot, "is_renewal", "user_id", 42)
    counts = S._bucket_counts(keys, 4)
    assert counts.agg(F.sum("_n")).first()[0] == hot.count()
    inside = S._inside(keys, counts.withColumn("_rank", F.lit(1)).limit(3), 3, 4)
    by_key = inside.groupBy("_label", "_p", F.col("_me").alias("_q")).agg(F.count(F.lit(1)).alias("_n"))
    assert by_key.count() <= hot.select("user_id").distinct().count()


def test_many_classes_are_joined_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_ROWS", 3)
    df = spark.range(2000).selectExpr("id AS user_id", "CAST(id % 7 AS INT) AS is_renewal")
    sizes = {r["is_renewal"]: r["class_test"] for r in S.class_allocation(df, "is_renewal").collect()}
    got = S.stratified_split(df, fold_col="fold")
    assert {r[0]: r[1] for r in got.where("part = 'test'").groupBy("is_renewal").count().collect()} == sizes
    assert got.where("(part = 'test') <> (fold IS NULL)").isEmpty()


def test_empty_input(spark):
    df = spark.createDataFrame([], "user_id long, is_renewal int, _n int, _q int, _label int, _p int, _rank int, _id int")
    assert S.stratified_split(df, fold_col="fold").count() == 0 and S.stratified_folds(df).count() == 0


def test_columns_with_the_same_names(spark):
    df = spark.range(100).selectExpr("id AS user_id", "CAST(id % 2 AS INT) AS is_renewal", "7 AS _n", "8 AS _q", "9 AS _label", "1 AS _p", "2 AS _rank")
    got = S.stratified_split(df)
    assert got.columns == [*df.columns, "part"] and got.where("_n = 7 AND _label = 9 AND part = 'test'").count() == 20
