"""Properties over the driver tables: split, folds, shares, AUC symmetry, plans."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_ORACLE, SF_SMALL
from renewlens import catalog as C
from renewlens.operators import analysis as A
from renewlens.operators import metrics as M
from renewlens.operators import split as S
from renewlens.sources.renewal import renewal_df


@pytest.fixture(scope="module")
def renewal(spark):
    return renewal_df(spark, SF_ORACLE).cache()


def test_split_exact_disjoint_complete(spark, renewal):
    s = S.stratified_split(renewal).cache()
    assert s.count() == renewal.count()
    assert s.select("user_id").distinct().count() == renewal.count()
    counts = S.class_counts(renewal, "is_renewal")
    want = S.class_test_sizes(counts, 0.2)
    got = {r[0]: r[1] for r in s.where("part = 'test'").groupBy("is_renewal").count().collect()}
    assert got == want


@pytest.mark.parametrize("digits", [0, 1, 4])
def test_cuts_equal_plain_ranks(spark, renewal, digits):
    w = Window.partitionBy("is_renewal").orderBy(S.split_hash(F.col("user_id"), 42), "user_id")
    plain = renewal.select("user_id", "is_renewal", F.row_number().over(w).alias("rank"))
    want = S.class_test_sizes(S.class_counts(renewal, "is_renewal"), 0.2)
    got = S.stratified_split(renewal, hex_digits=digits).select("user_id", "part").join(plain, "user_id").collect()
    assert len(got) == renewal.count()
    assert all((r.part == "test") == (r["rank"] <= want[r.is_renewal]) for r in got)


def test_split_moves_no_rows(spark, renewal):
    """Rows meet their cuts in broadcast joins; nothing is joined by a shuffle."""
    rows = spark.range(2000).selectExpr("id AS user_id", "CAST(id % 3 = 0 AS INT) AS is_renewal")
    split = S.stratified_split(rows, fold_col="fold")
    assert split.count() == 2000
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_split_and_folds_keep_rows_without_label(spark):
    df = spark.range(3000).selectExpr("concat('u', id) AS user_id", "CASE WHEN id % 10 = 0 THEN NULL ELSE CAST(id % 4 = 0 AS INT) END AS is_renewal")
    s = S.stratified_split(df)
    assert s.count() == 3000
    got = {r[0]: r[1] for r in s.where("part = 'test'").groupBy("is_renewal").count().collect()}
    assert sum(got.values()) == 600 and got[None] == 60
    f = S.stratified_folds(df, 5)
    assert {r[0]: r[1] for r in f.groupBy("fold").count().collect()} == {i: 600 for i in range(5)}
    with pytest.raises(ValueError, match="3 rows have no key"):
        S.stratified_split(df.union(spark.sql("SELECT CAST(NULL AS STRING), 1 FROM range(3)")))


def test_allocation_matches_reference_rule(spark):
    for counts in ({0: 10380, 1: 4620}, {0: 7, 1: 3}, {0: 1, 1: 1, 2: 5}, {0: 11, 1: 13}):
        df = spark.createDataFrame([(k,) for k, n in counts.items() for _ in range(n)], "y int")
        got = {r.y: r.class_test for r in S.class_allocation(df, "y", 0.2).collect()}
        assert got == S.class_test_sizes(counts, 0.2)


def test_fold_sizes_balanced(spark, renewal):
    f = S.stratified_folds(renewal, 5)
    per = f.groupBy("fold", "is_renewal").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in per if r.is_renewal == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    overall = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert max(overall) - min(overall) <= 1


def test_single_pass_folds_equal_separate_folds(spark, renewal):
    one = S.stratified_split(renewal, fold_col="fold", n_splits=5).where("part = 'train'")
    sep = S.stratified_folds(S.stratified_split(renewal).where("part = 'train'").drop("part"), 5)
    j = one.select("user_id", F.col("fold").alias("a")).join(sep.select("user_id", F.col("fold").alias("b")), "user_id")
    assert j.count() == one.count() and j.where("a <> b").count() == 0


def test_shares_sum_to_one(spark):
    mix = A.level_mix(C.scored(spark, SF_ORACLE), "l1_term_name", "level_tag")
    sums = mix.groupBy("l1_term_name").agg(F.sum("sample_ratio").alias("s")).collect()
    assert all(abs(r.s - 1.0) < 1e-9 for r in sums)


def test_auc_symmetry(spark):
    s = C.scored(spark, SF_ORACLE).select("is_renewal", "fns_cnt", "pred_probability")
    a = M.roc_auc(s, "fns_cnt", "is_renewal").first().roc_auc
    b = M.roc_auc(s.withColumn("neg", -F.col("fns_cnt")), "neg", "is_renewal").first().roc_auc
    assert a + b == pytest.approx(1.0)


def test_auc_matches_mllib_exact(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    s = C.scored(spark, SF_ORACLE).select(F.col("is_renewal").cast("double").alias("label"),
                                          F.col("fns_cnt").cast("double").alias("score")).na.drop()
    ours = M.roc_auc(s, "score", "label").first().roc_auc
    theirs = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(s)
    assert ours == pytest.approx(theirs, abs=1e-12)


@pytest.mark.parametrize("key", ["term_level_performance", "level_tags", "features_derived", "roc_auc",
                                 "stratified_split", "calibration_buckets"])
def test_no_python_stage(spark, key):
    df = E.queries()[key](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(s in plan for s in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "PythonUDF"))


def test_filters_and_columns_reach_scan(spark):
    df = E.queries()["drop_missing"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint" in plan
    assert "o_totalprice" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_next_order_day_equals_plain_lead_with_hot_customer(spark):
    """The per-(customer, day) form equals lead over (day, id) per customer,
    also when one customer holds a third of the rows and many share a day."""
    import random

    from renewlens.sources.renewal import next_order_day

    rng = random.Random(7)
    rows = []
    for oid in range(3000):
        cust = 0 if oid % 3 == 0 else rng.randint(1, 400)      # customer 0: a third of all orders
        day = rng.randint(0, 40) if cust == 0 else rng.randint(0, 900)
        rows.append((oid * 7 % 3001, cust, day))
    df = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, d int").select(
        "o_orderkey", "o_custkey", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")).alias("o_day"))
    ours = next_order_day(df).select("o_orderkey", F.col("_next_order_day").alias("a"))
    w = Window.partitionBy("o_custkey").orderBy("o_day", "o_orderkey")
    plain = df.select("o_orderkey", F.lead("o_day").over(w).alias("b"))
    j = ours.join(plain, "o_orderkey")
    assert j.count() == 3000
    assert j.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


def test_grouped_auc_many_groups_matches_single(spark):
    """Per-group AUC with 3,001 groups, one of them hot, equals per-group single runs."""
    from renewlens.operators import metrics as Mx

    rows = C.scored(spark, SF_SMALL).select("is_renewal", (F.col("user_id") * 31 % 997).alias("fns_cnt"), "user_id")
    copies = rows.select("is_renewal", "fns_cnt", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"), "user_id")
    s = copies.select("is_renewal", "fns_cnt", F.when(F.col("k") < 4, 0).otherwise((F.col("user_id") * 10 + F.col("k")) % 5000).alias("g"))
    many = {r.g: r.roc_auc for r in Mx.roc_auc(s, "fns_cnt", "is_renewal", ["g"]).collect()}
    assert len(many) == 3001
    some = {r.g: r.roc_auc for r in Mx.roc_auc(s.where("g < 5"), "fns_cnt", "is_renewal", ["g"]).collect()}
    for g, v in some.items():
        assert (v is None and many[g] is None) or abs(v - many[g]) < 1e-12


def test_renewal_same_rows_whatever_the_join(spark, tmp_path):
    """Orders without a date stay, with the customer broadcast or not."""
    import shutil

    for t in ("lineitem", "customer", "nation", "region"):
        shutil.copy(f"{SF_SMALL}/{t}.parquet", tmp_path)
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    date = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate"))
    o.withColumn("o_orderdate", date).write.parquet(str(tmp_path / "orders.parquet"))
    rows = {}
    for limit in ("-1", "64m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            rows[limit] = sorted(map(str, renewal_df(spark, str(tmp_path)).collect()))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows["-1"]) == o.count() and rows["-1"] == rows["64m"]
