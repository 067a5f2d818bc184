"""End-to-end train / predict / tune jobs (I13) on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from renewlens.plans.jobs import predict_job, train_job, tune_job
from renewlens.sources.renewal import renewal_df

TINY = {"maxIter": 4, "maxDepth": 3}


def test_train_then_predict(spark, tmp_path):
    data = renewal_df(spark, SF_SMALL)
    out = str(tmp_path / "train")
    res = train_job(spark, data, out, overrides=TINY)
    assert res.frames["split_balance"].count() == 2
    assert res.frames["test_predictions"].count() == 300
    for name in ("calibration_buckets", "term_level_performance", "level_summary", "term_level_pivot",
                 "level_mix_pivot", "term_trend", "chart_bounds", "feature_importance", "evaluation_test"):
        assert name in res.paths, name
    assert spark.read.csv(res.paths["term_level_pivot_csv"], header=True).count() > 0

    unlabeled = data.drop("is_renewal")
    pres = predict_job(spark, res.paths["model"], unlabeled, str(tmp_path / "pred"), partition_by=["l1_term_name"])
    assert pres.frames["predictions"].count() == data.count()
    assert "calibration_buckets" not in pres.frames  # no label: label analyses skipped
    assert "level_mix" in pres.frames
    back = spark.read.parquet(pres.paths["predictions"])
    assert back.count() == data.count() and "level_tag" in back.columns


def test_tune_small(spark, tmp_path):
    data = renewal_df(spark, SF_SMALL)
    space = {"max_depth": [2, 3], "learning_rate": [0.1, 0.3]}
    res = tune_job(spark, data, str(tmp_path / "tune"), space=space,
                   tuning={"search_method": "grid", "cv": 2}, overrides={"maxIter": 3})
    summary = res.frames["cv_results"]
    assert summary.count() == 4
    assert {"param_max_depth", "param_learning_rate", "mean_test_score", "std_test_score",
            "rank_test_score", "mean_train_score"} <= set(summary.columns)
    assert summary.where(F.col("rank_test_score") == 1).count() >= 1
    comp = res.frames["comparison"].first()
    assert abs(comp.improvement - (comp.best_mean - comp.default_mean)) < 1e-12
    assert res.frames["holdout_comparison"].count() == 2


def test_train_without_leaks(spark):
    data = renewal_df(spark, SF_SMALL)
    res = train_job(spark, data, None, overrides=TINY, validation_fraction=0.25, vocabulary_on_all_rows=False)
    assert res.frames["test_predictions"].count() == 300
    assert res.frames["evaluation_test"].first().roc_auc is not None


def test_cli_train_and_predict_from_csv(spark, tmp_path):
    from renewlens.cli import main
    from renewlens.sources.files import write_csv

    csv = write_csv(renewal_df(spark, SF_SMALL), str(tmp_path / "raw_csv"))
    assert main(["train", "--input", csv, "--output", str(tmp_path / "t"), "--trees", "3", "--format", "csv"]) == 0
    test_csv = write_csv(renewal_df(spark, SF_SMALL).drop("is_renewal"), str(tmp_path / "test_csv"))
    assert main(["predict", "--model", str(tmp_path / "t" / "model"), "--input", test_csv, "--format", "csv",
                 "--output", str(tmp_path / "p"), "--partition-by-term"]) == 0
    assert spark.read.parquet(str(tmp_path / "p" / "predictions")).count() == 1500


def test_predictions_are_saved_before_labels_are_refused(spark, tmp_path):
    from renewlens.plans.jobs import predict_job, train_job

    r = renewal_df(spark, SF_SMALL)
    res = train_job(spark, r, str(tmp_path / "t"), overrides={"maxIter": 2, "maxDepth": 2})
    gaps = r.withColumn("is_renewal", F.when(F.col("user_id") % 5 != 0, F.col("is_renewal")))
    with pytest.raises(ValueError):
        predict_job(spark, res.paths["model"], gaps, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p" / "predictions")).count() == r.count()
    with pytest.raises(ValueError, match="empty"):
        predict_job(spark, res.paths["model"], r.limit(0))
