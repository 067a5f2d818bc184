"""Model, persistence, streaming and file sources (small tables for speed)."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from renewlens.operators import metrics as M
from renewlens.operators.split import PART_TEST, PART_TRAIN, stratified_split
from renewlens.plans.model import RenewalModel, train_model
from renewlens.plans.tuning import count_combinations, decode_candidate, sample_candidates, search
from renewlens.sources import files as FS
from renewlens.sources.renewal import renewal_df
from renewlens import config

TREES = {"maxIter": 8, "maxDepth": 4}


@pytest.fixture(scope="module")
def planted(spark):
    """Renewal rows with a label the features determine (a check that training learns)."""
    r = renewal_df(spark, SF_SMALL)
    y = ((F.coalesce("house_price", F.lit(9000.0)) + 300 * F.coalesce("fns_cnt", F.lit(0))) > 6000).cast("int")
    s = stratified_split(r.withColumn("is_renewal", y)).cache()
    return s.where(F.col("part") == PART_TRAIN).drop("part"), s.where(F.col("part") == PART_TEST).drop("part")


@pytest.fixture(scope="module")
def model(planted):
    train, _ = planted
    return train_model(train, None, config.MODEL_PARAMS, overrides=TREES)


def test_planted_label_learns(model, planted):
    _, test = planted
    auc = M.roc_auc(model.score(test), config.PROBABILITY_COLUMN, "is_renewal").first().roc_auc
    assert auc > 0.9


def test_score_columns_and_threshold(model, planted):
    _, test = planted
    s = model.score(test, threshold=0.0)
    assert s.columns == test.columns + ["pred_probability", "pred_label", "level_tag"]
    assert s.where("pred_label = 1").count() == test.count()
    # the input fns_cnt is returned as given, not capped
    assert s.where("fns_cnt > 4").count() == test.where("fns_cnt > 4").count()


def test_save_load_equal(spark, model, planted, tmp_path):
    _, test = planted
    model.set_threshold(0.4)
    path = model.save(str(tmp_path / "m"))
    loaded = RenewalModel.load(spark, path)
    assert loaded.get_threshold() == 0.4 and loaded.spec.features == model.spec.features
    a = model.score(test).select("user_id", F.col("pred_probability").alias("a"))
    b = loaded.score(test).select("user_id", F.col("pred_probability").alias("b"))
    assert a.join(b, "user_id").where("a <> b").count() == 0
    with pytest.raises(FileNotFoundError):
        RenewalModel.load(spark, str(tmp_path / "absent"))


def test_missing_columns_at_scoring(model, planted):
    _, test = planted
    s = model.score(test.drop("house_price", "device"))
    assert s.count() == test.count() and s.where("pred_probability IS NULL").count() == 0


def test_importance_covers_features(spark, model):
    imp = model.feature_importance(spark, None).collect()
    assert sorted(r.feature for r in imp) == sorted(model.spec.features)
    assert sum(r.importance for r in imp) == pytest.approx(1.0)


def test_batch_and_stream_equal(spark, model, planted, tmp_path):
    from renewlens.streaming.scoring import start_scoring

    _, test = planted
    recs = test.withColumn("user_id", F.col("user_id").cast("string"))
    FS.records_to_json(recs).repartition(3).write.text(str(tmp_path / "in"))
    q = start_scoring(spark, model, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out")).select("user_id", F.col("probability").alias("s"))
    batch = model.score(FS.read_records(spark, str(tmp_path / "in"))).select("user_id", F.col("pred_probability").alias("b"))
    j = streamed.join(batch, "user_id")
    assert j.count() == test.count() and j.where("abs(s - b) > 1e-12").count() == 0


def test_csv_null_tokens(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("user_id,city,house_price,grade,is_renewal\n1,NA,12.5,3,1\n2,x,N/A,null,0\n3,,bad,4,\n")
    df = FS.read_csv(spark, str(p), allow_unreadable=True).orderBy("user_id").collect()
    assert df[0].city is None and df[0].house_price == 12.5
    assert df[1].house_price is None and df[1].grade is None and df[1].city == "x"
    assert df[2].city is None and df[2].house_price is None and df[2].is_renewal is None


def test_records_drop_nulls(spark):
    df = spark.createDataFrame([("a", None, 3)], "city string, house_price double, grade int")
    js = FS.records_to_json(df).first().value
    assert "house_price" not in js
    back = FS.parse_records(FS.records_to_json(df)).first()
    assert back.city == "a" and back.house_price is None and back.grade == 3 and back.device is None


def test_search_space_sampling():
    space = config.HYPERPARAMETER_SEARCH_SPACE
    assert count_combinations(space) == 1_562_500  # 5^8 x 4
    picks = sample_candidates(space, 50, 42)
    assert len({tuple(sorted(p.items())) for p in picks}) == 50
    assert decode_candidate(space, 0) == {k: v[0] for k, v in space.items()}
    with pytest.raises(ValueError):
        search(None, space, method="bayes")


def test_empty_batch_refused(spark):
    with pytest.raises(ValueError):
        FS.require_nonempty_batch(spark.createDataFrame([], FS.RECORD_SCHEMA))


def test_patience_rule():
    from renewlens.plans.model import patience_stop

    assert patience_stop([.5, .6, .7, .65, .64, .63], 2) == 3      # stops 2 rounds after the best (index 2)
    assert patience_stop([.5, .6, .7, .8, .9], 30) == 5            # still improving: keep all
    assert patience_stop([.9, .8, .7, .95], 2) == 1                # later gains after the stop are not seen


def test_cut_model_equals_a_shorter_fit(planted):
    """The first trees of a fit are the fit with that many trees, and the prefix AUC is theirs."""
    from renewlens.plans.model import FEATURES_COL, LABEL_COL, first_trees, prefix_auc, prepare_input

    train, test = planted
    full = train_model(train, None, config.MODEL_PARAMS, overrides={"maxIter": 6, "maxDepth": 3})
    short = train_model(train, None, config.MODEL_PARAMS, overrides={"maxIter": 3, "maxDepth": 3})
    gbt = full.pipeline.stages[-1]
    full.pipeline.stages[-1] = first_trees(gbt, 3)
    cols = ["user_id", config.PROBABILITY_COLUMN]
    a, b = full.score(test).select(*cols), short.score(test).toDF(*[f"{c}_b" for c in short.score(test).columns])
    j = a.join(b, F.col("user_id") == F.col("user_id_b"))
    assert j.count() == test.count() and j.where(f"abs({cols[1]} - {cols[1]}_b) > 1e-12").count() == 0
    prepared = prepare_input(test)
    for stage in full.pipeline.stages[:-1]:
        prepared = stage.transform(prepared)
    data = prepared.select(FEATURES_COL, F.col("is_renewal").cast("double").alias(LABEL_COL))
    exact = M.roc_auc(short.score(test), config.PROBABILITY_COLUMN, "is_renewal").first().roc_auc
    values = prefix_auc(gbt, data)
    assert len(values) == 6 and abs(values[2] - exact) < 0.005


def test_threshold_from_parameters(planted):
    train, _ = planted
    m = train_model(train, None, {**config.MODEL_PARAMS, "threshold": 0.3}, overrides={"maxIter": 1, "maxDepth": 2})
    assert m.get_threshold() == 0.3


def test_text_columns_need_a_role(spark, planted):
    train, _ = planted
    with pytest.raises(ValueError, match="channel"):
        train_model(train.withColumn("channel", F.lit("web")), None, overrides={"maxIter": 1})
    m = train_model(train.withColumn("visits", F.col("grade") * 2.0), None, overrides={"maxIter": 1, "maxDepth": 2})
    assert "visits" in m.spec.numeric


def test_vocabulary_limit(spark):
    from renewlens.plans.features import check_vocabularies

    df = spark.range(500).selectExpr("CAST(id AS STRING) AS city")
    check_vocabularies(df, ["city"])
    with pytest.raises(ValueError, match="city"):
        check_vocabularies(df, ["city"], limit=300)


def test_repeated_scores_raise(spark):
    from renewlens.plans.model import attach_scores

    df = spark.createDataFrame([(1,), (2,)], "user_id int")
    with pytest.raises(ValueError, match="1 keys"):
        attach_scores(df, spark.createDataFrame([(1, .5), (1, .6), (2, .7)], "user_id int, p double"))


def test_ordinary_csv(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('user_id,city,grade,is_renewal,visits,note\n'
                 'u1,"a, ""b""\nc",5.0,1.0,3,x\nu2,NA,,0,4.5,"2"\nu3,z,7,,,9\n')
    rows = FS.read_csv(spark, str(p)).orderBy("user_id").collect()
    assert [(r.user_id, r.city, r.grade, r.is_renewal, r.visits, r.note) for r in rows] == [
        ("u1", 'a, "b"\nc', 5, 1, 3.0, "x"), ("u2", None, None, 0, 4.5, "2"), ("u3", "z", 7, None, None, "9")]
    p.write_text("user_id,grade\n1,5.5\n2,x\n3,4\n")
    with pytest.raises(ValueError, match=r"grade \(2\)"):
        FS.read_csv(spark, str(p))
    assert sorted(r.grade or 0 for r in FS.read_csv(spark, str(p), allow_unreadable=True).collect()) == [0, 0, 4]


def test_patience_stopping_keeps_at_most_requested(planted):
    from renewlens.plans.model import train_model

    train, test = planted
    m = train_model(train, test, config.MODEL_PARAMS, overrides={"maxIter": 12, "maxDepth": 3},
                    early_stopping_rounds=3)
    assert 1 <= m.trees <= 12
