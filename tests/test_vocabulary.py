"""Vocabularies as tables; C1: scores stored for joining."""

import pytest
from pyspark.sql import functions as F

from renewlens import config
from renewlens.plans import features
from renewlens.plans.features import fit_category_indexers
from renewlens.plans.model import RenewalModel, train_model
from renewlens.plans.stored_scores import attach_stored_scores, store_scores
from renewlens.plans.vocabulary import encode_by_table, vocabulary_table

VALUES = ["b", "a", "", None, "\u00e9", "a", "Z", "a" * 5000, "\U0001F600", "\ufffd", None]


def plain(values, column):
    """The position of each value among the sorted distinct ones; null and unseen: their number."""
    order = {v: i for i, v in enumerate(sorted({v for v in column if v is not None}))}
    return [float(order.get(v, len(order))) for v in values]


@pytest.mark.parametrize("limit", [0, 3, 100])
def test_positions_equal_sorted_places(spark, limit):
    rows = [(i, v, None if i % 2 else f"k{i}", 7) for i, v in enumerate(VALUES)]
    df = spark.createDataFrame(rows, "id int, city string, device string, value int")  # value: a name used inside
    seen = df.where("id <> 6")
    words = vocabulary_table(seen, ["city", "device"])
    got = encode_by_table(df, words, ["city", "device"], broadcast_values=limit).orderBy("id").collect()
    assert [r.city_index for r in got] == plain(VALUES, [r[1] for r in rows if r[0] != 6])
    assert [r.device_index for r in got] == plain([r[2] for r in rows], [r[2] for r in rows if r[0] != 6])
    assert [(r.id, r.city, r.device, r.value) for r in got] == rows
    none = encode_by_table(df, vocabulary_table(df.limit(0), ["city"]), ["city"], broadcast_values=limit)
    assert {r.city_index for r in none.collect()} == {0.0}


def test_hot_values_equal_the_indexer(spark):
    """A third of the rows null, a third of one value, the rest over many: places as the indexer's."""
    df = spark.range(6000).selectExpr("id", "CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'hot' ELSE 'v' || id END AS city")
    want = fit_category_indexers(df, ["city"]).transform(df).select("id", F.col("city_index").alias("w"))
    words = vocabulary_table(df, ["city"])
    assert words.count() == 2001 and words.where("position < 0 or position > 2000").isEmpty()
    got = encode_by_table(df, words, ["city"], broadcast_values=10)
    assert got.join(want, "id").where("city_index = w").count() == 6000


def test_million_categories(spark):
    df = spark.range(1_000_000).selectExpr("format_string('%07d', (id * 7919) % 1000000) AS city")
    got = encode_by_table(df, vocabulary_table(df, ["city"]), ["city"])
    assert got.where("city_index = CAST(city AS DOUBLE)").count() == 1_000_000


def test_model_with_a_wide_column(spark, tmp_path, monkeypatch):
    """A column over the indexer's limit trains, scores, saves and loads; unseen and absent values score too."""
    monkeypatch.setattr(features, "MAX_VOCABULARY", 20)
    rows = spark.range(400).selectExpr("cast(id as string) as user_id", "format_string('c%03d', id % 100) as city", "'d' || id % 3 as device",
                                       "cast(id % 7 as int) as grade", "cast(id % 100 >= 50 as int) as is_renewal").checkpoint()
    m = train_model(rows, overrides={"maxIter": 3, "maxDepth": 3}, early_stopping_rounds=None)
    assert m.spec.wide == ["city"] and m.spec.categorical == ["device"]
    assert m.feature_importance(spark, 1).first().feature == "city"  # the label follows the city's place
    p = config.PROBABILITY_COLUMN
    told = sorted(map(tuple, m.score(rows).select("user_id", p).collect()))
    assert all((x > 0.5) == (int(i) % 100 >= 50) for i, x in told)
    loaded = RenewalModel.load(spark, m.save(str(tmp_path / "m")))
    assert sorted(map(tuple, loaded.score(rows).select("user_id", p).collect())) == told
    assert m.score(rows).columns[: len(rows.columns)] == rows.columns
    odd = m.score(rows.withColumn("city", F.lit("unseen"))).select(p).distinct().union(m.score(rows.drop("city")).select(p).distinct())
    assert odd.where(f"{p} is null").isEmpty()


def test_stored_scores(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scores = spark.range(1000).selectExpr("cast(id as string) as user_id", "id / 1000.0D as p")
        scores = scores.union(spark.sql("select cast(null as string), 0.5D"))
        store_scores(scores, "scores_once", str(tmp_path / "once"), buckets=4)
        df = spark.range(0, 1500, 3).selectExpr("cast(id as string) as user_id").union(spark.sql("select cast(null as string)"))
        got = attach_stored_scores(df, "scores_once")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # the rows' side alone
        rows = {r.user_id: r.p for r in got.collect()}
        assert len(rows) == 501 and rows["999"] == 0.999 and rows["1002"] is None and rows[None] is None
        with pytest.raises(ValueError, match="1 keys"):
            store_scores(scores.union(scores.where("user_id = '7'")), "scores_twice", str(tmp_path / "twice"), buckets=4)
        assert not spark.catalog.tableExists("scores_twice")
        with pytest.raises(ValueError, match="not known"):
            attach_stored_scores(df, "scores_once", key="p")
        with pytest.raises(ValueError, match="stored as string"):
            attach_stored_scores(df.selectExpr("cast(user_id as long) as user_id"), "scores_once")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS scores_once")
