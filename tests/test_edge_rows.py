"""Edge rows (FIXTURES F7) with expected values written by hand."""

import math

import pytest
from pyspark.sql import functions as F

from renewlens import config
from renewlens.functions.features import derive_features, sanitize_numeric
from renewlens.functions.levels import level_tag, level_tag_sql
from renewlens.functions.terms import term_sort_columns
from renewlens.operators import analysis as A
from renewlens.operators import metrics as M
from renewlens.operators.selection import check_threshold, require_columns, select_feature_names

NAN = float("nan")


def _tags(spark, values, **kw):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, p double")
    rows = df.select("i", level_tag("p", **kw).alias("t")).orderBy("i").collect()
    return [r.t for r in rows]


def test_level_limits(spark):
    import numpy as np

    values = [0.011, 0.025, 0.08, 0.15, 0.0, 1.0, -0.3, NAN, None, float(np.float32(0.15))]
    assert _tags(spark, values) == ["D", "C", "B", "A", "D", "S", "D", "S", "S", "S"]
    unknown = _tags(spark, values, missing_label=config.DEFAULT_LEVEL_LABEL)
    assert unknown[7] == unknown[8] == config.DEFAULT_LEVEL_LABEL


def test_level_sql_matches_column(spark):
    values = [0.011, 0.025, 0.08, 0.15, 0.0, 1.0, -0.3, NAN, None, 0.0999]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, p double")
    df.createOrReplaceTempView("edge_levels")
    via_sql = [r.t for r in spark.sql(f"SELECT i, {level_tag_sql('p')} AS t FROM edge_levels ORDER BY i").collect()]
    assert via_sql == _tags(spark, values)


def test_rule_defaults_and_gaps(spark):
    rules = [{"label": "hi", "min_prob": 0.5}, {"label": "lo", "max_prob": 0.2}]
    # min inclusive and max exclusive by default; the gap gets the default label
    assert _tags(spark, [0.5, 0.2, 0.3, 0.1], rule_configs=rules) == ["hi", config.DEFAULT_LEVEL_LABEL,
                                                                      config.DEFAULT_LEVEL_LABEL, "lo"]
    with pytest.raises(ValueError):
        level_tag("p", rule_configs=[])


def test_bucket_edges(spark):
    df = spark.createDataFrame([(v,) for v in [0.29, 0.57, 0.999, 1.0, 1.2, -0.01]], "p double")
    got = [r.b for r in df.select(A.bucket_index("p").alias("b")).collect()]
    assert got == [28, 56, 99, 99, 99, 0]


def test_round_half_even(spark):
    df = spark.createDataFrame([(v,) for v in [0.00005, 0.00015, 0.00025, 0.12345, 0.12355]], "x double")
    got = [r.r for r in df.select(A.round_half_even(F.col("x")).alias("r")).collect()]
    assert got == [0.0, 0.0001, 0.0002, 0.1234, 0.1236]


def test_feature_recipes(spark):
    rows = [
        (1, -1.0, 10.0, 2, 9.0, 1, 0),   # log1p(-1) = -inf; ratio 10/0 = +inf
        (2, -2.0, 10.0, -1, 4.5, 1, 1),  # log NaN; fns/(grade+1) = 4.5/0 = +inf
        (3, 0.0, 0.0, 1, 5.0, 0, 2),
        (4, None, 10.0, 0, None, 1, 3),
        (5, 100.0, 10.0, 3, 4.0, 1, 2),
    ]
    df = spark.createDataFrame(rows, "user_id int, house_price double, city_score double, grade int, "
                                     "fns_cnt double, is_enable int, refresh_num int")
    d = derive_features(df)
    raw = {r.user_id: r for r in d.collect()}
    assert raw[1].house_price_log == float("-inf") and raw[1].city_score_house_price_ratio == float("inf")
    assert math.isnan(raw[2].house_price_log) and raw[2].fns_cnt_per_grade == float("inf")
    assert raw[2].city_score_house_price_ratio == -10.0
    assert raw[3].house_price_log == 0.0 and raw[3].city_score_house_price_ratio == 0.0
    # the cap runs last: interactions and ratios use the raw count
    assert raw[1].fns_cnt == 4.0 and raw[1].fns_cnt_per_grade == 3.0 and raw[1].refresh_fns_interaction == 0.0
    assert raw[2].fns_cnt == 4.5 and raw[3].fns_cnt == 4.0 and raw[5].fns_cnt == 4.0
    assert raw[4].fns_cnt is None and raw[4].house_price_log is None
    clean = {r.user_id: r for r in sanitize_numeric(d).collect()}
    assert clean[1].house_price_log is None and clean[1].city_score_house_price_ratio is None
    assert clean[2].house_price_log is None and clean[2].fns_cnt_per_grade is None
    assert clean[5].house_price_log == pytest.approx(math.log1p(100.0))


def test_recipes_skip_missing_inputs(spark):
    df = spark.createDataFrame([(1, 3.0)], "user_id int, fns_cnt double")
    d = derive_features(df)
    assert d.columns == ["user_id", "fns_cnt"]  # only the cap applies


def test_feature_selection_lists():
    cols = ["user_id", "city", "district", "city_score", "is_renewal", "l1_term_name", "house_price_log", "x"]
    assert select_feature_names(cols) == ["city", "city_score", "x"]
    with pytest.warns(UserWarning):
        got = select_feature_names(cols, include=["city", "district", "nope"])
    assert got == ["city"]  # excludes beat includes, absent names skipped


@pytest.mark.parametrize("term,key", [
    ("2023年秋季第5期", (2023, 3, 5)),
    ("2024春12", (2024, 1, 12)),
    ("秋2023寒3", (2023, 0, 3)),
    ("22023026", (2023, 4, 0)),
    ("1995年秋季第10期", (0, 3, 1995)),
    ("2023-2024暑2", (2023, 2, 2)),
    ("abc", (0, 4, 0)),
    ("", (0, 4, 0)),
    (None, (0, 4, 0)),
])
def test_term_sort_key(spark, term, key):
    df = spark.createDataFrame([(term,)], "t string")
    r = df.select(*term_sort_columns("t", "k")).first()
    assert (r.k_year, r.k_season, int(r.k_period)) == key
    assert r.k_text == (term or "")


def test_term_order_sorted(spark):
    terms = ["2016年春季第3期", "2015年秋季第12期", "2015年秋季第9期", "2016年寒季第1期", "abc"]
    df = spark.createDataFrame([(t,) for t in terms], "l1_term_name string")
    order = A.term_order_table(df, "l1_term_name").orderBy("term_order").collect()
    assert [r.l1_term_name for r in order] == ["abc", "2015年秋季第9期", "2015年秋季第12期", "2016年寒季第1期",
                                              "2016年春季第3期"]


def test_guards(spark):
    df = spark.createDataFrame([(0.1, None)], "p double, y int")
    with pytest.raises(ValueError):
        require_columns(df, ["p", "missing"])
    with pytest.raises(ValueError):
        A.check_no_missing(df, "p", "y")
    one_bucket = A.bucket_summary(spark.createDataFrame([(0.1, 1), (0.105, 0)], "p double, y int"), "p", "y")
    with pytest.raises(ValueError):
        A.check_calibration_buckets(one_bucket)
    with pytest.raises(ValueError):
        check_threshold(1.5)


def test_metrics_edges(spark):
    df = spark.createDataFrame([(0.2, 0), (0.3, 1), (0.3, 0), (0.4, 1)], "p double, y int")
    rep = M.evaluation_report(df, "p", "y", 0.5).first()
    assert rep.tp == 0 and rep.fp == 0 and rep.precision == 0.0 and rep.f1_score == 0.0
    # ties count half: pairs (pos, neg): (0.3,0.2) 1, (0.3,0.3) .5, (0.4,0.2) 1, (0.4,0.3) 1 -> 3.5/4
    assert rep.roc_auc == pytest.approx(0.875)
    one_class = spark.createDataFrame([(0.2, 1), (0.4, 1)], "p double, y int")
    assert M.roc_auc(one_class, "p", "y").first().roc_auc is None
