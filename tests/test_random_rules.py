"""Term keys and level rules against rows written out by hand."""

import pytest

from renewlens import config
from renewlens.functions.levels import level_tag
from renewlens.functions.terms import term_sort_columns

WINTER, SPRING, SUMMER, AUTUMN, NONE = range(5)

TERMS = [
    # term, year, season, period
    ("2023年秋季第5期", 2023, AUTUMN, 5),
    ("2024春12", 2024, SPRING, 12),
    ("秋2023寒3", 2023, WINTER, 3),
    ("22023026", 2023, NONE, 0),
    ("1995年秋季第10期", 0, AUTUMN, 1995),
    ("2023-2024暑2", 2023, SUMMER, 2),
    ("2020", 2020, NONE, 0),
    ("20201", 2020, NONE, 1),
    ("202020", 2020, NONE, 20),
    ("秋秋寒", 0, WINTER, 0),
    ("abc", 0, NONE, 0),
    ("x 7 春", 0, SPRING, 7),
    ("第03期2019年", 2019, NONE, 3),
    ("暑2001-", 2001, SUMMER, 0),
    ("期300寒1999", 0, WINTER, 300),
    ("", 0, NONE, 0),
    (None, 0, NONE, 0),
]


def test_term_keys(spark):
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TERMS)], "i int, t string")
    got = df.select("i", *term_sort_columns("t", "k")).orderBy("i").collect()
    for row, (term, year, season, period) in zip(got, TERMS):
        assert (row.k_year, row.k_season, int(row.k_period), row.k_text) == (year, season, period, term or ""), term


VALUES = [None, float("nan"), -0.1, 0.0, 0.05, 0.1, 0.15, 0.2, 0.5, 1.0, 1.5]

RULE_TABLES = [
    # rules, label of a missing value (None: the first rule's), expected labels of VALUES
    ([{"label": "a", "min_prob": 0.1}, {"label": "b"}], None, "a a b b b a a a a a a"),
    ([{"label": "a", "min_prob": 0.1, "min_inclusive": False}, {"label": "b", "max_prob": 0.1}], None, "a a b b b - a a a a a"),
    ([{"label": "a", "max_prob": 0.1, "max_inclusive": True}], "m", "m m a a a a - - - - -"),
    ([{"label": "a", "min_prob": 0.05, "max_prob": 0.2}, {"label": "b", "min_prob": 0.1, "max_prob": 1.0, "max_inclusive": True}],
     None, "a a - - a a a b b b -"),
    ([{"label": "a", "min_prob": 0.5, "max_prob": 0.1}, {"label": "b", "min_prob": 0.2, "max_prob": 0.2}], "m", "m m - - - - - - - - -"),
    ([{"label": "a", "min_prob": 0.2, "max_prob": 0.2, "max_inclusive": True}], "m", "m m - - - - - a - - -"),
    (config.LEVEL_TAG_RULES, None, "S S D D B A A S S S S"),
]


@pytest.mark.parametrize("rules,missing,want", RULE_TABLES)
def test_level_rules(spark, rules, missing, want):
    df = spark.createDataFrame(list(enumerate(VALUES)), "i int, p double")
    told = {} if missing is None else {"missing_label": missing}
    got = [r.t for r in df.select("i", level_tag("p", rules, "-", **told).alias("t")).orderBy("i").collect()]
    assert got == want.split()
