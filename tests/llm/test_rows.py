"""Rows that operators and stages must take as they come: letters, clashing names, ties."""

import random

from llm_data import sentence
from pyspark.sql import functions as F

from renewlens.llm import language_id

SMALL = "/root/testdata/sf0.001"


def test_letters_are_category_l():
    yes = ["a", "é", "中", "ʰ", "ß", "1a", "½b", "ж", "\u0e01"]
    no = ["½", "²", "①", "ⅷ", "٣", "5", "_", "-", "\U0001F600", "", "\u0301", "\ufffd"]
    assert all(language_id.has_letter(w.encode()) for w in yes)
    assert not any(language_id.has_letter(w.encode()) for w in no)


def test_near_duplicate_stage_keeps_columns_and_breaks_ties(spark):
    """Columns named like the stage's own come out as they went in; of rows of one id and text the smallest stays."""
    import corpus_pipeline

    rng = random.Random(6)
    base = sentence(rng, 40)
    rows = [(1, base, 9, 5, "b"), (1, base, 7, 6, "z"), (1, base, 7, 6, "a"), (2, base, 1, 1, "c"), (3, sentence(rng, 40), 4, 4, "d"),
            (3, "", 2, 2, "e"), (None, None, 3, 3, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _hash int, _first int, _c1 string").withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    for seed in (1, 2):
        got = corpus_pipeline.near_duplicates(spark, df.orderBy(F.rand(seed)).repartition(3), SMALL)
        assert got.columns == df.columns
        assert sorted((r["_hash"], r["_first"], r["_c1"]) for r in got.collect()) == [(2, 2, "e"), (3, 3, "f"), (4, 4, "d"), (7, 6, "a")]
