"""Small tables and fixtures shared by the operator tests."""

import os
import random

import pytest

SF_ORACLE = os.environ.get("RENEWLENS_TEST_SF", "/root/testdata/sf0.01")

#: Names that operators use inside; as extra input columns they must neither clash nor matter.
CLASHING = "_id _text _row _c0 _k0 node sig n_shingles label part ids off n shard size block slot score rare spans base added v levels".split()

WORDS = "the of and river stone light paper garden winter summer window music letter silver table morning".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text) with null ids and texts, empty and blank texts, repeated rows, copies and a long text."""
    rng = random.Random(4)
    base = [sentence(rng, 60) for _ in range(6)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(10, base[0]), (11, base[0] + " end"), (12, None), (13, ""), (14, " \n\t "), (15, "Stone"), (16, "...!?")]
    out += [(17, "café naïve 中文 \U0001F600 mail a.b@c.de now"), (18, sentence(rng, 20000)), (12, None), (3, base[3]), (None, base[4]), (None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return with_extras(spark.createDataFrame(rows, "doc_id long, text string"))


def with_extras(df):
    from pyspark.sql import functions as F

    return df.select(*df.columns, *[F.lit(7).alias(c) for c in CLASHING if c not in df.columns])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def key(row):
    return tuple((x is not None, x) for x in row)
