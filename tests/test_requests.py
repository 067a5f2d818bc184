"""Request records are accepted with types or refused with a reason, in batch and stream; A4 CSV sinks."""

import json

import pytest
from pyspark.sql import functions as F

from renewlens import config
from renewlens.sources import files as FS
from renewlens.sources import requests as RQ

# (raw text, reason or None, accepted fields that are not null)
CASES = [
    ('{"city":"a","grade":3}', None, {"city": "a", "grade": 3}),
    (' {"grade": 1e2, "house_price": "1e3"} ', None, {"grade": 100, "house_price": 1000.0}),
    ('{"grade":"3","fns_cnt":" 4 ","is_enable":true}', None, {"grade": 3, "fns_cnt": 4, "is_enable": 1}),
    ('{"grade":3.0,"city_score":false}', None, {"grade": 3, "city_score": 0.0}),
    ('{"city":"Zo\\u00eb \\"x\\" \\n","device":""}', None, {"city": 'Zoë "x" \n', "device": ""}),
    ('{"grade":null,"unknown":{"a":[1]}}', None, {}),
    ("{}", None, {}),
    ("not json", "malformed JSON", None),
    ('{"city":"a"', "malformed JSON", None),
    ('{"city":"a"} trailing', "malformed JSON", None),
    ('{"city":"a"} {"city":"b"}', "malformed JSON", None),
    ('{"city":"a"},{"city":"b"}', "malformed JSON", None),
    ('{"city":"a"}],0],[[1', "malformed JSON", None),
    ('{"city":"a","city":"b"}', "malformed JSON", None),
    ('{"house_price":NaN}', "malformed JSON", None),
    ("[1]", "not an object", None),
    ("null", "not an object", None),
    ('"text"', "not an object", None),
    ('{"city":5}', "city: not text", None),
    ('{"grade":"three"}', "grade: not a number", None),
    ('{"grade":[1]}', "grade: not a number", None),
    ('{"grade":3.5}', "grade: not a whole number", None),
    ('{"grade":2147483648}', "grade: out of range", None),
    ('{"grade":123456789012345678901234567890}', "grade: out of range", None),
    ('{"city":1,"house_price":"x","grade":0.5}', "city: not text; house_price: not a number; grade: not a whole number", None),
]


def test_records_accepted_or_refused(spark):
    df = spark.createDataFrame([(i, v) for i, (v, *_) in enumerate(CASES)], "row int, value string")
    checked = RQ.check_records(df)
    bad = {r["row"]: (r["value"], r["reason"]) for r in RQ.refused(checked).collect()}
    good = {r["row"]: {k: v for k, v in r.asDict().items() if v is not None and k != "row"} for r in RQ.accepted(checked).collect()}
    assert bad == {i: (v, why) for i, (v, why, _) in enumerate(CASES) if why}
    assert good == {i: row for i, (_, why, row) in enumerate(CASES) if not why}
    n = RQ.record_counts(checked).first()
    assert (n["total"], n["accepted"], n["refused"]) == (len(CASES), len(good), len(bad))
    told = {r["reason"]: r["records"] for r in RQ.reason_counts(checked).collect()}
    assert told["malformed JSON"] == 8 and told["grade: not a whole number"] == 2
    assert "Python" not in checked._jdf.queryExecution().executedPlan().toString()


def test_long_and_byte_ranges(spark):
    schema = "n long, b byte, f float"
    from pyspark.sql.types import StructType

    rows = [('{"n":9223372036854775807}', 9223372036854775807), ('{"n":9007199254740993}', 9007199254740993), ('{"n":9223372036854775808}', None),
            ('{"b":128}', None), ('{"n":1e30}', None)]
    df = spark.createDataFrame([(v,) for v, _ in rows], "value string")
    got = {r["_value"]: r for r in RQ.check_records(df, schema=StructType.fromDDL(schema)).collect()}
    for v, want in rows:
        assert (got[v]["_record"]["n"] == want) if want else got[v]["_reason"].endswith("out of range")


def test_a_batch_with_refused_records_raises_unless_they_are_kept(spark, tmp_path):
    (tmp_path / "in.json").write_text("\n".join(v for v, *_ in CASES) + "\n\n  \n")
    with pytest.raises(ValueError, match=r"malformed JSON \(8\)"):
        RQ.read_records(spark, str(tmp_path / "in.json"))
    rows = RQ.read_records(spark, str(tmp_path / "in.json"), refused_to=str(tmp_path / "refused"))
    assert rows.count() == 7 and rows.schema.fieldNames() == FS.RECORD_SCHEMA.fieldNames()
    assert spark.read.parquet(str(tmp_path / "refused")).count() == len(CASES) - 7
    assert RQ.read_records(spark, str(tmp_path / "in.json"), refused_to=str(tmp_path / "refused")).count() == 7


@pytest.fixture(scope="module")
def scorer(spark):
    from renewlens.plans.model import train_model

    rows = spark.range(300).selectExpr("cast(id as string) as user_id", "if(id % 3 = 0, 'x', 'y') as city", "cast(id % 7 as int) as grade",
                                       "cast(id % 100 as double) as house_price", "cast(id % 3 = 0 as int) as is_renewal")
    return train_model(rows, overrides={"maxIter": 3, "maxDepth": 2}, early_stopping_rounds=None)


def test_stream_scores_accepted_and_keeps_refused(spark, scorer, tmp_path):
    from renewlens.streaming.scoring import read_progress, read_refused, read_scores, start_scoring

    src = tmp_path / "in"
    src.mkdir()
    told = [json.dumps({"user_id": str(i), "city": "x", "grade": i % 5}) for i in range(40)]
    (src / "a.json").write_text("\n".join(told[:20] + [v for v, why, _ in CASES if why]))
    (src / "b.json").write_text("\n".join(told[20:]))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    start_scoring(spark, scorer, str(src), out, ck, max_files_per_trigger=1).awaitTermination()
    rows = read_scores(spark, out).collect()
    assert sorted(int(r["user_id"]) for r in rows) == list(range(40)) and all(r["success"] for r in rows)
    bad = read_refused(spark, out).collect()
    assert sorted((r["value"], r["reason"]) for r in bad) == sorted((v, why) for v, why, _ in CASES if why)
    progress = read_progress(spark, out)
    assert progress.count() == 2 and tuple(progress.agg(F.sum("accepted"), F.sum("refused")).first()) == (40, len(bad))
    # a restart goes on with what is new
    (src / "c.json").write_text(json.dumps({"user_id": "40"}))
    start_scoring(spark, scorer, str(src), out, ck).awaitTermination()
    assert read_scores(spark, out).count() == 41


def test_a_replayed_batch_adds_nothing(spark, scorer, tmp_path):
    from renewlens.streaming.scoring import read_progress, read_refused, read_scores, write_batch

    out = str(tmp_path / "out")
    batch = RQ.check_records(spark.createDataFrame([('{"user_id":"1"}',), ("bad",)], "value string"))
    write_batch(scorer, batch, 0, out)
    # a batch that stopped before its progress row is not read ...
    later = RQ.check_records(spark.createDataFrame([('{"user_id":"2"}',)], "value string"))
    write_batch(scorer, later, 1, out)
    done = next((tmp_path / "out" / "_progress" / "batch=1").glob("*.parquet"))
    done.unlink()
    assert [r["user_id"] for r in read_scores(spark, out).collect()] == ["1"]
    # ... and both replayed are there once
    for n, b in ((0, batch), (1, later), (1, later)):
        write_batch(scorer, b, n, out)
    assert sorted(r["user_id"] for r in read_scores(spark, out).collect()) == ["1", "2"]
    assert read_refused(spark, out).count() == 1
    assert sorted((r["batch"], r["accepted"], r["refused"]) for r in read_progress(spark, out).collect()) == [(0, 1, 1), (1, 1, 0)]


def test_csv_sinks_read_back(spark, tmp_path):
    """A4 / A5: both CSV sinks give back what they were given."""
    from pyspark.sql.types import StructType

    rows = [('a "b", c', 1.0, "x"), (" blanks ", 0.25, "y"), ("line\nbreak, \"q\"", 0.5, "x"), ("back\\slash\\", 0.125, "y"), (None, 0.75, "x"), ('"', 1e-17, "y")]
    schema = "city string, pred_probability double, level_tag string"
    df = spark.createDataFrame(rows, schema)
    typed = StructType.fromDDL(schema)
    for name, write in (("a", FS.write_predictions), ("b", FS.write_table)):
        back = FS.read_csv(spark, write(df, str(tmp_path / name), fmt="csv"), typed)
        assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    parts = FS.write_predictions(df, str(tmp_path / "c"), fmt="csv", partition_by=["level_tag"])
    assert sorted(map(tuple, FS.read_csv(spark, parts, typed).collect()), key=str) == sorted(rows, key=str)
    assert config.PROBABILITY_COLUMN == "pred_probability"


def test_text_is_parsed_once(spark, tmp_path):
    """A filter on the reason is not pushed below the parsing, and a read batch is checked once."""
    df = spark.createDataFrame([(v,) for v, *_ in CASES], "value string")
    for part in (RQ.accepted, RQ.refused, RQ.reason_counts):
        plan = part(RQ.check_records(df))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson") == 1
    path = str(tmp_path / "in")
    df.write.text(path)
    good = RQ.read_records(spark, path, refused_to=str(tmp_path / "refused"))
    assert "parseJson" not in good._jdf.queryExecution().optimizedPlan().toString()
    assert good.count() == sum(1 for _, why, _ in CASES if not why)
    assert {r["reason"] for r in spark.read.parquet(str(tmp_path / "refused")).collect()} == {why for _, why, _ in CASES if why}
