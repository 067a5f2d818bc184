"""Request records (A2, J1): every record is either accepted with typed fields or refused with its
raw text and a reason; nothing malformed is scored.

A record is one JSON object. Declared fields may be absent or null; others are ignored. A text
field takes a JSON string only. A number field takes a number, true or false (1 and 0), or a
string that spells a number; a whole-number field takes no fractions and nothing beyond its range.
Text that is not one JSON value (with keys given twice, NaN,
or more text behind it) is malformed. Blank lines are no records.

The check is one projection over the raw text (no UDF), the same in batch and stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# one scoring request record; every field optional.
RECORD_SCHEMA = T.StructType([
    T.StructField("city", T.StringType()),
    T.StructField("city_level", T.StringType()),
    T.StructField("city_score", T.DoubleType()),
    T.StructField("house_price", T.DoubleType()),
    T.StructField("grade", T.IntegerType()),
    T.StructField("refresh_num", T.IntegerType()),
    T.StructField("device", T.StringType()),
    T.StructField("is_enable", T.IntegerType()),
    T.StructField("fns_cnt", T.IntegerType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("b2c_term_name", T.StringType()),
    T.StructField("l1_term_name", T.StringType()),
    T.StructField("l1_term_renewal_end_date", T.StringType()),
])

RAW, RECORD, REASON = "_value", "_record", "_reason"
MALFORMED, NOT_AN_OBJECT = "malformed JSON", "not an object"

_WHOLE = {T.ByteType: (-2**7, 2**7 - 1), T.ShortType: (-2**15, 2**15 - 1), T.IntegerType: (-2**31, 2**31 - 1), T.LongType: (-2**63, 2**63 - 1)}


def _checked_field(i: int, field: T.StructField) -> tuple[Column, Column]:
    """(typed value, reason or null) of a field whose JSON kind, text and number are _kind, _text and _number."""
    kind, text, number = F.col(f"_kind{i}"), F.col(f"_text{i}"), F.col(f"_number{i}")
    given = kind.isNotNull() & (kind != "VOID")
    if isinstance(field.dataType, T.StringType):
        return F.when(kind == "STRING", text), F.when(given & (kind != "STRING"), F.lit(f"{field.name}: not text"))
    no_number = F.when(given & number.isNull(), F.lit(f"{field.name}: not a number"))
    if type(field.dataType) not in _WHOLE:
        return number.cast(field.dataType), no_number
    low, high = (F.lit(x).cast("decimal(38,0)") for x in _WHOLE[type(field.dataType)])
    # Beyond 2^53 the number no longer tells: its text does.
    exact = F.coalesce(F.trim(text).try_cast("decimal(38,0)"), number.try_cast("decimal(38,0)"))
    reason = F.coalesce(no_number, F.when(number % 1 != 0, F.lit(f"{field.name}: not a whole number")),
                        F.when(given & ~F.coalesce(exact.between(low, high), F.lit(False)), F.lit(f"{field.name}: out of range")))
    return exact.try_cast(field.dataType), reason


def check_records(df: DataFrame, value_col: str = "value", schema: T.StructType = RECORD_SCHEMA) -> DataFrame:
    """The other columns of ``df`` with ``_value`` (raw text), ``_record`` (typed fields, null if refused)
    and ``_reason`` (null if accepted; of several fields all, in schema order)."""
    others = [c for c in df.columns if c != value_col]
    rows = df.select(*others, F.col(value_col).alias(RAW)).where(F.coalesce(F.trim(RAW, F.lit(" \t\r\n")) != "", F.lit(True)))
    # A parser stops after the first value: only a text that is one value lets the mark behind it be read.
    mark = F.xxhash64(RAW)
    whole = F.try_parse_json(F.concat(F.lit("[["), RAW, F.lit("],"), mark.cast("string"), F.lit("]")))
    rows = rows.withColumn("_whole", whole)
    alone = (F.try_variant_get("_whole", "$[1]", "long") == mark) & F.try_variant_get("_whole", "$[0][1]", "variant").isNull()
    rows = rows.withColumn("_document", F.when(alone, F.try_variant_get("_whole", "$[0][0]", "variant")))
    # One projection each for what a field is, its number, and its value: expressions stay small.
    steps, fields = ({}, {}), list(enumerate(schema.fields))
    for i, f in fields:
        path = "$['" + f.name.replace("'", "\\'") + "']"
        steps[0][f"_kind{i}"] = F.schema_of_variant(F.try_variant_get("_document", path, "variant"))
        steps[0][f"_text{i}"] = F.try_variant_get("_document", path, "string")
        if not isinstance(f.dataType, T.StringType):
            kind = F.col(f"_kind{i}")
            spelled = F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT", "STRING") | kind.startswith("DECIMAL"), F.trim(f"_text{i}").try_cast("double"))
            steps[1][f"_number{i}"] = F.when(kind == "BOOLEAN", F.col(f"_text{i}").try_cast("boolean").cast("double")).otherwise(spelled)
    for step in ({"_what": F.schema_of_variant("_document"), **steps[0]}, steps[1]):
        rows = rows.withColumns(step)
    found = [(f, *_checked_field(i, f)) for i, f in fields]
    rows = rows.select(*others, RAW, "_what", F.struct(*[v.alias(f.name) for f, v, _ in found]).alias(RECORD),
                       F.concat_ws("; ", *[r for *_, r in found]).alias("_wrong"))
    reason = (F.when(F.col("_what").isNull(), F.lit(MALFORMED)).when(~F.col("_what").startswith("OBJECT"), F.lit(NOT_AN_OBJECT))
              .when(F.col("_wrong") != "", F.col("_wrong")))
    rows = rows.select(*others, RAW, RECORD, reason.alias(REASON))
    told = F.struct(RAW, F.when(F.col(REASON).isNull(), F.col(RECORD)).alias(RECORD), REASON)
    # Out of a generator: a filter on the reason would else be pushed below the steps, with all of them
    # written out in it, and parse the text again for every use of a field.
    return rows.select(*others, F.inline(F.array(told)))


def accepted(checked: DataFrame) -> DataFrame:
    """The typed fields of accepted records, after the other columns."""
    others = [c for c in checked.columns if c not in (RAW, RECORD, REASON)]
    return checked.where(F.col(REASON).isNull()).select(*others, f"{RECORD}.*")


def refused(checked: DataFrame) -> DataFrame:
    """(others, value, reason) of refused records."""
    others = [c for c in checked.columns if c not in (RAW, RECORD, REASON)]
    return checked.where(F.col(REASON).isNotNull()).select(*others, F.col(RAW).alias("value"), F.col(REASON).alias("reason"))


def record_counts(checked: DataFrame) -> DataFrame:
    """One row: total, accepted and refused records."""
    return checked.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(REASON).isNull()).alias("accepted"),
                       F.count_if(F.col(REASON).isNotNull()).alias("refused"))


def reason_counts(checked: DataFrame) -> DataFrame:
    """How often each reason was given; a record with several counts under each."""
    given = checked.where(F.col(REASON).isNotNull()).select(F.explode(F.split(REASON, "; ")).alias("reason"))
    return given.groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


def read_checked(spark: SparkSession, path: str, schema: T.StructType = RECORD_SCHEMA) -> DataFrame:
    """JSON-lines files, checked."""
    return check_records(spark.read.text(path), "value", schema)


def read_records(spark: SparkSession, path: str, schema: T.StructType = RECORD_SCHEMA, refused_to: str | None = None) -> DataFrame:
    """A2: JSON-lines request records -> typed frame.

    Refused records go to ``refused_to`` (Parquet: value, reason). Without it a batch that holds
    any raises, with the counts by reason, as a service answers the whole request.
    """
    from .files import unique_scratch

    # Checked once: the outcome lies in the shared folder (raw text of refused records only), both answers read it.
    kept = unique_scratch(spark, "checked")
    checked = read_checked(spark, path, schema).withColumn(RAW, F.when(F.col(REASON).isNotNull(), F.col(RAW)))
    checked.write.parquet(kept)
    checked = spark.read.schema(checked.schema).parquet(kept)
    if refused_to:
        refused(checked).write.mode("overwrite").parquet(refused_to)
    else:
        told = {r["reason"]: r["records"] for r in reason_counts(checked).orderBy(F.desc("records"), "reason").limit(20).collect()}
        if told:
            raise ValueError("refused records: " + ", ".join(f"{k} ({n})" for k, n in told.items()))
    return accepted(checked)


def parse_records(df: DataFrame, value_col: str = "value", schema: T.StructType = RECORD_SCHEMA) -> DataFrame:
    """A2: JSON text column -> typed columns of the accepted records."""
    return accepted(check_records(df.select(value_col), value_col, schema))

