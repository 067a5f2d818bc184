"""The corpus pipeline: language ID, near-duplicates, decontamination, personal data, byte-level BPE.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows of ``docs`` and returns a
DataFrame; all but the last return the columns of ``docs``. ``run`` writes each stage's
result as a Parquet table in the cluster's shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from renewlens.llm import decontaminate, language_id, minhash, pii, tree_bpe
from renewlens.llm.common import fold, table, written

#: A text whose largest language share is below this has no language of its own and is rejected.
MIN_SHARE = 0.4
#: A byte of a word, as the near-duplicate operator splits words.
WORD = r"[^\x20\x09-\x0D]"


def _columns(docs: DataFrame) -> tuple[str, ...]:
    return tuple(docs.columns)


def _kept(found: DataFrame, columns: tuple[str, ...], condition) -> DataFrame:
    """The rows of ``found`` (an id column, then the columns under their names) that meet a condition."""
    named = found.toDF("_id", *[f"_c{i}" for i in range(len(columns))], *found.columns[len(columns) + 1 :])
    return named.where(condition).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; without letters, or with no language in front, they go."""
    field = language_id.learned_field(docs, fold(F.col("doc_id"), 4) != 2)
    columns = _columns(docs)
    found = language_id.identify(docs, field, keep=columns)
    return _kept(found, columns, (F.col("lang_pred") != "und") & (F.col("score") >= MIN_SHARE))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the smallest id (a null one last), then the smallest
    text hash; and every document without words."""
    found = minhash.near_duplicates(docs).where("label is not null")
    # Groups go by the component's label: ids may be null or repeated under unrelated texts.
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("p")
    one = found.groupBy("label").agg(smallest).select(F.col("p.doc_id").alias("_id"), F.col("p.text_hash").alias("_one"))
    columns = _columns(docs)
    named = docs.toDF(*[f"_c{i}" for i in range(len(columns))])  # whatever the columns are called
    id_, text = (F.col(f"_c{columns.index(c)}") for c in ("doc_id", "text"))
    worded = F.coalesce(text, F.lit("")).rlike(WORD)
    rows = named.where(worded).withColumn("_hash", F.xxhash64(text))
    rows = rows.join(one, id_.eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_one")), "left_semi")
    # Rows of one id and one text are the same document: the smallest in its other columns stays.
    ties = [F.col(n) for n, kind in named.dtypes if not kind.startswith(("map", "variant"))]
    first = F.row_number().over(Window.partitionBy(id_, "_hash").orderBy(*ties))
    rows = rows.withColumn("_first", first).where("_first = 1").drop("_first", "_hash")
    return rows.union(named.where(~worded)).toDF(*columns)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows, those of items without an id too, do not contaminate."""
    columns = _columns(docs)
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=columns, unnamed=True)
    return _kept(found, columns, ~F.col("contaminated"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets and the length kept right."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes of every document."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return tree_bpe.digests(tree_bpe.encode(docs, path, public_tokenizers.PATTERN, with_decoded=True))


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", clean_of_benchmark),
    ("personal_data", without_personal_data),
    ("tree_bpe", encode),
]

#: No SQL for a fitted field or for byte-level BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
