"""Online scoring as a Structured Streaming job (J1, replaces the HTTP service).

Arriving request records (JSON lines, schema F2, or Parquet) are checked, scored by the
saved model (features + boosted trees: a stateless per-row transform) and tagged with
levels. Refused records are never scored; they are kept with their raw text and a reason.

Each micro-batch is written under its own id (``batch=<id>``): its scores into the sink's
folder, its refused records and one progress row beside them, in that order and each by overwriting, so a batch that is replayed after a
failure adds nothing, and a batch without a progress row is not finished. A restarted query
resumes from its checkpoint. ``trigger(availableNow)`` drains what has arrived and
stops (batch-like); a processing-time trigger keeps it running.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import config
from ..plans.model import RenewalModel
from ..sources.files import RECORD_SCHEMA
from ..sources.requests import accepted, check_records, refused

#: Folders in the sink's; readers of the sink itself pass over names that begin with an underscore.
SCORES, REFUSED, PROGRESS = "", "_refused", "_progress"
REFUSED_SCHEMA, PROGRESS_SCHEMA = "value string, reason string", "accepted long, refused long"


def read_record_stream(spark: SparkSession, source_dir: str, fmt: str = "json", schema=RECORD_SCHEMA,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """Checked JSON-lines records (``sources.requests.check_records``), or typed rows of another format."""
    reader = spark.readStream.format("text") if fmt == "json" else spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.load(source_dir)
    return check_records(rows.select("value"), "value", schema) if fmt == "json" else rows


def score_stream(model: RenewalModel, records: DataFrame, keep=("user_id",)) -> DataFrame:
    """Response rows: kept id columns, probability, level_tag, success."""
    scored = model.score(records)
    return scored.select(
        *[c for c in keep if c in scored.columns],
        F.col(config.PROBABILITY_COLUMN).alias("probability"),
        F.col(config.LEVEL_COLUMN).alias("level_tag"),
        F.col(config.PROBABILITY_COLUMN).isNotNull().alias("success"),
    )


def write_batch(model: RenewalModel, batch: DataFrame, batch_id: int, sink_dir: str, sink_format: str = "parquet",
                checked: bool = True, keep=("user_id",)) -> None:
    """One micro-batch under its id: scores, refused records, then the progress row that completes it."""
    spark = batch.sparkSession
    path = lambda kind: f"{sink_dir}/{kind + '/' if kind else ''}batch={batch_id}"
    put = lambda df, kind: df.write.mode("overwrite").format(sink_format).save(path(kind))
    scored = score_stream(model, accepted(batch) if checked else batch, keep)
    put(scored, SCORES)
    counts = [spark.read.schema(scored.schema).format(sink_format).load(path(SCORES)).count(), 0]
    if checked:
        put(refused(batch), REFUSED)
        counts[1] = spark.read.schema(REFUSED_SCHEMA).format(sink_format).load(path(REFUSED)).count()
    put(spark.createDataFrame([tuple(counts)], PROGRESS_SCHEMA).coalesce(1), PROGRESS)


def read_progress(spark: SparkSession, sink_dir: str, sink_format: str = "parquet") -> DataFrame:
    """(accepted, refused, batch) of every finished batch."""
    return spark.read.schema(f"{PROGRESS_SCHEMA}, batch long").format(sink_format).load(f"{sink_dir}/{PROGRESS}")


def read_refused(spark: SparkSession, sink_dir: str, sink_format: str = "parquet") -> DataFrame:
    """(value, reason, batch) of the finished batches."""
    rows = spark.read.schema(f"{REFUSED_SCHEMA}, batch long").format(sink_format).load(f"{sink_dir}/{REFUSED}")
    return rows.join(read_progress(spark, sink_dir, sink_format).select("batch"), "batch", "left_semi")


def read_scores(spark: SparkSession, sink_dir: str, sink_format: str = "parquet") -> DataFrame:
    """Response rows of the finished batches, with ``batch``."""
    rows = spark.read.format(sink_format).load(sink_dir)
    return rows.join(read_progress(spark, sink_dir, sink_format).select("batch"), "batch", "left_semi")


def start_scoring(spark: SparkSession, model: RenewalModel, source_dir: str, sink_dir: str, checkpoint_dir: str,
                  fmt: str = "json", available_now: bool = True, processing_time: str | None = None,
                  sink_format: str = "parquet", max_files_per_trigger: int | None = None, keep=("user_id",)) -> StreamingQuery:
    """Start the scoring query, checkpointed; results are read with ``read_scores``. ``max_files_per_trigger``
    bounds a micro-batch, so a backlog is worked off in several."""
    rows = read_record_stream(spark, source_dir, fmt, max_files_per_trigger=max_files_per_trigger)
    writer = rows.writeStream.option("checkpointLocation", checkpoint_dir).foreachBatch(
        lambda batch, batch_id: write_batch(model, batch, batch_id, sink_dir, sink_format, fmt == "json", keep))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
