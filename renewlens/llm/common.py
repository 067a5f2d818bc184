"""Helpers shared by the operators: tables, scratch tables, doc-id folds, bounded sizes."""

from __future__ import annotations

import atexit
import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from renewlens.session import ensure_checkpoint_dir

#: Text bytes (roughly) that Python code keeps in one piece; batches are cut at documents.
BATCH_CHARS = 8_000_000

_SCRATCH: set[str] = set()
#: What this Python worker keeps between tasks, and whether the present task uses it.
_RESIDENT: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the path may be of any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(_remove_scratch)
    _SCRATCH.add(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: cuts the
    lineage, and every later reader sees the same rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder made by ``scratch_path``."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _SCRATCH.discard(path)


def _remove_scratch() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for path in list(_SCRATCH):
        try:
            remove_path(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_slices(batch: pa.RecordBatch, column: str, chars: int = BATCH_CHARS):
    """Cut an Arrow batch into slices of about ``chars`` bytes of text each; no text is cut."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = np.cumsum(sizes, dtype=np.int64) // chars
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts as UTF-8 bytes; null counts as empty."""
    return [t or b"" for t in pc.cast(batch.column(column), pa.binary()).to_pylist()]


def resident(key, build):
    """``build()``, kept in the Python worker for further tasks that ask for the same key; to be called
    in ``make``. One object is kept at a time, until a task of ``python_columns`` begins that asks for none."""
    if "value" not in _RESIDENT or _RESIDENT["key"] != key:
        _RESIDENT.clear()
        _RESIDENT.update(key=key, value=build())
    _RESIDENT["used"] = True
    return _RESIDENT["value"]


def begun(make):
    """``make()``, after which nothing of another operator's tasks stays in this Python worker."""
    _RESIDENT["used"] = False
    made = make()
    if not _RESIDENT["used"]:
        _RESIDENT.clear()
        give_back()
    return made


def give_back() -> None:
    """Return freed memory to the system: workers are used again, and both allocators keep what a task freed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        return


def python_columns(df: DataFrame, make, new: str, text: str | None = "_text", drop: tuple[str, ...] = (),
                   chars: int = BATCH_CHARS) -> DataFrame:
    """``df`` without ``drop`` and with the columns ``new`` (DDL) that Python adds.

    ``make()`` is called once per task and returns a function from an Arrow batch
    to a dict of value lists; all other columns pass through as they are. Batches are
    cut by the bytes of the column ``text``, if one is named. Between tasks a worker
    keeps ``resident`` objects only.
    """
    added = StructType.fromDDL(new)
    schema = StructType([f for f in df.schema.fields if f.name not in drop] + added.fields)
    kept = [f.name for f in df.schema.fields if f.name not in drop]
    types = [(f.name, to_arrow_type(f.dataType)) for f in added.fields]

    def run(batches):
        f = begun(make)
        batch = part = cols = None
        for batch in batches:
            for part in text_slices(batch, text, chars) if text else [batch]:
                cols = f(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in kept]
                    + [cols[n] if isinstance(cols[n], pa.Array) else pa.array(cols[n], t) for n, t in types],
                    names=kept + [n for n, _ in types])
        del f, batch, part, cols
        give_back()

    return df.mapInArrow(run, schema)


def list_array(values: list, lengths, dtype=np.int32) -> pa.Array:
    """An Arrow list array of flat ``values`` cut by ``lengths``."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.asarray(values, dtype))


def select_as(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The needed columns under internal names: _id, _text and _k0, _k1, ... for ``keep``."""
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                     *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])


def named(id_col: str, keep: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``select_as`` under their own names again."""
    return [F.col("_id").alias(id_col), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]]
