"""Versioned artefacts (A7, A8): every save is a folder of its own, and a manifest written last names it.

``<path>/versions/<id>/...`` holds what is saved, ``<path>/manifests/<number>-<id>`` one JSON row with
the version, its number and a digest over its files. A save that was cut off has no
manifest, so the version before stays the one that loads; saves never overwrite each other.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..sources.files import write_json_row


def files_digest(spark: SparkSession, folder: str) -> str:
    """SHA-256 over the sorted (name, SHA-256) of a folder's files, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    each = files.select(F.substring_index("path", "/versions/", -1).alias("name"), F.sha2("content", 256).alias("sha"))
    return hashlib.sha256(json.dumps(sorted(map(tuple, each.collect()))).encode()).hexdigest()


def versions(spark: SparkSession, path: str) -> list[dict]:
    """The manifests under ``path``, oldest first (one small row for each save)."""
    try:
        rows = spark.read.option("recursiveFileLookup", True).text(f"{path}/manifests").collect()
    except AnalysisException:
        return []
    return sorted((json.loads(r["value"]) for r in rows), key=lambda m: (m["number"], m["version"]))


def save_version(spark: SparkSession, path: str, write: Callable[[str], None]) -> dict:
    """``write(folder)`` into a new version, then its manifest."""
    version = uuid.uuid4().hex
    folder = f"{path}/versions/{version}"
    write(folder)
    before = versions(spark, path)
    manifest = {"number": (before[-1]["number"] if before else 0) + 1, "version": version, "digest": files_digest(spark, folder)}
    write_json_row(spark, manifest, f"{path}/manifests/{manifest['number']:08d}-{version}")
    return manifest


def find_version(spark: SparkSession, path: str, version: str | None = None) -> str:
    """The folder of the newest version, or of the one named; its files must be those that were saved."""
    found = [m for m in versions(spark, path) if version in (None, m["version"])]
    if not found:
        raise FileNotFoundError(f"no saved version{' ' + version if version else ''} under {path}")
    folder = f"{path}/versions/{found[-1]['version']}"
    if files_digest(spark, folder) != found[-1]["digest"]:
        raise FileNotFoundError(f"the files of version {found[-1]['version']} under {path} are not those that were saved")
    return folder
