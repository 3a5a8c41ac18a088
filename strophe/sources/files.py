"""Lyric files from folders and from a fetching function as ``filename, content``."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "filename string, content string"


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Each ``.ttml`` file of a folder, whole; invalid UTF-8 is dropped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT][tT][mM][lL]").load(path)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), text.alias("content")).filter("content is not null")


def fetch_files(names: DataFrame, fetch: Callable[[str], str | None], partitions: int = 20) -> DataFrame:
    """Files by name through a caller's function, a few at a time; names it can't fetch are dropped."""

    def run(batches):
        for b in batches:
            got = []
            for name in b.column("filename").to_pylist():
                try:
                    text = fetch(name)
                except Exception:
                    text = None
                if text is not None:
                    got.append((name, text))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["filename", "content"])

    return names.select("filename").repartition(partitions).mapInArrow(run, SCHEMA)
