"""Intermediate tables in the shared folder.

A table written once is computed once, has a known size for Spark's join choices, and survives
the loss of any executor.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from dialogmeter.session import new_scratch_path

_written: list[tuple[SparkSession, str]] = []
_folders: list[tempfile.TemporaryDirectory] = []


def stored(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` to a fresh folder of the shared scratch space and read it back.

    ``narrow`` is for tables of a few numbers a row: they are written by at most four tasks a
    core, so a shuffle into many partitions does not leave as many tiny files.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(4 * spark.sparkContext.defaultParallelism)
    path = new_scratch_path(spark, label)
    if not _written:
        atexit.register(clear)
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear() -> None:
    """Delete the tables written so far; results that still read them must have been saved."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        except Exception:  # the session is gone, and with it the means to delete
            return


_caches: dict[str, dict] = {}


def worker_cache(operator: str) -> dict:
    """What a Python worker keeps of ``operator`` from task to task.

    A worker serves one operator after another; what it kept of the one before is dropped here.
    """
    if operator not in _caches:
        _caches.clear()
        _caches[operator] = {}
        gc.collect()
        pa.default_memory_pool().release_unused()
    return _caches[operator]


def ship(spark: SparkSession) -> None:
    """Make this package importable in Spark's Python workers, once per application."""
    context = spark.sparkContext
    name = "dialogmeter-llm.zip"
    if name in context._python_includes:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.TemporaryDirectory()
    _folders.append(folder)  # the driver serves the file from here as long as it runs
    path = Path(folder.name, name)
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(path))
