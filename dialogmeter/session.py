"""Session settings and the shared scratch folder."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

MIB = 1024 * 1024


#: More map outputs times reducers than this many reducers make are a burden for the driver.
MOST_PARTITIONS = 20_000


def recommended_conf(shuffled_bytes: int, cores: int) -> dict[str, str]:
    """Spark settings for a job whose largest shuffle moves about ``shuffled_bytes`` on ``cores``.

    A shuffle starts with partitions of about 512 MiB, never more than ``MOST_PARTITIONS`` unless
    the cores ask for them, and adaptive execution merges those that turn out small. Larger
    partitions spill to disk, which costs less than the bookkeeping of hundreds of thousands.
    """
    wanted = min(-(-shuffled_bytes // (512 * MIB)), MOST_PARTITIONS)
    partitions = max(2 * cores, wanted)
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * MIB),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.files.maxPartitionBytes": str(256 * MIB if shuffled_bytes > 2**40 else 128 * MIB),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }


def send_with_jobs(module: str) -> None:
    """Send a module's functions along with the jobs that use them: Python workers need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_scratch(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master, where driver and executors share one disk, may fall back
    to a fresh temporary folder; on a cluster an unset folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="dialogmeter-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared scratch folder that nobody has used yet."""
    return f"{shared_scratch(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the shared folder.

    The copy is replicated storage, so a lost executor costs nothing but a re-read.
    """
    shared_scratch(df.sparkSession)
    return df.checkpoint(eager=True)


_landed: list[tuple[SparkSession, str]] = []


def landed(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; ``by`` names a column to file the rows under.

    What follows is computed from the copy: its size is known, so Spark can choose joins by it,
    and joins on it start from a plain scan, whose skew adaptive execution can split.
    """
    path = new_scratch_path(df.sparkSession, label)
    _landed.append((df.sparkSession, path))
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_landed() -> None:
    """Delete the copies written so far. Results that read them must have been saved before."""
    while _landed:
        spark, path = _landed.pop()
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
