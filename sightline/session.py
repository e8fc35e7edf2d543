"""Session defaults and reliable lineage cuts."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Small but costly tables (rings, rasters of one run) keep their parallelism.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows may hold long texts; a batch of them is held by the executor and by its Python worker.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator assumes."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A session on one machine that names none gets a scratch folder.  A cluster must name one: a folder
    that its executors do not share would lose rows.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sightline-checkpoint-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


_WRITTEN: list[str] = []


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage by writing ``df`` as a table in the shared checkpoint folder.

    A written table survives lost executors, is read back column by column, and tells
    the optimizer its true size.  ``discard_tables`` removes what is no longer read.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/sightline-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def working_folder(spark: SparkSession, kind: str) -> str:
    """A new path in the shared checkpoint folder that ``discard_tables`` removes too."""
    path = f"{checkpoint_folder(spark)}/sightline-{kind}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


@contextmanager
def tables_written() -> Iterator[list[str]]:
    """Collects the paths of the tables that ``reliable_checkpoint`` writes inside the block."""
    start, paths = len(_WRITTEN), []
    yield paths
    paths.extend(_WRITTEN[start:])


def discard_tables(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete the given written tables, or all that this process wrote; their readers must be done.

    Returns how many there were.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    for name in list(_WRITTEN if paths is None else paths):
        path = jvm.org.apache.hadoop.fs.Path(name)
        done += bool(path.getFileSystem(conf).delete(path, True))
        if name in _WRITTEN:
            _WRITTEN.remove(name)
    return done


def small_side(df: DataFrame) -> DataFrame:
    """A table with one row per run or key, written so that joins with it know its size.

    Spark broadcasts it when its bytes are below the session's threshold and shuffles otherwise.
    """
    return reliable_checkpoint(df)


def spread(df: DataFrame) -> DataFrame:
    """``df`` as a side that joins shuffle whatever its estimated size.

    Spark estimates a written table by its bytes on disk.  Cells lie in runs of equal values, so some hundred
    KB there may be many million rows, which a broadcast would hold whole on the driver.
    """
    return df.hint("merge")


def ship_by_value(module_name: str) -> None:
    """Send a module's Python functions to executors whole, so that they need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
