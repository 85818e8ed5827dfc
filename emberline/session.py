"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(app: str = "emberline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Partition counts are left to AQE: `initialPartitionNum` is what a cluster tunes,
    the advisory size then merges small partitions and splits skewed ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "16384",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every query relies on: UTC clock, skew handling and a checkpoint folder.

    A hot run is split even where that costs another shuffle: several operators join and
    aggregate on `run_id` in one stage, and without `force` AQE would leave them whole.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # The JVM does not compile methods above 8000 bytes of bytecode: let Spark split them.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a temporary one only in local mode."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="emberline-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one written intermediate."""
    return f"{shared_dir(spark).rstrip('/')}/emberline/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def staging(spark: SparkSession, name: str) -> Iterator[str]:
    """A fresh path below the shared folder that is deleted afterwards: what leaves the block must not read it."""
    path = staging_path(spark, name)
    try:
        yield path
    finally:
        discard(spark, path)
