"""An incremental run-status table fed by a stream of run updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberline.operators.status import latest_status
from emberline.sources.documents import block_fields
from emberline.sources.readers import BLOCK_START, parse_run_records


#: Batches after which their folders become one.
COMPACT_EVERY = 20


def document_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Run updates from progress documents dropped into a folder, `files` of them a batch."""
    reader = spark.readStream.format("text").option("lineSep", BLOCK_START)
    records = (reader if files is None else reader.option("maxFilesPerTrigger", files)).load(path)
    blocks = parse_run_records(records.withColumn("pos", F.lit(0)))
    return block_fields(blocks).select("run_id", "status")


def start(updates: DataFrame, table: str, checkpoint: str, once: bool = True, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Keep the furthest state per run in the state store and append changed runs.

    Transitions are monotone, so late and repeated updates cannot undo a newer state and
    no watermark is needed. A batch writes its own folder and overwrites it when it is
    replayed, which makes the sink exactly-once. Every `compact_every` batches the folders are folded into one.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batches/batch={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            compact(batch.sparkSession, table, batch_id)

    writer = (latest_status(updates).writeStream.outputMode("update")
              .option("checkpointLocation", checkpoint).foreachBatch(write))
    return (writer.trigger(availableNow=True) if once else writer).start()


def _folders(spark: SparkSession, path: str, mark: str) -> dict[int, str]:
    """Number and path of the complete folders `mark`=number below a path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return {}
    found = [s.getPath() for s in fs.listStatus(place) if s.getPath().getName().startswith(f"{mark}=")]
    done = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return {int(p.getName().partition("=")[2]): p.toString() for p in done}


def _current(spark: SparkSession, table: str) -> tuple[int, list[str]]:
    """Number of the newest snapshot, or -1, and the folders that hold the table: it and the batches after it."""
    snapshots, batches = _folders(spark, f"{table}/snapshots", "upto"), _folders(spark, f"{table}/batches", "batch")
    upto = max(snapshots, default=-1)
    return upto, [*([snapshots[upto]] if snapshots else []), *(path for n, path in sorted(batches.items()) if n > upto)]


def _newest(spark: SparkSession, folders: list[str]) -> DataFrame:
    rows = reduce(DataFrame.unionByName, [
        spark.read.parquet(path).select("run_id", "status", "updates", F.lit(n).alias("at")) for n, path in enumerate(folders)])
    return rows.groupBy("run_id").agg(F.max_by(F.struct("status", "updates"), "at").alias("s")).select("run_id", "s.*")


def compact(spark: SparkSession, table: str, upto: int) -> None:
    """Fold the snapshot before and all batches up to this one into a new snapshot, then delete them.

    A folder counts once it is completely written, and batches that a snapshot covers are not read, so it may
    stop and be repeated at any point.
    """
    before, folders = _current(spark, table)
    batches = _folders(spark, f"{table}/batches", "batch")
    folders = [f for f in folders if f not in {path for n, path in batches.items() if n > upto}]
    if not folders or before >= upto:
        return
    _newest(spark, folders).write.mode("overwrite").parquet(f"{table}/snapshots/upto={upto}")
    old = [path for n, path in batches.items() if n <= upto]
    old += [path for n, path in _folders(spark, f"{table}/snapshots", "upto").items() if n < upto]
    for path in old:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def read(spark: SparkSession, table: str) -> DataFrame:
    """Current table: for each run the row of the newest batch, or of the snapshot."""
    _, folders = _current(spark, table)
    if not folders:
        return spark.createDataFrame([], "run_id string, status string, updates long")
    return _newest(spark, folders)
