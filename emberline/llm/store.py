"""Tables of an operator's intermediate results, and files that tasks write themselves."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import emberline
from emberline.session import prepare, shared_dir

#: Rows and bytes of text handed to Python at once.
ARROW_ROWS = 2000
ARROW_BYTES = 16 << 20


def session(spark: SparkSession) -> SparkSession:
    """The session with the settings that these operators rely on."""
    prepare(spark)
    _ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def _ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a Spark application."""
    context = spark.sparkContext
    if getattr(context, "_emberline_sent", False):
        return
    root = Path(emberline.__file__).parent
    # the driver's own folder of this application, from which Spark serves the file
    packed = f"{getattr(context, '_temp_dir', None) or tempfile.mkdtemp()}/emberline-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(packed, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(packed)
    context._emberline_sent = True


#: Rows of one file of a table whose size is known before it is written.
ROWS_PER_FILE = 1_000_000


@contextmanager
def once(spark: SparkSession):
    """What runs in this block is run once, so Spark removes its shuffle files as soon as it has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Workspace:
    """A folder below the shared checkpoint folder that is deleted when the operator is done.

    What an operator returns must not read it: `result()` writes the rows to a checkpoint, which
    Spark deletes with the last reference to them where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables = []
        self.root = f"{shared_dir(spark).rstrip('/')}/emberline/work-{uuid.uuid4().hex}"

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *failed) -> None:
        self._delete(self.root)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def table(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """`df` written and read again; `rows` is the most that it can hold, where that is known."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        if rows is not None:
            df = df.coalesce(1 + rows // ROWS_PER_FILE)
        with once(self.spark):
            df.write.parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((read, path))
        return read

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read any more."""
        for read, path in self.tables:
            if any(read is t for t in tables):
                self._delete(path)
        self.tables = [(read, path) for read, path in self.tables if not any(read is t for t in tables)]

    def folder(self, name: str) -> str:
        return f"{self.root}/{name}"

    def result(self, df: DataFrame) -> DataFrame:
        with once(self.spark):
            return df.checkpoint()


def file_system(uri: str):
    """The pyarrow file system of a URI or plain path, and the path within it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def task_file(folder: str, stem: str) -> str:
    """A name that no other attempt of this task uses; files of failed attempts are never listed."""
    from pyspark import TaskContext

    return f"{folder}/{stem}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
