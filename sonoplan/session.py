"""Session construction and durable cuts of lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the submitted configuration is used as it is."""
    builder = SparkSession.builder.master(master).config(map=SETTINGS | {"spark.sql.shuffle.partitions": str(partitions)} | extra)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a folder of our own where none is set (tests, one machine)."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        present = context._jsc.sc().getCheckpointDir()
        named = present.get() if present.isDefined() else f"file://{tempfile.mkdtemp(prefix='sonoplan-')}"
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named)
    return named


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever file system the path names."""
    files, target = _file_system(spark, path)
    return files.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    files, target = _file_system(spark, path)
    files.delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small control file, whole or not at all: written beside its place and renamed."""
    files, target = _file_system(spark, path)
    partial = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = files.create(partial)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(target):
        files.delete(target, False)
    if not files.rename(partial, target):
        raise OSError(f"{path} could not be written")


def read_text(spark: SparkSession, path: str) -> str:
    files, target = _file_system(spark, path)
    held = files.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(held)).decode()
    finally:
        held.close()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
        else:
            delete(spark, path)
    except Exception:  # noqa: BLE001  the session may have ended
        pass


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept as a table in the shared folder, so that the loss of an executor loses nothing.

    A written table is smaller than a checkpoint, and its size is known to the optimizer. It goes when the driver ends, or by release()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/sonoplan/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def release(df: DataFrame) -> None:
    """Deletes the table of durable(); nothing that reads it may still be open."""
    _delete(df.sparkSession, df.kept_at)


def clear(spark: SparkSession) -> None:
    """Deletes all tables of durable() so far, for a session that goes on after its queries' results have been read or written."""
    _delete(spark, f"{shared_folder(spark).rstrip('/')}/sonoplan/{spark.sparkContext.applicationId}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
