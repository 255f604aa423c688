"""Session helpers that every operator shares: tables, the shared folder, recoverable writes."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folders of this driver's applications, which go when the driver ends.
_FOLDERS: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder; works with any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session. Only a local session (tests) that has none gets
    a folder of its own; on a cluster a missing setting is an error, since a machine-local folder
    would lose data with its machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    own = context._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="factgraph-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def _delete(context, path: str) -> None:
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder within the shared one; it is deleted when the driver ends."""
    context = spark.sparkContext
    path = f"{shared_dir(spark)}/factgraph-{context.applicationId}"
    if path not in _FOLDERS:
        _FOLDERS.add(path)

        def clean() -> None:
            with contextlib.suppress(Exception):  # the JVM may have gone first
                _delete(context, path)

        atexit.register(clean)
    return path


def materialise(frame: DataFrame, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``frame`` as Parquet to the shared folder and read it back.

    This cuts lineage like a reliable checkpoint, stays columnar, and survives lost executors.
    """
    spark = frame.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    writer = frame.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def drop_materialised(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove the files of frames made by ``materialise`` that no later step reads."""
    for path in {f.rsplit("/", 1)[0] for frame in frames for f in frame.inputFiles()}:
        if "/factgraph-" not in path:
            raise ValueError(f"not a materialised table: {path}")
        _delete(spark.sparkContext, path)
