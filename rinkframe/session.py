"""Session helpers for scripts, benchmarks and tests."""

from __future__ import annotations

import contextlib
import contextvars
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", app: str = "rinkframe", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the tests and the benchmark share."""
    return (
        SparkSession.builder.master(os.environ.get("SPARK_MASTER", f"local[{cpus}]"))
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, so that a folder of this machine is shared."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: by path where they are on this machine, as a zip elsewhere."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if sc.master.startswith("local"):
        paths = sc.environment.get("PYTHONPATH", "").split(":")
        if root not in paths:
            sc.environment["PYTHONPATH"] = ":".join(x for x in (root, *paths) if x)
    elif not getattr(sc, "_rinkframe_shipped", False):
        sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "rinkframe"), "zip", root, "rinkframe"))
        sc._rinkframe_shipped = True


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which driver and executors share; in local mode alone a temporary folder may stand in."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="rinkframe-")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of Spark's own file layer, for whatever store a path is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


#: Folders made by staged() within scratch(), innermost last.
_MADE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What is staged inside is removed at the end, however it ends; for work whose results are written or collected by then."""
    made: list[str] = []
    mark = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(mark)
        for path in made:
            fs, at = hadoop(spark, path)
            fs.delete(at, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: what several results share isn't computed for each, and lost executors don't repeat it. It stays there unless scratch() is around."""
    path = shared_folder(df.sparkSession, name)
    if (made := _MADE.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
