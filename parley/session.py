"""Session construction and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cores: int | str = "*", partitions: int = 8, app: str = "parley", conf: dict | None = None
) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config(map=conf or {})
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder from ``spark.checkpoint.dir``.

    Only a session that names none (a test on one machine) gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="parley-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(own)
    return context.getCheckpointDir().rstrip("/")


_SCOPE: ContextVar[str | None] = ContextVar("scratch scope", default=None)


@contextmanager
def scratch_in(folder: str) -> Iterator[str]:
    """Stores what is staged meanwhile in ``folder``, until :func:`remove_scratch`."""
    token = _SCOPE.set(folder)
    try:
        yield folder
    finally:
        _SCOPE.reset(token)


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def remove_scratch(spark: SparkSession, folder: str) -> None:
    files, path = _file_system(spark, folder)
    files.delete(path, True)


def move_folder(spark: SparkSession, folder: str, to: str) -> bool:
    """Gives a written folder another name, in place of what has it. False if there is no such folder."""
    files, path = _file_system(spark, folder)
    if not files.exists(path):
        return False
    target = _file_system(spark, to)[1]
    files.delete(target, True)
    if not files.rename(path, target):
        raise OSError(f"{folder} cannot be moved to {to}")
    return True


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for the tables that a run stores, removed at its end.

    Results that still read them must be written within the scope, or staged at a path that was
    taken before it.
    """
    folder = scratch_path(spark, "run")
    try:
        with scratch_in(folder):
            yield folder
    finally:
        remove_scratch(spark, folder)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, or below the current run's."""
    return f"{_SCOPE.get() or scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


# Tables dealt over folders are dealt over a few: splits.
_OPEN_FILES = 8


@contextmanager
def unsorted_writes(spark: SparkSession) -> Iterator[None]:
    """Rows that are dealt over folders are written as they come, a file open for each folder.

    Spark sorts each task's rows by folder otherwise, and spills them where they are many texts.
    """
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(_OPEN_FILES))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


# How texts are stored: a quarter smaller than with the default codec, in the same time.
COMPACT = {"compression": "zstd"}


def staged(
    df: DataFrame, name: str, path: str | None = None, options: dict[str, str] = COMPACT
) -> DataFrame:
    """Write ``df`` to the shared folder, or to ``path``, and read it back.

    Later passes then read only the columns they need, and a lost executor costs a
    file read instead of the whole upstream plan.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
