"""Durable intermediate tables in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    A private folder is made only for a local session without the setting (tests); on a cluster a
    folder of one machine would lose rows with that machine, so the setting is required there.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="firmnet-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


_MADE: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    _MADE.append(f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}")
    return _MADE[-1]


def drop_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables this process made, once no result built on them is needed any more."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    dropped = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        dropped += bool(path.getFileSystem(conf).delete(path, True))
    return dropped


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once as Parquet and read back, so that several passes see the same rows.

    Survives executor loss, cuts lineage, and lets each later pass prune columns and row groups.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """Deal out an input that came in fewer partitions than there are cores, for work that is bound by
    the processor (text patterns). A large input has more partitions and is left where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table_exists(spark: SparkSession, path: str) -> bool:
    """True only for a finished write: a job that died half way leaves no ``_SUCCESS`` marker."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(marker)


def reuse_or_write(spark: SparkSession, path: str, build: Callable[[], DataFrame], if_exists: str = "skip",
                   partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Build a Parquet output unless a finished one is there (``skip``), or replace it (``overwrite``)."""
    if if_exists not in ("skip", "overwrite", "error"):
        raise ValueError(f"unknown if_exists: {if_exists}")
    if if_exists != "skip" or not table_exists(spark, path):
        mode = "error" if if_exists == "error" else "overwrite"
        build().write.mode(mode).partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


def _files(spark: SparkSession, path: str):
    """The path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def write_run(df: DataFrame, path: str, run: str, partition_by: tuple[str, ...] = (), replace: bool = False) -> bool:
    """Add one run's rows to a Parquet table as ``run=…``; False if a finished run of that name is there already.

    The rows are written aside and moved into place when they are complete, so a reader sees all of a run or nothing, and a
    run that is done again after a failure leaves one set of rows. ``replace`` puts the new rows in place of the old ones.
    Moving is one step on a file system that renames folders; elsewhere, ``_SUCCESS`` is moved last.
    """
    spark = df.sparkSession
    target = f"{path}/run={run}"
    if table_exists(spark, target) and not replace:
        return False
    staged = f"{path}/_staged/{run}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(staged)
    at, files = _files(spark, target)
    if files.exists(at):
        files.delete(at, True)
    if not files.rename(_files(spark, staged)[0], at):
        raise OSError(f"{staged} cannot be moved to {target}")
    return True


def runs(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished runs of a table."""
    at, files = _files(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    return sorted(n.removeprefix("run=") for n in names if n.startswith("run=") and table_exists(spark, f"{path}/{n}"))


def drop_run(spark: SparkSession, path: str, run: str) -> None:
    at, files = _files(spark, f"{path}/run={run}")
    files.delete(at, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small note beside a table, complete or not there."""
    at, files = _files(spark, path)
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = files.create(staged, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(at, False)
    files.rename(staged, at)


def read_text(spark: SparkSession, path: str) -> str | None:
    at, files = _files(spark, path)
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
