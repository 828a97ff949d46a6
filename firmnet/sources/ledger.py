"""Ledger of keys that were ingested before: a bucketed table, joined without a shuffle of its own rows.

A ledger grows with all that was ever ingested, a new run's records do not. The ledger is therefore stored in buckets by the
hash of its keys, and a run's records are dealt out by the same hash: only they move, and a task meets one bucket at a time.
Nothing is held between runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmnet.storage import _files

BUCKETS = 64


def _buckets(spark: SparkSession, path: str, buckets: int) -> int:
    """Buckets of the ledger that is there, or the number for a new one: it is part of the folder's name."""
    at, files = _files(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    found = [int(n.removeprefix("buckets-")) for n in names if n.startswith("buckets-")]
    return found[0] if found else buckets


def open_ledger(spark: SparkSession, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> tuple[str, int]:
    """Name in the session's catalog of the ledger table at ``path`` (keys and run, text columns), and its buckets."""
    n = _buckets(spark, path, buckets)
    name = f"ledger_{hashlib.md5(path.encode()).hexdigest()}"
    columns, by = ", ".join(f"`{k}` STRING" for k in keys), ", ".join(f"`{k}`" for k in keys)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, run STRING) USING parquet "
              f"CLUSTERED BY ({by}) INTO {n} BUCKETS LOCATION '{path}/buckets-{n}'")
    spark.catalog.refreshTable(name)
    return name, n


def drop_seen(rows: DataFrame, keys: Sequence[str], run: str, path: str | None = None, compared=None, buckets: int = BUCKETS) -> DataFrame:
    """One row for each key; with the ``path`` of a ledger, only for keys that no other run has noted.

    Keys ``(archive_path, url)`` compare within an archive, ``(url,)`` across all. What an earlier attempt of the same run
    noted does not count. Rows that are not ``compared`` (a condition), or have no key, pass by.
    """
    spark = rows.sparkSession
    own = [f"_key{i}" for i in range(len(keys))]
    counts = F.lit(True) if compared is None else compared
    for k in keys:
        counts = counts & F.col(k).isNotNull()
    keyed = rows.select("*", *(F.when(counts, F.col(k)).alias(o) for k, o in zip(keys, own)))
    if path is None:
        noted, n = None, int(spark.conf.get("spark.sql.shuffle.partitions"))
    else:
        name, n = open_ledger(spark, path, keys, buckets)
        noted = spark.table(name).where(F.col("run") != run).select(*(F.col(k).alias(o) for k, o in zip(keys, own)))
    passing = F.when(F.col(own[0]).isNull(), F.monotonically_increasing_id()).alias("_passing")
    fresh = keyed.repartition(n, *own).select("*", passing).dropDuplicates([*own, "_passing"])
    return (fresh if noted is None else fresh.join(noted, own, "left_anti")).select(*rows.columns)


def note(spark: SparkSession, path: str, keys: Sequence[str], run: str, done: DataFrame, buckets: int = BUCKETS) -> None:
    """Add a run's keys, a file for each bucket."""
    name, n = open_ledger(spark, path, keys, buckets)
    done.select(*keys).distinct().repartition(n, *keys).withColumn("run", F.lit(run)).write.insertInto(name)
    spark.catalog.refreshTable(name)
