"""Sharding by a two-pass external shuffle.

Pass one scatters the rows by seeded hashes into buckets that fit a task's memory, pass two permutes each bucket by
Fisher-Yates and writes it. Read one bucket after the other, the rows are a uniform random permutation of the table; shards
are runs of it whose numbers of rows differ by one at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from firmnet.operators.rank import running_sum

SHARDS = 16
BUCKET_BYTES = 64 << 20  # text of a bucket, on average
BUCKET_ROWS = 1_000_000
SEED = 11
_BATCH_ROWS = 4096


def n_bytes(text: str) -> Column:
    """UTF-8 bytes of the text (NULL: none) and one for its end."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")


def permutation(n: int, seed: int, bucket: int) -> np.ndarray:
    """Order in which the rows of a bucket come out: numpy's permutation is a Fisher-Yates shuffle."""
    return np.random.default_rng([seed, bucket]).permutation(n)


def _shuffle(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket begins with a row that holds its place and its number of rows."""
        kept: list[pa.RecordBatch] = []
        head: tuple[int, int, int] | None = None

        def close() -> Iterator[pa.RecordBatch]:
            if head is None:
                return
            bucket, start, n = head
            if n != sum(b.num_rows for b in kept):
                raise ValueError(f"bucket {bucket} has other rows than were counted: shuffle a stored table")
            rows = pa.Table.from_batches(kept).take(pa.array(permutation(n, seed, bucket)))
            rows = rows.append_column("place", pa.array(np.arange(start, start + n)))
            yield from rows.to_batches(max_chunksize=_BATCH_ROWS)

        for batch in batches:
            marks = np.flatnonzero(batch.column("rows").is_valid().to_numpy(zero_copy_only=False)).tolist()
            for a, b in zip([-1, *marks], [*marks, batch.num_rows]):
                if a >= 0:
                    yield from close()
                    head, kept = tuple(batch.column(c)[a].as_py() for c in ("bucket", "start", "rows")), []
                a += 1
                if b > a:
                    kept.append(batch.select(["row"]).slice(a, b - a))
        yield from close()

    return run


def _scattered(docs: DataFrame, buckets: int, seed: int) -> tuple[Column, Column]:
    at = F.monotonically_increasing_id()
    return at, F.pmod(F.xxhash64(F.lit(seed), at), F.lit(buckets))


def bucket_count(docs: DataFrame, text: str, bucket_bytes: int) -> tuple[int, int]:
    """Rows of the table, and how many buckets keep each within a task's memory."""
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(n_bytes(text)), F.lit(0))).first()
    return n, max(1, -(-size // bucket_bytes), -(-n // BUCKET_ROWS))


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, text: str = "text", bucket_bytes: int = BUCKET_BYTES,
             shard: str = "shard", slot: str = "slot") -> DataFrame:
    """All rows of a stored table in random order: its columns with ``shard`` (int) and ``slot`` (long, gapless from 0).

    A row goes to its bucket by a hash of the seed and of its place in the stored table, not of its content, so repeated rows,
    one id on most rows, or NULLs spread like any others. Lost tasks find the same rows again; with the same seed and the same
    splits of the table, so do reruns. Columns of ``docs`` named like the two results give way to them. NULL texts count as
    empty; a text longer than a bucket makes its bucket longer; an empty table gives no rows, and with fewer rows than shards
    the last shards stay empty.
    """
    n, buckets = bucket_count(docs, text, bucket_bytes)
    at, bucket = _scattered(docs, buckets, seed)
    counts = docs.select(bucket.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("rows"))  # reads no column
    starts = running_sum(counts, [("bucket", True)], "rows", "start")
    own = [c for c in docs.columns if c.lower() not in (shard.lower(), slot.lower())]
    rows = docs.select(bucket.alias("bucket"), at.alias("at"), F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"))
    heads = starts.select("bucket", F.lit(-1).cast("long").alias("at"), "start", "rows")
    both = rows.unionByName(heads, allowMissingColumns=True)
    placed = (
        both.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "at")
        .select("bucket", "start", "rows", "row")
    )
    form = StructType([StructField("row", rows.schema["row"].dataType), StructField("place", LongType())])
    each, more = divmod(n, shards)  # the first ``more`` shards hold one row more
    p, edge = F.col("place"), more * (each + 1)
    late = F.expr(f"(place - {edge}) div {max(each, 1)}")
    early = F.expr(f"place div {each + 1}")
    k = F.when(p < edge, early).otherwise(late + more)
    first = F.when(p < edge, early * (each + 1)).otherwise(edge + late * each)
    out = placed.mapInArrow(_shuffle(seed), form)
    return out.select(*(F.col(f"row.`{c}`") for c in own), k.cast("int").alias(shard), (p - first).cast("long").alias(slot))


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, seed: int = SEED, text: str = "text",
                 bucket_bytes: int = BUCKET_BYTES, mode: str = "error") -> DataFrame:
    """Write the shuffled rows as Parquet under ``shard=…``, each bucket in order of its slots, and read them back."""
    rows = shuffled(docs, shards, seed, text, bucket_bytes)
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder, mode=mode)
    return docs.sparkSession.read.schema(rows.schema).parquet(folder).select(rows.columns)
