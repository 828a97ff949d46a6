"""Incremental ingest: archives are processed once, by the checkpoint of a Structured Streaming query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from firmnet.plans.ingest import ingest_records
from firmnet.sources.ledger import BUCKETS


def ingest(records: DataFrame, corpus: str, checkpoint: str, dedup_keys: Sequence[str] = (),
           buckets: int = BUCKETS) -> StreamingQuery:
    """Append the pages of all new archives to the corpus, then stop.

    The checkpoint remembers which archives are done. A micro-batch is a run of the corpus named after it, so a batch that is
    done again after a failure replaces its rows. With ``dedup_keys``, a page whose key came before is left out: keys
    ``(archive_path, url)`` compare within an archive, ``(url,)`` across all archives. Keys seen are kept in a bucketed ledger
    beside the checkpoint, not in streaming state, so nothing is held in memory from run to run. Without keys, repeats inside
    an archive stay; the checkpoint alone skips archives already done.
    """
    ledger = f"{checkpoint.rstrip('/')}-ledger" if dedup_keys else None

    def store(batch: DataFrame, number: int) -> None:
        ingest_records(batch, corpus, f"batch-{number:09d}", dedup_keys, ledger, buckets=buckets)

    return records.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
