"""Document fingerprints: quartile bucket digests, and the likeness of two of them.

Overlapping byte triplets are hashed into 256 buckets; each bucket stores which quartile its count lies in (two bits),
and one byte holds the length on a logarithmic scale. Two digests are compared bucket by bucket, and the difference is
bounded, so that unrelated texts all end at likeness 0.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmnet.llm.common import partitions, whole
from firmnet.operators.rank import distributed_rank
from firmnet.storage import materialize

BUCKETS = 256
BOUND = 512  # differences from here on count as no likeness at all
LENGTH_STEPS = 8  # steps of the length code for each doubling
LENGTH_BOUND = 64
ROWS_PER_TASK = 20_000
SLICE = 64  # rows of an Arrow batch whose texts are Python strings at a time

_MIX = np.array(sorted(range(BUCKETS), key=lambda i: zlib.crc32(bytes([i]))), np.uint8)
_GAPS = np.array([0, 1, 2, 6])  # opposite quartiles weigh double


def codes(data: bytes) -> np.ndarray:
    """Quartile code (0 to 3) of each bucket, then the length code. Under three bytes there is no triplet: all zero."""
    out = np.zeros(BUCKETS + 1, np.uint8)
    out[BUCKETS] = min(255, round(LENGTH_STEPS * log2(len(data) + 1)))
    if len(data) >= 3:
        b = np.frombuffer(data, np.uint8)
        counts = np.bincount(_MIX[_MIX[_MIX[b[:-2]] ^ b[1:-1]] ^ b[2:]], minlength=BUCKETS)
        ranked = np.sort(counts)
        for quarter in (1, 2, 3):
            out[:BUCKETS] += counts > ranked[quarter * BUCKETS // 4 - 1]
    return out


def text_form(code: np.ndarray) -> str:
    """Hexadecimal form: 128 digits of quartiles, two of length."""
    q = code[:BUCKETS].reshape(-1, 4)
    return bytes(q[:, 0] << 6 | q[:, 1] << 4 | q[:, 2] << 2 | q[:, 3]).hex() + bytes([code[BUCKETS]]).hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal digests, 0 from a difference of ``BOUND`` on."""
    gap = np.abs(a.astype(np.int64) - b)
    return 1.0 - min(int(_GAPS[gap[:BUCKETS]].sum()) + min(int(gap[BUCKETS]), LENGTH_BOUND), BOUND) / BOUND


def fingerprint(text: str | None) -> str:
    return text_form(codes((text or "").encode()))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, " \
         "near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_EDGE = pa.schema([*_ARROW, ("edge", pa.string()), ("text", pa.string())])


def _compared(doc_id: int | None, text: str, code: np.ndarray, after: str, after_code: np.ndarray) -> tuple:
    """The result row of a document and the one after it."""
    kept = len(text) - len(text) // 3
    edited = (text[:kept] + after[:len(text) // 3]).encode()
    edit_code = codes(edited)
    return (doc_id, len(text), hashlib.sha256(edited).hexdigest(), text_form(code), text_form(edit_code),
            likeness(code, edit_code), likeness(code, after_code))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that a batch of long texts is not held a second time as Python strings."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order. The first and the last one of the task are handed on with their texts (``edge``), as their
    neighbours lie elsewhere; the others are compared with the row that follows."""
    waiting, none = None, (None,) * 6
    for batch in _slices(batches):
        out = []
        for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("_id", "_text"))):
            code = codes(text.encode())
            if waiting is None:
                out.append((doc_id, *none, "first", text))
            else:
                out.append((*_compared(*waiting, text, code), None, None))
            waiting = doc_id, text, code
        yield _batch(out, _EDGE)
    if waiting is not None:
        yield _batch([(waiting[0], *none, "last", waiting[1])], _EDGE)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        rows = zip(*(batch.column(c).to_pylist() for c in ("_id", "_text", "_after")))
        yield _batch([_compared(i, t, codes(t.encode()), after, codes(after.encode())) for i, t, after in rows], _ARROW)


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of each document, of an edited form, and their likeness; and the likeness to the next document.

    The next document is the next one by descending id (equal ids by a hash of the text, NULL ids last), after the last
    the first. The edited form replaces the last third of the code points by the first ones of the next document. Rows are
    dealt to ranges of this order, in which rows equal in id and text are told apart by their place, so that neither one id
    nor one row on most places fills a task. Texts are shuffled once; only the first and the last of each range meet their
    neighbours in a small join. NULL text counts as empty; a single document is its own next one; repeated rows stay
    repeated; an empty table gives no rows. ``docs`` is read more than once: give a stored table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), whole(text).alias("_text"), F.xxhash64(whole(text)).alias("_tie"),
                       F.monotonically_increasing_id().alias("_at"))
    ranges = partitions(spark, docs.count(), ROWS_PER_TASK)
    order = [F.desc_nulls_last("_id"), F.asc("_tie"), F.asc("_at")]
    ranged = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("_id", "_text")
    done = ranged.mapInArrow(_neighbours, f"{RESULT}, edge string, text string").withColumn("part", F.spark_partition_id())
    done = materialize(done, "likeness")  # of a text only what is at an edge
    first = done.where("edge = 'first'").select("part", F.col("text").alias("_after"))
    n = first.count()
    places = materialize(distributed_rank(first.select("part"), [("part", True)], "no"), "places")
    after = places.join(first, "part").select((F.col("no") - 1).alias("_of"), "_after")
    last = done.where("edge = 'last'").select("part", F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    closed = last.join(places, "part").withColumn("_of", F.col("no") % F.lit(max(n, 1))).join(after, "_of")
    return done.where("edge IS NULL").select(*_ARROW.names).unionByName(closed.select("_id", "_text", "_after").mapInArrow(_close, RESULT))
