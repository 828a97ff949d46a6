"""Deterministic sharded WARC writer, and a reader that derives everything from the archives.

Records are ordered by page id and cut into shards at exact sums of payload bytes, so reruns make the same files. A task sorts a shard
and rolls to the next file once the compressed size reaches the limit. Files are written under temporary names; the
manifest of the attempts that succeeded is stored by Spark, and only files it names are renamed to their final names.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmnet.operators.rank import running_sum
from firmnet.storage import materialize

SHARD_BYTES = 32 << 20  # payload bytes of a shard
MOST_SHARDS = 10_000  # shards grow beyond this number of them, as their limits are held by every task
FILE_BYTES = 8 << 20  # compressed
REVISIT_BYTES = 100  # payloads from here on are stored once
DATE = "2000-01-01T00:00:00Z"
LEVEL = 6

MANIFEST = "temporary string, final string, records long, compressed long, sha256 string"
_MANIFEST = pa.schema([("temporary", pa.string()), ("final", pa.string()), ("records", pa.int64()), ("compressed", pa.int64()),
                       ("sha256", pa.string())])
PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
_PAGES = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                    ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
_BATCH_BYTES = 8 << 20


def page_uri(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: str | None) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <{page_uri(page_id)}>",
        f"WARC-Date: {DATE}", *([f"WARC-Target-URI: {target}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"WARC-Refers-To: <{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
          if refers is not None else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", "",
    ]
    return gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n", LEVEL, mtime=0)


class _Files:
    """The open file of a shard, rolled by compressed size."""

    def __init__(self, folder: str, most: int):
        self.most = most
        self.fs, self.folder = pa.fs.FileSystem.from_uri(folder)
        self.attempt = uuid.uuid4().hex
        self.shard, self.out, self.done = None, None, []

    def write(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, 0
        if self.out is None:
            self.final = f"shard-{shard:05d}-{self.number:05d}.warc.gz"
            self.temporary = f"_temporary/{self.attempt}-{self.final}"
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.temporary}", compression=None)
            self.records, self.size, self.sha = 0, 0, hashlib.sha256()
        self.out.write(data)
        self.sha.update(data)
        self.records, self.size = self.records + 1, self.size + len(data)
        if self.size >= self.most:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.temporary, self.final, self.records, self.size, self.sha.hexdigest()))
            self.out, self.number = None, self.number + 1


def _write(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by shard, page id, digest; a row with ``_mark`` 0 stands before the pages whose payload others share."""
        files, shared, stored = _Files(folder, file_bytes), None, False
        for batch in batches:
            for shard, page_id, digest, mark, refers, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if mark == 0:
                    shared, first, stored = (page_id, digest), refers, False
                    continue
                revisit = shared == (page_id, digest) and (stored or first != page_id)
                stored = stored or shared == (page_id, digest)
                files.write(shard, record(page_id, url, html.encode(), digest, page_uri(first) if revisit else None))
        files.close()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in files.done], f.type) for k, f in enumerate(_MANIFEST)], schema=_MANIFEST)

    return run


def _commit(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rename; a repeated attempt finds the file renamed already."""
        fs, root = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for temporary, final in zip(batch.column("temporary").to_pylist(), batch.column("final").to_pylist()):
                if fs.get_file_info(f"{root}/{temporary}").type != pa.fs.FileType.NotFound:
                    fs.move(f"{root}/{temporary}", f"{root}/{final}")
                elif fs.get_file_info(f"{root}/{final}").type == pa.fs.FileType.NotFound:
                    raise FileNotFoundError(final)
            yield batch

    return run


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record for each page to ``folder``; returns the manifest, also stored in ``folder``/manifest.

    Of records with equal payloads of at least ``REVISIT_BYTES``, the one with the smallest page id is stored as
    response and the others as revisits of it. NULL html is an empty payload. NULL ids sort last and count as largest;
    of equal rows the first one is the response. The payloads are shuffled once: what a page shares with others is
    found on ids and digests, and reaches the writer as a narrow row that sorts before the page.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("_id"), F.sha2(body.cast("binary"), 256).alias("_digest"),
                        F.col(url).alias("_url"), body.alias("_html"))
    keys = materialize(rows.select("_id", "_digest", F.octet_length("_html").alias("_bytes"), F.col("_id").isNull().alias("_last")), "keys")
    total, n = keys.agg(F.coalesce(F.sum("_bytes"), F.lit(0)), F.count("*")).first()
    shards = max(1, min(MOST_SHARDS, -(-total // shard_bytes), n))
    each = max(1, -(-(total + n) // shards))  # an empty payload counts, too
    summed = running_sum(keys.withColumn("_weight", F.col("_bytes") + 1), [("_last", True), ("_id", True), ("_digest", True)], "_weight")
    cuts = summed.where(~F.col("_last")).groupBy(F.expr(f"before div {each}").alias("s")).agg(F.min("_id").alias("c")).collect()
    cuts = sorted({r["c"] for r in cuts if r["s"] > 0})  # at most MOST_SHARDS
    shard = F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("_id"))) if cuts else F.lit(0)
    shard = F.when(F.col("_id").isNull(), len(cuts)).otherwise(shard)

    large = keys.where(F.col("_bytes") >= REVISIT_BYTES)
    groups = large.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    marks = large.select("_id", "_digest").join(materialize(groups, "shared"), "_digest").distinct()
    both = marks.select("_id", "_digest", F.lit(0).alias("_mark"), "_first", F.lit(None).cast("string").alias("_url"),
                        F.lit("").alias("_html")).unionByName(
        rows.select("_id", "_digest", F.lit(1).alias("_mark"), F.lit(None).cast("long").alias("_first"), "_url", "_html"))
    ordered = (
        both.withColumn("_shard", shard.cast("int")).repartitionById(len(cuts) + 1, F.col("_shard"))  # shard k is task k's
        .sortWithinPartitions("_shard", F.asc_nulls_last("_id"), "_digest", "_mark", "_url")
        .select("_shard", "_id", "_digest", "_mark", "_first", "_url", "_html")
    )
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_temporary")
    store = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    store.mkdirs(hadoop)
    manifest = materialize(ordered.mapInArrow(_write(folder, file_bytes), MANIFEST), "attempts")
    manifest.mapInArrow(_commit(folder), MANIFEST).write.parquet(f"{folder}/manifest")
    store.delete(hadoop, True)  # what failed attempts left
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _members(stream) -> Iterator[bytes]:
    """Gzip members of a file, one at a time."""
    rest, inflate, out = b"", zlib.decompressobj(31), []
    while True:
        data = rest or stream.read(1 << 20)
        rest = b""
        if not data:
            if out:
                raise ValueError("file ends within a record")
            return
        out.append(inflate.decompress(data))
        if inflate.eof:
            rest = inflate.unused_data
            yield b"".join(out)
            inflate, out = zlib.decompressobj(31), []


def parse(member: bytes) -> tuple:
    """Page id, payload length and digest, type, page referred to, URL and payload of a record; its digests are checked."""
    head, _, block = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[:int(fields["Content-Length"])]
    if hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:"):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.decode().rsplit("Content-Length: ", 1)[1])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    page = lambda uri: int(uri[len("<urn:page:"):-1]) if uri and uri != "<urn:page:>" else None
    return (page(fields["WARC-Record-ID"]), length, digest, kind, page(fields.get("WARC-Refers-To")),
            fields.get("WARC-Target-URI"), payload if kind == "response" else None)


def _read(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        form = _PAGES if payloads else pa.schema(list(_PAGES)[:-1])
        for batch in batches:
            for name in batch.column("final").to_pylist():
                out, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for member in _members(stream):
                        row = parse(member)
                        out.append(row)
                        size += 200 + (len(row[-1] or b"") if payloads else 0)
                        if size >= _BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(form)], schema=form)
                            out, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(form)], schema=form)

    return run


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the archives that the manifest in ``folder`` names, a file to a task; files it doesn't name are ignored."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("final")
    files = manifest.repartition(max(1, manifest.count()), "final")
    return files.mapInArrow(_read(folder, payloads), PAGES if payloads else PAGES.rsplit(",", 1)[0])
