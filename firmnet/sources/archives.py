"""Web archives (WARC and ARC, gzipped) as rows.

Spark lists the files and cuts them into byte ranges; a task opens its range and decodes records one
at a time. Archives are gzip files with one member per record, so a range owns the members that begin
in it, and one very large archive is read by many tasks. A file compressed as a single member is read
whole by its first range.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmnet.schemas import MANIFEST, WEB_RECORD

# Tasks need only this module's own functions, so they travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLIT_BYTES = 128 << 20
_CHUNK = 1 << 20
_BATCH_CHARS = 8 << 20


def list_archives(spark: SparkSession, glob: str) -> DataFrame:
    """(path, length) of ``*.arc.gz`` and ``*.warc.gz`` files; contents are not read."""
    files = spark.read.format("binaryFile").load(glob).select("path", "length")
    return files.where(F.col("path").rlike(r"\.w?arc\.gz$"))


def _splits(files: DataFrame, split_bytes: int | None) -> DataFrame:
    if split_bytes is None:
        return files.select("path", F.lit(0).cast("bigint").alias("start"), F.greatest("length", F.lit(1)).alias("stop"))
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes))
    ranges = files.select("path", F.explode(starts).alias("start"))
    return ranges.select("path", "start", (F.col("start") + split_bytes).alias("stop"))


def read_archives(spark: SparkSession, glob: str, split_bytes: int | None = SPLIT_BYTES) -> DataFrame:
    """All records of the archives: ``archive_file, rec_type, record_date, url, html, archive_path``.

    The path tells apart archives of one name in several folders.

    ``html`` is the decoded page of a response, NULL otherwise. A damaged record
    shows up as ``rec_type = 'unreadable'``, with the reason in ``html``; reading goes on behind it.

    A range finds its first record by the opening bytes of a gzip member and of the record inside. For
    crawls that downloaded web archives themselves, ``split_bytes=None`` reads each file in one task.
    """
    return read_files(list_archives(spark, glob), split_bytes)


def read_files(files: DataFrame, split_bytes: int | None = SPLIT_BYTES, accounts: bool = False) -> DataFrame:
    """Records of listed files (path, length), a range of bytes to a task.

    With ``accounts``, each range ends with a row ``rec_type = 'account'`` for each type of record in it: the type stands in
    ``url``, the number of records in ``html``.
    """
    ranges = _splits(files, split_bytes)
    return ranges.repartition(max(1, ranges.count())).mapInArrow(_range_reader(accounts), WEB_RECORD)


def archive_name(path: str = "path"):
    return F.element_at(F.split(path, "/"), -1)


def pending(files: DataFrame, done: DataFrame) -> DataFrame:
    """Listed files that are not done; none is opened.

    ``done`` names them by full ``path`` where it has that column, which tells apart archives of one name in several
    folders; else by ``archive_file``, which is right only where names are unique.
    """
    if "path" in done.columns:
        return files.join(done.select("path"), "path", "left_anti").select("path", "length")
    named = files.withColumn("archive_file", archive_name())
    return named.join(done.select("archive_file"), "archive_file", "left_anti").select("path", "length")


def stream_archives(spark: SparkSession, directory: str, split_bytes: int | None = SPLIT_BYTES,
                    max_files: int | None = None, accounts: bool = False) -> DataFrame:
    """The same rows as a stream: the query's checkpoint remembers which archives are done, by their paths."""
    reader = spark.readStream.format("binaryFile").schema(
        "path string, modificationTime timestamp, length bigint, content binary"
    ).option("pathGlobFilter", "*arc.gz")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = reader.load(directory).select("path", "length")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _splits(files, split_bytes).repartition(tasks).mapInArrow(_range_reader(accounts), WEB_RECORD)


def responses(records: DataFrame) -> DataFrame:
    return records.where(F.col("rec_type") == "response")


def unseen(records: DataFrame, ledger: DataFrame, dedup_within: bool = False) -> DataFrame:
    """Records whose URL is not yet in the ledger of its archive. Repeats inside an archive stay by default."""
    keys = ["archive_path" if {"archive_path"} <= {*records.columns} & {*ledger.columns} else "archive_file", "url"]
    fresh = records.join(ledger.select(*keys), keys, "left_anti")
    return fresh.dropDuplicates(keys) if dedup_within else fresh


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``md5, file_name, dir`` of a whitespace-separated list, and the container told by the suffix."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= 3)
    named = lines.select(*(F.col("p")[i].alias(c) for i, c in enumerate(MANIFEST.names)))
    container = F.when(F.contains("file_name", F.lit(".arc.gz")), "arc").when(
        F.contains("file_name", F.lit(".warc.gz")), "warc")
    return named.withColumn("container", container)


def resolve_manifest(manifest: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifest rows of known containers with their file's path and length, and rows whose file is missing."""
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*", "/")
    wanted = manifest.withColumn("_path", plain(F.concat_ws("/", F.regexp_replace("dir", "/+$", ""), "file_name")))
    present = files.select(plain(F.col("path")).alias("_path"), "path", "length")
    found = wanted.where(F.col("container").isNotNull()).join(present, "_path").drop("_path")
    return found, wanted.join(present, "_path", "left_anti").drop("_path")


# --- inside tasks -----------------------------------------------------------------------------------


def _range_reader(accounts):
    def read(batches):
        """Byte ranges in, record batches out, flushed by size."""
        from collections import Counter

        import pyarrow as pa

        names = ["archive_file", "rec_type", "record_date", "url", "html", "archive_path"]
        for batch in batches:
            for path, start, stop in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows, size, seen = [], 0, Counter()
                for row in _records_of_range(path, start, stop):
                    rows.append((*row, path))
                    seen[row[1]] += 1
                    size += len(row[4] or "")
                    if size >= _BATCH_CHARS or len(rows) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=names)
                        rows, size = [], 0
                if accounts:
                    name = path.rsplit("/", 1)[-1]
                    rows += [(name, "account", None, kind, str(n), path) for kind, n in sorted(seen.items(), key=str)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=names)

    return read


def _records_of_range(path, start, stop):
    import pyarrow.fs as pafs

    if not path.startswith("file:"):
        fs, inner = pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    else:
        from urllib.parse import unquote

        fs, inner = pafs.LocalFileSystem(), unquote(path[len("file:"):])
    name = path.rsplit("/", 1)[-1]
    with fs.open_input_file(inner) as raw:
        at = start if start == 0 else _next_member(raw, start, stop)
        while at is not None and at < stop:
            member = _Member(raw, at)
            try:
                for row in _parse_records(member):
                    yield (name, *row)
                at = member.end()
            except (ValueError, EOFError, OSError, member.error) as problem:
                yield name, "unreadable", None, None, f"{type(problem).__name__} at byte {at}: {problem}"
                at = _next_member(raw, at + 1, stop)


def _next_member(raw, start, stop):
    """Offset of the first gzip member in [start, stop) that opens with an archive record, or None."""
    import re
    import zlib

    opening = re.compile(rb"\s*(WARC/|filedesc://|[a-z]+:\S* \S+ \d{8,14} )")
    size = raw.size()
    at = start
    while at < min(stop, size):
        raw.seek(at)
        window = raw.read(_CHUNK + 2)
        hit = window.find(b"\x1f\x8b\x08")
        while hit >= 0 and hit < _CHUNK and at + hit < stop:
            raw.seek(at + hit)
            try:
                head = zlib.decompressobj(31).decompress(raw.read(4096), 512)
                if opening.match(head):
                    return at + hit
            except zlib.error:
                pass
            hit = window.find(b"\x1f\x8b\x08", hit + 1)
        at += _CHUNK
    return None


class _Member:
    """Line and byte reads from one gzip member (or from a file that is not compressed)."""

    def __init__(self, raw, start):
        import zlib

        self.error = zlib.error
        self._raw, self._pos = raw, start
        raw.seek(start)
        head = raw.read(2)
        raw.seek(start)
        self._unzip = zlib.decompressobj(31) if head == b"\x1f\x8b" else None
        self._buffer, self._done = bytearray(), False

    def _fill(self):
        if self._done:
            return False
        self._raw.seek(self._pos)
        chunk = self._raw.read(_CHUNK if self._unzip is None else 1 << 16)
        self._pos += len(chunk)
        if self._unzip is None:
            self._buffer += chunk
            self._done = not chunk
        elif not chunk:
            raise EOFError("compressed data ends early")
        else:
            self._buffer += self._unzip.decompress(chunk)
            if self._unzip.eof:
                self._pos -= len(self._unzip.unused_data)
                self._done = True
        return True

    def readline(self):
        searched = 0
        while (cut := self._buffer.find(b"\n", searched)) < 0:
            searched = len(self._buffer)
            if not self._fill():
                cut = len(self._buffer) - 1
                break
        line = bytes(self._buffer[:cut + 1])
        del self._buffer[:cut + 1]
        return line

    def read(self, n):
        while len(self._buffer) < n:
            if not self._fill():
                raise EOFError(f"record ends early, {n - len(self._buffer)} bytes missing")
        data = bytes(self._buffer[:n])
        del self._buffer[:n]
        return data

    def end(self):
        """Offset behind the member; the file's end closes a file read without compression."""
        while self._fill():
            self._buffer.clear()
        self._raw.seek(self._pos)
        return self._pos if self._raw.read(1) else None


def _headers(member):
    found = {}
    while (line := member.readline().strip()):
        name, _, value = line.decode("latin-1").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def _parse_records(member):
    """(rec_type, record_date, url, html) of each record."""
    while (line := member.readline()):
        line = line.strip()
        if not line:
            continue
        if line.startswith(b"WARC/"):
            head = _headers(member)
            length = head.get("content-length", "")
            if not (length.isascii() and length.isdigit()):
                raise ValueError(f"record without a length: {head.get('warc-record-id') or head.get('warc-target-uri')}")
            body = member.read(int(length))
            kind, date = head.get("warc-type"), head.get("warc-date")
            url = head.get("warc-target-uri", "").strip("<>") or None
        else:
            # An ARC line is "url address date type length", in the long form with more fields before length.
            fields = line.decode("latin-1").split(" ")
            if len(fields) < 5 or not fields[-1].isdigit():
                raise ValueError(f"no archive record: {line[:80]!r}")
            url, digits = fields[0], fields[2]
            body = member.read(int(fields[-1]))
            kind = "warcinfo" if url.startswith("filedesc://") else "response"
            date = (f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"
                    if len(digits) == 14 else digits)
        yield kind, date, url, _page(body) if kind == "response" else None


def _page(body):
    """Text of an HTTP response: header block off, transfer and content encodings undone."""
    import gzip
    import re
    import zlib

    charset = None
    if body.startswith(b"HTTP/"):
        block, _, body = body.partition(b"\r\n\r\n" if b"\r\n\r\n" in body else b"\n\n")
        fields = {}
        for line in block.decode("latin-1").splitlines()[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        if "chunked" in fields.get("transfer-encoding", "").lower():
            body = _unchunk(body)
        coding = fields.get("content-encoding", "").lower()
        try:
            if "gzip" in coding:
                body = gzip.decompress(body)
            elif "deflate" in coding:
                body = zlib.decompress(body, 15 if body[:1] == b"\x78" else -15)
        except (OSError, EOFError, zlib.error):
            pass  # some crawlers store the body decoded but keep the header
        found = re.search(r"charset=[\"']?([\w.-]+)", fields.get("content-type", ""), re.I)
        charset = found.group(1) if found else None
    try:
        return body.decode(charset or "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def _unchunk(body):
    """Join transfer chunks; data that is not chunked after all is returned as it is."""
    out, at = [], 0
    while at < len(body):
        line_end = body.find(b"\n", at)
        size = body[at:line_end].split(b";")[0].strip() if line_end >= 0 else b""
        try:
            n = int(size, 16)
        except ValueError:
            return body if not out else b"".join(out) + body[at:]
        if n == 0:
            break
        out.append(body[line_end + 1:line_end + 1 + n])
        at = line_end + 1 + n
        while body[at:at + 1] in (b"\r", b"\n"):
            at += 1
    return b"".join(out)
