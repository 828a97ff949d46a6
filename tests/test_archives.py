import gzip
import random

import pytest
from pyspark.sql import functions as F

from firmnet import storage
from firmnet.plans.ingest import ingest_account, ingest_archives, pages_of_records
from firmnet.sources import archives, ledger, stores
from firmnet.streaming import ingest as streaming


def warc(kind, url, body, date="2001-02-03T04:05:06Z", headers="Content-Type: text/html\r\n"):
    if kind == "response":
        body = f"HTTP/1.1 200 OK\r\n{headers}\r\n".encode() + body
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Date: {date}\r\nContent-Length: {len(body)}\r\n"
    head += f"WARC-Target-URI: {url}\r\n" if url else ""
    return head.encode() + b"\r\n" + body + b"\r\n\r\n"


def arc(url, body, date="20000229123456"):
    body = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    return f"{url} 10.0.0.1 {date} text/html {len(body)}\n".encode() + body + b"\n"


ARC_HEAD = b"filedesc://x.arc 0.0.0.0 20000229123456 text/plain 14\n1 0 archive.o\n\n"


def members(records):
    return b"".join(gzip.compress(r) for r in records)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("crawl")
    pages = [warc("response", f"http://www.firm{i % 5}.com/p{i}", f"<p>page number word{'x' * i}</p>".encode())
             for i in range(40)]
    noise = random.Random(1).randbytes(50_000)  # does not compress, so that ranges begin inside records
    records = [warc("warcinfo", None, b"about"), *pages[:20], warc("response", "http://big.org/", noise), *pages[20:],
               warc("request", "http://a.com/", b"GET /")]
    (base / "a.warc.gz").write_bytes(members(records))
    (base / "single.warc.gz").write_bytes(gzip.compress(b"".join(pages[:3])))
    (base / "old.arc.gz").write_bytes(members([ARC_HEAD, arc("http://www.old.co.uk/x/y", b"<li>abc</li><li>def</li>"),
                                               arc("http://old.co.uk/", b"ghi")]))
    (base / "notes.txt").write_text("ignored")
    return base


def test_reads_both_containers_whatever_the_range_size(spark, folder):
    whole = {tuple(r) for r in archives.read_archives(spark, str(folder)).collect()}
    count = archives.read_archives(spark, str(folder)).count()
    assert count == len(whole) == 43 + 3 + 3
    for size in (None, 700, 4096, 30_000):
        rows = archives.read_archives(spark, str(folder), split_bytes=size).collect()
        assert len(rows) == count and {tuple(r) for r in rows} == whole


def test_record_fields(spark, folder):
    rows = {(r["archive_file"], r["url"]): r for r in archives.read_archives(spark, str(folder)).collect()}
    old = rows["old.arc.gz", "http://www.old.co.uk/x/y"]
    assert (old["rec_type"], old["record_date"], old["html"]) == (
        "response", "2000-02-29T12:34:56Z", "<li>abc</li><li>def</li>")
    assert rows["old.arc.gz", "filedesc://x.arc"]["rec_type"] == "warcinfo"
    assert rows["a.warc.gz", "http://a.com/"]["html"] is None
    pages = {(r["page"], r["company"], r["year"], r["level"], tuple(r["words"]))
             for r in pages_of_records(archives.read_archives(spark, f"{folder}/old.arc.gz")).collect()}
    assert pages == {("http://www.old.co.uk/x/y", "old.co.uk", 2000, 2, ("abcdef",)),
                     ("http://old.co.uk/", "old.co.uk", 2000, 1, ("ghi",))}


def test_encodings(spark, tmp_path):
    body = "déjà vu".encode()
    chunked = b"4;x=1\r\n" + body[:4] + b"\r\n" + f"{len(body) - 4:x}\r\n".encode() + body[4:] + b"\r\n0\r\n\r\n"
    (tmp_path / "e.warc.gz").write_bytes(members([
        warc("response", "http://a.com/gz", gzip.compress(body), headers="Content-Encoding: gzip\r\n"),
        warc("response", "http://a.com/plain", body, headers="Content-Encoding: gzip\r\n"),
        warc("response", "http://a.com/chunk", chunked, headers="Transfer-Encoding: chunked\r\n"),
        warc("response", "http://a.com/latin", "déjà vu".encode("latin-1"),
             headers="Content-Type: text/html; charset=ISO-8859-1\r\n"),
        warc("response", "http://a.com/odd", body, headers="Content-Type: text/html; charset=nonsense\r\n"),
    ]))
    rows = archives.read_archives(spark, str(tmp_path)).collect()
    assert len(rows) == 5 and {r["html"] for r in rows} == {"déjà vu"}


def test_damaged_record_is_reported_and_the_rest_is_read(spark, tmp_path):
    good = [gzip.compress(warc("response", f"http://a.com/{i}", b"<p>fine</p>")) for i in range(3)]
    broken = bytearray(good[1])
    broken[len(broken) // 2] ^= 0xFF
    (tmp_path / "d.warc.gz").write_bytes(good[0] + bytes(broken) + good[2] + good[0][:40])
    rows = archives.read_archives(spark, str(tmp_path)).collect()
    assert {r["url"] for r in archives.responses(archives.read_archives(spark, str(tmp_path))).collect()} >= {
        "http://a.com/0", "http://a.com/2"}
    assert "unreadable" in {r["rec_type"] for r in rows}


def test_manifest(spark, folder, tmp_path):
    (tmp_path / "md5.txt").write_text(f"aa  a.warc.gz  {folder}/\nbb old.arc.gz {folder}\ncc gone.warc.gz {folder}\n"
                                      f"dd notes.txt {folder}\n\nbad line\n")
    manifest = archives.read_manifest(spark, str(tmp_path / "md5.txt"))
    found, missing = archives.resolve_manifest(manifest, archives.list_archives(spark, str(folder)))
    assert {(r["file_name"], r["container"]) for r in found.collect()} == {("a.warc.gz", "warc"), ("old.arc.gz", "arc")}
    assert {r["file_name"] for r in missing.where("container is not null").collect()} == {"gone.warc.gz"}
    out = str(tmp_path / "corpus")
    absent = ingest_archives(spark, f"{folder}/old.arc.gz", out, manifest=str(tmp_path / "md5.txt"))
    assert stores.read_corpus(spark, out).count() == 2
    assert {"a.warc.gz", "gone.warc.gz"} <= {r["file_name"] for r in absent.collect()}


def test_unseen_keeps_repeats_inside_an_archive_by_default(spark):
    r = spark.createDataFrame([("a", "u1"), ("a", "u1"), ("a", "u2"), ("b", "u2")], "archive_file string, url string")
    ledger = spark.createDataFrame([("a", "u2")], "archive_file string, url string")
    got = sorted(tuple(x) for x in archives.unseen(r, ledger).collect())
    assert got == [("a", "u1"), ("a", "u1"), ("b", "u2")]
    assert archives.unseen(r, ledger, dedup_within=True).count() == 2


def test_batch_ingest_skips_archives_done_before(spark, folder, tmp_path):
    out, ledger = str(tmp_path / "corpus"), str(tmp_path / "ledger")
    ingest_archives(spark, f"{folder}/old.arc.gz", out, ledger)
    assert stores.read_corpus(spark, out).count() == 2
    for _ in range(2):
        ingest_archives(spark, f"{folder}/[os]*arc.gz", out, ledger)
        assert stores.read_corpus(spark, out).count() == 5
    assert stores.read_corpus(spark, out, 2004).count() == 5
    assert stores.read_corpus(spark, out, 2003, max_level=1).count() == 4
    ingest_archives(spark, f"{folder}/old.arc.gz", out)
    assert stores.read_corpus(spark, out).count() == 7


def test_incremental_ingest_of_archives(spark, tmp_path):
    drop, out, mark = tmp_path / "drop", str(tmp_path / "corpus"), str(tmp_path / "mark")
    drop.mkdir()
    page = warc("response", "http://a.com/x", b"some words")

    def run(keys=()):
        streaming.ingest(archives.stream_archives(spark, str(drop)), out, mark, keys).awaitTermination()
        return stores.read_corpus(spark, out).count()

    (drop / "one.warc.gz").write_bytes(members([page, page]))
    assert run() == 2          # the same URL twice in one archive is kept
    assert run() == 2          # the same archive again adds nothing
    (drop / "two.warc.gz").write_bytes(members([page]))
    assert run() == 3          # the same URL in another archive counts


@pytest.mark.parametrize("keys, want", [(("archive_file", "url"), 2), (("url",), 1)])
def test_incremental_ingest_without_repeats(spark, tmp_path, keys, want):
    drop, out, mark = tmp_path / "drop", str(tmp_path / "corpus"), str(tmp_path / "mark")
    drop.mkdir()
    page = warc("response", "http://a.com/x", b"some words")
    for name in ("one", "two"):
        (drop / f"{name}.warc.gz").write_bytes(members([page, page]))
        streaming.ingest(archives.stream_archives(spark, str(drop)), out, mark, keys).awaitTermination()
    assert stores.read_corpus(spark, out).count() == want


def test_archives_of_one_name_in_two_folders_are_both_read(spark, tmp_path):
    for year in ("2000", "2001"):
        (tmp_path / year).mkdir()
        (tmp_path / year / "a.warc.gz").write_bytes(members([warc("response", "http://a.com/", f"<p>text of {year}</p>".encode())]))
    files = archives.list_archives(spark, str(tmp_path / "*" / "*.gz"))
    done = files.where("path like '%/2000/%'")
    left = archives.pending(files, done)
    assert [r["path"].rsplit("/", 2)[1] for r in left.collect()] == ["2001"]
    records = archives.read_files(files)
    assert records.dropDuplicates(["archive_path", "url"]).count() == 2
    assert archives.unseen(records, archives.read_files(done)).count() == 1


@pytest.mark.parametrize("length", ["", "Content-Length: -3\r\n", "Content-Length: x\r\n"])
def test_a_record_without_a_length_is_reported_and_reading_goes_on(spark, tmp_path, length):
    good = [warc("response", f"http://a.com/{i}", b"<p>fine</p>") for i in range(2)]
    bad = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://bad/\r\n{length}\r\nbody\r\n\r\n".encode()
    (tmp_path / "a.warc.gz").write_bytes(members([good[0], bad, good[1]]))
    rows = archives.read_archives(spark, str(tmp_path / "*.gz")).collect()
    assert sorted(r["rec_type"] for r in rows) == ["response", "response", "unreadable"]


def test_account_tells_what_became_of_each_archive_by_its_path(spark, tmp_path):
    from pyspark.sql import Observation

    page = lambda url, n: warc("response", url, b"<p>" + b"some words " * n + b"</p>")
    for folder in ("x", "y"):  # archives of one name in two folders
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.warc.gz").write_bytes(members([page(f"http://{folder}.com/{i}", i) for i in range(3)] + [
            warc("request", "http://x.com/", b"GET /")]))
    bad = b"WARC/1.0\r\nWARC-Type: response\r\n\r\nbody\r\n\r\n"
    (tmp_path / "y" / "a.warc.gz").write_bytes(members([page("http://y.com/0", 4)]) + gzip.compress(bad) + members([page("http://y.com/1", 1)]))
    (tmp_path / "list.txt").write_text("\n".join(f"0 {name} {tmp_path}/{folder}" for folder, name in (
        ("x", "a.warc.gz"), ("y", "a.warc.gz"), ("y", "gone.warc.gz"))))
    out, seen = str(tmp_path / "corpus"), Observation("ingest")
    ingest_archives(spark, str(tmp_path / "*"), out, manifest=str(tmp_path / "list.txt"), observation=seen)
    found = {r["archive_path"].split(str(tmp_path))[1]: tuple(r)[1:] for r in ingest_account(spark, out).collect()}
    assert found == {"/x/a.warc.gz": (4, 3, 0, 3, 6, False), "/y/a.warc.gz": (3, 2, 1, 2, 10, False), "/y/gone.warc.gz": (0, 0, 0, 0, 0, True)}
    assert seen.get == {"pages": 5, "words": 16, "records": 7, "unreadable": 1}
    assert stores.read_corpus(spark, out).count() == 5


def test_archives_are_read_once_for_pages_and_accounts(spark, folder):
    from firmnet.plans.ingest import rows_of_records

    rows = rows_of_records(archives.read_files(archives.list_archives(spark, str(folder)), accounts=True))
    rows = ledger.drop_seen(rows, ("page",), "r", None, F.col("kind") == "page")
    assert rows._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_a_run_done_again_replaces_its_rows(spark, folder, tmp_path):
    out = str(tmp_path / "corpus")
    for _ in range(2):
        ingest_archives(spark, f"{folder}/old.arc.gz", out, run="2000")
    assert stores.read_corpus(spark, out).count() == 2 and storage.runs(spark, out) == ["2000"]
    ingest_archives(spark, f"{folder}/old.arc.gz", out, run="2001")
    assert stores.read_corpus(spark, out).count() == 4


def test_ledger_rows_are_not_shuffled(spark, tmp_path):
    path, keys = str(tmp_path / "ledger"), ("archive_path", "page")
    rows = spark.createDataFrame([(f"a{i % 3}", f"u{i}", "page") for i in range(100)] + [("a", None, "page"), ("a", "u1", "account"), ("a", "u1", "account")],
                                 "archive_path string, page string, kind string")
    ledger.note(spark, path, keys, "r0", rows.where("page < 'u5' and kind = 'page'"), buckets=8)
    fresh = ledger.drop_seen(rows.unionByName(rows.where("kind = 'page'")), keys, "r1", path, F.col("kind") == "page")
    want = {(f"a{i % 3}", f"u{i}") for i in range(100) if f"u{i}" >= "u5"}
    got = sorted(map(tuple, fresh.collect()), key=str)
    assert {r[:2] for r in got if r[1] and r[2] == "page"} == want and len(got) == len(want) + 2 + 2  # two without a key, two accounts
    assert ledger.drop_seen(rows, keys, "r0", path).count() > len(want)  # a run's own notes do not count
    with_merge = fresh.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = ledger.drop_seen(rows, keys, "r1", path, F.col("kind") == "page")
        plan = fresh._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_merge)
    assert plan.count("Exchange") == 1 and "SelectedBucketsCount: 8 out of 8" in plan  # the new rows alone


def test_many_runs_keep_no_state(spark, tmp_path):
    drop, out, mark = tmp_path / "drop", str(tmp_path / "corpus"), str(tmp_path / "mark")
    drop.mkdir()
    for i in range(4):
        (drop / f"{i}.warc.gz").write_bytes(members([warc("response", f"http://a.com/{k}", b"some words") for k in range(i + 1)]))
        streaming.ingest(archives.stream_archives(spark, str(drop)), out, mark, ("url",)).awaitTermination()
        assert stores.read_corpus(spark, out).count() == i + 1
    assert not (tmp_path / "mark" / "state").exists()
    assert len(list((tmp_path / "mark-ledger").glob("*/*.parquet"))) <= 4 * 4  # a file for each bucket with new keys
