"""Archives to corpus."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from firmnet.functions.text import page_words
from firmnet.functions.urls import crawl_year, url_level, with_registrable_domain
from firmnet.schemas import CORPUS_ROW
from firmnet.sources import ledger as ledgers
from firmnet.sources.archives import (
    archive_name, list_archives, pending, read_files, read_manifest, resolve_manifest, responses,
)
from firmnet.sources.stores import stored_rows, write_corpus_run
from firmnet.storage import materialize, table_exists

# A record's key columns, taken from a row of the corpus.
KEYS = {"archive_path": F.col, "archive_file": lambda _: archive_name("archive_path"), "url": lambda _: F.col("page")}


def pages_of_records(records: DataFrame, sep: str = "") -> DataFrame:
    """Responses as corpus pages keyed by registrable domain, year and depth, without a shuffle."""
    path = ["archive_path"] if "archive_path" in records.columns else []
    keyed = with_registrable_domain(responses(records), "url", underscore_as_slash=False)
    return keyed.select(
        "archive_file", *path, "company", crawl_year(F.col("record_date")).alias("year"),
        url_level(F.col("url")).alias("level"), F.col("url").alias("page"),
        page_words(F.col("html"), sep).alias("words"),
    )


def rows_of_records(records: DataFrame) -> DataFrame:
    """Rows of a stored corpus: pages, unreadable records with their reason, and accounts of what each range held."""
    told = records.where(F.col("rec_type").isin("response", "account", "unreadable"))
    kind, url = F.col("rec_type"), F.col("url")
    page = kind == "response"
    words = F.when(page, page_words(F.col("html")))
    keyed = with_registrable_domain(told, "url", underscore_as_slash=False).select("*", words.alias("words"))
    return keyed.select(
        F.when(page, F.col("company")).alias("company"), F.when(page, crawl_year(F.col("record_date"))).alias("year"),
        F.when(page, url_level(url)).alias("level"), F.when(page, url).when(kind == "unreadable", F.col("html")).alias("page"), "words",
        F.when(page, "page").otherwise(kind).alias("kind"), "archive_path", F.when(kind == "account", url).otherwise(kind).alias("rec_type"),
        F.when(page, F.size("words")).when(kind == "account", F.col("html").cast("bigint")).otherwise(1).cast("bigint").alias("n"))


def missing_rows(missing: DataFrame) -> DataFrame:
    """Rows of a stored corpus for manifest lines without a file."""
    given = {"kind": F.lit("missing"), "archive_path": F.concat_ws("/", F.regexp_replace("dir", "/+$", ""), "file_name"), "n": F.lit(1)}
    return missing.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CORPUS_ROW))


def ingest_records(records: DataFrame, corpus: str, run: str, dedup_keys: Sequence[str] = (), ledger: str | None = None,
                   missing: DataFrame | None = None, observation: Observation | None = None,
                   buckets: int = ledgers.BUCKETS) -> None:
    """Store the pages of one run, with the accounts of its archives, unreadable records and missing files, while the archives
    are read once. ``records`` come with accounts (see ``archives.read_files``).

    A run that is done again replaces its rows. With ``dedup_keys``, repeats of a page within the run are left out; with a
    ``ledger``, also pages whose key an earlier run stored. ``observation`` is filled by the same job: pages, words, records
    and unreadable ones.
    """
    rows = rows_of_records(records)
    own = {f"_{k}": KEYS[k](k) for k in dedup_keys}
    if dedup_keys:
        rows = ledgers.drop_seen(rows.withColumns(own), list(own), run, ledger, F.col("kind") == "page", buckets).drop(*own)
    if missing is not None:
        rows = rows.unionByName(missing_rows(missing))
    if observation is not None:
        kind, n = F.col("kind"), F.col("n")
        rows = rows.observe(observation, F.count_if(kind == "page").alias("pages"), F.sum(F.when(kind == "page", n)).alias("words"),
                            F.sum(F.when(kind == "account", n)).alias("records"), F.count_if(kind == "unreadable").alias("unreadable"))
    write_corpus_run(rows, corpus, run)
    if dedup_keys and ledger:
        spark = records.sparkSession
        ledgers.note(spark, ledger, list(own), run, stored_rows(spark, f"{corpus}/run={run}").where("kind = 'page'").withColumns(own), buckets)


def ingest_account(spark: SparkSession, corpus: str) -> DataFrame:
    """What became of each archive, by its full path: records and responses read, unreadable ones, pages stored and their
    words, and whether the file was missing. Reads narrow columns of the corpus, no archive."""
    rows = stored_rows(spark, corpus).select("kind", "archive_path", "rec_type", "n")
    is_ = lambda kind: F.col("kind") == kind
    add = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return rows.groupBy("archive_path").agg(
        add(is_("account")).alias("records"), add(is_("account") & (F.col("rec_type") == "response")).alias("responses"),
        F.count_if(is_("unreadable")).alias("unreadable"), F.count_if(is_("page")).alias("pages"), add(is_("page")).alias("n_words"),
        F.max(is_("missing")).alias("missing"))


def ingest_archives(spark: SparkSession, glob: str, corpus: str, ledger: str | None = None,
                    dedup_within: bool = False, manifest: str | None = None, run: str | None = None,
                    observation: Observation | None = None) -> DataFrame | None:
    """Batch form: append the words of each page of the archives not yet in the ledger, then note them there.

    With a ``manifest`` only the archives it names are read; its rows without a file are returned, and kept in the account.

    The ledger is written after the corpus. A ``run`` that died between the two may be started again under its name: its
    rows are replaced, not added.
    """
    files, missing = list_archives(spark, glob), None
    if manifest is not None:
        found, missing = resolve_manifest(read_manifest(spark, manifest), files)
        files = found.select("path", "length").distinct()
    if ledger is not None and table_exists(spark, ledger):
        files = pending(files, spark.read.parquet(ledger))
    files = materialize(files, "archives")  # the ledger has to name the files that were read
    ingest_records(read_files(files, accounts=True), corpus, run or uuid.uuid4().hex, ("archive_path", "url") if dedup_within else (),
                   missing=missing, observation=observation)
    if ledger is not None:
        files.select("path", archive_name().alias("archive_file")).write.parquet(ledger, mode="append")
    return missing
