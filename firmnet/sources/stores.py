"""Parquet stores of the corpus and of firm vectors.

A corpus is a table of runs (``run=…/kind=…/year=…``). Pages have the kind ``page``; what else a run has to tell, the
accounts of its archives, stands beside them and is not read with them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmnet.operators.corpus import look_back, shallow
from firmnet.schemas import CORPUS, CORPUS_ROW, FIRM_VECTOR
from firmnet.storage import drop_run, runs, write_run

_PLACE = ("kind", "year", "company", "level", "page")


def corpus_rows(pages: DataFrame) -> DataFrame:
    """Pages as rows of the stored corpus; the archive's path is kept where there is one."""
    path = F.col("archive_path") if "archive_path" in pages.columns else F.lit(None).cast("string")
    return pages.select(*CORPUS.names, F.lit("page").alias("kind"), path.alias("archive_path"), F.lit("response").alias("rec_type"),
                        F.size(F.coalesce("words", F.array())).cast("bigint").alias("n"))


def write_corpus_run(rows: DataFrame, path: str, run: str, replace: bool = True) -> None:
    """Store a run. Rows are rebalanced by year and company: files have the size Spark is set to, whatever tasks the rows come
    from, and a company that outgrows one is split. Within a file rows are sorted, so pages of other companies are skipped."""
    placed = rows.select(*CORPUS_ROW.names).hint("rebalance", "kind", "year", "company").sortWithinPartitions(*_PLACE)
    write_run(placed, path, run, ("kind", "year"), replace)


def write_corpus(pages: DataFrame, path: str, run: str | None = None) -> None:
    """Append pages; a named run that is written again replaces its rows."""
    write_corpus_run(corpus_rows(pages), path, run or uuid.uuid4().hex)


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a stored corpus, of every kind."""
    return spark.read.schema(CORPUS_ROW).parquet(path)


def read_corpus(spark: SparkSession, path: str, year: int | None = None, span: int = 4,
                max_level: int = 3) -> DataFrame:
    """Pages of the look-back years and shallow levels: year prunes folders, level prunes row groups."""
    corpus = stored_rows(spark, path).where("kind = 'page'").select(*CORPUS.names)
    return corpus if year is None else shallow(look_back(corpus, year, span), max_level)


def compact_corpus(spark: SparkSession, path: str) -> str:
    """Put all runs into one, in ranges of company within each year, so that statistics of whole files tell which of them a
    company's pages are in. Returns the new run's name. Nobody should read the corpus meanwhile: the old runs go last."""
    old, new = runs(spark, path), f"compact-{uuid.uuid4().hex}"
    rows = stored_rows(spark, path).select(*CORPUS_ROW.names)
    ranged = rows.repartitionByRange(*(F.asc_nulls_first(c) for c in _PLACE)).sortWithinPartitions(*(F.asc_nulls_first(c) for c in _PLACE))
    write_run(ranged, path, new, ("kind", "year"))
    for run in old:
        drop_run(spark, path, run)
    return new


def write_vectors(vectors: DataFrame, path: str, mode: str = "error") -> None:
    vectors.select(*FIRM_VECTOR.names).write.parquet(path, mode=mode)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FIRM_VECTOR).parquet(path)


def vector_entities(vectors: DataFrame) -> DataFrame:
    """Companies that have a vector; reads one column."""
    return vectors.where(F.col("v").isNotNull()).select("company").distinct()
