"""Page words to firm text: windows, bags of words, vocabulary, coverage.

A corpus row is one page: ``company, year, level, page, words``. A firm's text is a set of such rows
(or of bounded segments of them); no operator builds one row out of a firm with unboundedly many pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmnet.functions.text import normalise_words
from firmnet.functions.urls import with_registrable_domain
from firmnet.storage import materialize

SEGMENT_WORDS = 100_000


def look_back(df: DataFrame, year: int, span: int = 4) -> DataFrame:
    """Rows of the years ``year - span`` to ``year``; a partition filter on a stored corpus."""
    return df.where(F.col("year").between(year - span, year))


def shallow(df: DataFrame, max_level: int = 3) -> DataFrame:
    return df.where(F.col("level") <= max_level)


def firm_pages(corpus: DataFrame, year: int, span: int = 4, max_level: int = 3) -> DataFrame:
    """Pages that make up the firms' texts of a year, words lower-cased."""
    kept = shallow(look_back(corpus, year, span), max_level).where(F.col("company") != "")
    none = F.array().cast("array<string>")
    return kept.withColumn("words", F.coalesce(normalise_words(F.col("words")), none))


def company_domains(companies: DataFrame) -> DataFrame:
    """(_company, company): each listed company and the registrable domain its pages are stored by."""
    listed = companies.select(F.col("company").alias("_company")).where(F.col("_company") != "").distinct()
    return with_registrable_domain(listed, "_company", "company")


def domain_text(companies: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of the domains that listed companies belong to, each once however many companies share it."""
    return pages.join(company_domains(companies).select("company").distinct(), "company", "left_semi")


def firm_text(companies: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of each listed company. Pages are stored by registrable domain, and companies may be keyed
    by domain and path, so several of them can share the pages of one domain. This copies a domain's text for
    each of its companies; where a result per domain can be handed on instead, use :func:`domain_text`."""
    shared = pages.join(company_domains(companies), "company").drop("company")
    return shared.withColumnRenamed("_company", "company").select(*pages.columns)


def _segments(most: int):
    """Cut the words of pages that come sorted by company into segments of at most ``most`` words, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        company, made, start, rest = None, 0, 0, []

        def segments(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made, start, rest
            words = pa.concat_arrays(rest) if len(rest) > 1 else (rest[0] if rest else pa.array([], pa.string()))
            ends = list(range(most, len(words) + 1, most))
            if last and ((ends[-1] if ends else 0) < len(words) or not made and not ends):
                ends.append(len(words))
            done = ends[-1] if ends else 0
            if ends:
                sizes = np.diff([0, *ends])
                at = start + np.cumsum([0, *sizes[:-1]])
                lists = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), words.slice(0, done))
                yield pa.RecordBatch.from_arrays([pa.array([company] * len(ends), pa.string()), pa.array(range(made, made + len(ends)), pa.int64()),
                                                  pa.array(at, pa.int64()), lists], names=["company", "segment", "start", "words"])
                made, start = made + len(ends), start + done
            rest = [words.slice(done)]

        for batch in batches:
            names, lists = batch.column("company").to_pylist(), batch.column("words")
            edges = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            for a, b in zip(edges, edges[1:]):
                if a < b:
                    if names[a] != company and company is not None:
                        yield from segments(True)
                    if names[a] != company:
                        company, made, start, rest = names[a], 0, 0, []
                    rest.append(lists.slice(a, b - a).flatten())
                    yield from segments(False)
        if company is not None:
            yield from segments(True)

    return run


def bag_of_words(pages: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """(company, segment, start, words): each firm's words in order of year, level and page.

    The segments of a firm, put one after the other, are its whole bag; ``start`` counts the words ahead of a segment. No
    segment holds more than ``segment_words`` words, so neither a firm owning a third of all pages nor a page of a million
    words makes a large row. Pages are shuffled once, by ranges of the whole order, and cut where they lie. What the
    ranges ahead hold of a firm is added from a table of at most one row for each range.
    """
    order = ["company", "year", "level", "page"]
    none = F.array().cast("array<string>")
    ranged = pages.where(F.col("company").isNotNull()).select(*order, F.coalesce("words", none).alias("words"))
    ranged = ranged.repartitionByRange(*(F.asc_nulls_last(c) for c in order)).sortWithinPartitions(*(F.asc_nulls_last(c) for c in order))
    cut = ranged.select("company", "words").mapInArrow(_segments(segment_words), "company string, segment long, start long, words array<string>")
    cut = materialize(cut.withColumn("_part", F.spark_partition_id()), "segments")
    runs = cut.groupBy("company", "_part").agg(F.count("*").alias("_segments"), F.sum(F.size("words")).alias("_words"))
    before = W.partitionBy("company").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ahead = runs.select("company", "_part", F.sum("_segments").over(before).alias("_skip"), F.sum("_words").over(before).alias("_ahead"))
    ahead = F.broadcast(ahead.where(F.col("_skip") > 0))  # a range has one firm at most that began in a range ahead
    add = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
    return cut.join(ahead, ["company", "_part"], "left").select("company", add("segment", "_skip"), add("start", "_ahead"), "words")


def word_counts(pages: DataFrame) -> DataFrame:
    """(company, n_words); summed map-side, whatever the number of pages."""
    return pages.groupBy("company").agg(F.sum(F.size("words")).cast("bigint").alias("n_words"))


def min_words(pages: DataFrame, n: int = 100) -> DataFrame:
    """Companies with at least ``n`` words, and never those without any."""
    return word_counts(pages).where(F.col("n_words") >= max(n, 1))


def vocabulary(pages: DataFrame, min_count: int = 5) -> DataFrame:
    """(word, n) for words seen at least ``min_count`` times."""
    tokens = pages.select(F.explode("words").alias("word"))
    return tokens.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def corpus_coverage(companies: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listed companies with at least one word of text, and those without any."""
    listed = companies.select("company").where(F.col("company") != "").distinct()
    with_text = pages.where(F.size("words") > 0).select("company").distinct()
    return listed.join(with_text, "company", "left_semi"), listed.join(with_text, "company", "left_anti")


def domain_coverage(companies: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listed companies whose domain has at least one word of text, and the others."""
    keyed = company_domains(companies)
    with_text = pages.where(F.size("words") > 0).select("company").distinct()
    sides = (keyed.join(with_text, "company", how) for how in ("left_semi", "left_anti"))
    return tuple(side.select(F.col("_company").alias("company")) for side in sides)


def run_metrics(records: DataFrame) -> DataFrame:
    """Records, responses, pages and words per archive, which is known by its path where records have one.

    For archives that are ingested, ``plans.ingest.ingest_account`` has the same without reading them again.
    """
    response = F.col("rec_type") == "response"
    key = "archive_path" if "archive_path" in records.columns else "archive_file"
    return records.groupBy(key).agg(
        F.count("*").alias("records"),
        F.count_if(response).alias("responses"),
        F.countDistinct(F.when(response, F.col("url"))).alias("urls"),
        F.coalesce(F.sum(F.when(response, F.size("words"))), F.lit(0)).cast("bigint").alias("n_words"),
    )
