"""Companies, firm ids, year lists and public firms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmnet.functions.urls import with_domain_path_key, with_registrable_domain
from firmnet.operators.rank import assign_ids
from firmnet.params import FIRST_YEAR
from firmnet.schemas import METRICS


def valid_years(df: DataFrame, first: int = FIRST_YEAR) -> DataFrame:
    """Years a build may be run for; the unknown year 0 is never one of them."""
    return df.where(F.col("year") >= first)


def companies(url_id: DataFrame) -> DataFrame:
    """(company, master_id, years, n_lines): first-seen id and the set of years."""
    return url_id.groupBy("company").agg(
        F.min_by("master_id", "line_no").alias("master_id"),
        F.array_sort(F.collect_set("year")).alias("years"),
        F.count("*").alias("n_lines"),
    )


def url_id_totals(url_id: DataFrame) -> DataFrame:
    """Lines, companies, (company, year) pairs and pairs with a known year, in one shuffle by company."""
    per = companies(url_id)
    known = F.size(F.filter("years", lambda y: y != 0))
    return per.agg(
        F.coalesce(F.sum("n_lines"), F.lit(0)).alias("total_lines"),
        F.count("*").alias("companies"),
        F.coalesce(F.sum(F.size("years")), F.lit(0)).cast("bigint").alias("company_years"),
        F.coalesce(F.sum(known), F.lit(0)).cast("bigint").alias("valid_years"),
    )


def year_companies(url_id: DataFrame) -> DataFrame:
    return url_id.select("year", "company").distinct()


def known_companies(year_company: DataFrame, firm: DataFrame) -> DataFrame:
    """Year lists restricted to companies of the firm dimension."""
    return year_company.join(firm.select("company"), "company", "left_semi").select("year", "company")


def firms_per_year(year_company: DataFrame) -> DataFrame:
    return year_company.groupBy("year").agg(F.count("*").alias("firms"))


def master_to_firm(master: DataFrame, firm: DataFrame) -> DataFrame:
    return master.select("company", "master_id").join(firm.select("company", "firm_id"), "company")


def not_indexed(master_firm: DataFrame, firm: DataFrame) -> DataFrame:
    """Mapped companies that the dimension does not hold; empty after a sound build."""
    return master_firm.select("company").subtract(firm.select("company"))


def unknown_companies(master: DataFrame, firm: DataFrame) -> DataFrame:
    """(company, master_id) of registrable domains without a firm id; the lowest master id stands for a domain."""
    keyed = with_registrable_domain(master.select(F.col("company").alias("_raw"), "master_id"), "_raw")
    fresh = keyed.groupBy("company").agg(F.min("master_id").alias("master_id"))
    return fresh.join(firm.select("company"), "company", "left_anti")


def extend_firms(master: DataFrame, firm: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New (company, master_id, firm_id) rows, and the dimension with those firms appended."""
    new = assign_ids(firm, unknown_companies(master, firm), "company", "master_id")
    blank = F.lit(None).cast("string")
    rows = new.select("company", "firm_id", blank.alias("naics"), blank.alias("obtained_from"))
    return new, firm.select("company", "firm_id", "naics", "obtained_from").unionByName(rows)


def rekey_dimension(dimension: DataFrame, order: str = "company") -> tuple[DataFrame, DataFrame]:
    """Re-key a dimension by domain and path: first row of a key wins, the others are listed as repeats.

    ``order`` has to be unique. Winners are one aggregate with map-side combine and repeats an
    anti-join on the unique column, so a key with very many rows never meets in one task.
    """
    plain = dimension.withColumn("_order", F.col(order))
    keyed = with_domain_path_key(plain, "company", "_key")
    rest = [c for c in dimension.columns if c != "company"]
    winners = keyed.groupBy("_key").agg(F.min_by(F.struct("_order", *rest), "_order").alias("_row"))
    kept = winners.select(F.col("_key").alias("company"), *(F.col(f"_row.{c}").alias(c) for c in rest))
    won = winners.select(F.col("_row._order").alias("_order"))
    repeats = keyed.join(won, "_order", "left_anti").select("company", F.col("_key").alias("new_key"))
    return kept, repeats


def latest_public_rows(public_raw: DataFrame, url: str = "url") -> DataFrame:
    """One row per year and company key; a later line replaces an earlier one."""
    keyed = with_domain_path_key(public_raw, url)
    carried = [c for c in keyed.columns if c not in ("year", "company")]
    last = keyed.groupBy("year", "company").agg(F.max_by(F.struct(*carried), "line_no").alias("_row"))
    return last.select("year", "company", *(F.col(f"_row.{c}").alias(c) for c in carried if c not in ("line_no", url)))


def public_firms(public: DataFrame, firm: DataFrame, crawled: DataFrame) -> DataFrame:
    """Public firms that have crawled data and a firm id."""
    with_data = public.join(crawled.select("company"), "company", "left_semi")
    kept = [c for c in ("gvkey", *METRICS) if c in public.columns]
    return with_data.join(firm.select("company", "firm_id"), "company").select("year", "company", "firm_id", *kept)


def training_set(sample: DataFrame, public: DataFrame) -> DataFrame:
    """Sampled private companies and all public ones, as a set without blanks."""
    both = sample.select("company").union(public.select("company"))
    return both.where(F.col("company") != "").distinct()
