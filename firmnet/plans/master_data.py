"""Company lists and firm index from the URL/id file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from firmnet.operators import master as m
from firmnet.storage import materialize


@dataclass(frozen=True)
class MasterData:
    firm: DataFrame
    repeats: DataFrame
    year_lists: DataFrame
    firms_per_year: DataFrame
    master_firm: DataFrame
    totals: DataFrame


def build_master_data(url_id: DataFrame, dimension: DataFrame) -> MasterData:
    """Re-key the dimension, list known companies per year, and give new companies an id."""
    kept, repeats = m.rekey_dimension(dimension)
    kept = materialize(kept, "firm")
    master = materialize(m.companies(url_id), "master")
    lists = m.known_companies(m.year_companies(url_id), kept)
    new, firm = m.extend_firms(master, kept)
    mapped = m.master_to_firm(master, kept)
    return MasterData(
        firm=firm,
        repeats=repeats,
        year_lists=lists,
        firms_per_year=m.firms_per_year(lists),
        master_firm=mapped.unionByName(new),
        totals=m.url_id_totals(url_id),
    )


def build_public_firms(public_raw: DataFrame, firm: DataFrame, crawled: DataFrame) -> DataFrame:
    """Public firms of all years with financials, last line of a firm and year wins."""
    return m.public_firms(m.latest_public_rows(public_raw), firm, crawled)
