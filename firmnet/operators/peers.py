"""Peer edges: filters, id translation, rival means and monopolists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmnet.operators.similarity import Pairs, TopPairs, cosine_pairs, percent_count
from firmnet.schemas import LR_INPUT, METRICS

EDGE = ("focal_firmid", "rival_firmid", "wtnic_score")


def above(peers: DataFrame, threshold: float = 0.24) -> DataFrame:
    """Edges with at least the threshold score."""
    return peers.where(F.col("wtnic_score") >= threshold)


def known_keys(df: DataFrame, firm: DataFrame, key: str = "company") -> DataFrame:
    """Rows whose key is neither blank nor missing from the firm dimension."""
    return df.where(F.col(key) != "").join(firm.select(F.col("company").alias(key)), key, "left_semi")


def public_vectors(vectors: DataFrame, public: DataFrame) -> DataFrame:
    """(firm_id, v) of the documents that are public firms."""
    ids = public.select("company", F.col("firm_id").cast("bigint").alias("firm_id"))
    return vectors.select("company", "v").join(ids, "company").select("firm_id", "v")


def public_peers(vectors: DataFrame, public: DataFrame, top_k: int | None = None, **options) -> DataFrame:
    """All scored pairs of public firms, by firm id, without self pairs.

    Without a rank cut only public vectors are paired at all. With one, each public firm ranks every
    document of the model (itself included) before rivals that are not public are dropped.
    """
    if top_k is None:
        return cosine_pairs(public_vectors(vectors, public), "firm_id", "v", **options)
    return _known_best(vectors, public, top_k=top_k, self_uses_rank=True, **options)


def _known_best(vectors: DataFrame, firm: DataFrame, **cuts) -> DataFrame:
    """Best pairs of all companies, by firm id, where both ends are known.

    Company and firm id travel through the tiles as one key, so nothing is joined onto the edges; equal
    scores are ranked by company.
    """
    ids = firm.select("company", F.col("firm_id").cast("bigint").alias("firm"))
    keyed = vectors.where(F.col("company").isNotNull()).select("company", "v").join(ids, "company", "left")
    edges = cosine_pairs(keyed.select(F.struct("company", "firm").alias("key"), "v"), "key", "v",
                         focal=F.col("key.firm").isNotNull(), **cuts)
    return edges.where(F.col("rival_firmid.firm").isNotNull()).select(
        F.col("focal_firmid.firm").alias("focal_firmid"), F.col("rival_firmid.firm").alias("rival_firmid"), "wtnic_score")


def private_peers(vectors: DataFrame, firm: DataFrame, percent: float = 15.0, threshold: float = 0.24,
                  **options) -> DataFrame:
    """Each firm's best ``percent`` of all entities, then known rivals, then the threshold.

    Unknown entities keep their place in the ranks but are no edges' end.
    """
    return _known_best(vectors, firm, min_score=threshold, top_k=percent_count(vectors.count(), percent), **options)


def _renamed(metrics: DataFrame, key: str, prefix: str) -> DataFrame:
    return metrics.select(F.col("firm_id").alias(key), *(F.col(m).alias(f"{prefix}_{m}") for m in METRICS))


def with_rival_metrics(edges: DataFrame | Pairs, metrics: DataFrame) -> DataFrame:
    """The rival's financials on each edge; edges to a firm without any are dropped (see ``unknown_rivals``).

    Give :class:`Pairs` where the edges are not stored: the financials travel with the vectors, and no edge is shuffled.
    """
    values = _renamed(metrics, "rival_firmid", "rival")
    if isinstance(edges, Pairs):
        return edges.joined("inner", rival=values)
    return edges.join(values, "rival_firmid")


def unknown_rivals(edges: DataFrame | Pairs, metrics: DataFrame) -> DataFrame:
    """Edges that ``with_rival_metrics`` drops."""
    known = metrics.select(F.col("firm_id").alias("rival_firmid"))
    return edges.joined("anti", rival=known) if isinstance(edges, Pairs) else edges.join(known, "rival_firmid", "left_anti")


def rival_means(edges_with_metrics: DataFrame) -> DataFrame:
    return edges_with_metrics.groupBy("focal_firmid").agg(*(F.avg(f"rival_{m}").alias(f"rival_{m}") for m in METRICS))


def with_focal_metrics(firms: DataFrame, metrics: DataFrame) -> DataFrame:
    return firms.join(_renamed(metrics, "focal_firmid", "focal"), "focal_firmid")


def monopolists(all_edges: DataFrame, kept_edges: DataFrame) -> DataFrame:
    """Focal firms that lost all their edges in the cut."""
    return all_edges.select("focal_firmid").distinct().join(kept_edges.select("focal_firmid"), "focal_firmid",
                                                            "left_anti")


def top_rivals(top: TopPairs, metrics: DataFrame) -> DataFrame:
    """(focal_firmid, pairs, known, rival means) of each firm with a kept pair: what ``with_rival_metrics`` and ``rival_means``
    make of the kept pairs, summed up where they are multiplied. Give it stored to :func:`lr_input_of`."""
    return top.rival_means(metrics, "firm_id", METRICS).select(
        "focal_firmid", "pairs", "known", *(F.col(m).alias(f"rival_{m}") for m in METRICS))


def lr_input(all_edges: DataFrame, kept_edges: DataFrame, metrics: DataFrame) -> DataFrame:
    """Regression input: rival means and own values per focal firm, monopolists with zero means and flag 1."""
    return _lr_rows(rival_means(with_rival_metrics(kept_edges, metrics)), monopolists(all_edges, kept_edges), metrics)


def lr_input_of(all_edges: DataFrame, rivals: DataFrame, metrics: DataFrame) -> DataFrame:
    """The same from the firms' :func:`top_rivals`."""
    means = rivals.where("known > 0").select("focal_firmid", *(f"rival_{m}" for m in METRICS))
    return _lr_rows(means, monopolists(all_edges, rivals), metrics)


def _lr_rows(means: DataFrame, alone: DataFrame, metrics: DataFrame) -> DataFrame:
    alone = alone.select("focal_firmid", *(F.lit(0.0).alias(f"rival_{m}") for m in METRICS), F.lit(1).alias("monopolist"))
    return with_focal_metrics(means.withColumn("monopolist", F.lit(0)).unionByName(alone), metrics).select(*LR_INPUT.names)


def focal_counts(all_edges: DataFrame, kept_edges: DataFrame, regression: DataFrame) -> DataFrame:
    """Distinct focal firms before the cut, after it, and in the regression."""
    def n(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.countDistinct("focal_firmid").alias("focal_firms")).withColumn("stage", F.lit(name))

    parts = [n(all_edges, "before_cut"), n(kept_edges, "after_cut"), n(regression, "regression")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("stage", "focal_firms")
