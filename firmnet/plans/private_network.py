"""Infer vectors for all private firms, pair them, measure the overlap of their industry codes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import Word2VecModel
from pyspark.sql import DataFrame

from firmnet.operators.corpus import firm_pages
from firmnet.operators.encoder import infer_vectors
from firmnet.operators.industry import entities_not_found, entity_codes, naics_report, with_pair_codes
from firmnet.operators.peers import known_keys, private_peers
from firmnet.params import Params
from firmnet.plans.outputs import Outputs, fingerprint
from firmnet.sources import tables


@dataclass(frozen=True)
class PrivateNetwork:
    vectors: DataFrame
    peers: DataFrame
    report: DataFrame
    not_found: DataFrame  # entities without a row in the firm dimension


def build_private_network(params: Params, model: Word2VecModel, trained: DataFrame, corpus: DataFrame,
                          private: DataFrame, firm: DataFrame, mode: str = "reference", folder: str | None = None,
                          if_exists: str = "skip") -> PrivateNetwork:
    """``trained`` are the stored vectors of the training firms. With a ``folder``, finished steps are reused."""
    content = fingerprint((params, mode), trained, corpus, private, firm) if folder else ""
    out = Outputs(corpus.sparkSession, folder, if_exists, content)
    wanted = known_keys(private, firm)
    pages = firm_pages(corpus, params.year, params.look_back, params.max_level)
    vectors = out.table("private_vectors", lambda: infer_vectors(model, trained, pages, wanted, params.min_words))
    peers = out.table("private_peers", lambda: private_peers(vectors, firm, params.top_percent, params.threshold))
    coded = out.table("private_peer_codes", lambda: with_pair_codes(peers, firm))
    entities = vectors.select("company")
    report = naics_report(params.year, coded, entity_codes(entities, firm), params.top_fraction, mode, both_codes=True)
    if folder is not None:
        tables.write_peers(peers, f"{folder}/published/private_peers_file_{params.year}.csv", "overwrite")
        tables.write_naics_report(report, f"{folder}/published/naics", out.run)
    return PrivateNetwork(vectors, peers, report, entities_not_found(entities, firm))
