"""Train on a sample, pair the public firms, explain their financials by their peers'."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.ml.feature import Word2VecModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmnet.operators.corpus import domain_coverage, domain_text, firm_pages
from firmnet.operators.encoder import by_company, encode, fit_encoder
from firmnet.operators.master import training_set
from firmnet.operators.peers import lr_input, public_peers, public_vectors, unknown_rivals
from firmnet.operators.rank import hash_sample, top_fraction
from firmnet.operators.similarity import top_fraction_of_pairs
from firmnet.operators.regression import r2_report, r2_reports
from firmnet.params import Params
from firmnet.plans.outputs import Outputs, fingerprint
from firmnet.sources import tables


@dataclass(frozen=True)
class PublicNetwork:
    model: Word2VecModel
    trained: DataFrame
    without_text: DataFrame
    vectors: DataFrame
    peers: DataFrame
    regression: DataFrame
    report: DataFrame
    unknown_rivals: DataFrame  # edges whose rival has no financials


def build_public_network(params: Params, corpus: DataFrame, private: DataFrame, public: DataFrame,
                         seed: int = 0, partitions: int = 16, folder: str | None = None,
                         if_exists: str = "skip", store_all_peers: bool = False) -> PublicNetwork:
    """``private`` and ``public`` are the company lists of the year; ``public`` carries ids and metrics.

    With a ``folder``, steps whose output is there are not run again, unless parameters or inputs are others than then; the
    regression input and the report over all published inputs are written there as text. Only the top pairs are ever
    written, unless ``store_all_peers`` asks for the rest, which gives the same report.
    """
    content = fingerprint((params, seed, partitions, store_all_peers), corpus, private, public) if folder else ""
    out = Outputs(corpus.sparkSession, folder, if_exists, content)
    sample = out.table("training_sample", lambda: hash_sample(private, "company", params.sample_size, str(seed)))
    shortfall = params.sample_size - sample.count()
    if shortfall > 0:
        warnings.warn(f"the private firms are {shortfall} fewer than the sample asked for; all were taken")
    wanted = out.table("pre_training_tags", lambda: training_set(sample, public))
    pages = firm_pages(corpus, params.year, params.look_back, params.max_level)
    text = out.table("training_text", lambda: domain_text(wanted, pages))  # once for all firms of a domain
    trained, without_text = domain_coverage(wanted, text)
    model = out.model("model", lambda: fit_encoder(text, params.dim, params.min_count, params.window, params.epochs,
                                                   partitions, seed))
    vectors = out.table("vectors", lambda: by_company(encode(model, text), wanted))
    if store_all_peers or params.public_top is not None:
        peers = out.table("public_peers", lambda: public_peers(vectors, public, params.public_top))
        kept = out.table("top_public_peers", lambda: top_fraction(peers, public.count(), params.top_fraction))
        focal = peers
    else:
        paired = out.table("public_vectors", lambda: public_vectors(vectors, public))
        kept = peers = out.table("top_public_peers", lambda: top_fraction_of_pairs(
            paired, public.count(), params.top_fraction))
        focal = paired.select(F.col("firm_id").alias("focal_firmid"))  # every one of them has a pair
    regression = out.table("regression_input", lambda: lr_input(focal, kept, public))
    report = r2_report(regression, f"public_peers_file_{params.year}_LR.csv")
    if folder is not None:
        tables.write_lr_input(regression, f"{folder}/published/public_peers_file_{params.year}_LR.csv", "overwrite")
        tables.write_r2_report(r2_reports(tables.read_lr_inputs(corpus.sparkSession, f"{folder}/published/*_LR.csv")),
                               f"{folder}/published/r2", "overwrite")
    return PublicNetwork(model, trained, without_text, vectors, peers, regression, report, unknown_rivals(kept, public))
