"""The two networks end to end on a small generated corpus."""

import random

import pytest

from firmnet.params import Params
from firmnet.plans.outputs import fingerprint
from firmnet.plans.private_network import build_private_network
from firmnet.plans.public_network import build_public_network
from firmnet.sources import tables

TOPICS = {"11": "crop seed farm grain harvest", "52": "bank loan credit fund asset", "62": "nurse clinic patient care ward"}


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(7)
    firms, pages = [], []
    for i in range(60):
        code = list(TOPICS)[i % 3]
        firms.append((f"firm{i}.com", i + 100, f"{code}{i % 2}000" if i % 10 else None, "x"))
        for p in range(3):
            own = r.choices(TOPICS[code].split(), k=50)
            pages.append((f"firm{i}.com", 2000 - p, p, f"p{p}", own if i != 59 else own[:5]))
    corpus = spark.createDataFrame(pages, "company string, year int, level int, page string, words array<string>")
    firm = spark.createDataFrame(firms, "company string, firm_id bigint, naics string, obtained_from string")
    public = spark.createDataFrame(
        [(f"firm{i}.com", i + 100, float(i % 3), float(i % 3 + 1), float(i % 3), float(i)) for i in range(24)],
        "company string, firm_id bigint, profit_assets double, profit_sales double, stock_return double, valuation double")
    return corpus, firm, public


def test_networks(spark, world):
    corpus, firm, public = world
    params = Params(2000, dim=16, epochs=20, sample_size=20, top_fraction=0.2)
    private = firm.select("company").subtract(public.select("company"))
    net = build_public_network(params, corpus, private, public, store_all_peers=True)
    assert net.trained.count() == 44 and net.without_text.count() == 0
    assert net.peers.count() == 24 * 23 and net.peers.where("focal_firmid = rival_firmid").count() == 0
    report = net.report.first()
    assert report["no_of_docs"] == "24" and report["RSQ_profit_asset"] > 0.8

    lean = build_public_network(params, corpus, private, public, partitions=1)
    assert lean.peers.count() == int(24 * 23 * 0.2) and lean.regression.count() == net.regression.count()

    other = build_private_network(params, net.model, net.vectors, corpus, private, firm)
    assert other.vectors.count() == 35 or other.vectors.count() == 36   # firm59 has few words unless it was sampled
    scores = other.peers
    assert scores.where("wtnic_score < 0.24 or focal_firmid = rival_firmid").count() == 0
    rows = {r["digits"]: r for r in other.report.collect()}
    assert rows[2]["matches"] > 0 and all(rows[d]["matches"] <= rows[d]["budget"] for d in rows)


def test_finished_steps_are_reused(spark, world, tmp_path):
    corpus, firm, public = world
    params = Params(2000, dim=4, epochs=1, sample_size=5)
    private = firm.select("company").subtract(public.select("company"))
    few = private.limit(3)
    with pytest.warns(UserWarning, match="2 fewer"):
        first = build_public_network(params, corpus, few, public, folder=str(tmp_path))
    stamps = {p: p.stat().st_mtime_ns for p in tmp_path.glob("*/_SUCCESS")}
    with pytest.warns(UserWarning):
        again = build_public_network(params, corpus, few, public, folder=str(tmp_path))
    assert len(stamps) == 7 and stamps == {p: p.stat().st_mtime_ns for p in tmp_path.glob("*/_SUCCESS")}
    assert sorted(first.peers.collect()) == sorted(again.peers.collect())


def test_other_parameters_or_inputs_never_get_old_steps(spark, world, tmp_path):
    corpus, firm, public = world
    private = firm.select("company").subtract(public.select("company"))
    build = lambda params, seed=0: build_public_network(params, corpus, private, public, seed=seed, folder=str(tmp_path))
    sample = lambda net: {r[0] for r in spark.read.parquet(f"{tmp_path}/training_sample").collect()}
    params = Params(2000, dim=4, epochs=1, sample_size=5)
    first = sample(build(params))
    assert sample(build(params)) == first
    other = sample(build(params, seed=1))
    assert other != first and len(other) == 5
    assert len(sample(build(Params(2000, dim=4, epochs=1, sample_size=7), seed=1))) == 7
    assert sample(build(params)) == first


def test_fingerprints_tell_inputs_apart(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(3).write.parquet(f"{tmp_path}/{name}")
    a, b = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("a", "b"))
    assert fingerprint((1,), a) == fingerprint((1,), spark.read.parquet(f"{tmp_path}/a"))
    assert len({fingerprint((1,), a), fingerprint((2,), a), fingerprint((1,), b), fingerprint((1,), a, b), fingerprint((1,), a.withColumn("x", a.id))}) == 5


def test_published_outputs_and_what_was_left_out(spark, world, tmp_path):
    corpus, firm, public = world
    params = Params(2000, dim=8, epochs=2, sample_size=20, top_fraction=0.2)
    private = firm.select("company").subtract(public.select("company"))
    net = build_public_network(params, corpus, private, public, folder=str(tmp_path))
    assert net.unknown_rivals.count() == 0
    scores = spark.read.json(f"{tmp_path}/published/r2").selectExpr("inline(scores)").collect()
    assert [r["input_file_name"] for r in scores] == ["public_peers_file_2000_LR.csv"]
    known = firm.where("firm_id < 150")
    for _ in range(2):
        other = build_private_network(params, net.model, net.vectors, corpus, private, known, folder=str(tmp_path))
    assert {r[0] for r in other.not_found.collect()} == {r[0] for r in other.vectors.select("company").subtract(known.select("company")).collect()}
    report = tables.read_naics_report(spark, f"{tmp_path}/published/naics")
    assert report.count() == 5 and {"both_codes", "digits"} <= set(report.columns)  # done twice, one set of rows
    assert tables.read_peers(spark, f"{tmp_path}/published/private_peers_file_2000.csv").count() == other.peers.count()


def test_text_of_a_domain_is_stored_once(spark, world, tmp_path):
    corpus, firm, public = world
    keyed = public.unionByName(public.limit(3).selectExpr("concat(company, '_shop') AS company", "firm_id + 1000 AS firm_id", "profit_assets", "profit_sales",
                                                          "stock_return", "valuation"))
    net = build_public_network(Params(2000, dim=4, epochs=1, sample_size=2), corpus, firm.select("company").limit(2), keyed, folder=str(tmp_path))
    text = spark.read.parquet(f"{tmp_path}/training_text")
    assert text.count() == text.dropDuplicates(["company", "year", "level", "page"]).count()
    got = {r["company"]: r["v"] for r in net.vectors.collect()}
    for r in public.limit(3).collect():
        assert got[r["company"]] == got[f"{r['company']}_shop"]
