import pytest
from pyspark.sql import functions as F

from firmnet.operators import corpus, encoder, master
from firmnet.plans.master_data import build_master_data, build_public_firms

URL_ID = [(1, 10, "a.com", 2000), (2, 11, "a.com", 2001), (3, 12, "a.com", 2000), (4, 20, "b.com", 0),
          (5, 20, "b.com", 1999), (6, 30, "www.c.com/x", 2000), (7, 25, "c.com", 2000), (8, 40, "d.com", 2001)]


@pytest.fixture(scope="module")
def url_id(spark):
    return spark.createDataFrame(URL_ID, "line_no bigint, master_id bigint, company string, year int")


def firms(spark, rows):
    return spark.createDataFrame(rows, "company string, firm_id bigint, naics string, obtained_from string")


def test_companies_and_totals(spark, url_id):
    got = {r["company"]: (r["master_id"], r["years"], r["n_lines"]) for r in master.companies(url_id).collect()}
    assert got["a.com"] == (10, [2000, 2001], 3) and got["b.com"] == (20, [0, 1999], 2)
    assert tuple(master.url_id_totals(url_id).first()) == (8, 5, 7, 6)
    assert tuple(master.url_id_totals(url_id.limit(0)).first()) == (0, 0, 0, 0)
    plan = master.url_id_totals(url_id)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_valid_years(url_id):
    assert {r["year"] for r in master.valid_years(url_id).collect()} == {1999, 2000, 2001}


def test_rekeyed_dimension_first_wins(spark):
    dim = firms(spark, [("http://a.com", 1, "11", "x"), ("a.com", 2, "22", "y"), ("https://www.a.com", 3, "33", "z"),
                        ("b.com/p", 4, "44", "x")])
    kept, repeats = master.rekey_dimension(dim)
    assert {tuple(r) for r in kept.collect()} == {("a.com", 2, "22", "y"), ("b.com_p", 4, "44", "x")}
    assert {tuple(r) for r in repeats.collect()} == {("http://a.com", "a.com"), ("https://www.a.com", "a.com")}


def test_new_firms_take_the_lowest_master_id(spark, url_id):
    dim = firms(spark, [("a.com", 7, "11", "x"), ("b.com", 5, None, None)])
    new, extended = master.extend_firms(master.companies(url_id), dim)
    assert sorted(tuple(r) for r in new.collect()) == [("c.com", 25, 8), ("d.com", 40, 9)]
    assert extended.count() == 4 and extended.where("naics is null").count() == 3


def test_public_firms(spark):
    raw = spark.createDataFrame([(1, "g1", 2000, "http://a.com"), (2, "g2", 2000, "www.a.com"), (3, "g3", 2001, "a.com"),
                                 (4, "g4", 2000, "nodata.com"), (5, "g5", 2000, "noid.com")],
                                "line_no bigint, gvkey string, year int, url string")
    latest = master.latest_public_rows(raw)
    assert {tuple(r) for r in latest.collect()} >= {(2000, "a.com", "g2"), (2001, "a.com", "g3")}
    dim = firms(spark, [("a.com", 1, None, None), ("nodata.com", 2, None, None)])
    crawled = spark.createDataFrame([("a.com",), ("noid.com",)], "company string")
    got = {tuple(r) for r in build_public_firms(raw, dim, crawled).collect()}
    assert got == {(2000, "a.com", 1, "g2"), (2001, "a.com", 1, "g3")}


def test_master_plan(spark, url_id):
    dim = firms(spark, [("a.com", 7, "11", "x"), ("http://a.com", 3, "12", "x"), ("b.com", 5, None, None)])
    built = build_master_data(url_id, dim)
    assert {tuple(r) for r in built.firms_per_year.collect()} == {(2000, 1), (2001, 1), (0, 1), (1999, 1)}
    assert {tuple(r) for r in built.master_firm.collect()} == {
        ("a.com", 10, 7), ("b.com", 20, 5), ("c.com", 25, 8), ("d.com", 40, 9)}
    assert built.repeats.count() == 1
    assert master.not_indexed(built.master_firm, built.firm).count() == 0


def test_training_set(spark):
    sample = spark.createDataFrame([("a",), ("b",), ("",)], "company string")
    public = spark.createDataFrame([("b",), ("c",)], "company string")
    assert {r[0] for r in master.training_set(sample, public).collect()} == {"a", "b", "c"}


PAGES = [("f", 2004, 1, "p9", ["Late"]), ("f", 2000, 2, "p2", ["Deep", "ONE"]), ("f", 2000, 0, "p1", ["Home"]),
         ("f", 2000, 2, "p1", []), ("f", 1999, 0, "p0", ["old"]), ("f", 2005, 0, "p0", ["new"]),
         ("f", 2000, 4, "p0", ["deeper"]), ("g", 2001, 1, "p", ["x"] * 99), ("h", 2001, 1, "p", ["x"] * 100),
         ("e", 2001, 1, "p", []), ("e", 2001, 2, "p", None), ("", 2001, 1, "p", ["blank"])]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "company string, year int, level int, page string, words array<string>")


def test_bag_of_words_is_ordered_and_windowed(pages):
    bags = {r["company"]: r for r in corpus.bag_of_words(corpus.firm_pages(pages, 2004)).collect()}
    assert bags["f"]["words"] == ["home", "deep", "one", "late"] and bags["f"]["segment"] == 0
    assert bags["e"]["words"] == [] and "" not in bags


def test_segments_join_to_the_whole_bag(spark):
    rows = [("hot" if i % 3 else "cold", 2000, i % 4, f"{i:05d}", [f"w{i}", "z"]) for i in range(900)]
    df = spark.createDataFrame(rows, "company string, year int, level int, page string, words array<string>")
    got = corpus.bag_of_words(corpus.firm_pages(df, 2000), segment_words=100).orderBy("company", "segment").collect()
    for company in ("hot", "cold"):
        want = [w for r in sorted((r for r in rows if r[0] == company), key=lambda r: (r[2], r[3])) for w in r[4]]
        parts = [r for r in got if r["company"] == company]
        assert [w for r in parts for w in r["words"]] == want
        assert max(len(r["words"]) for r in parts) == 100 and [r["segment"] for r in parts] == list(range(len(parts)))


def test_a_page_of_many_words_and_a_firm_over_many_ranges_make_no_long_row(spark):
    words = [f"w{i}" for i in range(100_000)]
    rows = [("big", 2000, 0, f"{i:03d}", words[:i * 37 % 500]) for i in range(200)] + [("big", 2001, 0, "x", words), ("a", 2000, 0, "x", ["y"]), ("none", 2000, 0, "x", [])]
    df = spark.createDataFrame(rows, "company string, year int, level int, page string, words array<string>").repartition(9)
    got = corpus.bag_of_words(df, segment_words=1000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # segments stay where they were cut
    parts = got.where("company = 'big'").orderBy("segment").collect()
    assert [w for r in parts for w in r["words"]] == [w for r in sorted(r for r in rows if r[0] == "big") for w in r[4]]
    at = 0
    for k, r in enumerate(parts):
        assert (r["segment"], r["start"]) == (k, at) and len(r["words"]) <= 1000
        at += len(r["words"])
    assert [tuple(r) for r in got.where("company = 'none'").collect()] == [("none", 0, 0, [])]


def test_min_words(pages):
    assert {r["company"] for r in corpus.min_words(corpus.firm_pages(pages, 2004), 100).collect()} == {"h"}
    assert {r["company"] for r in corpus.min_words(corpus.firm_pages(pages, 2004), 0).collect()} == {"f", "g", "h"}


def test_vocabulary_and_coverage(spark, pages):
    kept = corpus.firm_pages(pages, 2004)
    assert {tuple(r) for r in corpus.vocabulary(kept, 5).collect()} == {("x", 199)}
    listed = spark.createDataFrame([("f",), ("e",), ("zz",), ("f",), ("",)], "company string")
    covered, missing = corpus.corpus_coverage(listed, kept)
    assert {r[0] for r in covered.collect()} == {"f"} and {r[0] for r in missing.collect()} == {"e", "zz"}


def test_companies_of_one_domain_share_its_pages(spark):
    pages = spark.createDataFrame([("a.com", 2000, 0, "p", ["home"]), ("a.com", 2000, 1, "q", ["deep"]), ("b.com", 2000, 0, "p", ["x"])],
                                  "company string, year int, level int, page string, words array<string>")
    listed = spark.createDataFrame([("a.com",), ("a.com_x",), ("a.com_x",), ("c.com",), ("",)], "company string")
    got = corpus.firm_text(listed, pages)
    assert got.columns == pages.columns
    assert sorted((r["company"], r["page"]) for r in got.collect()) == [
        ("a.com", "p"), ("a.com", "q"), ("a.com_x", "p"), ("a.com_x", "q")]


def test_run_metrics(spark):
    df = spark.createDataFrame([("a", "response", "u", ["x", "y"]), ("a", "response", "u", ["x"]), ("a", "request", "u", ["q"]),
                                ("b", "request", "u", [])], "archive_file string, rec_type string, url string, words array<string>")
    assert {tuple(r) for r in corpus.run_metrics(df).collect()} == {("a", 3, 2, 1, 3), ("b", 1, 0, 0, 0)}


def test_encoding_pages_equals_encoding_the_joined_text(spark):
    import numpy as np
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    rows = [(f"f{i % 3}", 2000, 0, f"{i}", [f"w{(i * j) % 11}" for j in range(1, i + 2)]) for i in range(30)]
    df = spark.createDataFrame(rows, "company string, year int, level int, page string, words array<string>")
    model = encoder.fit_encoder(df, dim=8, epochs=2, partitions=1)
    again = encoder.fit_encoder(df, dim=8, epochs=2, partitions=1)
    assert [r["vector"] for r in model.getVectors().orderBy("word").collect()] == [
        r["vector"] for r in again.getVectors().orderBy("word").collect()]
    got = {r["company"]: r for r in encoder.encode(model, df).collect()}
    joined = model.transform(df.groupBy("company").agg(F.flatten(F.collect_list("words")).alias("words")))
    for r in joined.select("company", vector_to_array("page_vector").alias("v"), F.size("words").alias("n")).collect():
        assert np.allclose(got[r["company"]]["v"], r["v"]) and got[r["company"]]["n_words"] == r["n"]
    with pytest.warns(UserWarning, match="min_count was raised from 5 to 40"):
        few = encoder.fit_encoder(df, dim=8, max_floats=80)
    assert 0 < few.getVectors().count() <= 10


def test_words_meet_their_vectors_in_a_shuffled_join(spark):
    rows = [(f"f{i % 3}", 2000, 0, f"{i}", [f"w{(i * j) % 11}" for j in range(1, i + 2)]) for i in range(30)]
    df = spark.createDataFrame(rows, "company string, year int, level int, page string, words array<string>")
    table = spark.createDataFrame([(f"w{i}", [float(i), 1.0]) for i in range(8)], "word string, vector array<double>")
    got = encoder.encode(table, df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [word" in plan and "BroadcastHashJoin [word" not in plan
    for company in ("f0", "f1", "f2"):
        own = [w for r in rows if r[0] == company for w in r[4]]
        known = [int(w[1:]) for w in own if int(w[1:]) < 8]
        r = got.where(F.col("company") == company).first()
        assert r["n_words"] == len(own) and r["v"] == pytest.approx([sum(known) / len(own), len(known) / len(own)], abs=1e-9)
    assert encoder.encode(table, df.select("company", F.array(F.lit("zz")).alias("words"))).first()["v"] == [0.0, 0.0]


def test_a_block_of_companies_is_sent_each_word_once(spark, monkeypatch):
    """Forty companies share thirty words: vectors travel by block and word, not by company and word."""
    rows = [(f"f{i}", [f"w{(i + j) % 30}" for j in range(30)] + ["w1"] * i + ["zz"]) for i in range(40)]
    df = spark.createDataFrame(rows, "company string, words array<string>")
    table = spark.createDataFrame([(f"w{i}", [float(i), 1.0]) for i in range(30)], "word string, vector array<double>")
    monkeypatch.setattr(encoder, "company_blocks", lambda *_: 3)
    monkeypatch.setattr(encoder, "SLICE_BYTES", 16 * 7)
    sums, sent = encoder._adder(), spark.sparkContext.accumulator(0)

    def counted(counts, vectors):
        sent.add(len(vectors))
        return sums(counts, vectors)

    monkeypatch.setattr(encoder, "_adder", lambda: counted)
    got = {r["company"]: r for r in encoder.encode(table, df).collect()}
    assert 0 < sent.value <= 3 * 30  # 40 * 30 before
    for i in range(40):
        assert got[f"f{i}"]["n_words"] == 31 + i
        assert got[f"f{i}"]["v"] == pytest.approx([(sum(range(30)) + i) / (31 + i), (30 + i) / (31 + i)], abs=1e-12)


def test_a_block_of_companies_is_bounded_by_its_counts_too(spark, monkeypatch):
    """With short vectors the names and words of the counts are most of what a task holds."""
    df = spark.createDataFrame([(f"firm{i:06d}", [f"word{(i + j) % 50:06d}" for j in range(20)]) for i in range(200)], "company string, words array<string>")
    table = spark.createDataFrame([(f"word{i:06d}", [float(i)]) for i in range(50)], "word string, vector array<double>")
    most, sums = 20_000, encoder._adder()
    monkeypatch.setattr(encoder, "BLOCK_BYTES", most)

    def bounded(counts, vectors):
        assert 3 * len(counts) * (24 + 20) <= 2 * most, len(counts)
        return sums(counts, vectors)

    monkeypatch.setattr(encoder, "_adder", lambda: bounded)
    got = {r["company"]: r["v"][0] for r in encoder.encode(table, df).collect()}
    assert got == {f"firm{i:06d}": pytest.approx(sum((i + j) % 50 for j in range(20)) / 20) for i in range(200)}


def test_no_core_waits_while_words_are_trained(spark, monkeypatch):
    asked, real = [], encoder.Word2Vec
    monkeypatch.setattr(encoder, "Word2Vec", lambda **options: asked.append(options["numPartitions"]) or real(**options))
    df = spark.createDataFrame([(["a", "b", "c"] * 5,)] * 4, "words array<string>")
    for partitions in (1, 2, 16):
        encoder.fit_encoder(df, dim=2, min_count=1, epochs=1, partitions=partitions)
    assert asked == [1, max(2, spark.sparkContext.defaultParallelism), 16]


def test_trained_vectors_are_reused(spark, pages):
    text = corpus.firm_pages(pages, 2004)
    model = encoder.fit_encoder(text, dim=2, min_count=1, epochs=1, partitions=1)
    trained = spark.createDataFrame([("f", [9.0, 9.0]), ("unused", [1.0, 1.0])], "company string, v array<double>")
    wanted = spark.createDataFrame([(c,) for c in ("f", "g", "h", "e", "", "zz")], "company string")
    got = {r["company"]: r["v"] for r in encoder.infer_vectors(model, trained, text, wanted, 100).collect()}
    assert set(got) == {"f", "h"} and got["f"] == [9.0, 9.0]


def test_a_domain_is_encoded_once_for_all_its_firms(spark, monkeypatch):
    pages = spark.createDataFrame([("a.com", 2000, 0, f"{i}", ["x", "y"]) for i in range(60)] + [("b.com", 2000, 0, "p", ["x"] * 200)],
                                  "company string, year int, level int, page string, words array<string>")
    model = encoder.fit_encoder(pages, dim=2, min_count=1, epochs=1, partitions=1)
    none = spark.createDataFrame([], "company string, v array<double>")
    wanted = spark.createDataFrame([(f"a.com_{i}",) for i in range(50)], "company string")
    seen, encode = [], encoder.encode
    monkeypatch.setattr(encoder, "encode", lambda m, p: seen.append(p.count()) or encode(m, p))
    got = encoder.infer_vectors(model, none, pages, wanted, 100).collect()
    assert seen == [60]
    assert {r["company"] for r in got} == {f"a.com_{i}" for i in range(50)} and len({tuple(r["v"]) for r in got}) == 1
