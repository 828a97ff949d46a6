import gzip
import json

import pytest
from pyspark.sql import functions as F

from firmnet.params import Params
from firmnet.schemas import LR_INPUT, PEER
from firmnet.sources import stores, tables
from firmnet import storage
from firmnet.storage import reuse_or_write, scratch_root, table_exists


def test_url_id(spark, tmp_path):
    path = tmp_path / "ids.txt"
    path.write_text("1\ta.com\t2000\n9\ta.com\t2001\n2\tb.com\n\n  3\tc.com\t0\t more \nx\td.com\t1999\n4\te.com\tnone\n")
    rows = tables.read_url_id(spark, str(path)).orderBy("line_no").collect()
    assert [tuple(r)[1:] for r in rows] == [(1, "a.com", 2000), (9, "a.com", 2001), (3, "c.com", 0)]
    assert tables.rejected_url_ids(spark, str(path)).count() == 2


def test_line_numbers_follow_the_file(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_text("".join(f"{i}\tc{i}\t2000\n" for i in range(50_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        ids = [r["master_id"] for r in tables.read_url_id(spark, str(path)).orderBy("line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ids == list(range(50_000))


def test_public_raw(spark, tmp_path):
    head = "\t".join(f"h{i}" for i in range(14))
    line = ["x", "g1", "x", "x", "2000", "x", "x", "x", "x", '"http://a.com/b\tc"', "1.5", "2", "nan?", ""]
    bad = [*line[:4], "year", *line[5:]]
    path = tmp_path / "p.txt"
    path.write_text("\n".join([head, "\t".join(line), "\t".join(bad)]) + "\n")
    (row,) = tables.read_public_raw(spark, str(path)).drop("line_no").collect()
    assert tuple(row) == ("g1", 2000, "http://a.com/b\tc", 1.5, 2.0, None, None)


def test_year_list(spark, tmp_path):
    (tmp_path / "2000.txt").write_text(" a.com \nb.com\n\na.com\n")
    assert {r[0] for r in tables.read_year_list(spark, str(tmp_path / "2000.txt")).collect()} == {"a.com", "b.com"}


def test_peer_round_trip(spark, tmp_path):
    peers = spark.createDataFrame([(1, 2, 0.25), (2, 1, 1e-7)], PEER)
    tables.write_peers(peers, str(tmp_path / "peers"))
    assert sorted(tables.read_peers(spark, str(tmp_path / "peers")).collect()) == sorted(peers.collect())


def test_peers_are_written_gzipped(spark, tmp_path):
    """Text of 100,000 pairs as the tiles give them, with its header, in less than half its size."""
    peers = spark.range(100_000).selectExpr("id div 300 AS focal_firmid", "xxhash64(id) & 65535 AS rival_firmid",
                                            "(240000 + (xxhash64(id, 1) & 131071)) / 1e6D AS wtnic_score")
    tables.write_peers(peers.coalesce(1), str(tmp_path / "peers"))
    (part,) = (tmp_path / "peers").glob("part-*.csv.gz")
    text = gzip.decompress(part.read_bytes())
    assert text.startswith(b"focal_firmid\trival_firmid\twtnic_score\n") and 2 * part.stat().st_size < len(text)
    assert tables.read_peers(spark, str(tmp_path / "peers")).exceptAll(peers).isEmpty()
    assert tables.read_peers(spark, str(tmp_path / "peers")).count() == 100_000


def test_r2_json(spark, tmp_path):
    report = spark.createDataFrame([("3", "a.csv", 0.5)], "no_of_docs string, input_file_name string, RSQ_average double")
    tables.write_r2_report(report, str(tmp_path / "r2"))
    (part,) = (tmp_path / "r2").glob("part-*.json")
    assert json.loads(part.read_text()) == {
        "scores": [{"no_of_docs": "3", "input_file_name": "a.csv", "RSQ_average": 0.5}]}


def test_overlap_report_appends(spark, tmp_path):
    report = spark.createDataFrame([(2000, 2)], "year int, digits int")
    for _ in range(2):
        tables.write_naics_report(report, str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n")).count() == 2


def test_a_report_run_done_again_leaves_one_set_of_rows(spark, tmp_path):
    path = str(tmp_path / "n")
    for year, rows in ((2000, 1), (2001, 2), (2000, 3)):
        tables.write_naics_report(spark.range(rows).select(F.lit(year).alias("year"), "id"), path, str(year))
    got = tables.read_naics_report(spark, path)
    assert sorted(map(tuple, got.collect())) == [(2000, 0), (2000, 1), (2000, 2), (2001, 0), (2001, 1)]
    assert storage.runs(spark, path) == ["2000", "2001"]


def test_a_run_is_seen_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "t")
    assert storage.write_run(spark.range(2), path, "a") and not storage.write_run(spark.range(5), path, "a")
    failing = spark.range(3).select(F.raise_error(F.lit("no")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="no"):
        storage.write_run(failing, path, "b")
    with pytest.raises(Exception, match="no"):
        storage.write_run(failing, path, "a", replace=True)  # the old rows stay
    assert storage.runs(spark, path) == ["a"] and spark.read.parquet(path).count() == 2
    storage.write_run(spark.range(4), path, "a", replace=True)
    assert spark.read.parquet(path).count() == 4


def test_one_report_over_several_inputs(spark, tmp_path):
    from firmnet.operators import regression

    rows = [(i, float(i % 5), float(i % 3), 1.0, 2.0, float(i % 5) + (i % 2), float(i % 7), float(i % 4), float(i), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, LR_INPUT)
    tables.write_lr_input(df, str(tmp_path / "in" / "public_peers.csv"))
    df.where("focal_firmid < 20").select(*LR_INPUT.names).toPandas().to_csv(tmp_path / "in" / "even.v2_peers.tsv", sep="\t", index=False)
    got = regression.r2_reports(tables.read_lr_inputs(spark, str(tmp_path / "in" / "*")))
    tables.write_r2_report(got, str(tmp_path / "r2"))
    (file,) = (tmp_path / "r2").glob("part-*.json")
    scores = json.loads(file.read_text())["scores"]
    assert [(r["input_file_name"], r["similarity"], r["no_of_docs"]) for r in scores] == [("even.v2_peers.tsv", "EVENV2", "20"), ("public_peers.csv", "PUBLIC", "40")]
    alone = regression.r2_report(df, "public_peers.csv").first()
    assert all(scores[1][k] == pytest.approx(alone[k]) for k in ("RSQ_average", "RSQ_valuation", "RSQ_stock_return"))


def test_lines_are_ordered_over_files_and_blocks(spark, tmp_path):
    """Three files, of which the second is cut into many blocks."""
    lines = {"a": 50, "b": 4000, "c": 7}
    for name, n in lines.items():
        (tmp_path / name).write_text("".join(f"{i}\tfirm{i % 3}.com\t{2000 + i % 2}\t{name}\n" for i in range(n)))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        read = spark.read.text(str(tmp_path)).select(tables.line_order().alias("line_no"), "value")
        assert read.rdd.getNumPartitions() > 5
        got = [r["value"].split("\t") for r in read.orderBy("line_no").collect()]
        assert got == [[str(i), f"firm{i % 3}.com", str(2000 + i % 2), name] for name, n in lines.items() for i in range(n)]
        assert read.select("line_no").distinct().count() == sum(lines.values())
        first = tables.read_url_id(spark, str(tmp_path)).groupBy("company").agg(F.max_by("master_id", "line_no").alias("last"))
        assert {tuple(r) for r in first.collect()} == {("firm0.com", 6), ("firm1.com", 4), ("firm2.com", 5)}  # of the third file
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_firm_dimension(spark):
    raw = spark.createDataFrame([("a", "1", "", ""), ("b", "x", "1", "s"), ("", "3", "1", "s"), ("c", "4", " 22 ", "s")],
                                "company string, firm_id string, naics string, obtained_from string")
    got = {tuple(r) for r in tables.firm_dimension(raw).collect()}
    assert got == {("a", 1, None, None), ("c", 4, "22", "s")}
    assert ("a", 1, "", "") in {tuple(r) for r in tables.firm_export(tables.firm_dimension(raw)).collect()}


def test_year_lists_and_pruning(spark, tmp_path):
    lists = spark.createDataFrame([(2000, f"c{i}") for i in range(50)] + [(2001, "c1")], "year int, company string")
    tables.write_year_lists(lists, str(tmp_path / "y"))
    one = spark.read.parquet(str(tmp_path / "y")).where("year = 2001")
    assert one.collect()[0]["company"] == "c1"
    assert "PartitionFilters: [isnotnull(year" in one._jdf.queryExecution().executedPlan().toString()


def test_corpus_scan_is_pruned(spark, tmp_path):
    rows = [("a", y, lv, f"{y}{lv}", ["w"]) for y in range(2000, 2010) for lv in range(6)]
    df = spark.createDataFrame(rows, "company string, year int, level int, page string, words array<string>")
    stores.write_corpus(df, str(tmp_path / "c"))
    got = stores.read_corpus(spark, str(tmp_path / "c"), 2005)
    assert {(r["year"], r["level"]) for r in got.collect()} == {(y, lv) for y in range(2001, 2006) for lv in range(4)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(year" in plan.split("PartitionFilters: [")[1].split("]")[0] and "LessThanOrEqual(level,3)" in plan


@pytest.mark.parametrize("tasks", [3, 60])
def test_files_of_a_corpus_follow_bytes_not_tasks(spark, tmp_path, tasks):
    rows = [(f"c{i % 40:02d}" if i % 3 else "hot", 2000 + i % 2, i % 4, f"{i:05d}", [f"w{i}"] * 20) for i in range(6000)]
    df = spark.createDataFrame(rows, "company string, year int, level int, page string, words array<string>")
    stores.write_corpus(df.repartition(tasks), str(tmp_path / "c"))
    assert len(list((tmp_path / "c").glob("run=*/kind=page/year=*/*.parquet"))) <= 4
    assert sorted(map(str, stores.read_corpus(spark, str(tmp_path / "c")).collect())) == sorted(map(str, df.collect()))


def test_compacted_corpus_is_cut_into_ranges_of_companies(spark, tmp_path):
    import pyarrow.parquet as pq

    path = tmp_path / "c"
    for run in range(5):
        rows = [(f"c{i % 40:02d}", 2000, i % 4, f"{run}-{i}", ["w"] * 20) for i in range(800)]
        stores.write_corpus(spark.createDataFrame(rows, "company string, year int, level int, page string, words array<string>"), str(path), str(run))
    before = stores.read_corpus(spark, str(path)).count()
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small data would end in one file
    try:
        run = stores.compact_corpus(spark, str(path))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    assert storage.runs(spark, str(path)) == [run] and stores.read_corpus(spark, str(path)).count() == before == 4000
    spans = []
    for f in path.glob("run=*/kind=page/year=*/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = [c for c in range(meta.num_columns) if meta.schema.column(c).path == "company"][0]
        stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        spans.append((min(s.min for s in stats), max(s.max for s in stats)))
    spans.sort()
    assert len(spans) > 3 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))  # files overlap at their ends at most


def test_vectors(spark, tmp_path):
    v = spark.createDataFrame([("a", 1, [1.0]), ("b", 2, None)], "company string, firm_id bigint, v array<double>")
    stores.write_vectors(v, str(tmp_path / "v"))
    assert [r[0] for r in stores.vector_entities(stores.read_vectors(spark, str(tmp_path / "v"))).collect()] == ["a"]


def test_finished_outputs_are_reused(spark, tmp_path):
    path = str(tmp_path / "out")
    assert not table_exists(spark, path)
    assert reuse_or_write(spark, path, lambda: spark.range(3)).count() == 3
    assert reuse_or_write(spark, path, lambda: spark.range(5)).count() == 3
    assert reuse_or_write(spark, path, lambda: spark.range(5), "overwrite").count() == 5
    (tmp_path / "out" / "_SUCCESS").unlink()
    assert reuse_or_write(spark, path, lambda: spark.range(7)).count() == 7
    assert spark.sparkContext.getCheckpointDir() is not None or scratch_root(spark)


def test_params():
    assert Params(2000).first_year == 1996
    for bad in (dict(year=1995), dict(year=2000, top_fraction=2.0), dict(year=2000, min_words=-1)):
        with pytest.raises(ValueError):
            Params(**bad)


def test_only_own_scratch_tables_are_dropped(spark, monkeypatch):
    monkeypatch.setattr(storage, "_MADE", [])
    other = f"{scratch_root(spark)}/kept-{id(spark)}"
    spark.range(2).write.mode("overwrite").parquet(other)
    path = storage.materialize(spark.range(3), "x").inputFiles()[0].rsplit("/", 1)[0]
    assert table_exists(spark, path) and storage.drop_scratch(spark) == 1
    assert not table_exists(spark, path) and table_exists(spark, other)
