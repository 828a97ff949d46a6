"""One runnable query per operator, on whole tables. The SQL each is checked against is in ``catalog_sql``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmnet.functions import industry_codes as codes
from firmnet.functions import text, urls, vectors
from firmnet.operators import corpus, encoder, industry, master, peers, rank, regression, similarity
from firmnet.plans import ingest, standins as st
from firmnet.sources import archives, stores, tables
from firmnet.storage import dealt, materialize, scratch_path
from firmnet.streaming import ingest as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

YEAR = 2016
THRESHOLD = 0.24
TOP_FRACTION = 0.02
NARROW = 0.001  # leaves many firms without any edge


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def _text(words: str = "words"):
    return F.array_join(words, " ").alias("text")


def _peers(spark, sf_dir, min_score=THRESHOLD) -> DataFrame:
    return similarity.cosine_pairs(st.vectors(spark, sf_dir), min_score=min_score)


def _pairs(spark, sf_dir) -> similarity.Pairs:
    """The same edges, for operators that join onto them."""
    return similarity.Pairs(st.vectors(spark, sf_dir), THRESHOLD)


# --- sources and sinks ------------------------------------------------------------------------------


def _write_archives(records: DataFrame, folder: str, broken: str | None = None) -> None:
    """Store page records as gzipped archives, one file per archive name, as input for the archive scan.

    Records whose URL holds ``broken`` get no length, or a negative one.
    """

    def write(batches):
        import gzip

        import pyarrow as pa
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        name, out = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["archive_file"] != name:
                    if out:
                        out.close()
                    name, out = r["archive_file"], fs.open_output_stream(f"{base}/{r['archive_file']}", compression=None)
                body = r["html"].encode()
                if r["rec_type"] == "response":
                    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + body
                head = (f"WARC/1.0\r\nWARC-Type: {r['rec_type']}\r\nWARC-Date: {r['record_date']}\r\n"
                        f"WARC-Target-URI: {r['url']}\r\nContent-Length: {len(body)}\r\n\r\n")
                if broken and broken in r["url"]:
                    head = head.replace("Content-Length: ", "Content-Length: -" if len(body) % 2 else "X-Length: ")
                out.write(gzip.compress(head.encode() + body + b"\r\n\r\n", 6))
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([1])], names=["done"])

    import pyarrow.fs as pafs

    fs, base = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    fs.create_dir(base)
    placed = records.repartition("archive_file").sortWithinPartitions("archive_file", "url")
    placed.mapInArrow(write, "done bigint").agg(F.sum("done")).collect()


def _stored_archives(spark, sf_dir) -> DataFrame:
    folder = scratch_path(spark, "archives")
    _write_archives(st.records(spark, sf_dir), folder)
    return archives.read_archives(spark, folder, split_bytes=64 << 10)


@query("s1_read_archives")
def s1(spark, sf_dir):
    return _stored_archives(spark, sf_dir).select("archive_file", "rec_type", "record_date", "url",
                                                  F.md5("html").alias("page_md5"))


@query("s1_read_archives_damaged")
def s1b(spark, sf_dir):
    """Records without a usable length stand between good ones; they are reported and the others come through."""
    folder = scratch_path(spark, "damaged")
    _write_archives(st.records(spark, sf_dir), folder, broken="/5")
    found = archives.read_archives(spark, folder, split_bytes=64 << 10)
    return found.groupBy("rec_type", "url").agg(F.count("*").alias("records"))


@query("s2_read_manifest")
def s2(spark, sf_dir):
    path = scratch_path(spark, "manifest")
    named = st.records(spark, sf_dir).select("archive_file").distinct()
    named.select(F.concat_ws("  ", F.md5("archive_file"), "archive_file", F.lit("/crawl/data"))).write.text(path)
    return archives.read_manifest(spark, path)


@query("s2_resolve_manifest")
def s2b(spark, sf_dir):
    """Manifest lines next to the archives that are there: two are named that are not, one is there that is not named."""
    folder, path = scratch_path(spark, "archives"), scratch_path(spark, "manifest")
    _write_archives(st.records(spark, sf_dir), folder)
    named = st.records(spark, sf_dir).select("archive_file").distinct().where("archive_file <> 'crawl-3.warc.gz'")
    named = named.unionByName(spark.createDataFrame([("gone.arc.gz",), ("notes.txt",)], "archive_file string"))
    named.select(F.concat_ws("  ", F.md5("archive_file"), "archive_file", F.lit(f"{folder}/"))).write.text(path)
    found, missing = archives.resolve_manifest(archives.read_manifest(spark, path), archives.list_archives(spark, folder))
    sides = [side.select("md5", "file_name", "container", F.lit(there).alias("found")) for side, there in ((found, True), (missing, False))]
    return sides[0].unionByName(sides[1])


@query("s3_read_public_tsv")
def s3(spark, sf_dir):
    path = scratch_path(spark, "public-raw")
    raw = st.public_raw(spark, sf_dir)
    filler = [F.lit("x").alias(f"f{i}") for i in range(9)]
    fields = [filler[0], F.col("gvkey"), *filler[1:3], F.col("year"), *filler[3:7], F.col("url"),
              *(F.col(m) for m in ("profit_assets", "profit_sales", "stock_return", "valuation"))]
    tables.write_tsv(raw.select(*fields), path)
    return tables.read_public_raw(spark, path).drop("line_no")


@query("s4_read_url_id")
def s4(spark, sf_dir):
    path = scratch_path(spark, "url-id")
    u = st.url_id(spark, sf_dir)
    # Short rows and rows with an unreadable year have to be left out again.
    year = F.when(F.col("line_no") % 31 == 0, "unknown").otherwise(F.col("year").cast("string"))
    line = F.when(F.col("line_no") % 37 == 0, F.concat_ws("\t", "master_id", "company")).otherwise(
        F.concat_ws("\t", "master_id", "company", year))
    u.select(line).write.text(path)
    return tables.read_url_id(spark, path).drop("line_no")


@query("s5_read_year_list")
def s5(spark, sf_dir):
    path = scratch_path(spark, "year-list")
    st.url_id(spark, sf_dir).select(F.concat(F.lit("  "), "company", F.lit(" "))).write.text(path)
    return tables.read_year_list(spark, path)


@query("s6_firm_dimension")
def s6(spark, sf_dir):
    path = scratch_path(spark, "firms")
    tables.write_tsv(tables.firm_export(st.firm(spark, sf_dir)), path)
    raw = tables.read_tsv(spark, path, st.firm(spark, sf_dir).select(
        "company", F.col("firm_id").cast("string"), "naics", "obtained_from").schema)
    return tables.firm_export(tables.firm_dimension(raw))


@query("s7_read_corpus")
def s7(spark, sf_dir):
    path = scratch_path(spark, "corpus")
    stores.write_corpus(st.corpus(spark, sf_dir), path)
    return stores.read_corpus(spark, path, YEAR).select("company", "year", "level", "page", _text())


@query("s8_append_corpus")
def s8(spark, sf_dir):
    path = scratch_path(spark, "corpus")
    pages = ingest.pages_of_records(st.records(spark, sf_dir))
    for archive in ("archive_file < 'crawl-3'", "archive_file >= 'crawl-3'"):
        stores.write_corpus(pages.where(archive), path)
    return stores.read_corpus(spark, path).groupBy("company", "year", "level").agg(
        F.count("*").alias("pages"), F.sum(F.size("words")).alias("n_words"))


@query("s9_peer_table")
def s9(spark, sf_dir):
    path = scratch_path(spark, "peers")
    tables.write_peers(_peers(spark, sf_dir), path)
    return tables.read_peers(spark, path)


@query("s10_regression_input_table")
def s10(spark, sf_dir):
    path = scratch_path(spark, "lr")
    tables.write_lr_input(_lr_input(spark, sf_dir), path)
    return _rounded_lr(tables.read_lr_input(spark, path))


@query("s11_r2_report_json")
def s11(spark, sf_dir):
    """One report over several regression inputs, which are read from their files."""
    folder, path = scratch_path(spark, "lr"), scratch_path(spark, "r2")
    rows = materialize(_lr_input(spark, sf_dir), "lr-rows")
    tables.write_lr_input(rows, f"{folder}/public_peers.csv")
    tables.write_lr_input(rows.where("focal_firmid % 2 = 0"), f"{folder}/even.v2_peers.csv")
    tables.write_r2_report(regression.r2_reports(tables.read_lr_inputs(spark, f"{folder}/*.csv")), path)
    schema = ("scores array<struct<no_of_docs string, input_file_name string, similarity string, type string, "
              "RSQ_average double>>")
    return spark.read.schema(schema).json(path).select(F.inline("scores")).withColumn(
        "RSQ_average", F.round("RSQ_average", 6))


@query("s12_overlap_report")
def s12(spark, sf_dir):
    """Two runs add to one report; one of them is done twice."""
    path = scratch_path(spark, "naics-report")
    for mode in ("reference", "all_pairs", "reference"):
        tables.write_naics_report(_overlap(spark, sf_dir, mode, True), path, f"{YEAR}-{mode}")
    return tables.read_naics_report(spark, path)


@query("s13_vector_store")
def s13(spark, sf_dir):
    path = scratch_path(spark, "vectors")
    stored = st.vectors(spark, sf_dir).withColumn("v", F.col("v").cast("array<double>"))
    stores.write_vectors(stored, path)
    back = stores.read_vectors(spark, path)
    named = stores.vector_entities(back)
    return back.join(named, "company", "left_semi").select("company", "firm_id", F.size("v").alias("dim"),
                                                           F.round(vectors.norm(F.col("v")), 6).alias("length"))


@query("s14_year_lists")
def s14(spark, sf_dir):
    path = scratch_path(spark, "year-lists")
    lists = master.known_companies(master.year_companies(st.url_id(spark, sf_dir)), st.customer_firm(spark, sf_dir))
    for _ in range(2):  # a run that is done again leaves one set of lists
        tables.write_year_lists(lists, path, run="1")
    return spark.read.schema("company string, year int").parquet(path).select("company", "year")


@query("s14_compiled_public_list")
def s14b(spark, sf_dir):
    return tables.compiled_public(st.public(spark, sf_dir))


@query("s15_corpus_coverage")
def s15(spark, sf_dir):
    listed = st.vectors(spark, sf_dir).select(F.lpad("company", 12, "0").alias("company"))
    pages = corpus.firm_pages(st.doc_corpus(spark, sf_dir), YEAR)
    covered, missing = corpus.corpus_coverage(listed, pages)
    return covered.withColumn("covered", F.lit(True)).unionByName(missing.withColumn("covered", F.lit(False)))


# --- projections, filters, scalar functions ---------------------------------------------------------


@query("p1_registrable_domain")
def p1(spark, sf_dir):
    p = st.table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.with_registrable_domain(p, "url").select("page_id", "company")


@query("p1_registrable_domain_hard_hosts")
def p1c(spark, sf_dir):
    """Upper case, final dots, and suffixes of several labels, by wildcard and by exception, under each page's number."""
    suffixes = F.lit([".Foo.COM", ".foo.com.", ".shop.co.uk", ".www.state.tx.us", ".q.ck", "x.www.ck"])
    form = F.get(suffixes, (F.col("page_id") % 6).cast("int"))
    p = st.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("HTTPS://Www.N"), F.col("page_id"), form, F.lit("/A")).alias("url"))
    return urls.with_registrable_domain(p, "url").select("page_id", "company")


@query("p1_registrable_domain_keep_underscore")
def p1b(spark, sf_dir):
    p = st.table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit("_x")).alias("url"))
    keyed = urls.with_registrable_domain(p, "url", underscore_as_slash=False)
    return keyed.select("page_id", "company", urls.url_path(F.col("url")).alias("path"))


@query("p2_domain_path_key")
def p2(spark, sf_dir):
    p = st.table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.with_domain_path_key(p, "url").select("page_id", "company")


@query("p3_flat_key")
def p3(spark, sf_dir):
    return st.table(spark, sf_dir, "pages").select("page_id", urls.flat_key(F.col("url")).alias("key"))


@query("p4_url_level")
def p4(spark, sf_dir):
    return st.table(spark, sf_dir, "pages").select("page_id", urls.url_level(F.col("url")).alias("level"))


@query("p5_crawl_year")
def p5(spark, sf_dir):
    o = st.table(spark, sf_dir, "orders")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return o.select("o_orderkey", urls.crawl_year(stamp).alias("from_text"),
                    urls.crawl_year(F.col("o_orderdate")).alias("from_time"))


@query("p6_strip_prolog")
def p6(spark, sf_dir):
    p = st.table(spark, sf_dir, "pages")
    xml = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<?xml version="1.0"\n?>'), "html")).otherwise(F.col("html"))
    return p.select("page_id", F.md5(text.strip_prolog(xml)).alias("html_md5"))


@query("p7_html_text")
def p7(spark, sf_dir):
    return dealt(st.table(spark, sf_dir, "pages")).select("page_id", text.html_text(F.col("html")).alias("text"))


@query("p7_html_text_hard_markup")
def p7b(spark, sf_dir):
    """The page's number behind markup with many quoted values, numeric references with zeros, names without semicolon."""
    many = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(90)), lambda i: F.concat(F.lit("a"), i, F.lit('="x>y"'))), " ")
    html = F.concat(F.lit("<b "), many, F.lit(">&#0000000065;&#x00042; page&nbsp number&copy "), F.col("page_id"), F.lit(" &#99999999999;<br "))
    return st.table(spark, sf_dir, "pages").select("page_id", text.html_text(html).alias("text"))


@query("p8_words")
def p8(spark, sf_dir):
    return dealt(st.table(spark, sf_dir, "pages")).select("page_id", _text(text.page_words(F.col("html"))))


@query("p9_normalise_words")
def p9(spark, sf_dir):
    d = dealt(st.table(spark, sf_dir, "documents"))
    return d.select("doc_id", _text(text.normalise_words(text.words(F.col("text")))))


@query("p10_pad_naics")
def p10(spark, sf_dir):
    return st.firm(spark, sf_dir).select("firm_id", codes.pad_naics(F.col("naics")).alias("naics"))


@query("p11_naics_prefixes")
def p11(spark, sf_dir):
    padded = codes.pad_naics(F.col("naics"))
    return st.firm(spark, sf_dir).where("naics is not null").select("firm_id", F.inline(codes.naics_prefixes(padded)))


@query("p12_naics_match_len")
def p12(spark, sf_dir):
    f = st.firm(spark, sf_dir)
    other = f.select((F.col("firm_id") - 1).alias("firm_id"), F.col("naics").alias("next_naics"))
    return f.join(other, "firm_id").select(
        "firm_id", codes.naics_match_len(F.col("naics"), F.col("next_naics")).alias("match_len"))


@query("p13_responses")
def p13(spark, sf_dir):
    return archives.responses(st.records(spark, sf_dir)).select("archive_file", "url", "record_date")


@query("p14_look_back")
def p14(spark, sf_dir):
    return corpus.look_back(st.corpus(spark, sf_dir), 2014).select("company", "year", "level", "page")


@query("p15_shallow_levels")
def p15(spark, sf_dir):
    return corpus.shallow(st.corpus(spark, sf_dir)).select("company", "year", "level", "page")


@query("p16_min_words")
def p16(spark, sf_dir):
    return corpus.min_words(st.doc_corpus(spark, sf_dir), 100)


@query("p17_similarity_cut")
def p17(spark, sf_dir):
    return peers.above(_peers(spark, sf_dir, THRESHOLD), THRESHOLD)


@query("p18_valid_years")
def p18(spark, sf_dir):
    return master.valid_years(st.url_id(spark, sf_dir)).select("line_no", "company", "year")


@query("p19_known_keys")
def p19(spark, sf_dir):
    u = st.url_id(spark, sf_dir).withColumn("company", F.when(F.col("line_no") % 9 == 0, "").otherwise(F.col("company")))
    return peers.known_keys(u, st.customer_firm(spark, sf_dir)).select("line_no", "company")


@query("p20_report_labels")
def p20(spark, sf_dir):
    report = regression.r2_report(_lr_input(spark, sf_dir), "doc.2vec_public_peers.csv")
    return report.select("no_of_docs", "input_file_name", "similarity", "type", "pruned_words_cutoff",
                         "WTNIC_Score_Cutoff")


# --- joins ------------------------------------------------------------------------------------------


def _public_by_year(spark, sf_dir) -> DataFrame:
    """A public list per year over companies of the URL/id table."""
    u = master.valid_years(st.url_id(spark, sf_dir), 1995)
    return u.groupBy("year", "company").agg(F.max("line_no").cast("string").alias("gvkey"))


@query("j1_public_with_data")
def j1(spark, sf_dir):
    crawled = st.table(spark, sf_dir, "customer").where(F.col("c_nationkey") < 20).select(F.col("c_name").alias("company"))
    return master.public_firms(_public_by_year(spark, sf_dir), st.customer_firm(spark, sf_dir), crawled)


@query("j2_known_companies_of_year")
def j2(spark, sf_dir):
    lists = master.year_companies(st.url_id(spark, sf_dir))
    return master.known_companies(lists, st.customer_firm(spark, sf_dir))


@query("j3_master_to_firm")
def j3(spark, sf_dir):
    return master.master_to_firm(master.companies(st.url_id(spark, sf_dir)), st.customer_firm(spark, sf_dir))


def _page_master(spark, sf_dir) -> DataFrame:
    """Master companies that are page hosts; several share a registrable domain."""
    p = st.table(spark, sf_dir, "pages")
    tail = F.concat(urls.url_host(F.col("url")), F.lit("."), F.concat(F.lit("s"), F.col("page_id") % 40), F.lit(".com"))
    return p.groupBy(tail.alias("company")).agg(F.min("page_id").alias("master_id"))


def _page_firm(spark, sf_dir) -> DataFrame:
    p = st.table(spark, sf_dir, "pages")
    s = F.col("page_id") % 40
    return p.where(s < 25).groupBy(F.concat(F.lit("s"), s, F.lit(".com")).alias("company")).agg(
        (F.max(s) + 500).alias("firm_id")).withColumn("naics", F.lit("111111")).withColumn("obtained_from", F.lit("x"))


@query("j4_unknown_companies")
def j4(spark, sf_dir):
    return master.unknown_companies(_page_master(spark, sf_dir), _page_firm(spark, sf_dir))


def _r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


RIVAL = [f"rival_{m}" for m in ("profit_assets", "profit_sales", "stock_return", "valuation")]
FOCAL = [f"focal_{m}" for m in ("profit_assets", "profit_sales", "stock_return", "valuation")]


@query("j5_rival_metrics")
def j5(spark, sf_dir):
    edges = peers.with_rival_metrics(_pairs(spark, sf_dir), st.public(spark, sf_dir))
    return edges.select("focal_firmid", "rival_firmid", "wtnic_score", *_r6(*RIVAL))


@query("j5_unknown_rivals")
def j5b(spark, sf_dir):
    edges = _pairs(spark, sf_dir)
    return peers.unknown_rivals(edges, st.metrics(spark, sf_dir).where("firm_id % 3 <> 0")).groupBy("rival_firmid").agg(F.count("*").alias("dropped"))


@query("j6_focal_metrics")
def j6(spark, sf_dir):
    metrics = st.public(spark, sf_dir)
    means = peers.rival_means(peers.with_rival_metrics(_pairs(spark, sf_dir), metrics))
    return peers.with_focal_metrics(means, metrics).select("focal_firmid", *_r6(*RIVAL, *FOCAL))


def _listed_public(spark, sf_dir) -> DataFrame:
    """Public firms whose firm id differs from the vector's key, stored."""
    listed = st.public(spark, sf_dir).where(F.col("firm_id") % 3 != 0)
    return materialize(listed.withColumn("firm_id", F.col("firm_id") + 10_000_000), "listed")


@query("j7_public_pairs")
def j7(spark, sf_dir):
    return peers.public_peers(st.vectors(spark, sf_dir), _listed_public(spark, sf_dir))


@query("j8_known_firm_pairs")
def j8(spark, sf_dir):
    return peers.private_peers(st.vectors(spark, sf_dir), _listed_public(spark, sf_dir), percent=100, threshold=THRESHOLD)


@query("j9_pair_codes")
def j9(spark, sf_dir):
    return industry.with_pair_codes(_pairs(spark, sf_dir), st.firm(spark, sf_dir))


def _evaluation(spark, sf_dir, fraction=TOP_FRACTION) -> tuple[DataFrame, DataFrame, similarity.TopPairs]:
    """Public firms, those with peers, and the cut through all their pairs; no pair is ever stored."""
    public = materialize(st.public(spark, sf_dir), "public")
    paired = materialize(peers.public_vectors(st.vectors(spark, sf_dir), public), "public-vectors")
    top = similarity.top_pairs(paired, public.count(), fraction)
    return public, paired.select(F.col("firm_id").alias("focal_firmid")), top


def _evaluated(spark, sf_dir, fraction=TOP_FRACTION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Public firms, those with peers, and what the kept pairs say of each firm that has one."""
    public, every, top = _evaluation(spark, sf_dir, fraction)
    return public, every, materialize(peers.top_rivals(top, public), "top-rivals")


@query("j10_monopolists")
def j10(spark, sf_dir):
    return peers.monopolists(*_evaluated(spark, sf_dir, NARROW)[1:])


@query("j11_unseen_records")
def j11(spark, sf_dir):
    r = st.records(spark, sf_dir)
    ledger = r.where(F.pmod(F.length("url"), F.lit(3)) == 0)
    return archives.unseen(archives.responses(r), ledger).select("archive_file", "url")


@query("j12_trained_or_inferred")
def j12(spark, sf_dir):
    """Which firms keep their trained vector, unchanged, and which have one computed from enough text."""
    pages = st.doc_corpus(spark, sf_dir)
    even = F.col("page").try_cast("bigint") % 2 == 0
    stored = F.array(*(F.col("company").try_cast("double") + k for k in range(3)))
    trained = pages.where(even).select("company", stored.alias("v"))
    model = encoder.fit_encoder(pages.where(even), dim=3, epochs=1, min_count=5, partitions=8)
    both = encoder.infer_vectors(model, trained, pages, pages.select("company"), 100)
    return both.select("company", F.size("v").alias("dim"), (F.col("v") == stored).alias("is_stored"))


@query("j12_firms_of_one_domain")
def j12b(spark, sf_dir):
    """Firms keyed below the pages' domains: all firms of a domain have one vector."""
    pages = materialize(corpus.firm_pages(ingest.pages_of_records(st.records(spark, sf_dir)), YEAR), "pages")
    keyed = urls.with_registrable_domain(st.table(spark, sf_dir, "pages"), "url", "domain")
    listed = keyed.select("domain", F.concat("domain", F.lit("_"), "page_id").alias("company"))
    model = encoder.fit_encoder(pages, dim=3, epochs=1, min_count=5, partitions=8)
    none = spark.createDataFrame([], "company string, v array<double>")
    found = encoder.infer_vectors(model, none, pages, listed, 100)
    return found.join(listed, "company").groupBy(F.col("domain").alias("company")).agg(
        F.count("*").alias("firms"), F.countDistinct("v").alias("vectors"))


@query("j13_entity_codes")
def j13(spark, sf_dir):
    listed = _page_master(spark, sf_dir).select("company")
    return industry.entity_codes(listed, _page_firm(spark, sf_dir)).groupBy("company", "naics").agg(
        F.count("*").alias("entities"))


@query("j13_entities_not_found")
def j13b(spark, sf_dir):
    return industry.entities_not_found(_page_master(spark, sf_dir).select("company"), _page_firm(spark, sf_dir))


@query("j14_all_pairs_cosine")
def j14(spark, sf_dir):
    return _peers(spark, sf_dir, None)


@query("j14_cosine_above_threshold")
def j14b(spark, sf_dir):
    return _peers(spark, sf_dir, THRESHOLD)


# --- aggregations -----------------------------------------------------------------------------------


@query("j14_threshold_over_clusters")
def j14c(spark, sf_dir):
    """The same edges from blocks of near vectors, where tiles too far apart for the threshold are left out."""
    return similarity.cosine_pairs(st.vectors(spark, sf_dir), min_score=0.35, block_rows=64)


@query("a1_bag_of_words")
def a1(spark, sf_dir):
    """Every word at its place in its firm's bag, in lines of a thousand; segments are cut at 700 words."""
    pages = corpus.firm_pages(st.corpus(spark, sf_dir), YEAR)
    bags = corpus.bag_of_words(pages, 700)
    placed = bags.select("company", "start", F.posexplode("words").alias("at", "word"), F.size("words").alias("size"))
    place = F.col("start") + F.col("at")
    lines = placed.groupBy("company", F.expr("(start + at) div 1000").alias("line")).agg(
        F.count("*").alias("n_words"), F.array_sort(F.collect_list(F.struct(place.alias("p"), "word"))).alias("w"), F.max("size").alias("longest"))
    return lines.select("company", "line", "n_words", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"),
                        (F.col("longest") <= 700).alias("bounded"))


@query("a1_text_of_companies_by_domain")
def a1b(spark, sf_dir):
    companies = master.latest_public_rows(st.public_raw(spark, sf_dir))
    pages = corpus.firm_pages(ingest.pages_of_records(st.records(spark, sf_dir)), YEAR)
    return corpus.firm_text(companies, pages).groupBy("company").agg(
        F.count("*").alias("pages"), F.sum(F.size("words")).alias("n_words"))


@query("a2_companies")
def a2(spark, sf_dir):
    return master.companies(st.url_id(spark, sf_dir)).select(
        "company", "master_id", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"), "n_lines")


@query("a3_year_companies")
def a3(spark, sf_dir):
    return master.year_companies(st.url_id(spark, sf_dir))


@query("a4_url_id_totals")
def a4(spark, sf_dir):
    return master.url_id_totals(st.url_id(spark, sf_dir))


@query("a5_private_firms_per_year")
def a5(spark, sf_dir):
    lists = master.year_companies(st.url_id(spark, sf_dir))
    return master.firms_per_year(master.known_companies(lists, st.customer_firm(spark, sf_dir)))


@query("a5_public_firms_per_year")
def a5b(spark, sf_dir):
    return master.firms_per_year(j1(spark, sf_dir))


@query("a6_next_firm_id")
def a6(spark, sf_dir):
    return spark.createDataFrame([(rank.next_id(st.customer_firm(spark, sf_dir)),)], "next_firm_id bigint")


@query("a7_prefix_frequency")
def a7(spark, sf_dir):
    return industry.prefix_frequency(_codes(spark, sf_dir))


def _codes(spark, sf_dir) -> DataFrame:
    f = st.firm(spark, sf_dir)
    return industry.entity_codes(f.select("company"), f)


@query("a8_required_pairs")
def a8(spark, sf_dir):
    return industry.required_pairs(industry.prefix_frequency(_codes(spark, sf_dir)))


@query("a9_frequency_check")
def a9(spark, sf_dir):
    c = _codes(spark, sf_dir)
    return industry.frequency_check(industry.prefix_frequency(c), c)


@query("a10_entity_count")
def a10(spark, sf_dir):
    return stores.vector_entities(st.vectors(spark, sf_dir)).agg(F.count("*").alias("entities"))


@query("a11_rival_means")
def a11(spark, sf_dir):
    means = peers.rival_means(peers.with_rival_metrics(_pairs(spark, sf_dir), st.public(spark, sf_dir)))
    return means.select("focal_firmid", *_r6(*RIVAL))


@query("a12_focal_counts")
def a12(spark, sf_dir):
    public, every, kept = _evaluated(spark, sf_dir)
    return peers.focal_counts(every, kept, peers.lr_input_of(every, kept, public))


def _overlap(spark, sf_dir, mode, both_codes=False) -> DataFrame:
    coded = industry.pairs_by_codes(st.vectors(spark, sf_dir), st.firm(spark, sf_dir), THRESHOLD)
    report = industry.naics_report(YEAR, coded, _codes(spark, sf_dir), TOP_FRACTION, mode, both_codes)
    more = ["both_codes"] if both_codes else []
    return report.select(F.lit(mode).alias("mode"), "digits", "total_firms", "required", "budget", "matches",
                         F.round("similarity", 6).alias("similarity"), *more)


@query("a13_naics_overlap_reference")
def a13(spark, sf_dir):
    return _overlap(spark, sf_dir, "reference")


@query("a13_naics_overlap_all_pairs")
def a13b(spark, sf_dir):
    return _overlap(spark, sf_dir, "all_pairs")


@query("a13_pairs_with_both_codes")
def a13c(spark, sf_dir):
    coded = industry.pairs_by_codes(st.vectors(spark, sf_dir), st.firm(spark, sf_dir), THRESHOLD)
    total, required = industry.entity_totals(_codes(spark, sf_dir))
    found = {
        fraction: industry.pairs_with_both_codes(coded, industry.pair_budgets(total, required, fraction))
        for fraction in (TOP_FRACTION, NARROW)
    }
    return spark.createDataFrame(list(found.items()), "fraction double, pairs bigint")


def _lr_input(spark, sf_dir, fraction=TOP_FRACTION) -> DataFrame:
    public, every, kept = _evaluated(spark, sf_dir, fraction)
    return peers.lr_input_of(every, kept, public)


def _rounded_lr(df: DataFrame) -> DataFrame:
    return df.select("focal_firmid", *_r6(*RIVAL, *FOCAL), "monopolist")


@query("a14_r_squared")
def a14(spark, sf_dir):
    names = ("RSQ_stock_return", "RSQ_profit_sales", "RSQ_profit_asset", "RSQ_valuation")
    return regression.r_squared(_lr_input(spark, sf_dir)).select("no_of_docs", *_r6(*names))


@query("a14_r_squared_with_monopolists")
def a14b(spark, sf_dir):
    names = ("RSQ_stock_return", "RSQ_profit_sales", "RSQ_profit_asset", "RSQ_valuation")
    return regression.r_squared(_lr_input(spark, sf_dir, NARROW)).select("no_of_docs", *_r6(*names))


@query("a15_mean_profit_r_squared")
def a15(spark, sf_dir):
    return regression.r_squared(_lr_input(spark, sf_dir)).select(*_r6("RSQ_average"))


@query("a16_vocabulary")
def a16(spark, sf_dir):
    return corpus.vocabulary(corpus.firm_pages(st.corpus(spark, sf_dir), YEAR), 5)


@query("a17_latest_public_rows")
def a17(spark, sf_dir):
    return master.latest_public_rows(st.public_raw(spark, sf_dir))


@query("a17_last_line_wins_over_files")
def a17b(spark, sf_dir):
    """Lines dealt to three files: a later file's line replaces an earlier file's, and within a file a later line an earlier one."""
    path = scratch_path(spark, "three-files")
    raw = st.public_raw(spark, sf_dir)
    part = F.concat(F.lit("part"), F.col("line_no") % 3).alias("file")
    line = F.concat_ws("\t", "gvkey", F.col("year").cast("string"), "url", F.col("profit_assets").cast("string"))
    raw.select(part, "line_no", line.alias("value")).repartition("file").sortWithinPartitions("file", "line_no").drop("line_no").write.partitionBy(
        "file").text(path)
    p = F.split("value", "\t")
    read = spark.read.text(path).select(tables.line_order().alias("line_no"), p[0].alias("gvkey"), p[1].cast("int").alias("year"), p[2].alias("url"),
                                        p[3].cast("double").alias("profit_assets"))
    return master.latest_public_rows(read)


def _page_dimension(spark, sf_dir) -> DataFrame:
    """Firm rows keyed by raw URL, of which many share domain and path."""
    raw = st.public_raw(spark, sf_dir)
    return raw.select(F.concat("url", F.lit("/"), F.lit("?line="), "line_no").alias("company"), F.col("line_no").alias("firm_id"))


@query("a18_rekeyed_dimension")
def a18(spark, sf_dir):
    return master.rekey_dimension(_page_dimension(spark, sf_dir), "firm_id")[0]


@query("a18_rekeyed_repeats")
def a18b(spark, sf_dir):
    return master.rekey_dimension(_page_dimension(spark, sf_dir), "firm_id")[1]


@query("a19_run_metrics")
def a19(spark, sf_dir):
    return corpus.run_metrics(st.records(spark, sf_dir).withColumn("words", text.page_words(F.col("html"))))


@query("a19_ingest_account")
def a19b(spark, sf_dir):
    """What the ingest itself says of each archive it was told to read: damaged records, one file that is not there."""
    folder, out, manifest = (scratch_path(spark, name) for name in ("archives", "account-corpus", "manifest"))
    _write_archives(st.records(spark, sf_dir), folder, broken="/5")
    named = st.records(spark, sf_dir).select("archive_file").distinct().where("archive_file <> 'crawl-2.warc.gz'")
    named = named.unionByName(spark.createDataFrame([("gone.warc.gz",)], "archive_file string"))
    named.select(F.concat_ws("  ", F.md5("archive_file"), "archive_file", F.lit(folder))).write.text(manifest)
    ingest.ingest_archives(spark, folder, out, manifest=manifest)
    return ingest.ingest_account(spark, out).withColumn("archive_file", F.element_at(F.split("archive_path", "/"), -1)).drop("archive_path")


# --- ranks, sorts, samples --------------------------------------------------------------------------


@query("w1_new_firm_ids")
def w1(spark, sf_dir):
    return master.extend_firms(_page_master(spark, sf_dir), _page_firm(spark, sf_dir))[0]


@query("w2_top_k_rivals")
def w2(spark, sf_dir):
    """Rank cut before the public filter; the focal firm takes one of the 40 places."""
    return peers.public_peers(st.vectors(spark, sf_dir), _listed_public(spark, sf_dir), top_k=40)


@query("w3_top_percent_rivals")
def w3(spark, sf_dir):
    return peers.private_peers(st.vectors(spark, sf_dir), _listed_public(spark, sf_dir), 1.5, 0.1)


@query("l1_global_top_fraction")
def l1(spark, sf_dir):
    return _evaluation(spark, sf_dir)[2].edges()


@query("l1_top_fraction_of_vector_pairs")
def l1c(spark, sf_dir):
    public = materialize(st.public(spark, sf_dir), "public")
    paired = materialize(peers.public_vectors(st.vectors(spark, sf_dir), public), "public-vectors")
    return similarity.top_fraction_of_pairs(paired, public.count(), TOP_FRACTION)


@query("l1_top_fraction_of_lineitem")
def l1b(spark, sf_dir):
    items = st.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    k = int(items.count() * TOP_FRACTION)
    return rank.top_rows(items, k, "l_quantity", ["l_orderkey", "l_linenumber"])


@query("l1_top_fraction_with_missing_scores")
def l1d(spark, sf_dir):
    """Discounts stand for scores; some are NULL, some NaN, and more rows are kept than have a score."""
    items = st.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    key = F.col("l_orderkey") % 7
    score = F.when(key == 0, None).when(key < 3, F.lit(float("nan"))).otherwise(F.col("l_discount").cast("double"))
    scored = materialize(items.select("l_orderkey", "l_linenumber", score.alias("score")), "scored")
    kept = rank.top_rows(scored, int(items.count() * 0.7), "score", ["l_orderkey", "l_linenumber"])
    return kept.select("l_orderkey", "l_linenumber", rank.present("score").alias("score"))


@query("l2_sorted_peers")
def l2(spark, sf_dir):
    return rank.sorted_peers(_pairs(spark, sf_dir))


@query("l3_hash_sample")
def l3(spark, sf_dir):
    return rank.hash_sample(st.url_id(spark, sf_dir), "company", 700, "17")


@query("l4_ordered_pages")
def l4(spark, sf_dir):
    order = [("year", True), ("level", True), ("page", True)]
    pages = st.corpus(spark, sf_dir).select("company", "year", "level", "page")
    return rank.distributed_rank(pages, order, "position", ["company"])


# --- set operations ---------------------------------------------------------------------------------


@query("u1_training_set")
def u1(spark, sf_dir):
    sample = rank.hash_sample(st.url_id(spark, sf_dir), "company", 700, "17")
    return master.training_set(sample, st.customer_firm(spark, sf_dir))


@query("u2_not_indexed")
def u2(spark, sf_dir):
    return master.not_indexed(master.companies(st.url_id(spark, sf_dir)), st.customer_firm(spark, sf_dir))


@query("u3_regression_input")
def u3(spark, sf_dir):
    return _rounded_lr(_lr_input(spark, sf_dir))


@query("u3_regression_input_with_monopolists")
def u3b(spark, sf_dir):
    return _rounded_lr(_lr_input(spark, sf_dir, NARROW))


@query("u4_all_vectors")
def u4(spark, sf_dir):
    v = st.vectors(spark, sf_dir)
    both = encoder.all_vectors(v.where(F.col("firm_id") % 3 == 0), v.where(F.col("firm_id") % 3 != 0))
    return both.select("company", "origin", F.round(vectors.norm(F.col("v")), 6).alias("length"))


# --- text embedding ---------------------------------------------------------------------------------


def _encoder(spark, sf_dir):
    pages = materialize(corpus.firm_pages(st.doc_corpus(spark, sf_dir), YEAR), "training")
    return encoder.fit_encoder(pages, dim=32, epochs=1, window=8, min_count=5, partitions=8), pages


@query("m1_word_vectors")
def m1(spark, sf_dir):
    model, _ = _encoder(spark, sf_dir)
    v = vector_to_array("vector")
    return model.getVectors().select("word", F.size(v).alias("dim"), (vectors.norm(v) > 0).alias("has_direction"))


@query("m2_firm_vectors")
def m2(spark, sf_dir):
    """Each vector next to the one Spark ML's model makes of the pages: how far apart they are at most."""
    model, pages = _encoder(spark, sf_dir)
    sized = pages.where(F.size("words") > 0).withColumn("_n", F.size("words").cast("double"))
    means = model.transform(sized.select("company", "words", "_n")).groupBy("company").agg(
        Summarizer.mean(F.col("page_vector"), F.col("_n")).alias("_mean"))
    both = encoder.encode(model, pages).join(means.select("company", vector_to_array("_mean").alias("want")), "company")
    want = F.col("want")
    gap = F.array_max(F.zip_with("v", want, lambda a, b: F.abs(a - b)))
    return both.select("company", F.size("v").alias("dim"), "n_words", F.round(gap, 6).alias("deviation"))


@query("m3_cosine_with_next")
def m3(spark, sf_dir):
    v = st.vectors(spark, sf_dir)
    other = v.select((F.col("firm_id") - 1).alias("firm_id"), F.col("v").alias("w"))
    return v.join(other, "firm_id").select("firm_id", F.round(vectors.cosine(F.col("v"), F.col("w")), 6).alias("score"))


# --- incremental ingest -----------------------------------------------------------------------------


def _stream_drops(spark, sf_dir, dedup_keys) -> DataFrame:
    """Offer page archives in two drops, read from real files by their paths; the second drop, in another folder, repeats
    archives of the first."""
    drop, out, mark = (scratch_path(spark, name) for name in ("drop", "stream-corpus", "stream-checkpoint"))
    r = st.records(spark, sf_dir)
    for folder, offered in (("one", "archive_file <= 'crawl-4'"), ("two", "archive_file >= 'crawl-3'")):
        _write_archives(r.where(offered), f"{drop}/{folder}")
        streaming.ingest(archives.stream_archives(spark, f"{drop}/*", accounts=True), out, mark, dedup_keys,
                         buckets=8).awaitTermination()
    return stores.read_corpus(spark, out)


@query("t1_incremental_ingest")
def t1(spark, sf_dir):
    pages = _stream_drops(spark, sf_dir, ("url",))
    return pages.select("company", "year", "level", "page", _text())


@query("t1_incremental_ingest_with_repeats")
def t1b(spark, sf_dir):
    pages = _stream_drops(spark, sf_dir, ())
    return pages.select("company", "year", "level", "page", _text())
