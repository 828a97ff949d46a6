"""The engine's input tables, derived from the driver's tables as FIXTURES.md part B lays out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmnet.functions.text import words
from firmnet.storage import dealt

PUBLIC_YEAR = 2016


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("company"), F.col("vec_id").alias("firm_id"),
                    F.col("embedding").alias("v"))


def firm(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    code = F.concat((F.col("label") + 10).cast("string"), *((i % m).cast("string") for m in (5, 3, 2)), F.lit("0"))
    naics = F.when(i % 17 == 0, None).when(i % 13 == 0, F.substring(code, 1, 4)).otherwise(code)
    return e.select(i.cast("string").alias("company"), i.alias("firm_id"), naics.alias("naics"),
                    F.when(naics.isNotNull(), F.lit("label")).alias("obtained_from"))


def metrics(spark, sf_dir) -> DataFrame:
    """Financials per firm, all whole numbers: their sums and means do not depend on the order of rows."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    spent = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.sum(cents).alias("cents"), F.max("o_totalprice").alias("top"))
    c = table(spark, sf_dir, "customer").join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(
        F.col("c_custkey").alias("firm_id"),
        F.round(F.col("c_acctbal") * 100).alias("profit_assets"),
        F.coalesce("n", F.lit(0)).cast("double").alias("profit_sales"),
        F.coalesce(F.col("cents") % 100003, F.lit(0)).cast("double").alias("stock_return"),
        F.round(F.coalesce("top", F.lit(0.0)) * 100).alias("valuation"),
    )


def public(spark, sf_dir) -> DataFrame:
    """Firms with a vector and financials, as the public firms of one year."""
    ids = vectors(spark, sf_dir).select("company", "firm_id")
    return ids.join(metrics(spark, sf_dir), "firm_id").withColumn("gvkey", F.concat(F.lit("g"), "company")).withColumn(
        "year", F.lit(PUBLIC_YEAR))


def url_id(spark, sf_dir) -> DataFrame:
    """Every second line of a company carries another id, every fiftieth an unknown year."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    k = F.col("o_orderkey")
    return o.join(c, "o_custkey").select(
        k.alias("line_no"), (F.col("o_custkey") + 1_000_000 * (k % 2)).alias("master_id"),
        F.col("c_name").alias("company"),
        F.when(k % 50 == 0, 0).otherwise(F.year("o_orderdate")).alias("year"),
    )


def customer_firm(spark, sf_dir) -> DataFrame:
    """Firm dimension over the companies of ``url_id``: customers with a positive balance."""
    c = table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0)
    naics = F.concat(F.lit("3"), (F.col("c_nationkey") + 100).cast("string"))
    return c.select(F.col("c_name").alias("company"), (F.col("c_custkey") * 3 + 1).alias("firm_id"),
                    naics.alias("naics"), F.col("c_mktsegment").alias("obtained_from"))


def corpus(spark, sf_dir) -> DataFrame:
    d = dealt(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    i = F.col("doc_id")
    return d.select(F.col("source").alias("company"), (2010 + i % 8).cast("int").alias("year"),
                    (i % 5).cast("int").alias("level"), F.lpad(i.cast("string"), 12, "0").alias("page"),
                    words(F.col("text")).alias("words"))


def doc_corpus(spark, sf_dir) -> DataFrame:
    """The same pages with every document a firm of its own."""
    return corpus(spark, sf_dir).withColumn("company", F.col("page"))


def records(spark, sf_dir) -> DataFrame:
    p = dealt(table(spark, sf_dir, "pages"))
    i = F.col("page_id")
    return p.select(
        F.concat(F.lit("crawl-"), (i % 7).cast("string"), F.lit(".warc.gz")).alias("archive_file"),
        F.when(i % 6 == 0, "request").otherwise("response").alias("rec_type"),
        F.concat((2010 + i % 8).cast("string"), F.lit("-03-01T00:00:00Z")).alias("record_date"),
        "url", "html",
    )


def public_raw(spark, sf_dir) -> DataFrame:
    """Public-firm lines whose URLs (last path part cut off) repeat within a year."""
    p = table(spark, sf_dir, "pages")
    i = F.col("page_id")
    return p.select(
        i.alias("line_no"), F.concat(F.lit("g"), i.cast("string")).alias("gvkey"), (2010 + i % 8).cast("int").alias("year"),
        F.regexp_replace("url", "/[^/]*/?$", "").alias("url"),
        (i % 100 / 10).alias("profit_assets"), (i % 50 / 10).alias("profit_sales"),
        (i % 25 / 10).alias("stock_return"), (i % 10 / 10).alias("valuation"),
    )
