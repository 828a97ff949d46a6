"""Registered queries of the operators in this package, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from firmnet.llm import (
    alignment, apportion, chat, digest, disclosure, hosts, neighbours, packing, phrases, sharding, simhash, toxicity, warc,
)
from firmnet.llm.common import table, whole
from firmnet.storage import scratch_path


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.neighbours(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_form("fp").alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, payloads=False).drop("url")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.find(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in disclosure.KINDS]
    return found.select("doc_id", *counts, F.sha2(disclosure.listed(disclosure.KINDS).cast("binary"), 256).alias("base_sha256"),
                        disclosure.listed((*disclosure.KINDS, *disclosure.TERMS)).alias("spans"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.tokenised_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"),
                                                  public_tokenizers.path("byte_bpe_50k.tiktoken")))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = apportion.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                        F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.extract_text(table(spark, sf_dir, "pages"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.edited_likeness(table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    written = sharding.write_shards(docs, scratch_path(spark, "shards"))
    return written.select(
        "doc_id", sharding.n_bytes("text").alias("size"), F.crc32(whole("text").cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_statistics(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                     public_tokenizers.path("piece_bpe_32k.model"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_nearest_neighbours, op2_chat_formatting, op3_simhash_dedup, op4_toxicity, op5_warc_writer, op6_pii, op7_best_fit_packing,
    op8_source_mixing, op9_html_extraction, op10_document_fingerprints, op11_sharding, op12_tokenizer_alignment,
    op13_phrase_collocations)} | {"pipeline": corpus_pipeline.run}

ORACLE_SQL: dict[str, str] = {
    "op5_warc_writer": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
             d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
             f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM f""",
    "op13_phrase_collocations": r"""
        WITH doc AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
             piece AS (SELECT lang, regexp_extract_all(part, '[^ \t]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(body, '[.,;:!?\x0A-\x0D]')) AS part FROM doc)),
             place AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM piece),
             gram AS (SELECT lang, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM place),
             f1 AS (SELECT lang, a, count(*) AS f FROM gram GROUP BY ALL),
             f2 AS (SELECT lang, a, b, count(*) AS f FROM gram WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
             f3 AS (SELECT lang, a, b, c, count(*) AS f FROM gram WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
             total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
             cover AS (SELECT lang, a, b, max(f) AS most FROM (SELECT lang, a, b, f FROM f3 UNION ALL SELECT lang, b, c, f FROM f3) GROUP BY ALL),
             two AS (SELECT lang, f2.a || ' ' || f2.b AS phrase, f2.f AS a, x.f AS l, y.f AS r,
                            1000000 * CAST(f2.f AS HUGEINT) * f2.f // (CAST(x.f AS HUGEINT) * y.f) AS score
                     FROM f2 JOIN f1 x USING (lang, a) JOIN f1 y ON y.lang = f2.lang AND y.a = f2.b LEFT JOIN cover USING (lang, a, b)
                     WHERE most IS NULL OR 100 * most < 50 * f2.f),
             cuts AS (SELECT f3.lang AS lang, f3.a || ' ' || f3.b || ' ' || f3.c AS phrase, f3.f AS a, x.f AS l1, yz.f AS r1, xy.f AS l2, z.f AS r2,
                             1000000 * CAST(f3.f AS HUGEINT) * f3.f // (CAST(x.f AS HUGEINT) * yz.f) AS s1,
                             1000000 * CAST(f3.f AS HUGEINT) * f3.f // (CAST(xy.f AS HUGEINT) * z.f) AS s2
                      FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.a = f3.a JOIN f1 z ON z.lang = f3.lang AND z.a = f3.c
                           JOIN f2 xy ON xy.lang = f3.lang AND xy.a = f3.a AND xy.b = f3.b JOIN f2 yz ON yz.lang = f3.lang AND yz.a = f3.b AND yz.b = f3.c),
             scored AS (SELECT * FROM two UNION ALL
                        SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, least(s1, s2) FROM cuts),
             ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM scored)
        SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
}
