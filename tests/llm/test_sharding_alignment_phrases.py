import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from firmnet.llm import alignment, phrases, sharding
from firmnet.llm.queries import ORACLE_SQL, QUERIES
from firmnet.storage import materialize, scratch_path

FOLDER = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", " a  b ", "a\tb\nc", "x<|endoftext|>y <s> </s> <unk> <0x41>", "▁ under ▁▁ mark", "é ü ß 日本語 𝒳 ½ ﬁ", "\x00 nul", "\u200b\ufeff zero",
       "don't stop, it's 12 34!?", "a" * 5000, "word " * 3000, "no_space" * 2000, "e\u0301", "　wide　space", "1,234.5;6:7"]
SCHEMA = "doc_id long, text string, lang string, source string"


def odd_docs(spark, texts=ODD, lang=lambda i: ("en", "de", None)[i % 3]):
    return spark.createDataFrame([(i if i % 7 else None, t, lang(i), "s") for i, t in enumerate(texts)], SCHEMA)


# Sharding


def test_shuffle_is_the_two_passes_of_a_plain_version(spark):
    docs = spark.createDataFrame([(i, f"text {i}" * (i % 5)) for i in range(3000)], "doc_id long, text string").repartition(6)
    docs = materialize(docs, "docs")
    rows = sharding.shuffled(docs, 16, 5, bucket_bytes=4000).orderBy("shard", "slot").collect()
    n, buckets = sharding.bucket_count(docs, "text", 4000)
    assert n == 3000 and buckets > 10
    at, bucket = sharding._scattered(docs, buckets, 5)
    placed = sorted(docs.select(bucket.alias("b"), at.alias("at"), "doc_id").collect())
    want = []
    for b in range(buckets):
        own = [r["doc_id"] for r in placed if r["b"] == b]
        want += [own[k] for k in sharding.permutation(len(own), 5, b)]
    assert [r["doc_id"] for r in rows] == want
    sizes = Counter(r["shard"] for r in rows)
    assert sorted(sizes) == list(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k in range(16):
        assert [r["slot"] for r in rows if r["shard"] == k] == list(range(sizes[k]))


def test_shuffle_is_uniform(spark):
    docs = materialize(spark.range(16_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), "docs")
    rows = sharding.shuffled(docs, 16, 3, bucket_bytes=4000).toPandas()
    order = rows.sort_values(["shard", "slot"]).doc_id.to_numpy()
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.03
    counts = np.histogram2d(rows.doc_id // 1000, rows["shard"], bins=(16, 16))[0]  # 62.5 expected in each cell
    assert ((counts - 62.5) ** 2 / 62.5).sum() < 330  # 225 degrees of freedom


def test_one_row_on_most_places_spreads_over_buckets_and_shards(spark):
    docs = materialize(spark.range(20_000).select(F.when(F.col("id") % 5 > 0, 7).otherwise(F.col("id")).alias("doc_id"),
                                                  F.when(F.col("id") % 5 > 0, "same").otherwise(F.col("id").cast("string")).alias("text")), "docs")
    rows = sharding.shuffled(docs, bucket_bytes=5000)
    hot = [r["n"] for r in rows.where("doc_id = 7").groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert len(hot) == 16 and max(hot) < 2 * 16_000 / 16
    assert sorted(r[0] for r in rows.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())


def test_shuffle_of_odd_tables(spark):
    docs = odd_docs(spark).withColumn("shard", F.lit("mine")).withColumn("Slot", F.lit(1)).withColumn("bucket", F.lit(2)).withColumn("row", F.lit(3))
    rows = sharding.shuffled(docs)
    assert rows.columns == ["doc_id", "text", "lang", "source", "bucket", "row", "shard", "slot"]
    found = rows.collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["text"] is None)
    assert sorted(map(key, found)) == sorted(map(key, docs.collect()))
    assert {(r["bucket"], r["row"]) for r in found} == {(2, 3)}
    assert sharding.shuffled(docs.limit(0)).count() == 0
    few = sharding.shuffled(docs.limit(3)).collect()
    assert sorted((r["shard"], r["slot"]) for r in few) == [(0, 0), (1, 0), (2, 0)]


def test_shards_are_written_and_read_back(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    folder = scratch_path(spark, "shards")
    back = sharding.write_shards(docs, folder, bucket_bytes=50_000)
    assert back.exceptAll(sharding.shuffled(docs, bucket_bytes=50_000)).isEmpty()  # reruns agree
    assert sorted(map(tuple, back.select(docs.columns).collect())) == sorted(map(tuple, docs.collect()))


def test_query_of_shards(spark):
    got = {r["doc_id"]: r for r in QUERIES["op11_sharding"](spark, FOLDER).collect()}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        raw = r["text"].encode()
        own = got.pop(r["doc_id"])
        assert (own["size"], own["text_crc32"], own["law"], own["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    assert not got


# Alignment


@pytest.fixture(scope="module")
def sides():
    return alignment.ByteLevel(A), alignment.Pieces(B)


def plain(texts, sides):
    """Groups by byte sets, links by all pairs of occurrences, counts by a Counter."""
    rows, pairs = [], Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        ids = [side.encode([text])[0] if text else [] for side in sides]
        tokens = [[side.bytes[i] for i in own] for side, own in zip(sides, ids)]
        if not text or any(b"".join(t) != raw for t in tokens):
            rows.append(([], [], "", []))
            continue
        ends = [np.cumsum([len(t) for t in own]).tolist() for own in tokens]
        both = set(ends[0]) & set(ends[1])
        groups, links = [], []
        at = [0, 0]
        for end in sorted(both):
            stop = [own.index(end) + 1 for own in ends]
            groups.append("|".join(",".join(map(str, own[i:j])) for own, i, j in zip(ids, at, stop)))
            at = stop
        for i, x in enumerate(ends[0]):
            links += [(ids[0][i], ids[1][j]) for j in [ends[1].index(x)] if x in both] if x in both else []
        pairs.update(links)
        rows.append((*ids, ";".join(groups), links))
    best = Counter()
    for (_, b), n in pairs.items():
        best[b] = max(best[b], n)
    return [(len(a), len(b), len(links), len(links), sum(pairs[p] == best[p[1]] for p in links), sum(pairs[p] for p in links),
             hashlib.sha256(groups.encode()).hexdigest() if groups else "") for a, b, groups, links in rows]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_statistics_of_documents_and_odd_texts(spark, sides):
    texts = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).collect()] + ODD
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, pairs string")
    got = sorted(alignment.link_statistics(docs, A, B).collect())
    assert [tuple(r[c] for c in COLUMNS) for r in got] == plain(texts, sides)
    zeros = [t for t, r in zip(texts, got) if not r["n_a"]]
    assert None in zeros and "" in zeros and "▁ under ▁▁ mark" in zeros and len(zeros) == 3


def test_query_of_alignment(spark, sides):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_tokenizer_alignment"](spark, FOLDER).collect()}
    assert [got[r["doc_id"]] for r in docs] == plain([r["text"] for r in docs], sides)


def test_windows_of_a_batch_are_aligned_once(sides):
    texts = ["the cat and the dog and the cat"] * 50
    own = alignment.Aligner(*sides)
    out = own.align_texts(texts, *(side.encode(texts) for side in sides))
    assert len({(groups, tuple(codes)) for groups, codes in out}) == 1
    assert own.aligned == 4 and own.met == 50 * 8  # the, cat, and, dog


@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=20), st.lists(st.integers(0, 3), min_size=1, max_size=20)), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_equal_windows_are_found_token_by_token(pairs):
    x, y = (np.array([t for p in pairs for t in p[side]], np.int64) for side in (0, 1))
    bounds = [np.cumsum([0] + [len(p[side]) for p in pairs]) for side in (0, 1)]
    kind, some = alignment.same_windows(x, bounds[0][:-1], bounds[0][1:], y, bounds[1][:-1], bounds[1][1:], 4, 4)
    keys = [(tuple(a), tuple(b)) for a, b in pairs]
    for i, key in enumerate(keys):
        assert keys[some[kind[i]]] == key
        for j in range(i):
            same, long = key == keys[j], max(map(len, key)) > alignment.LONG
            assert (kind[i] == kind[j]) == (same and not long)


def test_ids_are_those_of_the_file_s_own_tokenizer(spark, sides):
    own = Tokenizer.from_file(A)
    own.encode_special_tokens = True
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]
    texts += [t for t in ODD if t] + [" ".join(random.Random(i).choices(["a", "the", "", "\n", "x1", "don't", "é,", "<|endoftext|>", "　z"], k=40)) for i in range(200)]
    for s in range(0, len(texts), 500):
        want = own.encode_batch([" " + t for t in texts[s:s + 500]], add_special_tokens=False)
        assert sides[0].encode(texts[s:s + 500]) == [e.ids for e in want]


def test_special_strings_are_plain_text(sides):
    for text in ("x<|endoftext|>y", "<s></s><unk>"):
        for side in sides:
            assert b"".join(side.bytes[i] for i in side.encode([text])[0]) == b" " + text.encode()


def test_possible_pairs_are_bounded_by_the_vocabularies(spark, sides):
    """A linked pair ends alike: one token's bytes are the end of the other's."""
    a, b = sides
    linked = alignment._rows(odd_docs(spark), "doc_id", "text").mapInArrow(alignment._linked(A, B), f"_id long, {alignment.LINKED}")
    for r in alignment.pair_counts(linked).collect():
        x, y = a.bytes[r["pair"] >> 32], b.bytes[r["pair"] & 0xFFFFFFFF]
        assert x.endswith(y) or y.endswith(x)
    ends = [Counter(x) for x in (a.bytes, b.bytes)]
    possible = sum(ends[1][x[k:]] for x in a.bytes for k in range(len(x))) + sum(ends[0][x[k:]] for x in b.bytes for k in range(1, len(x)))
    assert possible < 400_000


def test_alignment_of_an_empty_table_and_null_ids(spark):
    docs = odd_docs(spark)
    assert alignment.link_statistics(docs.limit(0), A, B).count() == 0
    rows = alignment.aligned(docs, A, B).collect()
    assert len(rows) == len(ODD) and sum(r["doc_id"] is None for r in rows) == sum(i % 7 == 0 for i in range(len(ODD)))
    assert {r["groups"] for r in rows if not r["a"]} == {""}
    one = alignment.aligned(docs.where("text = 'a'"), A, B).first()
    assert one["groups"] == f"{one['a'][0]}|{one['b'][0]}"


# Phrases


def plain_collocations(rows, support=10, top=2000):
    counts, totals = {n: Counter() for n in (1, 2, 3)}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in phrases.pieces(text or ""):
            words = [w.decode() for w in words]
            totals[lang] += len(words)
            for n in counts:
                counts[n].update((lang, *words[i:i + n]) for i in range(len(words) - n + 1))
    f = {k: v for c in counts.values() for k, v in c.items()}
    cover = Counter()
    for (lang, *w), n in counts[3].items():
        if n >= support:
            for part in ((lang, w[0], w[1]), (lang, w[1], w[2])):
                cover[part] = max(cover[part], n)
    out = []
    for size in (2, 3):
        for (lang, *w), a in counts[size].items():
            if a >= support and 100 * cover[lang, *w] < 50 * a:
                cuts = [(10**6 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, size)]
                score, _, left, right = min(cuts)
                out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    result, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            result.append((lang, rank[lang], phrase.decode(), -a, left, right, totals[lang], -score))
    return result


def collected(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def invented(n, seed=1):
    draw = random.Random(seed)
    words = ["Ab", "b", "c,", "d.", "é", "new york", "new york city", "x\ty", "f!", "a a a", "\x00", "u\n"]
    return [" ".join(draw.choices(words, k=draw.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("shards, chunk_words", [(1, 1 << 20), (4, 300), (3, 50)])
def test_collocations_equal_a_plain_count(spark, shards, chunk_words):
    texts = invented(300) + ODD
    docs = odd_docs(spark, texts).withColumn("n", F.lit(1)).withColumn("chunk", F.lit("x")).repartition(5)
    got = collected(phrases.collocations(docs, shards=shards, chunk_words=chunk_words))
    want = plain_collocations([(("en", "de", None)[i % 3], t) for i, t in enumerate(texts)])
    assert got == sorted(want) and len(want) > 30


def test_top_cuts_ties_by_phrase(spark):
    docs = odd_docs(spark, invented(200))
    want = plain_collocations([(("en", "de", None)[i % 3], t) for i, t in enumerate(invented(200))], top=3)
    assert collected(phrases.collocations(docs, top=3)) == sorted(want)


def test_collocations_of_no_rows(spark):
    assert phrases.collocations(odd_docs(spark).limit(0)).count() == 0
    assert phrases.collocations(odd_docs(spark, [None, "", "a b"])).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    row = spark.range(1).select(F.lit(big).alias("a"), F.lit(big + 7).alias("l"), F.lit(big + 11).alias("r")).select(
        phrases._score("a", "l", "r").alias("s")).first()
    assert row["s"] == 10**6 * big * big // ((big + 7) * (big + 11))


def test_local_support_keeps_every_frequent_phrase(spark):
    """Ten occurrences dealt evenly over chunks stay below ten in each shard, but not below the shard's share."""
    docs = spark.createDataFrame([(i, "alpha beta " + "filler%d " % i * 30, "en", "s") for i in range(10)], SCHEMA).repartition(10)
    found = phrases.frequent_phrases(docs, chunk_words=20)
    assert found.pairs.where("f = 10").count() >= 1
    assert ("alpha beta", 10) in [(r["phrase"], r["a"]) for r in phrases.collocations(docs, chunk_words=20).collect()]


def test_collocations_of_documents_equal_their_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = con.sql(ORACLE_SQL["op13_phrase_collocations"]).fetchall()
    assert collected(QUERIES["op13_phrase_collocations"](spark, FOLDER)) == sorted(want) and want
