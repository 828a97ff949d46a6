"""Phrase collocations by SON partitioning: mine shards at a lowered support, unite, count the union exactly.

Texts are cut into chunks that fit a task's memory; a chunk stores its words as numbers of its own vocabulary. Chunks are
dealt to ``SHARDS`` shards. A shard is mined completely, length by length: a phrase whose shorter parts are rare cannot be
frequent, so a chunk counts only phrases made of frequent ones, which it is sent back by number. A phrase that is frequent
anywhere reaches, in one shard at least, the share of the support that the shard has of the words; such phrases are the
candidates. Their exact counts are the sums over all shards. The counts of a phrase meet in one partition, one row a chunk,
so both steps take a single shuffle of rows that are summed by chunk already.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmnet.llm.common import partitions, whole
from firmnet.operators.rank import distributed_rank
from firmnet.storage import materialize

SUPPORT = 10
SHARDS = 4  # a phrase of ``SUPPORT`` occurrences has to reach about a quarter of them in one shard
COVERED = (50, 100)  # a phrase goes when a longer candidate around it has at least this share of its occurrences
TOP = 2000
CHUNK_WORDS = 4_000_000  # words of a chunk; a single piece of text is not cut
ROWS_PER_TASK = 4_000_000
_PLACE_BITS = 27  # place of a word: chunk above, number in the chunk's vocabulary below
_CHUNK_BITS = 13  # chunk: partition above, number in the partition below

_PIECE_END = re.compile(rb"[.,;:!?\x0A-\x0D]+")
_CHUNK = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.list_(pa.string())),
                    ("counts", pa.list_(pa.int64())), ("size", pa.int64()), ("distinct", pa.int64()), ("ids", pa.binary())])
CHUNK = "chunk long, lang string, n long, words array<string>, counts array<long>, size long, distinct long, ids binary"


def pieces(text: str) -> list[list[bytes]]:
    """Words of each piece of a text: A-Z in lower case, pieces ended by ``. , ; : ! ?`` and line ends, words by blanks."""
    return [words for p in _PIECE_END.split(text.encode().lower()) if (words := p.split())]


class _Numbers(dict):
    """Words numbered in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _chunk_row(chunk: int, lang: str, numbers: _Numbers, ids: list[int]) -> tuple:
    """A chunk: its words by falling counts, and its text as places in that order, packed (see :func:`_opened`)."""
    at = np.array(ids, np.int32)
    if len(numbers) >> _PLACE_BITS:
        raise ValueError(f"a chunk holds {len(numbers)} distinct words")
    counts = np.bincount(at[at >= 0], minlength=len(numbers))
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order) + 1, "<u4")
    place[order], place[-1] = np.arange(1, len(order) + 1), 0  # -1, the end of a piece, becomes 0
    # Bytes of equal weight lie together: frequent words have small numbers, so most of them are alike.
    packed = pa.compress(place[at].view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)
    words = [w.decode() for w in numbers]
    return chunk, lang, int(counts.sum()), [words[k] for k in order], counts[order], len(at), len(numbers), packed


def _chunks(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, tuple[_Numbers, list[int]]] = {}
        part, made, held = 0, 0, 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal made, held
            for lang, (numbers, ids) in open_.items():
                if made >> _CHUNK_BITS:
                    raise ValueError(f"partition {part} has more than {made} chunks: use more partitions")
                row = _chunk_row(part << _CHUNK_BITS | made, lang, numbers, ids)
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, _CHUNK)], schema=_CHUNK)
                made += 1
            open_.clear()
            held = 0

        for batch in batches:
            for part, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                for words in pieces(text):
                    if lang not in open_:
                        open_[lang] = _Numbers(), []
                    numbers, ids = open_[lang]
                    ids.extend(map(numbers.__getitem__, words))
                    ids.append(-1)
                    held += len(words) + 1
                    if held >= most:
                        yield from close()
        yield from close()

    return run


def _opened(chunk: pa.Table) -> tuple[int, np.ndarray, int]:
    """Tag, word numbers (-1 ends a piece) and size of the vocabulary of a table of one chunk."""
    row = chunk.to_pylist()[0]
    planes = np.frombuffer(pa.decompress(row["ids"], decompressed_size=4 * row["size"], codec="zstd", asbytes=True), np.uint8)
    ids = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64) - 1
    return row["tag"], ids, row["distinct"]


_PAIRS = pa.schema([("tag", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
_TRIPLES = pa.schema([("tag", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("n", pa.int64())])


def _known(rows: pa.Table, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of each frequent word by its place in the chunk's vocabulary, -1 for others; and codes of frequent pairs, sorted.

    A pair's code holds the places of its two words.
    """
    kind, x, y = (rows.column(c).to_numpy() for c in ("kind", "x", "y"))
    number, place = np.full(words, -1, np.int64), np.flatnonzero(kind == 1)
    number[x[place]] = y[place]
    order = place[np.argsort(y[place])]
    at = lambda of: x[order][np.searchsorted(y[order], of[kind == 2])]
    return number, np.sort(at(x) << 32 | at(y)) if (kind == 2).any() else np.zeros(0, np.int64)


def _count_pairs(chunk: pa.Table, sent: pa.Table) -> pa.Table:
    """A chunk's pairs of frequent words."""
    if not chunk.num_rows or not sent.num_rows:
        return _PAIRS.empty_table()
    tag, ids, distinct = _opened(chunk)
    number, _ = _known(sent, distinct)
    ok = (ids >= 0) & (number[ids] >= 0)
    both = ok[:-1] & ok[1:]
    code, n = np.unique(ids[:-1][both] << 32 | ids[1:][both], return_counts=True)
    return pa.table([np.full(len(code), tag), number[code >> 32], number[code & 0xFFFFFFFF], n], schema=_PAIRS)


def _count_triples(chunk: pa.Table, sent: pa.Table) -> pa.Table:
    """A chunk's triples whose first and last two words are frequent pairs."""
    if not chunk.num_rows or not sent.num_rows:
        return _TRIPLES.empty_table()
    tag, ids, distinct = _opened(chunk)
    number, pairs = _known(sent, distinct)
    if not len(pairs) or len(ids) < 3:
        return _TRIPLES.empty_table()
    inside = (ids[:-1] >= 0) & (ids[1:] >= 0)
    code = np.where(inside, ids[:-1] << 32 | ids[1:], -1)
    at = np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)
    ok = pairs[at] == code
    both = ok[:-1] & ok[1:]
    key, n = np.unique(at[:-1][both] << 32 | ids[2:][both], return_counts=True)
    first = pairs[key >> 32]
    return pa.table([np.full(len(key), tag), number[first >> 32], number[first & 0xFFFFFFFF], number[key & 0xFFFFFFFF], n], schema=_TRIPLES)


def _frequent(counted: DataFrame, keys: list[str], support: int, parts: int) -> DataFrame:
    """Rows of ``counted`` (keys, tag, n) whose phrase is frequent, with its exact count ``f``.

    The phrase must reach the local support in one shard at least, which every frequent phrase does; its count is the sum
    over all shards. One shuffle by ``keys`` serves the sums by shard and the sums over shards. The tag of a row holds its
    chunk, shard and local support in one number, which keeps the shuffled rows short.
    """
    by_shard, over_all = W.partitionBy(*keys, "shard"), W.partitionBy(*keys)
    rows = counted.repartition(parts, *keys).withColumn("shard", _untag("shard")).withColumn("local", F.sum("n").over(by_shard))
    rows = rows.withColumn("candidate", F.max(F.col("local") >= _untag("need")).over(over_all)).withColumn("f", F.sum("n").over(over_all))
    return rows.where(F.col("candidate") & (F.col("f") >= support)).withColumn("chunk", _untag("chunk")).drop(
        "local", "candidate", "shard", "tag")


_NEED_BITS, _SHARD_BITS = 12, 8


def _tag() -> Column:
    return F.shiftleft("chunk", _NEED_BITS + _SHARD_BITS).bitwiseOR(F.shiftleft("shard", _NEED_BITS)).bitwiseOR(F.col("need"))


def _untag(part: str) -> Column:
    need, shard = (1 << _NEED_BITS) - 1, (1 << _SHARD_BITS) - 1
    return {"chunk": F.shiftright("tag", _NEED_BITS + _SHARD_BITS), "need": F.col("tag").bitwiseAND(need),
            "shard": F.shiftright("tag", _NEED_BITS).bitwiseAND(shard)}[part]


@dataclass(frozen=True)
class Phrases:
    """Frequent words (lang, word, a, f), pairs (a, b, f) and triples (a, b, c, f), and the words of each language (lang, n).

    ``a``, ``b`` and ``c`` are the numbers of words in the first table; a number belongs to one language.
    """

    words: DataFrame
    pairs: DataFrame
    triples: DataFrame
    totals: DataFrame


def frequent_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", support: int = SUPPORT, shards: int = SHARDS,
                     chunk_words: int = CHUNK_WORDS) -> Phrases:
    """Words, pairs and triples with at least ``support`` occurrences in their language, counted exactly.

    NULL texts have no words, NULL languages count as ``und``; repeated rows count each time; an empty table gives empty ones.
    """
    if not 0 < shards <= 1 << _SHARD_BITS or not 0 < support < 1 << _NEED_BITS:
        raise ValueError(f"{shards} shards or a support of {support} are out of range")
    spark = docs.sparkSession
    rows = docs.select(F.spark_partition_id().cast("long").alias("part"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                       whole(text).alias("text"))
    chunks = materialize(rows.mapInArrow(_chunks(chunk_words), CHUNK), "chunks")
    sized = chunks.select("chunk", "lang", "n", F.pmod(F.xxhash64("chunk"), F.lit(shards)).alias("shard"))
    totals = materialize(sized.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    parts = partitions(spark, totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], ROWS_PER_TASK)
    share = sized.groupBy("lang", "shard").agg(F.sum("n").alias("own")).join(totals, "lang")
    need = F.ceil(F.lit(support) * F.col("own").cast("decimal(20,0)") / F.col("n")).cast("long")
    tags = sized.select("chunk", "lang", "shard").join(share.select("lang", "shard", need.alias("need")), ["lang", "shard"])
    tags = materialize(tags.where("need > 0").select("chunk", _tag().alias("tag")), "tags")  # chunks without words have none

    word = chunks.join(tags, "chunk").select("tag", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    word = word.select("tag", "lang", F.col("w.words").alias("word"), F.col("at").cast("long").alias("at"), F.col("w.counts").alias("n"))
    words = _frequent(word, ["lang", "word"], support, parts)
    place = F.shiftleft("chunk", _PLACE_BITS).bitwiseOR(F.col("at"))
    words = materialize(words.withColumn("a", F.min(place).over(W.partitionBy("lang", "word"))).drop("n"), "frequent-words")

    known = words.select("chunk", F.lit(1).alias("kind"), F.col("at").alias("x"), F.col("a").alias("y"))
    body = chunks.select("chunk", "size", "distinct", "ids").join(tags, "chunk").groupBy("chunk")
    counted = body.cogroup(known.groupBy("chunk")).applyInArrow(_count_pairs, "tag long, a long, b long, n long")
    pairs = materialize(_frequent(counted, ["a", "b"], support, parts).drop("n"), "frequent-pairs")

    known = known.unionByName(pairs.select("chunk", F.lit(2).alias("kind"), F.col("a").alias("x"), F.col("b").alias("y")))
    counted = body.cogroup(known.groupBy("chunk")).applyInArrow(_count_triples, "tag long, a long, b long, c long, n long")
    triples = _frequent(counted, ["a", "b", "c"], support, parts)
    return Phrases(*(materialize(df.distinct(), name) for df, name in (
        (words.select("lang", "word", "a", "f"), "words"), (pairs.select("a", "b", "f"), "pairs"),
        (triples.select("a", "b", "c", "f"), "triples"))), totals)


def _score(a: str, l: str, r: str) -> Column:
    """floor(10^6 a^2 / (l r)) in whole decimals of 38 digits; at most 10^6, as l and r are at least a."""
    whole_ = lambda c: f"CAST({c} AS DECIMAL(15, 0))"
    return F.expr(f"CAST({whole_(a)} * {whole_(a)} * CAST(1000000 AS DECIMAL(7, 0)) AS DECIMAL(38, 0)) div ({whole_(l)} * {whole_(r)})")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", support: int = SUPPORT, top: int = TOP,
                 **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best ``top`` phrases of two or three words.

    A phrase scores the floor of 10^6 a^2 / (l r) at its weakest cut (the first of equal ones), where a, l and r count the
    phrase and the two sides. A phrase inside a longer frequent one with at least half of its occurrences is left out. Order:
    score and count descending, then phrase by UTF-8 bytes. Counts must stay below 10^15. Rows are ranked by ranges of the
    whole order, so no language is gathered in one task.
    """
    found = frequent_phrases(docs, lang, text, support, **options)
    word = lambda at, f, w: found.words.select(F.col("a").alias(at), F.col("f").alias(f), F.col("word").alias(w))
    pair = lambda x, y, f: found.pairs.select(F.col("a").alias(x), F.col("b").alias(y), F.col("f").alias(f))
    t = found.triples.select("a", "b", "c", F.col("f").alias("n_abc"))
    covers = [t.select(F.col(x).alias("a"), F.col(y).alias("b"), "n_abc") for x, y in (("a", "b"), ("b", "c"))]
    cover = covers[0].unionByName(covers[1]).groupBy("a", "b").agg(F.max("n_abc").alias("cover"))
    two = pair("a", "b", "n_ab").join(cover, ["a", "b"], "left")
    two = two.where(F.coalesce(F.col("cover") * COVERED[1] < F.col("n_ab") * COVERED[0], F.lit(True)))
    first = found.words.select("lang", "a", F.col("f").alias("n_a"), F.col("word").alias("w_a"))
    two = two.join(first, "a").join(word("b", "n_b", "w_b"), "b").select(
        "lang", F.concat_ws(" ", "w_a", "w_b").alias("phrase"), F.col("n_ab").alias("a"), F.col("n_a").alias("l"), F.col("n_b").alias("r"),
        _score("n_ab", "n_a", "n_b").alias("score"))
    three = t.join(pair("a", "b", "n_ab"), ["a", "b"]).join(pair("b", "c", "n_bc"), ["b", "c"])
    three = three.join(first, "a").join(word("b", "n_b", "w_b"), "b").join(word("c", "n_c", "w_c"), "c")
    one, other = _score("n_abc", "n_a", "n_bc"), _score("n_abc", "n_ab", "n_c")
    three = three.withColumn("late", other < one).select(
        "lang", F.concat_ws(" ", "w_a", "w_b", "w_c").alias("phrase"), F.col("n_abc").alias("a"),
        F.when(F.col("late"), F.col("n_ab")).otherwise(F.col("n_a")).alias("l"),
        F.when(F.col("late"), F.col("n_c")).otherwise(F.col("n_bc")).alias("r"), F.least(one, other).alias("score"))
    best = two.unionByName(three)
    ranked = distributed_rank(best, [("score", False), ("a", False), ("phrase", True)], "rank", ["lang"])
    return ranked.where(F.col("rank") <= top).join(found.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
