"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets in words are turned into whole blocks for each source by highest quotients, each source's blocks into quotas of
its shards in the same way, and each shard takes its quota from a seeded, evenly spread choice of blocks. Everything a
document needs to know is arithmetic on its word range, so no table of blocks is ever made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from firmnet.llm.common import WORD
from firmnet.operators.rank import distributed_rank
from firmnet.storage import materialize

WEIGHTS = (5, 2, 1)
REPEATS = 3  # a source, and each of its documents, is taken at most so many times
BLOCK_WORDS = 1024  # at most
BLOCKS_PER_SOURCE = 1000  # on average at least, by smaller blocks
SHARD_WORDS = 1_000_000
SHARD_ROWS = 10_000


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def fill_level(sources: DataFrame, size: str, weight: str, repeats: int = REPEATS) -> float:
    """Words for each unit of weight, so that ``least(repeats * size, weight * level)`` sums to all sizes.

    Sources above their limit are fixed at it and the rest reshared, until none is above. One small aggregate a round;
    rounds are bounded by the number of distinct ratios of size to weight, and few in practice.
    """
    limit, want = F.col(size) * repeats, F.col(weight)
    total, weights = sources.where(F.col(size) > 0).agg(F.sum(size), F.sum(weight)).first()
    if not total:
        return 0.0
    level, before = total / weights, 0
    while True:
        over = want * level > limit
        fixed, free, n = sources.where(F.col(size) > 0).agg(
            F.sum(F.when(over, limit).otherwise(0)), F.sum(F.when(over, 0).otherwise(want)), F.count_if(over)).first()
        if n == before or not free:
            return level
        level, before = (total - fixed) / free, n


def sainte_lague(parties: DataFrame, votes: str, seats: str, cap: str, key: str, group: tuple[str, ...] = (),
                 out: str = "quota") -> DataFrame:
    """Add the seats of each row by highest quotients ``votes / (2 k + 1)``; equal quotients in order of ``key``.

    ``seats`` is the number to deal in the row's ``group`` (the whole table without one), ``cap`` the most a row may
    get. A row's seats lie near its exact share: the number of rows bounds how far off, so only quotients in that
    window are ranked, a few for each row however many seats there are. Rows without votes get none.
    """
    per = W.partitionBy(*(group or [F.lit(0)]))
    share = F.try_divide(F.col(votes).cast("double"), F.sum(votes).over(per).cast("double")) * F.col(seats)
    slack = (F.ceil(F.count("*").over(per) * F.col("_share") / F.greatest(F.col(seats), F.lit(1))) + 2).cast("long")
    near = (
        parties.withColumn("_share", F.coalesce(share, F.lit(0.0)))
        .withColumn("_slack", slack)
        .withColumn("_from", F.least(F.greatest(F.floor("_share") - F.col("_slack"), F.lit(0)), F.col(cap)))
        .withColumn("_to", F.least(F.floor("_share") + F.col("_slack") + 1, F.col(cap)))
    )
    near = materialize(near, "shares")
    keys = [*group, key]
    bids = (
        near.where((F.col(votes) > 0) & (F.col("_to") > F.col("_from")))
        .withColumn("_left", F.col(seats) - F.sum("_from").over(per))
        .withColumn("_k", F.explode(F.sequence("_from", F.col("_to") - 1)))
        .select(*keys, "_left", "_k", (F.col(votes) / (2 * F.col("_k") + 1)).alias("_quotient"))
    )
    ranked = distributed_rank(bids, [("_quotient", False), (key, True), ("_k", True)], "_rank", group)
    won = ranked.where(F.col("_rank") <= F.col("_left")).groupBy(*keys).agg(F.count("*").alias("_won"))
    on = [near[k].eqNullSafe(won[k]) for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition &= c
    quota = F.when(F.col(votes) > 0, F.col("_from") + F.coalesce("_won", F.lit(0))).otherwise(0).cast("long")
    return near.join(won, condition, "left").select(*(near[c] for c in parties.columns), quota.alias(out))


def _chosen_before(k: Column) -> Column:
    """Blocks chosen among the first k of the shard, counted from the seeded start: evenly spread ``_rest`` of ``_blocks``."""
    return F.floor((k + F.col("_phase")) * F.col("_rest") / F.col("_blocks"))


_PLACE = ("_start", "_full", "_rest", "_blocks", "_phase", "_block")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """All rows and columns of a stored table with ``_size``, ``_source_size``, ``_target``, ``_taken``, and the word range's
    place (``_start``, ``_full``, ``_rest``, ``_blocks``, ``_phase``, ``_block``).

    Sources in code-point order, NULL last, weigh 5, 2, 1, repeating. Reruns agree: documents of a source are laid out
    by seeded hashes of id and text; rows equal in both are numbered, which spreads them over shards like others, and are
    interchangeable. NULL text has size 0, takes nothing, and stays in the result; NULL ids are
    hashed like any other value; a source whose documents are all empty has target 0. Columns of ``docs`` named like a
    result give way to it here; :func:`mixed_documents` keeps them all.
    """
    results = ("_size", "_source_size", "_target", "_taken", *_PLACE)
    kept = [c for c in docs.columns if c.lower() not in results]
    laid = _laid(docs, doc_id, text, source, seed)
    return laid.select(*(F.col(_own(docs, c)).alias(c) for c in kept), *results)


def _own(docs: DataFrame, column: str) -> str:
    """Name a column of ``docs`` has on its way: by place, so that no name clashes and columns nobody asks for are pruned."""
    return f"_in{docs.columns.index(column)}"


def _laid(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """The rows of ``docs``, columns named by :func:`_own`, with the results of :func:`mix`."""
    placed = docs.select(
        *(F.col(f"`{c}`").alias(_own(docs, c)) for c in docs.columns), F.col(source).alias("_source"),
        n_words(text).alias("_size"), F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.col(text), F.col(source)).alias("_at"),
        F.monotonically_increasing_id().alias("_row_no"))
    sizes = materialize(placed.select("_source", "_size", "_at", "_row_no"), "sizes")  # the texts are read once for this
    several = sizes.groupBy("_at").agg(F.count("*").alias("_n")).where("_n > 1")
    numbered = distributed_rank(sizes.join(several, "_at", "left_semi").select("_at", "_row_no"), [("_row_no", True)], "_copy", ("_at",))
    numbered = materialize(numbered.select("_row_no", "_copy"), "copies")
    deal = F.xxhash64(F.lit(seed), F.col("_at"), F.coalesce("_copy", F.lit(1)))
    placed, sizes = (df.join(numbered, "_row_no", "left").withColumn("_deal", deal) for df in (placed, sizes))
    totals = sizes.groupBy("_source").agg(F.sum("_size").alias("_source_size"), F.count("*").alias("_rows"))
    totals = totals.withColumn("_last", F.col("_source").isNull()).withColumn("_name", F.coalesce("_source", F.lit("")))
    ranked = distributed_rank(totals, [("_last", True), ("_name", True)], "_no")
    weight = F.element_at(F.lit(list(WEIGHTS)), ((F.col("_no") - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("_weight", weight), "sources")
    level = fill_level(ranked, "_source_size", "_weight")
    total, n = ranked.agg(F.coalesce(F.sum("_source_size"), F.lit(0)), F.count("*")).first()
    block = max(1, min(BLOCK_WORDS, total // (BLOCKS_PER_SOURCE * max(n, 1))))
    ranked = ranked.select(
        "_source", "_no", "_source_size",
        F.least((F.col("_source_size") * REPEATS).cast("double"), F.col("_weight") * F.lit(level)).alias("_target"),
        F.greatest(F.ceil(F.col("_source_size") / SHARD_WORDS), F.ceil(F.col("_rows") / SHARD_ROWS), F.lit(1)).alias("_shards"))
    shard = F.pmod(F.xxhash64(F.col("_deal")), F.col("_shards"))
    same = sizes["_source"].eqNullSafe(ranked["_source"])
    shards = (
        sizes.join(ranked, same).withColumn("_shard", shard)
        .groupBy("_no", "_shard").agg(F.sum("_size").alias("_words"), F.first("_target").alias("_target"))
        .withColumn("_blocks", F.ceil(F.col("_words") / block))
    )
    shards = materialize(shards, "shards")
    seats = shards.groupBy("_no").agg(F.sum("_blocks").alias("_all"), F.first("_target").alias("_target"))
    seats = seats.withColumn("_seats", F.lit(round(total / block))).withColumn("_cap", F.col("_all") * REPEATS)
    quotas = sainte_lague(seats, "_target", "_seats", "_cap", "_no", out="_quota").select("_no", "_quota")
    shards = shards.join(quotas, "_no").withColumn("_cap", F.col("_blocks") * REPEATS)
    shards = sainte_lague(shards, "_words", "_quota", "_cap", "_shard", ("_no",), "_share_of")
    blocks = F.greatest(F.col("_blocks"), F.lit(1))
    shards = materialize(shards.select(
        F.col("_no"), F.col("_shard"), blocks.alias("_blocks"), F.floor(F.col("_share_of") / blocks).alias("_full"),
        (F.col("_share_of") % blocks).alias("_rest"),
        F.pmod(F.xxhash64(F.lit(seed), "_no", "_shard"), blocks).alias("_phase")), "quotas")

    ahead = W.partitionBy("_no", "_shard").orderBy("_at", "_size").rowsBetween(W.unboundedPreceding, -1)
    laid = placed.join(ranked, placed["_source"].eqNullSafe(ranked["_source"])).drop("_source").withColumn("_shard", shard)
    laid = laid.join(shards, ["_no", "_shard"]).withColumn("_start", F.coalesce(F.sum("_size").over(ahead), F.lit(0)))
    first, end = F.floor(F.col("_start") / block), F.col("_start") + F.col("_size")
    last = F.floor((end - 1) / block)
    one = lambda k: _chosen_before(k + 1) - _chosen_before(k)
    some = F.when(first == last, one(first) * F.col("_size")).otherwise(
        one(first) * ((first + 1) * block - F.col("_start")) + one(last) * (end - last * block)
        + block * (_chosen_before(last) - _chosen_before(first + 1)))
    taken = F.when(F.col("_size") > 0, F.col("_full") * F.col("_size") + some).otherwise(0).cast("long")
    return laid.select(
        *(_own(docs, c) for c in docs.columns), "_size", "_source_size", "_target",
        taken.alias("_taken"), "_start", "_full", "_rest", "_blocks", "_phase", F.lit(block).alias("_block"))


_WORDS = re.compile(WORD)


def chosen_text(text: str, start: int, rest: int, blocks: int, phase: int, block: int) -> str:
    """The words of a text that lie in chosen blocks: runs as they stand, joined by a line feed."""
    spans = [m.span() for m in _WORDS.finditer(text)]
    out, at = [], 0
    while at < len(spans):
        k = (start + at) // block
        end = min(len(spans), (k + 1) * block - start)
        if (k + phase + 1) * rest // blocks > (k + phase) * rest // blocks:
            if out and out[-1][1] == at:
                out[-1][1] = end
            else:
                out.append([at, end])
        at = end
    return "\n".join(text[spans[a][0]:spans[b - 1][1]] for a, b in out)


def _copies(text: str, n_chars: str | None, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row as often as it is taken whole, then once more with the words of its chosen blocks."""
        for batch in batches:
            at, texts = [], []
            own = (batch.column(c).to_pylist() for c in ("_full", "_start", "_rest", "_blocks", "_phase", "_block"))
            bodies = batch.column(f"_in{columns.index(text)}").to_pylist()
            for i, (body, full, start, rest, blocks, phase, block) in enumerate(zip(bodies, *own)):
                part = chosen_text(body, start, rest, blocks, phase, block) if rest else ""
                copies = [body] * full + ([part] if part else [])
                at += [i] * len(copies)
                texts += copies
            taken = batch.take(pa.array(at, pa.int64()))
            new = {text: pa.array(texts, pa.string()), n_chars: pa.array([len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else taken.column(f"_in{k}") for k, c in enumerate(columns)], names=columns)

    return run


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                    n_chars: str | None = "n_chars", seed: int = 7) -> DataFrame:
    """The mixture itself: each document as often as it is taken, a part taken as the words of its chosen blocks.

    A document taken not at all has no row. Columns are those of ``docs``; ``n_chars`` is set to the length of the text.
    """
    laid = _laid(docs, doc_id, text, source, seed).where(F.col("_taken") > 0).select(
        *(_own(docs, c) for c in docs.columns), *_PLACE)
    form = StructType([StructField(f.name, LongType() if f.name == n_chars else f.dataType) for f in docs.schema])
    return laid.mapInArrow(_copies(text, n_chars if n_chars in docs.columns else None, docs.columns), form)
