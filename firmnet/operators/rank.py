"""Exact global ranks and cuts that never sort everything in one task.

``orderBy().limit(k)`` gathers k rows in one task and a window without partitions gathers all of
them; both fail when k is a share of billions of pairs. The operators here use range partitions,
per-partition counts, and histograms of fixed size instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isfinite
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmnet.storage import materialize

if TYPE_CHECKING:
    from firmnet.operators.similarity import Pairs

BINS = 4096
SCORE_RANGE = (-1.0, 1.0)  # of a cosine; scores outside fall into the outer bins
_POSITION_BITS = 33  # layout of monotonically_increasing_id: partition above, row number below


def _ordering(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.asc_nulls_last(name) if ascending else F.desc_nulls_last(name) for name, ascending in order]


def present(score: str) -> Column:
    """The score, NULL where it is missing (NULL or NaN): missing scores come last in every order."""
    return F.when(~F.isnan(F.col(score).cast("double")), F.col(score))


def distributed_rank(df: DataFrame, order: Sequence[tuple[str, bool]], out: str = "rank",
                     group: Sequence[str] = ()) -> DataFrame:
    """Add the 1-based rank over the whole table, or within each ``group``.

    ``order`` lists (column, ascending) and has to be unique together with ``group``, so that a hot
    score or a hot group still splits over range partitions. The ranged rows are written once: the
    offsets and the ranks must see the same partitions, also after an executor is lost.
    """
    keys = [(g, True) for g in group] + list(order)
    ranged = (
        df.repartitionByRange(*_ordering(keys))
        .sortWithinPartitions(*_ordering(keys))
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", _POSITION_BITS))
        .withColumn("_at", F.col("_at").bitwiseAND((1 << _POSITION_BITS) - 1))
    )
    ranged = materialize(ranged, "ranked")
    # One row per partition and group; the rows of one group number at most the partitions.
    runs = ranged.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = runs.select("_part", *group, "_first",
                          F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    if not group:
        offsets = F.broadcast(offsets)  # as many rows as there are partitions
    joined = ranged.join(offsets, ["_part", *group])
    return joined.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(out))


def running_sum(df: DataFrame, order: Sequence[tuple[str, bool]], value: str, out: str = "before",
                group: Sequence[str] = ()) -> DataFrame:
    """Add the sum of a whole-number ``value`` over all rows ahead in the order, or ahead within each ``group``.

    Like :func:`distributed_rank` the rows are cut into ranges and written once; a range sums its own rows, and takes the sums
    of the ranges ahead from a table of one row for each range and group. ``order`` has to be unique together with ``group``.
    Give narrow rows: keys and the value. NULL values count as 0.
    """
    keys = [(g, True) for g in group] + list(order)
    ranged = df.repartitionByRange(*_ordering(keys)).sortWithinPartitions(*_ordering(keys))
    ranged = materialize(ranged.withColumn("_part", F.spark_partition_id()), "ranged")
    own = W.partitionBy("_part", *group).orderBy(*_ordering(order)).rowsBetween(W.unboundedPreceding, -1)
    ahead = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = ranged.groupBy("_part", *group).agg(F.sum(value).alias("_sum"))
    runs = runs.select(F.col("_part").alias("_of"), *(F.col(g).alias(f"_of_{g}") for g in group),
                       F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    if not group:
        runs = F.broadcast(runs)  # as many rows as there are partitions
    same = F.col("_part") == F.col("_of")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    within = ranged.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    return within.join(runs, same).select(*df.columns, (F.col("_ahead") + F.col("_own")).alias(out))


class ScoreBins:
    """Fixed number of equal-width bins, bin 0 holding the best scores; one bin more, behind all, for missing scores."""

    def __init__(self, lo: float, hi: float, descending: bool = True, bins: int = BINS):
        self.lo, self.hi, self.descending, self.bins = float(lo), float(hi), descending, bins

    def column(self, score: str) -> Column:
        width, missing = self.hi - self.lo, present(score).isNull()
        if not width > 0:
            return F.when(missing, self.bins).otherwise(0)
        gap = (F.lit(self.hi) - F.col(score)) if self.descending else (F.col(score) - F.lit(self.lo))
        place = F.floor(gap * F.lit(self.bins / width)).cast("int")
        return F.when(missing, self.bins).otherwise(F.least(F.greatest(place, F.lit(0)), F.lit(self.bins - 1)))


def score_bins(df: DataFrame, score: str, descending: bool = True, bins: int = BINS) -> ScoreBins:
    """Bins spanning the scores of the table."""
    lo, hi = df.agg(F.min(present(score).cast("double")), F.max(present(score).cast("double"))).first()
    if lo is not None and not (isfinite(lo) and isfinite(hi)):
        raise ValueError(f"{score} must be finite")
    return ScoreBins(lo or 0.0, hi or 0.0, descending, bins)


def boundary(counts: dict[int, int], k: int) -> tuple[int, int]:
    """Bin holding the k-th best row and the number of rows in better bins."""
    seen = 0
    for b in sorted(counts):
        if seen + counts[b] >= k:
            return b, seen
        seen += counts[b]
    raise ValueError("fewer rows than k")


def top_rows(df: DataFrame, k: int, score: str, ties: Sequence[str], descending: bool = True,
             bounds: tuple[float, float] | None = None, bins: int = BINS) -> DataFrame:
    """The k best rows by score, equal scores in ascending order of ``ties``; exact for any k.

    One histogram pass finds the bin the cut falls into. Better bins pass by a plain filter; only
    the boundary bin is ranked, by range partitions, so even one score shared by a third of all rows
    spreads out. ``df`` is read several times: give it as a stored table. NULL and NaN scores come
    last, in order of ``ties``; others must be finite. Known ``bounds`` of the scores save a pass.
    """
    if k <= 0:
        return df.limit(0)
    spans = ScoreBins(*bounds, descending, bins) if bounds else score_bins(df, score, descending, bins)
    binned = df.withColumn("_bin", spans.column(score))
    counts = {r["_bin"]: r["count"] for r in binned.groupBy("_bin").count().collect()}  # at most ``bins`` rows
    if sum(counts.values()) <= k:
        return df
    cut, better = boundary(counts, k)
    if better + counts[cut] == k:
        return binned.where(F.col("_bin") <= cut).drop("_bin")
    kept = binned.where(F.col("_bin") < cut).drop("_bin")
    edge = binned.where(F.col("_bin") == cut).drop("_bin")
    order = [("_present", not descending), *((t, True) for t in ties)]
    ranked = distributed_rank(edge.withColumn("_present", present(score)), order, "_rank")
    ranked = ranked.where(F.col("_rank") <= k - better).drop("_rank", "_present")
    return kept.unionByName(ranked)


def fraction_count(n: int, fraction: float) -> int:
    """``int(n * (n - 1) * fraction)`` in double arithmetic."""
    return int((n * (n - 1)) * fraction)


def top_fraction(peers: DataFrame, firms: int, fraction: float = 0.02, score: str = "wtnic_score",
                 focal: str = "focal_firmid", rival: str = "rival_firmid") -> DataFrame:
    """Best ``fraction`` of all directed pairs of ``firms`` firms, whatever number of them is in ``peers``."""
    return top_rows(peers, fraction_count(firms, fraction), score, [focal, rival], bounds=SCORE_RANGE)


def sorted_peers(peers: DataFrame | Pairs) -> DataFrame:
    """All edges, best score first. A global sort in Spark is a range exchange plus local sorts.

    Give ``similarity.Pairs`` where the edges are not stored: they are packed by range where they are multiplied.
    """
    if not isinstance(peers, DataFrame):
        return peers.sorted()
    return peers.orderBy(F.desc("wtnic_score"), "focal_firmid", "rival_firmid")


def hash_sample(df: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    """``n`` distinct keys without replacement, or all when there are fewer; repeatable per seed.

    Keys are ordered by the MD5 of key and seed; the cut is found with :func:`top_rows` on the
    leading 52 bits, equal ones by the rest, so no task holds the whole sample.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))
    keyed = (
        df.select(key).where(F.col(key).isNotNull()).distinct()
        .withColumn("_digest", digest)
        .withColumn("_draw", F.conv(F.substring("_digest", 1, 13), 16, 10).cast("bigint"))
    )
    keyed = materialize(keyed, "sample")
    return top_rows(keyed, n, "_draw", ["_digest", key], False, (0.0, float(1 << 52))).select(key)


def next_id(dimension: DataFrame, id_col: str = "firm_id") -> int:
    """The first id behind the largest one; 1 for an empty dimension."""
    return dimension.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0] + 1


def assign_ids(dimension: DataFrame, new_keys: DataFrame, key: str, order: str, id_col: str = "firm_id") -> DataFrame:
    """(key, order, id) for keys not yet in the dimension: consecutive ids after the largest one.

    ``new_keys`` may repeat a key; its lowest ``order`` counts, and ids follow that order.
    """
    fresh = new_keys.groupBy(key).agg(F.min(order).alias(order)).join(dimension.select(key), key, "left_anti")
    start = next_id(dimension, id_col)
    ranked = distributed_rank(fresh, [(order, True), (key, True)], "_rank")
    return ranked.select(key, order, (F.col("_rank") - 1 + F.lit(start).cast("bigint")).alias(id_col))
