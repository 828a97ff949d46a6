"""SimHash near-duplicates, found with an index of fingerprints in Gray order.

Fingerprints within ``distance`` bits agree on one of ``distance + 1`` segments of their 64 bits. For each segment the
distinct fingerprints are rotated so that it leads, and sorted by Gray rank, which keeps those that share leading bits
together and neighbours close. Within such a run a hierarchy of nodes holds what the fingerprints below have in common
(a mask and the masked bits). Two nodes whose common bits already differ in more than ``distance`` places are pruned
with everything below them; differences grow on the way down, until single fingerprints are compared. Runs too long for
one task are cut in Gray order, and only pairs of cuts that the same test leaves go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from firmnet.llm.components import contract
from firmnet.storage import materialize

SHINGLE = 3
DISTANCE = 3
SEED = 42
RUN = 4096  # fingerprints that a task compares at once
CUTS = 1024  # at most so many cuts of a long run
LEAF, FAN = 32, 16
SLAB = 1 << 11  # pairs of leaves compared at once


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included; a bit is set if more than half of them have it.

    Fewer words than a shingle count as one shingle of all; without words the fingerprint is 0. Letters A to Z are
    lower-cased, words end at ASCII white space.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    n = max(1, len(words) - shingle + 1)
    ends = ends[-n:].tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends)], ">u8")
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        part = hashes[lo:lo + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint_column(text: str, shingle: int = SHINGLE) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return F.pandas_udf(run, "long")(F.col(text))


def _rotated(fp: str, bits: int) -> Column:
    return F.col(fp) if not bits else F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits))


def gray_rank(value: str) -> Column:
    """Place of a word in the Gray sequence, with the top bit turned so that signed order is the order of places."""
    rank = F.col(value)
    for step in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, step))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def nodes(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(mask, bits) that consecutive groups of ``size`` values have in common."""
    at = np.arange(0, len(values), size)
    both, any_ = np.bitwise_and.reduceat(values, at), np.bitwise_or.reduceat(values, at)
    return ~(both ^ any_), both


def _upper(mask: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(0, len(mask), FAN)
    agreed = np.bitwise_and.reduceat(mask, at)
    both, any_ = np.bitwise_and.reduceat(bits & mask, at), np.bitwise_or.reduceat(bits & mask, at)
    agreed &= ~(both ^ any_)
    return agreed, both & agreed


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining i and j; a label is the least number of its set."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def linked(values: np.ndarray, distance: int) -> np.ndarray:
    """For values in Gray order, the number of the first one that each is linked to, directly or through others."""
    n = len(values)
    label = np.arange(n)
    levels = [nodes(values, LEAF)]
    while len(levels[-1][0]) > FAN:
        levels.append(_upper(*levels[-1]))
    top = len(levels[-1][0])
    left, right = np.triu_indices(top)
    for depth in range(len(levels) - 1, -1, -1):
        mask, bits = levels[depth]
        near = np.bitwise_count((bits[left] ^ bits[right]) & mask[left] & mask[right]) <= distance
        left, right = left[near], right[near]
        if depth:
            below = len(levels[depth - 1][0])
            child = np.arange(FAN)
            l2 = np.repeat(left[:, None] * FAN + child, FAN, 1).ravel()
            r2 = np.tile(right[:, None] * FAN + child, FAN).ravel()
            ok = (l2 <= r2) & (r2 < below)
            left, right = l2[ok], r2[ok]
    padded = np.concatenate([values, np.zeros(-n % LEAF, values.dtype)]).reshape(-1, LEAF)
    order = np.argsort(right - left, kind="stable")
    left, right = left[order], right[order]
    for lo in range(0, len(left), SLAB):
        a, b = left[lo:lo + SLAB], right[lo:lo + SLAB]
        # Leaves that are one set already have nothing to add.
        low, high = np.minimum.reduceat(label, np.arange(0, n, LEAF)), np.maximum.reduceat(label, np.arange(0, n, LEAF))
        open_ = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
        a, b = a[open_], b[open_]
        k, x, y = np.nonzero(np.bitwise_count(padded[a][:, :, None] ^ padded[b][:, None, :]) <= distance)
        i, j = a[k] * LEAF + x, b[k] * LEAF + y
        ok = (i < n) & (j < n) & (i != j)
        label = _merge(label, i[ok], j[ok])
    return label


def _link_runs(distance: int):
    def edges(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of whole runs; equal keys stand together."""
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        left, right = [], []
        small = np.repeat(sizes <= LEAF, sizes)
        ends = np.repeat(starts + sizes, sizes)
        for lag in range(1, LEAF):  # short runs, all at once
            i = np.flatnonzero(small & (np.arange(len(keys)) + lag < ends))
            if not len(i):
                break
            i = i[np.bitwise_count(values[i] ^ values[i + lag]) <= distance]
            left.append(values[i])
            right.append(values[i + lag])
        for s, m in zip(starts[sizes > LEAF], sizes[sizes > LEAF]):
            run = values[s:s + m]
            label = linked(run, distance)
            moved = np.flatnonzero(label != np.arange(m))
            left.append(run[moved])
            right.append(run[label[moved]])
        return np.concatenate(left or [values[:0]]), np.concatenate(right or [values[:0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by run and Gray rank; the last run of a batch waits for the next batch."""
        kept_k, kept_v = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            k = np.stack([batch.column(c).to_numpy() for c in range(4)], 1)
            kept_k = np.concatenate([kept_k, k])
            kept_v = np.concatenate([kept_v, batch.column(4).to_numpy().view(np.uint64)])
            if not len(kept_k):
                continue
            last = (kept_k == kept_k[-1]).all(1)
            whole = 0 if last.all() else len(last) - int(last[::-1].argmin())
            if whole:
                a, b = edges(kept_k[:whole], kept_v[:whole])
                kept_k, kept_v = kept_k[whole:], kept_v[whole:]
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
        if len(kept_k):
            a, b = edges(kept_k, kept_v)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def links(fingerprints: DataFrame, distance: int = DISTANCE, run: int = RUN) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (distinct, column ``fp``) within ``distance`` bits.

    Of the links inside a run those of a spanning forest are given, so large sets of near copies make few rows. Each
    fingerprint is sent once for every segment; those of long runs once for every surviving pair of cuts.
    """
    segments = distance + 1
    width = 64 // segments
    turned = fingerprints.select("fp", F.posexplode(F.array(*(_rotated("fp", i * width) for i in range(segments)))).alias("seg", "turned"))
    turned = turned.select("seg", "turned", F.shiftrightunsigned("turned", 64 - width).alias("lead"), gray_rank("turned").alias("rank"))
    long = turned.groupBy("seg", "lead").agg(F.count("*").alias("n")).where(F.col("n") > run).select("seg", "lead", "n")
    long = materialize(long, "long-runs")
    none = F.lit(-1).cast("long")
    plain = turned.join(long.drop("n"), ["seg", "lead"], "left_anti").select("seg", "lead", none.alias("c1"), none.alias("c2"), "turned", "rank")
    if not long.isEmpty():
        hot = materialize(turned.join(long, ["seg", "lead"]), "hot")
        # Cuts at approximate quantiles; where they lie decides the work of a task, not what is found.
        cuts = hot.groupBy("seg", "lead").agg(
            F.percentile_approx("rank", [i / CUTS for i in range(1, CUTS)], 100_000).alias("q"), F.max("n").alias("n"))
        step = F.greatest(F.lit(1), F.floor(F.lit(CUTS) * run / F.col("n")).cast("int"))
        cuts = cuts.select("seg", "lead", F.filter("q", lambda x, i: (i + 1) % step == 0).alias("q"))
        hot = hot.join(cuts, ["seg", "lead"]).withColumn(
            "c", F.size(F.filter("q", lambda x: x < F.col("rank"))).cast("long")).select("seg", "lead", "c", "turned", "rank")
        node = hot.groupBy("seg", "lead", "c").agg(F.bit_and("turned").alias("all"), F.bit_or("turned").alias("any"))
        node = materialize(node.select("seg", "lead", "c", F.bitwise_not(F.col("all").bitwiseXOR(F.col("any"))).alias("mask"), F.col("all").alias("bits")), "nodes")
        other = node.select("seg", "lead", F.col("c").alias("c2"), F.col("mask").alias("m2"), F.col("bits").alias("b2"))
        differ = F.bit_count(F.col("bits").bitwiseXOR(F.col("b2")).bitwiseAND(F.col("mask")).bitwiseAND(F.col("m2")))
        tiles = node.withColumnRenamed("c", "c1").join(other, ["seg", "lead"]).where((F.col("c1") <= F.col("c2")) & (differ <= distance))
        tiles = materialize(tiles.select("seg", "lead", "c1", "c2"), "tiles")
        one = hot.join(tiles.withColumn("c", F.col("c1")), ["seg", "lead", "c"])
        two = hot.join(tiles.where("c1 != c2").withColumn("c", F.col("c2")), ["seg", "lead", "c"])
        columns = ["seg", "lead", "c1", "c2", "turned", "rank"]
        plain = plain.unionByName(one.select(columns)).unionByName(two.select(columns))
    keyed = plain.withColumn("seg", F.col("seg").cast("long")).repartition("seg", "lead", "c1", "c2").sortWithinPartitions("seg", "lead", "c1", "c2", "rank")
    found = keyed.select("seg", "lead", "c1", "c2", "turned").mapInArrow(_link_runs_unturned(distance, width), "a long, b long")
    return found


def _link_runs_unturned(distance: int, width: int):
    inner = _link_runs(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs' edges on turned fingerprints; the segment each came from turns them back."""
        for seg, group in _by_segment(batches):
            back = np.uint64((64 - seg * width) % 64)
            for out in inner(iter(group)):
                sides = [out.column(c).to_numpy().view(np.uint64) for c in range(2)]
                if back:
                    sides = [x << back | x >> (np.uint64(64) - back) for x in sides]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in sides], names=["a", "b"])

    return run


def _by_segment(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Consecutive batches of one segment; rows come sorted by it."""
    source, waiting = iter(batches), []

    def pull() -> bool:
        while not waiting:
            batch = next(source, None)
            if batch is None:
                return False
            seg = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(seg[1:] != seg[:-1]) + 1).tolist(), len(seg)]
            waiting.extend((int(seg[a]), batch.slice(a, b - a)) for a, b in zip(cuts, cuts[1:]) if b > a)
        return True

    def group(seg: int) -> Iterator[pa.RecordBatch]:
        while pull() and waiting[0][0] == seg:
            yield waiting.pop(0)[1]

    while pull():
        seg = waiting[0][0]
        yield seg, group(seg)


def hex_form(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest id among the documents reachable over linked fingerprints.

    Equal fingerprints are linked, so they are joined first and only distinct ones compared. NULL text has no words and
    fingerprint 0, like an empty one. Rows with a NULL id belong to a component but do not name it; a component of such
    rows alone has a NULL id. Repeated rows stay repeated.
    """
    keys = materialize(docs.select(F.col(doc_id).cast("long").alias("doc_id"), fingerprint_column(text, shingle).alias("fp")), "fingerprints")
    least = materialize(keys.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = materialize(contract(links(least.select("fp"), distance)), "roots")
    named = least.join(roots, least["fp"] == roots["id"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(named.join(names, "root").select("fp", "component_id"), "components")
    return keys.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Rows of ``docs`` without near copies: the one with the smallest id of each component, or all columns' first by
    hash where ids repeat; rows without id stay only where no row of their component has one."""
    columns = docs.columns
    packed = docs.select(F.struct(*(F.col(c) for c in columns)).alias("_row"), F.col(doc_id).cast("long").alias("_doc"),
                         F.xxhash64(*(F.col(c) for c in columns)).alias("_hash"))
    keys = materialize(docs.select(F.col(doc_id).cast("long").alias("doc_id"), fingerprint_column(text, shingle).alias("fp"),
                                   F.xxhash64(*(F.col(c) for c in columns)).alias("hash")), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("hash").alias("h"))
    least = materialize(keys.groupBy("fp").agg(F.min(order).alias("o"), F.count("*").alias("rows")), "distinct")
    roots = materialize(contract(links(least.select("fp"), distance)), "roots")
    named = least.join(roots, least["fp"] == roots["id"], "left").select("o", "fp", F.coalesce("root", "fp").alias("root"))
    kept = named.groupBy("root").agg(F.min(F.struct("o", "fp")).alias("k")).select(
        F.col("k.o.d").alias("_kdoc"), F.col("k.o.h").alias("_khash")).distinct()
    kept = materialize(kept, "kept")
    found = packed.join(kept, (F.col("_hash") == F.col("_khash")) & F.col("_doc").eqNullSafe(F.col("_kdoc")))
    return found.dropDuplicates(["_hash"]).select(*(F.col("_row").getField(c).alias(c) for c in columns))
