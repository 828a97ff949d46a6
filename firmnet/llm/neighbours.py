"""Approximate nearest neighbours with a forest of random-projection trees.

The trees are fitted on a bounded sample, deeper for larger tables; every row is routed to its leaf in each tree. A query
walks all trees through one priority queue, least margin first. It does so twice: first until the leaves it has opened hold
enough rows to tell how far its k-th neighbour is at most, then until the margin of the next leaf is so large that nearer rows
behind it are unlikely. Rows travel to the cells of their leaves, queries to the cells of the leaves they opened; within a
cell only the members of opened leaves are compared, by the exact cosine.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmnet.storage import materialize

TREES = 4
SAMPLE = 8192  # rows the trees are fitted on, at most
LEAF = 64  # rows in a leaf, as long as the sample allows for so many leaves
SAMPLE_LEAF = 4  # rows of the sample in a leaf, at least
FIRST_ROWS = 8 * LEAF  # rows in the leaves that a query opens first, at least
REACH = 1.0  # a leaf is opened up to this margin, in units of the k-th distance over the root of the dimensions
CELL = 4096  # rows that a task compares at a time
CELL_LEAVES = 32  # leaves of a cell, one bit each
STRIP = 256  # queries compared at a time


@dataclass
class Tree:
    """Complete binary tree: hyperplanes by level, breadth first."""

    planes: list[np.ndarray]
    cuts: list[np.ndarray]

    @property
    def depth(self) -> int:
        return len(self.planes)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for w, t in zip(self.planes, self.cuts):
            at = at * 2 + ((x * w[at]).sum(1) > t[at])
        return at


def grow(x: np.ndarray, seed: int, depth: int) -> Tree:
    """Split at the median along the difference of two random rows, ``depth`` times."""
    draw = np.random.default_rng(seed)
    planes, cuts, at = [], [], np.zeros(len(x), np.int64)
    for level in range(depth):
        n = 1 << level
        w, t = np.zeros((n, x.shape[1])), np.zeros(n)
        for k in range(n):
            own = np.flatnonzero(at == k)
            if len(own):
                a, b = draw.choice(own, 2) if len(own) > 1 else (own[0], own[0])
                w[k] = x[a] - x[b]
            if not w[k].any():  # equal rows, or none: any direction
                w[k] = draw.standard_normal(x.shape[1])
            w[k] /= np.linalg.norm(w[k])
            t[k] = np.median((x[own] * w[k]).sum(1)) if len(own) else 0.0
        planes.append(w)
        cuts.append(t)
        at = at * 2 + ((x * w[at]).sum(1) > t[at])
    return Tree(planes, cuts)


def depth_for(rows: int, sample: int) -> int:
    """Levels that leave about ``LEAF`` rows in a leaf, but not fewer than ``SAMPLE_LEAF`` of the sample."""
    depth = 0
    while rows > LEAF << depth and sample >= SAMPLE_LEAF << depth + 1:
        depth += 1
    return depth


def search(x: np.ndarray, trees: list[Tree], sizes: list[np.ndarray], rows: float = float("inf"),
           margin: float = float("inf")) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of one queue over all trees, until the leaves hold ``rows`` rows or the next one's margin is
    above ``margin``. The margin of a node is the largest distance to a hyperplane that has to be crossed to get there."""
    sides = [[(w @ x - t).tolist() for w, t in zip(tree.planes, tree.cuts)] for tree in trees]
    heap = [(-np.inf, k, 0, 0) for k in range(len(trees))]
    found, seen = [], 0
    while heap and seen < rows:
        least, k, level, at = heapq.heappop(heap)
        if least > margin:
            break
        own = sides[k]
        while level < len(own):
            side = own[level][at]
            near = at * 2 + (side > 0)
            heapq.heappush(heap, (max(least, abs(side)), k, level + 1, near ^ 1))
            level, at = level + 1, near
        if sizes[k][at]:
            found.append((k, at))
            seen += int(sizes[k][at])
    return found


def _valid(vector: str):
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return x, F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _rows_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; large or tiny components are scaled away first, so that squares stay in range."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Layout:
    """Cells of the index: runs of leaves of a tree with about ``CELL`` rows; a run with more is dealt to several cells."""

    def __init__(self, trees: list[Tree], sizes: list[np.ndarray], cell: int = CELL):
        self.run_of, self.bit_of, runs = [], [], []
        for own in sizes:
            run = np.zeros(len(own), np.int64)
            held, leaves = 0, 0
            for leaf, n in enumerate(own):
                if leaf and (held + n > cell or leaves == CELL_LEAVES):
                    runs.append(held)
                    held, leaves = 0, 0
                run[leaf] = len(runs)
                held, leaves = held + int(n), leaves + 1
            runs.append(held)
            first = np.concatenate([[True], run[1:] != run[:-1]])
            self.run_of.append(run)
            self.bit_of.append(np.arange(len(own)) - np.maximum.accumulate(np.where(first, np.arange(len(own)), 0)))
        self.parts = np.maximum(1, -(-np.array(runs) // cell))  # cells of each run
        self.first = np.cumsum(self.parts) - self.parts


_ROW = pa.schema([("cell", pa.int64()), ("bit", pa.int32()), ("id", pa.int64()), ("x", pa.list_(pa.float64()))])
_PROBE = pa.schema([("cell", pa.int64()), ("bits", pa.int64()), ("id", pa.int64()), ("x", pa.list_(pa.float64()))])


def _route(trees: list[Tree]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with its leaf in every tree, numbered through all trees."""
        for batch in batches:
            if batch.num_rows:
                x = _unit(_rows_of(batch.column("x")))
                leaves = np.stack([(k << t.depth) + t.leaf(x) for k, t in enumerate(trees)], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(leaves), pa.list_(pa.int64()))],
                                                 names=["id", "x", "leaves"])

    return run


def _place(layout: Layout, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each tree: the cell it lies in and the bit of its leaf there."""
        for batch in batches:
            if not batch.num_rows:
                continue
            leaves, salt = np.stack(batch.column("leaves").to_numpy(zero_copy_only=False)), batch.column("salt").to_numpy()
            for k in range(leaves.shape[1]):
                leaf = leaves[:, k] - (k << depth)
                at = layout.run_of[k][leaf]
                cell = layout.first[at] + salt % layout.parts[at]
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(layout.bit_of[k][leaf], pa.int32()), batch.column("id"),
                                                  batch.column("x")], schema=_ROW)

    return run


def _probe(trees: list[Tree], sizes: list[np.ndarray], layout: Layout, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with every cell it has opened leaves in. ``kth`` is the cosine of its k-th neighbour so far, NULL where
        there are fewer; ``again`` says that the first leaves were searched already."""
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_rows_of(batch.column("x")))
            cells, bits, at = [], [], []
            for i, (q, kth, again) in enumerate(zip(x, batch.column("kth").to_pylist(), batch.column("again").to_pylist())):
                opened = search(q, trees, sizes, max(FIRST_ROWS, 4 * k))
                if again:
                    far = np.inf if kth is None else np.sqrt(max(0.0, 2 - 2 * kth))
                    known = set(opened)
                    opened = [o for o in search(q, trees, sizes, margin=REACH * far / np.sqrt(len(q))) if o not in known]
                mask: dict[int, int] = {}
                for tree, leaf in opened:
                    run_ = int(layout.run_of[tree][leaf])
                    mask[run_] = mask.get(run_, 0) | 1 << int(layout.bit_of[tree][leaf])
                for run_, b in mask.items():
                    for part in range(layout.parts[run_]):
                        cells.append(layout.first[run_] + part)
                        bits.append(b)
                        at.append(i)
            for s in range(0, len(at), 4096):
                rows = batch.select(["id", "x"]).take(pa.array(at[s:s + 4096], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(cells[s:s + 4096], pa.int64()), pa.array(bits[s:s + 4096], pa.int64()),
                                                  rows.column("id"), rows.column("x")], schema=_PROBE)

    return run


def cosines(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, in double precision and summed in one order however the rows are grouped."""
    dots = (rows * q).sum(1)
    return dots / (np.sqrt((rows * rows).sum(1)) * np.sqrt((q * q).sum(1)))


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def best_pairs(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best pairs of each query, ties to smaller ids; an id counts once, with its best score."""
    order = np.lexsort((vec, -score, query))
    pairs = np.stack([query[order], vec[order]])
    _, first = np.unique(pairs, axis=1, return_index=True)
    order = order[np.sort(first)]
    q = query[order]
    start = np.concatenate([[True], q[1:] != q[:-1]])
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
    return order[rank < k]


def nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> pa.Table:
    """The k nearest ids of each query; a fast product picks the rows worth the exact measure."""
    out = []
    unit, repeated = _unit(rows), len(np.unique(ids)) < len(ids)
    for s in range(0, len(queries), STRIP):
        own, own_ids = queries[s:s + STRIP], query_ids[s:s + STRIP]
        rough = _unit(own) @ unit.T
        rough[own_ids[:, None] == ids[None, :]] = -np.inf
        keep = rough > -np.inf
        if len(ids) > k and not repeated:  # of repeated ids, any number could be in front
            keep &= rough >= np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k][:, None] - 1e-9
        i, j = np.nonzero(keep)
        score = np.concatenate([cosines(own[i[a:a + 65536]], rows[j[a:a + 65536]]) for a in range(0, len(i), 65536)] or [np.zeros(0)])
        score = np.where(np.isfinite(score), score, rough[i, j])  # squares out of the range of doubles
        at = best_pairs(own_ids[i], ids[j], score, k)
        out.append(pa.table([own_ids[i][at], ids[j][at], score[at]], schema=_FOUND))
    return pa.concat_tables(out) if out else _FOUND.empty_table()


def _compare(k: int):
    def run(rows: pa.Table, probes: pa.Table) -> pa.Table:
        """Queries of a cell meet the members of the leaves they opened, leaf by leaf; their k best rows of the cell stay."""
        if not rows.num_rows or not probes.num_rows:
            return _FOUND.empty_table()
        bit, ids, x = rows.column("bit").to_numpy(), rows.column("id").to_numpy(), _rows_of(rows.column("x"))
        bits, query_ids, q = probes.column("bits").to_numpy(), probes.column("id").to_numpy(), _rows_of(probes.column("x"))
        out = []
        for leaf in np.unique(bit):
            members, asking = np.flatnonzero(bit == leaf), np.flatnonzero(bits >> leaf & 1)
            if len(asking):
                out.append(nearest(query_ids[asking], q[asking], ids[members], x[members], k))
        found = pa.concat_tables(out) if out else _FOUND.empty_table()
        return found.take(best_pairs(*(found.column(c).to_numpy() for c in _FOUND.names), k))

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, hits): the k best of each query as (far, vec_id, score), nearest first. A cell hands on k rows at most."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    hits = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score")))
    return once.groupBy("query_id").agg(F.slice(hits, 1, k).alias("hits"))


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
               trees: int = TREES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest cosine found for each query, without the query's own id.

    Vectors that are NULL, zero, or hold NULL, NaN or infinite components take no part, and rows with a NULL id neither.
    Vectors of different lengths never meet: each length has a forest of its own. A repeated id counts once, with its
    largest score; repeated rows are merged first. A query with fewer than k rows in its first leaves opens all leaves, so it
    finds all there are. A leaf that holds many rows, as equal ones, is dealt to many cells, and queries that open it go to
    each. Collected are the sample and the leaf sizes, both bounded.
    """
    x, fine = _valid(vector)
    form = lambda df: df.where(F.col(vec_id).isNotNull() & fine).select(F.col(vec_id).cast("long").alias("id"), x.alias("x"))
    rows, asked = (materialize(form(df).distinct(), name) for df, name in ((vectors, "vectors"), (queries, "queries")))
    parts = [_search(rows.where(F.size("x") == n), asked.where(F.size("x") == n), k, trees)
             for (n,) in rows.select(F.size("x")).distinct().collect()]
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = _best(found, k).select("query_id", F.posexplode("hits").alias("at", "hit"))
    return best.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def _search(rows: DataFrame, asked: DataFrame, k: int, trees: int) -> DataFrame:
    """(query_id, vec_id, score) of both walks, for vectors of one length."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x").toArrow().column("x")
    fitted = _unit(_rows_of(sample))
    depth = depth_for(rows.count(), len(fitted))
    forest = [grow(fitted, seed, depth) for seed in range(trees)]
    index = materialize(rows.mapInArrow(_route(forest), "id long, x array<double>, leaves array<long>"), "index")
    counts = index.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()  # bounded by the sample
    flat = np.zeros(trees << depth, np.int64)
    for r in counts:
        flat[r["leaf"]] = r["count"]
    sizes = np.split(flat, trees)
    layout = Layout(forest, sizes)
    placed = index.select("id", "x", "leaves", F.pmod(F.xxhash64("id", "x"), F.lit(1 << 30)).alias("salt")).mapInArrow(
        _place(layout, depth), "cell long, bit int, id long, x array<double>")

    def walk(probes: DataFrame) -> DataFrame:
        sent = probes.mapInArrow(_probe(forest, sizes, layout, k), "cell long, bits long, id long, x array<double>")
        return placed.groupBy("cell").cogroup(sent.groupBy("cell")).applyInArrow(_compare(k), "query_id long, vec_id long, score double")

    first = materialize(walk(asked.select("id", "x", F.lit(None).cast("double").alias("kth"), F.lit(False).alias("again"))), "first")
    kth = _best(first, k).where(F.size("hits") == k).select(F.col("query_id").alias("id"), F.element_at("hits", -1)["score"].alias("kth"))
    again = asked.join(kth, "id", "left").select("id", "x", "kth", F.lit(True).alias("again"))
    return first.unionByName(walk(again))
