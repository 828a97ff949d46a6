"""Best-fit packing of tokenised documents into sequences, improved by a grouping genetic algorithm on islands.

Pieces are hashed into shards of bounded size. A shard is solved by several islands; an island keeps a few packings,
begun by best fit over falling, blurred and shuffled lengths, and breeds them: crossover injects whole well-filled bins of one
parent into the other; bins that now hold a document twice are dissolved, and the worst-filled ones with them. A displaced
document may take the place of shorter ones in a bin that it fills better; what is displaced in the end is placed by best
fit. Between epochs the best packing of an island moves to the next one. An island stops when no child was better for a while,
or, after its first crossovers, when its packing has as few bins as the sum of lengths allows.
"""

from __future__ import annotations

import random
import zlib
from base64 import b64decode
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from firmnet.llm.common import whole
from firmnet.storage import materialize

CAPACITY = 2048
END = 0  # id that closes each document
SHARD_PIECES = 8192
ISLANDS, EPOCHS, POPULATION = 2, 2, 6
FIRST = 8  # crossovers of an island in each epoch, at least
STALL = 12  # crossovers without a better child that end an epoch
WELL_FILLED = 0.98
DISSOLVED = 0.1  # of the other parent's bins, the worst-filled
TRIED = 4  # bins looked at for each displaced document

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64())])
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of texts as bytes of little-endian unsigned 32-bit numbers.

    ``path`` is the tokenizer's file. Where ``ranks`` names the same vocabulary as byte ranks, they encode the texts, which
    is several times faster; tests compare the ids of both. Texts that hold one of the tokenizer's special strings go to
    the tokenizer itself, as ranks have none.
    """

    def __init__(self, path: str, ranks: str | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranks = ranks and tiktoken.Encoding(
            ranks, pat_str=PATTERN, special_tokens={},
            mergeable_ranks={b64decode(a): int(b) for a, b in (line.split() for line in open(ranks, "rb"))})

    def encode(self, text: str) -> bytes:
        if self.ranks is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.ranks.encode_ordinary(text), "<u4").tobytes()


@cache  # a worker keeps its encoder from task to task
def _encoder(path: str, ranks: str | None) -> Encoder:
    return Encoder(path, ranks)


def cut_sizes(total: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: full ones, the first one taking what is over."""
    over = total % capacity
    return ([over] if over else []) + [capacity] * (total // capacity)


def _pieces(path: str, ranks: str | None, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, closing = _encoder(path, ranks), np.array([end], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, start = encoder.encode(text) + closing, 0
                for k, size in enumerate(cut_sizes(len(ids) // 4, capacity)):
                    out.append((doc_id, k, start, size, zlib.crc32(ids[4 * start:4 * (start + size)])))
                    start += size
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECES)], schema=_PIECES)

    return run


def tokenised_pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, doc_id: str = "doc_id", text: str = "text",
                     capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row for each piece of a document. NULL text is empty and has the closing id alone."""
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), whole(text).alias("_text"))
    return rows.mapInArrow(_pieces(tokenizer, ranks, capacity, end), PIECES)


class Packing:
    """Bins of item numbers, with the room each has left; best fit by a bit set of the rooms in use."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int] | None] = []
        self.room: list[int] = []
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room
        self.mask = 0

    def _file(self, b: int) -> None:
        r = self.room[b]
        self.open[r].append(b)
        self.mask |= 1 << r

    def add_bin(self, items: list[int]) -> None:
        self.bins.append(items)
        self.room.append(self.capacity - sum(self.lengths[i] for i in items))
        self._file(len(self.bins) - 1)

    def place(self, i: int) -> None:
        n = self.lengths[i]
        fits = self.mask >> n
        if not fits:
            self.add_bin([i])
            return
        r = n + (fits & -fits).bit_length() - 1
        b = self.open[r].pop()
        if not self.open[r]:
            self.mask &= ~(1 << r)
        self.bins[b].append(i)
        self.room[b] = r - n
        self._file(b)

    def fill(self, items: list[int]) -> Packing:
        for i in items:
            self.place(i)
        return self

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones."""
        return -len(self.bins), sum((self.capacity - r) ** 2 for r in self.room)


def _exchanged(bins: list[list[int]], loose: list[int], lengths: list[int], capacity: int, draw: random.Random) -> list[int]:
    """Let loose items take the place of one or two shorter ones in bins that they fill better; returns what is loose then."""
    by_length: dict[int, list[int]] = {}
    for i in loose:
        by_length.setdefault(lengths[i], []).append(i)
    mask = sum(1 << n for n in by_length)
    for b in draw.sample(range(len(bins)), min(len(bins), TRIED * len(loose))):
        x = bins[b]
        room = capacity - sum(lengths[i] for i in x)
        if not room:
            continue
        best = (0, 0, 0, 0)
        for p in range(len(x)):
            for q in range(p, len(x)):
                out = lengths[x[p]] + (lengths[x[q]] if q > p else 0)
                fits = mask & ((1 << (out + room + 1)) - 1)
                best = max(best, (fits.bit_length() - 1 - out, p, q, fits.bit_length() - 1))
        gain, p, q, n = best
        if gain > 0:
            own = by_length[n]
            new = own.pop()
            if not own:
                del by_length[n]
                mask &= ~(1 << n)
            for k in {p, q}:
                by_length.setdefault(lengths[x[k]], []).append(x[k])
                mask |= 1 << lengths[x[k]]
            bins[b] = [i for k, i in enumerate(x) if k not in (p, q)] + [new]
    return [i for own in by_length.values() for i in own]


def cross(a: Packing, b: Packing, draw: random.Random) -> Packing:
    """Child of ``a`` with some of the well-filled bins of ``b``, the fullest or any."""
    good = sorted((r, k) for k, r in enumerate(b.room) if r <= b.capacity * (1 - WELL_FILLED))
    half = (len(good) + 1) // 2
    taken = [b.bins[k] for _, k in (good[:half] if draw.random() < 0.5 else draw.sample(good, half))]
    inside = {i for x in taken for i in x}
    kept = sorted((r, k) for k, r in enumerate(a.room) if inside.isdisjoint(a.bins[k]))
    kept = [a.bins[k] for _, k in kept[:len(kept) - int(len(kept) * DISSOLVED)]]
    bins = [list(x) for x in taken + kept]
    placed = inside.union(*kept)
    loose = _exchanged(bins, [i for x in a.bins for i in x if i not in placed], a.lengths, a.capacity, draw)
    child = Packing(a.lengths, a.capacity)
    for x in bins:
        child.add_bin(x)
    return child.fill(sorted(loose, key=lambda i: -a.lengths[i]))


def evolve(lengths: list[int], capacity: int, seed: int, given: list[list[list[int]]] = ()) -> tuple[list[list[int]], int]:
    """Best packing of an island and the crossovers it took, from the ``given`` packings and best fit over several orders."""
    draw = random.Random(seed)
    least = -(-sum(lengths) // capacity)
    down = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    people = []
    for bins in given:
        p = Packing(lengths, capacity)
        for x in bins:
            p.add_bin(x)
        people.append(p)
    for k in range(POPULATION - len(people)):
        if k == 0:
            order = down
        elif k % 2:
            order = sorted(down, key=lambda i: -lengths[i] * (1 + 0.1 * k * draw.random()))
        else:
            order = draw.sample(down, len(down))
        people.append(Packing(lengths, capacity).fill(order))
    crossed = stalled = 0
    while stalled < STALL:
        people.sort(key=Packing.fitness, reverse=True)
        if crossed >= FIRST and len(people[0].bins) <= least:
            break
        mother, father = people[0], draw.choice(people[1:])
        child = max(cross(mother, father, draw), cross(father, mother, draw), key=Packing.fitness)
        crossed += 2
        stalled = 0 if child.fitness() > mother.fitness() else stalled + 1
        people[-1] = child
    return max(people, key=Packing.fitness).bins, crossed


def _epoch(capacity: int, epoch: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Rows of an island: its pieces, once for each packing given (``from_island``, -1 for none)."""
        shard, island = (int(k) for k in key)
        rows = rows.sort_values(["from_island", "key"])
        own = rows[rows.from_island == rows.from_island.iloc[0]]
        keys, lengths = own.key.to_numpy(), [int(n) for n in own.length]
        given = []
        for _, g in rows[rows.from_island >= 0].groupby("from_island"):
            bins: dict[int, list[int]] = {}
            for i, b in enumerate(g.bin):
                bins.setdefault(b, []).append(i)
            given.append(list(bins.values()))
        best, crossed = evolve(lengths, capacity, hash((shard, island, epoch)), given)
        out = np.empty((len(keys), 2), np.int64)
        for b, items in enumerate(best):
            at = 0
            for i in items:
                out[i] = b, at
                at += lengths[i]
        return pd.DataFrame({"shard": shard, "island": island, "key": keys, "length": lengths, "bin": out[:, 0], "at": out[:, 1],
                             "bins": len(best), "crossed": crossed})

    return run


def islands(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(shard, island, key, length, bin, at, bins, crossed): the last epoch's best packing of each island of each shard, for
    a stored table of (key, length); ``crossed`` counts the island's crossovers in that epoch."""
    shards = -(-items.count() // SHARD_PIECES) or 1
    state = items.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", "length",
                         F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
                         F.lit(-1).alias("from_island"), F.lit(-1).cast("long").alias("bin"))
    form = "shard long, island long, key long, length long, bin long, at long, bins long, crossed long"
    for epoch in range(EPOCHS):
        done = materialize(state.groupBy("shard", "island").applyInPandas(_epoch(capacity, epoch), form), "islands")
        own = done.select("shard", "key", "length", "island", F.col("island").alias("from_island"), "bin")
        sent = done.select("shard", "key", "length", ((F.col("island") + 1) % ISLANDS).alias("island"),
                           F.col("island").alias("from_island"), "bin")
        state = own.unionByName(sent)
    return done


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of a stored table with a ``length`` of 1 to ``capacity``.

    Full pieces are sequences of their own. Others are hashed into shards of about ``SHARD_PIECES``; a shard ends with
    at most about one ill-filled bin, so splitting costs little. Repeated pieces are packed each; an empty table gives
    an empty one. Numbering reads the stored table twice and is the same each time.
    """
    keyed = materialize(pieces.withColumn("_key", F.monotonically_increasing_id()), "pieces")
    done = islands(keyed.where(F.col("length") < capacity).select(F.col("_key").alias("key"), "length"), capacity)
    best = done.groupBy("shard").agg(F.min(F.struct("bins", "island")).alias("_best")).select(
        "shard", F.col("_best.island").alias("island"))
    placed = done.join(best, ["shard", "island"]).select(
        F.col("key").alias("_key"), (F.col("shard") * capacity * SHARD_PIECES + F.col("bin")).alias("sequence_id"),
        F.col("at").alias("offset"))
    packed = keyed.where(F.col("length") < capacity).join(placed, "_key")
    full = keyed.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("_key")).withColumn(
        "offset", F.lit(0).cast("long"))
    columns = [*pieces.columns, "sequence_id", "offset"]
    return packed.select(columns).unionByName(full.select(columns))
