"""Alignment of two tokenizers' tokens over the same bytes, and how often pairs of ids end together in a corpus.

A text is tokenised whole by both sides, and the bytes of the tokens are compared with the text. Offsets at which both sides
begin a token that is marked by a space are anchors: ends that both sides share there are verified on bytes, so the windows
between anchors can be aligned on their own. A window is known by its two tuples of ids, and as most windows are words that
come again and again, each different one of a batch of texts is aligned once, and its alignment is used for all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from firmnet.storage import materialize

BATCH_CHARS = 4 << 20  # text that is tokenised and aligned at one go
_CODE_BITS = 32  # code of a pair: id of A above, id of B below


def byte_level_alphabet() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for.

    Printable bytes of Latin-1 stand for themselves; the others, in order, for the characters from U+0100 on.
    """
    kept = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(0x100 + k): b for k, b in enumerate(moved)}


class ByteLevel:
    """Byte-level BPE of a ``tokenizers`` file. Strings of special tokens are plain text.

    The file's merges are in order of their ids, so the bytes of its entries, ranked by id, say all there is to its BPE;
    they are handed to an encoder that is several times faster. Tests compare its ids with those of the file's own library.
    """

    def __init__(self, path: str, pattern: str = PATTERN):
        own = Tokenizer.from_file(path)
        alphabet, special = byte_level_alphabet(), {t.content for t in own.get_added_tokens_decoder().values()}
        ranks = {bytes(alphabet[c] for c in entry): i for entry, i in own.get_vocab().items() if entry not in special}
        self.encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * own.get_vocab_size()
        for entry, i in ranks.items():
            self.bytes[i] = entry

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text behind a space."""
        return [self.encoding.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """SentencePiece model with byte fallback; it puts a space before each text by itself."""

    def __init__(self, path: str):
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i)
                      else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.vocab_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, out_type=int, num_threads=1)


def _ragged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all runs ``start`` to ``end``, one behind the other, and where each run ends there."""
    size = end - start
    stop = np.cumsum(size)
    return np.arange(int(size.sum())) + np.repeat(start - stop + size, size), stop


class Aligner:
    """Aligns batches of texts. ``aligned`` counts the windows that were aligned, ``met`` all windows."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.a_size, self.b_size = (np.array([len(x) for x in side.bytes], np.int64) for side in (a, b))
        form = lambda side, end: np.array([f"{i}{end}" for i in range(len(side.bytes))], object)
        self.a_texts, self.a_closing, self.b_texts, self.b_closing = form(a, ","), form(a, "|"), form(b, ","), form(b, ";")
        self.a_marked, self.b_marked = (np.array([x[:1] == b" " for x in side.bytes]) for side in (a, b))
        self.aligned = self.met = 0

    def align_windows(self, x: np.ndarray, x_stop: np.ndarray, y: np.ndarray, y_stop: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Written groups of windows whose ids stand behind one another; codes of the linked pairs, the last tokens of each
        group; and where each window's codes end.

        All are aligned at one go, as both sides cover the same bytes window by window. A group ends where tokens of both
        end; the pieces of its writing are put at their places, and cut at the windows' ends.
        """
        x_end, y_end = np.cumsum(self.a_size[x]), np.cumsum(self.b_size[y])
        at = np.minimum(np.searchsorted(y_end, x_end), len(y) - 1)
        x_last = y_end[at] == x_end  # a group's last token
        y_last = np.zeros(len(y), bool)
        y_last[at[x_last]] = True
        i, j = np.flatnonzero(x_last), np.flatnonzero(y_last)
        # A token stands behind the other side's tokens of the groups before, one of B also behind its group's own of A.
        x_place = np.arange(len(x)) + np.concatenate([[0], j + 1])[np.cumsum(x_last) - x_last]
        y_place = np.arange(len(y)) + (i + 1)[np.cumsum(y_last) - y_last]
        written = np.empty(len(x) + len(y), object)
        written[x_place] = np.where(x_last, self.a_closing[x], self.a_texts[x])
        written[y_place] = np.where(y_last, self.b_closing[y], self.b_texts[y])
        pieces, stop = written.tolist(), (x_stop + y_stop).tolist()
        groups = ["".join(pieces[s:e])[:-1] for s, e in zip([0, *stop[:-1]], stop)]
        return groups, x[i] << _CODE_BITS | y[j], np.searchsorted(i, x_stop)

    def windows(self, x: np.ndarray, y: np.ndarray, x_new: np.ndarray, y_new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``x`` and ``y`` at which windows begin: offsets where both sides begin a space-marked token, or a text
        (``x_new``, ``y_new``). Both sides cover the same bytes text by text."""
        x_size, y_size = self.a_size[x], self.b_size[y]
        x_mark, y_mark = self.a_marked[x], self.b_marked[y]
        x_mark[x_new], y_mark[y_new] = True, True
        i, j = np.flatnonzero(x_mark), np.flatnonzero(y_mark)
        one, two = (np.cumsum(x_size) - x_size)[i], (np.cumsum(y_size) - y_size)[j]
        at = np.minimum(np.searchsorted(two, one), len(two) - 1)
        shared = two[at] == one
        return i[shared], j[at[shared]]

    def align_texts(self, texts: list[str], a: list[list[int]], b: list[list[int]]) -> list[tuple[str, np.ndarray] | None]:
        """Groups and link codes of each text; None where the tokens' bytes are not those of the text behind a space.

        Windows with the same tuples of ids are aligned once.
        """
        sure = [k for k, (t, x, y) in enumerate(zip(texts, a, b)) if t and self._covers(t, x, y)]
        out: list[tuple[str, np.ndarray] | None] = [None] * len(texts)
        if not sure:
            return out
        x, y = (np.fromiter(chain.from_iterable(side[k] for k in sure), np.int64) for side in (a, b))
        x_new, y_new = (np.cumsum([0] + [len(side[k]) for k in sure]) for side in (a, b))
        i, j = self.windows(x, y, x_new[:-1], y_new[:-1])
        i_end, j_end = np.append(i[1:], len(x)), np.append(j[1:], len(y))
        kind, some = same_windows(x, i, i_end, y, j, j_end, len(self.a_size), len(self.b_size))
        (x_at, x_stop), (y_at, y_stop) = _ragged(i[some], i_end[some]), _ragged(j[some], j_end[some])
        groups, codes, stop = self.align_windows(x[x_at], x_stop, y[y_at], y_stop)
        self.aligned, self.met = self.aligned + len(some), self.met + len(i)
        written, start = np.array(groups, object)[kind], np.concatenate([[0], stop[:-1]])
        at, links = _ragged(start[kind], stop[kind])
        at, links = codes[at], np.concatenate([[0], links]).tolist()
        bounds = np.searchsorted(i, x_new).tolist()
        for k, s, e in zip(sure, bounds, bounds[1:]):
            out[k] = ";".join(written[s:e].tolist()), at[links[s]:links[e]]
        return out

    def _covers(self, text: str, a: list[int], b: list[int]) -> bool:
        raw = b" " + text.encode()
        return b"".join(map(self.a.bytes.__getitem__, a)) == raw and b"".join(map(self.b.bytes.__getitem__, b)) == raw


LONG = 12  # windows with more tokens on a side are not compared with others of the batch


def _refined(kind: np.ndarray, ids: np.ndarray, start: np.ndarray, end: np.ndarray, n_ids: int) -> np.ndarray:
    """Windows of one ``kind`` split by their ids, token by token: equal numbers for equal kinds and equal ids."""
    for place in range(LONG):
        (more,) = np.nonzero(end - start > place)
        if not len(more):
            break
        # Windows that have ended keep their number; the others get new ones behind all.
        _, new = np.unique(kind[more] * n_ids + ids[start[more] + place], return_inverse=True)
        kind[more] = kind.max() + 1 + new
    return kind


def same_windows(x: np.ndarray, i: np.ndarray, i_end: np.ndarray, y: np.ndarray, j: np.ndarray, j_end: np.ndarray, n_a: int,
                 n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of each window among the different ones, and a place of each different one."""
    kind = _refined(np.zeros(len(i), np.int64), x, i, i_end, n_a)
    _, kind = np.unique(kind, return_inverse=True)
    kind = _refined(kind, y, j, j_end, n_b)
    long = (i_end - i > LONG) | (j_end - j > LONG)
    kind[long] = kind.max() + 1 + np.arange(long.sum())
    _, some, kind = np.unique(kind, return_index=True, return_inverse=True)
    return kind, some


@cache  # a worker keeps its tokenizers and its memory from task to task
def _aligner(a: str, b: str) -> Aligner:
    return Aligner(ByteLevel(a), Pieces(b))


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``BATCH_CHARS``."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= BATCH_CHARS or k + 1 == len(texts):
            yield start, k + 1
            start, held = k + 1, 0


Aligned = tuple[list[int], list[int], str, np.ndarray]
_NONE = np.zeros(0, np.int64)


def _texts(aligner: Aligner, texts: list[str | None]) -> Iterator[tuple[int, int, list[Aligned]]]:
    """Runs of texts (from, to) with ids of both sides, written groups and link codes of each; empty ones for a text without
    tokens."""
    for s, e in _slices(texts):
        part = [t or "" for t in texts[s:e]]
        a, b = aligner.a.encode(part), aligner.b.encode(part)
        found = aligner.align_texts(part, a, b)
        yield s, e, [(x, y, *f) if f else ([], [], "", _NONE) for x, y, f in zip(a, b, found)]


_ALIGNED = pa.schema([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("groups", pa.string())])
_LINKED = pa.schema([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()),
                     ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
LINKED = "n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, counts array<long>"


def _aligned(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e, found in _texts(_aligner(a, b), batch.column(1).to_pylist()):
                columns = [pa.array([r[k] for r in found], f.type) for k, f in enumerate(_ALIGNED)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), *columns], names=["_id", *_ALIGNED.names])

    return run


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) for x in arrays]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([_NONE, *arrays])))


def _linked(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e, found in _texts(_aligner(a, b), batch.column(1).to_pylist()):
                links = [np.unique(codes, return_counts=True) for *_, codes in found]
                rows = [(len(x), len(y), len(codes), hashlib.sha256(groups.encode()).hexdigest() if groups else "") for x, y, groups, codes in found]
                columns = [pa.array([r[k] for r in rows], _LINKED[k].type) for k in range(4)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), *columns, *(_lists([x[k] for x in links]) for k in (0, 1))],
                                                 names=["_id", *_LINKED.names])

    return run


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))


def aligned(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, a, b, groups) of each row: ids of both tokenizers and their groups, written ``a1,a2|b1;a3|b2,b3``.

    NULL and empty texts, and texts whose bytes a tokenizer changes, have no tokens. Rows stay where they are; a NULL id stays
    NULL, repeated rows stay repeated, other columns take no part, an empty table gives no rows.
    """
    rows = _rows(docs, doc_id, text).mapInArrow(_aligned(a, b), "_id long, a array<int>, b array<int>, groups string")
    return rows.withColumnRenamed("_id", "doc_id")


def _lookup(codes: np.ndarray, totals: np.ndarray, best: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Replace the pairs of each row by sums over its links."""
        for batch in batches:
            pairs, counts = batch.column("pairs"), batch.column("counts")
            at = np.searchsorted(codes, pairs.flatten().to_numpy())
            n = counts.flatten().to_numpy()
            ends = np.cumsum(pairs.value_lengths().to_numpy())
            sums = [np.diff(np.concatenate(([0], np.cumsum(v)))[np.concatenate(([0], ends))]) for v in (n, n * best[at], n * totals[at])]
            kept = [batch.column(c) for c in ("_id", "n_a", "n_b", "n_groups")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, pa.int64()) for v in sums), batch.column("groups_sha256")],
                                             names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return run


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, n): links of each pair in the corpus, summed before the shuffle."""
    return linked.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(
        F.sum("x.counts").alias("n"))


def link_statistics(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens, groups and links of each row, with how common its linked pairs are in all rows.

    A text is tokenised once; its distinct pairs are stored and counted. Tokens that end together cover the same bytes up to
    the shorter one, so a pair is possible only where one token's bytes end with the other's: the table of pairs is bounded by
    the two vocabularies (some 300,000 pairs) whatever the corpus, and is handed to the tasks. Nulls, empty tables and other
    columns as in :func:`aligned`.
    """
    linked = materialize(_rows(docs, doc_id, text).mapInArrow(_linked(a, b), f"_id long, {LINKED}"), "linked")
    found = pair_counts(linked).toArrow()
    codes, totals = (found.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(codes)
    codes, totals = codes[order], totals[order]
    most = np.zeros(1 + int((codes & (1 << _CODE_BITS) - 1).max(initial=0)), np.int64)
    np.maximum.at(most, codes & (1 << _CODE_BITS) - 1, totals)
    best = totals == most[codes & (1 << _CODE_BITS) - 1]
    form = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return linked.mapInArrow(_lookup(codes, totals, best), form)
