"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents and unlabelled text train numpy classifiers under the class-prior-corrected risk

    prior * E_p[loss(f)] + max(0, E_u[loss(-f)] - prior * E_p[loss(-f)])

where the second part, the risk of the negative class, may not go below zero. Each classifier has two steps trained
that way: a linear one over words and their character n-grams, which gives every word a score, and one over the largest
word scores of a document, so that long texts are not drowned in the noise of their many harmless words.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmnet.llm.common import held_out, whole
from firmnet.storage import materialize

POSITIVES, UNLABELLED = 2000, 4000  # at most so many documents train a classifier; the bound of the sample
MODELS = 3
BITS = 18  # hashed features
GRAMS = (3, 4, 5)
LEAST_DOCS = 3  # of the sample that hold a feature
TOP = 4
ROUNDS, SECOND_ROUNDS = 80, 400
_WORD = re.compile(r"[^\W\d_]+")
CACHE = 500_000  # words whose scores a task remembers, as rows of one array
SLICE = 64  # texts that are Python strings at a time


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(word: str) -> list[int]:
    """Hashed features of a word: itself and its character n-grams, ends marked."""
    marked = f"^{word}$"
    grams = {marked[i:i + n] for n in GRAMS for i in range(len(marked) - n + 1)} | {marked}
    return [crc32(g.encode()) >> (32 - BITS) for g in grams]


def nn_gradient(margin: np.ndarray, positive: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Gradient of the non-negative risk by each document's margin, and the risk; logistic loss."""
    n_p, n_u = max(positive.sum(), 1), max((~positive).sum(), 1)
    up = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))  # derivative of loss(-f)
    soft = np.logaddexp(0, margin)
    negative = soft[~positive].sum() / n_u - prior * soft[positive].sum() / n_p
    part = np.where(positive, -prior / n_p, 1 / n_u) * up
    if negative < 0:  # step back from a negative risk instead of following it
        return -part, float(prior * np.logaddexp(0, -margin[positive]).sum() / n_p)
    gradient = part + np.where(positive, prior / n_p, 0) * (up - 1)
    return gradient, float(prior * np.logaddexp(0, -margin[positive]).sum() / n_p + negative)


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return self.rate * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.999 ** self.t)) + 1e-8)


@dataclass
class Model:
    """Weights of the features, and of the second step over a document's largest word scores."""

    weights: np.ndarray
    second: np.ndarray

    def word(self, word: str) -> float:
        return float(self.weights[features(word)].sum())

    def margin(self, scores: list[float]) -> float:
        return float(pooled(scores) @ self.second)


def pooled(scores: list[float] | np.ndarray) -> np.ndarray:
    """The largest word scores, how many words there are, and one."""
    top = np.zeros(TOP)
    best = np.sort(np.asarray(scores, float))[::-1][:TOP]
    top[:len(best)] = best
    return np.concatenate([top, [np.log1p(len(scores)) / 10, 1.0]])


def train(texts: list[str], positive: np.ndarray, prior: float) -> Model:
    """Fit both steps on a bounded sample."""
    # Words are held once, documents as their numbers, and features in one array: lists of them take many times the memory.
    index: dict[str, int] = {}
    every, sizes = array("i"), []
    for t in texts:
        found = words_of(t)
        every.extend(index.setdefault(w, len(index)) for w in found)
        sizes.append(len(found))
    word, of_doc = np.array(every, np.int64), np.repeat(np.arange(len(texts)), sizes)
    seen = np.bincount(word, minlength=len(index))
    # Words of one document only are left to their n-grams, which other words teach.
    often = seen > 1
    held, flat, lengths = np.zeros(1 << BITS), array("i"), []
    for w, k in index.items():
        if often[k]:
            f = features(w)
            held[f] += seen[k]
            flat.extend(f)
            lengths.append(len(f))
    del index, every
    n_words, number = len(lengths), np.cumsum(often) - 1
    word, of_doc = number[word[often[word]]], of_doc[often[word]]
    counts = np.bincount(of_doc, minlength=len(texts))
    feats = np.array(flat, np.int64)
    usable = held[feats] >= LEAST_DOCS
    feats, of_word = feats[usable], np.repeat(np.arange(n_words), lengths)[usable]
    del flat
    scale = 1 / np.sqrt(np.maximum(counts, 1))
    weights, bias = np.zeros(1 << BITS), 0.0
    adam, adam_bias = Adam(1 << BITS, 0.05), Adam(1, 0.05)
    for _ in range(ROUNDS):
        score = np.bincount(of_word, weights[feats], n_words)
        margin = np.bincount(of_doc, score[word], len(texts)) * scale + bias
        g, _risk = nn_gradient(margin, positive, prior)
        by_word = np.bincount(word, (g * scale)[of_doc], n_words)
        grad = np.bincount(feats, by_word[of_word], 1 << BITS)
        weights -= adam.step(grad + 1e-5 * weights)
        bias -= adam_bias.step(np.array([g.sum()]))[0]
    score = np.bincount(of_word, weights[feats], n_words)
    starts = np.concatenate([[0], np.cumsum(counts)])
    x = np.array([pooled(score[word[a:b]]) for a, b in zip(starts, starts[1:])]).reshape(len(texts), TOP + 2)
    spread = max(np.abs(x[:, :TOP]).max(), 1e-9)
    x[:, :TOP] /= spread
    second, adam = np.zeros(TOP + 2), Adam(TOP + 2, 0.1)
    for _ in range(SECOND_ROUNDS):
        g, _risk = nn_gradient(x @ second, positive, prior)
        second -= adam.step(x.T @ g + 1e-5 * second)
    second[:TOP] /= spread
    return Model(weights.astype(np.float32), second)


def _fit(prior: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_draw", "_text"])
        model = train(list(rows["_text"]), rows["_positive"].to_numpy(bool), prior)
        return pd.DataFrame({"weights": [model.weights.tobytes()], "second": [model.second.tobytes()]})

    return run


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", models: int = MODELS,
        positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> list[Model]:
    """Train ``models`` classifiers, each in its own task, from rows that are not held out.

    A classifier sees at most ``positives`` confirmed toxic documents and about ``unlabelled`` other draws of all training
    text, whatever their label, in order of a hash of id and text. Rows equal in both count once, so the bounds hold however
    often an id or a row is repeated; rows of one id with several texts are documents of their own. The class prior is the
    share of toxic ones among all labelled training ids. NULL labels are unlabelled; a document labelled twice is toxic if
    one label says so. Without any positive the list is empty, and every score is 0.
    """
    said = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)).groupBy(
        F.col(doc_id).cast("long").alias("_id")).agg(F.max(F.col(toxic).cast("int")).alias("_toxic"))
    n, n_toxic = said.agg(F.count("*"), F.coalesce(F.sum("_toxic"), F.lit(0))).first()
    if not n_toxic:
        return []
    prior = min(max(n_toxic / n, 1e-4), 0.9)
    texts = docs.where(F.col(doc_id).isNotNull() & ~held_out(doc_id)).select(
        F.col(doc_id).cast("long").alias("_id"), whole(text).alias("_text"), F.xxhash64(whole(text)).alias("_hash"))
    rows = texts.select("_id", "_hash").distinct()  # summed before the shuffle
    draw = lambda seed: F.xxhash64(F.lit(seed), "_id", "_hash")
    pos = rows.join(said.where("_toxic = 1").select("_id"), "_id").orderBy(draw(1), "_id", "_hash").limit(positives).withColumn(
        "_model", F.explode(F.sequence(F.lit(0), F.lit(models - 1)))).withColumn("_positive", F.lit(True))
    free = rows.orderBy(draw(2), "_id", "_hash").limit(unlabelled * models).withColumn(
        "_model", F.pmod(draw(3), F.lit(models)).cast("int")).withColumn("_positive", F.lit(False))
    drawn = materialize(pos.unionByName(free), "sample")  # ids and hashes; their number is bounded by the parameters
    sample = texts.join(F.broadcast(drawn), ["_id", "_hash"]).groupBy("_id", "_hash", "_model", "_positive").agg(
        F.first("_text").alias("_text")).withColumn("_draw", draw(4))
    fitted = sample.groupBy("_model").applyInPandas(_fit(prior), "weights binary, second binary").collect()  # of fixed size
    return [Model(np.frombuffer(r["weights"], np.float32), np.frombuffer(r["second"], np.float64)) for r in fitted]


def score_column(models: list[Model], text: str):
    """Mean probability of the classifiers for the whole text; NULL and empty texts are scored as texts without words."""
    if not models:
        return F.lit(0.0)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, int] = {}
        table = np.stack([m.weights for m in models])
        values = np.zeros((1 << 12, len(models)))
        for texts in batches:
            out = []
            for t in (t for start in range(0, len(texts), SLICE) for t in texts.slice(start, SLICE).to_pylist()):
                found = words_of(t or "")
                new = [w for w in found if w not in known]
                if new:
                    if len(known) + len(new) > CACHE:
                        known.clear()
                        new = list(found)
                    lists = [features(w) for w in new]
                    starts = np.cumsum([0] + [len(f) for f in lists[:-1]])
                    sums = np.add.reduceat(table[:, [x for f in lists for x in f]], starts, axis=1)
                    first = len(known)
                    known.update(zip(new, range(first, first + len(new))))
                    while len(known) > len(values):
                        values = np.concatenate([values, np.zeros_like(values)])
                    values[first:len(known)] = sums.T
                cols = values[[known[w] for w in found]].T if found else [()] * len(models)
                margins = np.array([m.margin(c) for m, c in zip(models, cols)])
                out.append(float(np.mean(1 / (1 + np.exp(-np.clip(margins, -40, 40))))))
            yield pa.array(out, pa.float64())

    return F.arrow_udf(run, "double")(F.col(text))


def score(docs: DataFrame, models: list[Model], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; repeated rows stay repeated."""
    s = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), score_column(models, text).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, models: list[Model], text: str = "text") -> DataFrame:
    """Rows of ``docs`` that the classifiers do not call toxic."""
    return docs.where(score_column(models, text) < 0.5)
