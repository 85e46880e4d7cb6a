"""Operator 9: toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed features of a text's distinct words (the word, its beginnings and its inner pieces) is
trained in numpy from confirmed toxic texts (P) and unlabelled ones (U). With the class prior p, the risk is
p * R_p(+) + max(0, R_u(-) - p * R_p(-)): the second term estimates the risk of the negatives and is kept from going
below zero, where the step goes against its gradient instead. The prior is the rate of toxic labels among the labelled
texts outside the held-out fold. Weights are shrunk towards zero (soft threshold), which leaves a short list.

Training uses a bounded sample: at most ``positives`` toxic texts and ``unlabelled`` others (documented parameters), those
with the least hash of the id; scoring covers every whole text. The label, language, source and id are never features.

Defined results: null and empty texts score as a text without words; very long texts are read whole; a null id is never in the
held-out fold, nor in training; a document labelled more than once is toxic if any label says so; null labels don't count; where
nothing can be told apart (no label outside the held-out fold, all of one kind, or no such text) every score is the rate of toxic
labels: 0 without any, 1 if all are; ties in the sample's order go to the smaller id; repeated rows score alike; other columns
stay as they are, but for one named tox_score; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import discard, saved, table

BITS = 18
#: Features that a step of the training looks at together.
SLICE = 400_000
WORD = re.compile(r"[^\W\d_]+")
FOLDS = 5


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def text_words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def word_features(word: str) -> list[int]:
    """Hashed features of a word: itself, its beginnings of 2 to 8 letters."""
    of = xxhash.xxh3_64_intdigest
    out = [of(b"=" + word.encode()) >> (64 - BITS)]
    out += [of(b"^" + word[:n].encode()) >> (64 - BITS) for n in range(2, min(8, len(word)) + 1)]
    return out


def sparse(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of the texts one after another, and where each text starts (and the last ends)."""
    memo: dict[str, list[int]] = {}
    flat, starts = [np.empty(0, np.int32)], [0]
    for t in texts:
        has: set[int] = set()
        for w in text_words(t):
            f = memo.get(w)
            if f is None:
                f = memo[w] = word_features(w)
            has.update(f)
        flat.append(np.array(sorted(has), np.int32))
        starts.append(starts[-1] + len(has))
    return np.concatenate(flat), np.array(starts, np.int64)


class Rows:
    """Texts as sparse rows: which features each has, of those in ``kept`` (positions in the weights). Products run over SLICE features at a time."""

    def __init__(self, flat, starts, kept):
        self.n, self.width = len(starts) - 1, len(kept)
        place = np.full(1 << BITS, -1, np.int32)
        place[kept] = np.arange(len(kept), dtype=np.int32)
        col, sizes = [np.empty(0, np.int32)], np.zeros(self.n, np.int64)
        self.cuts = [0]  # whole texts, about SLICE features of them
        while self.cuts[-1] < self.n:
            lo = self.cuts[-1]
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + SLICE, "right")) - 1)
            part = place[flat[starts[lo] : starts[hi]]]
            sizes[lo:hi] = np.diff(np.concatenate([[0], np.cumsum(part >= 0)])[starts[lo : hi + 1] - starts[lo]])
            col.append(part[part >= 0])
            self.cuts.append(hi)
        self.col, self.at = np.concatenate(col), np.concatenate([[0], np.cumsum(sizes)])

    def slices(self):
        for lo, hi in zip(self.cuts, self.cuts[1:], strict=False):
            at = self.at[lo : hi + 1]
            yield lo, hi, self.col[at[0] : at[-1]], np.repeat(np.arange(hi - lo, dtype=np.int32), np.diff(at))

    def dot(self, w):
        out = np.empty(self.n)
        for lo, hi, col, row in self.slices():
            out[lo:hi] = np.bincount(row, w[col], hi - lo)
        return out

    def back(self, g):
        out = np.zeros(self.width)
        for lo, hi, col, row in self.slices():
            out += np.bincount(col, g[lo:hi][row], self.width)
        return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def loss(z):
    """log(1 + exp(z)), the logistic loss of a negative."""
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def train(p: tuple, u: tuple, prior: float, epochs: int = 200, rate: float = 0.05, shrink: float = 2e-4, least: int = 3) -> dict[int, float]:
    """Weights by feature, -1 for the constant: Adam on the non-negative risk, with a soft threshold after each step.

    p and u are what sparse() returns. Features of fewer than ``least`` sampled texts get no weight.
    """
    known = np.bincount(p[0], minlength=1 << BITS) + np.bincount(u[0], minlength=1 << BITS)
    kept = np.flatnonzero(known >= least)
    p, u = Rows(*p, kept), Rows(*u, kept)
    w = np.zeros(len(kept) + 1)
    m, v = w.copy(), w.copy()
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, epochs + 1):
        zp, zu = p.dot(w) + w[-1], u.dot(w) + w[-1]
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = loss(zu).mean() - prior * loss(zp).mean()
        on_p, on_u = -prior * sp / p.n, su / u.n  # slopes of that
        on_p, on_u = (on_p + prior * (sp - 1) / p.n, on_u) if negative >= 0 else (-on_p, -on_u)
        g = np.append(p.back(on_p) + u.back(on_u), on_p.sum() + on_u.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
        w = w - step * (m / (1 - 0.9**t))
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - step[:-1] * shrink, 0)
    out = {int(f): float(x) for f, x in zip(kept, w, strict=False) if x}
    out[-1] = float(w[-1])
    return out


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, positives: int, unlabelled: int):
    """(P and U as sparse() gives them, or None if there is no text of one of them; rate of toxic labels, 0 without labels)."""
    known = labels.filter(F.col(doc_id).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max("toxic").alias("toxic")).filter(fold(F.col("_id")) != 0)
    first = F.xxhash64("_id"), F.col("_id")
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double")).alias("p")).first()["p"] or 0.0
    if not 0 < prior < 1:
        return None, prior
    p = known.filter("toxic = 1").select("_id", F.lit(1).alias("_kind")).orderBy(*first).limit(positives)
    u = docs.select(F.col(doc_id).alias("_id")).filter(F.col("_id").isNotNull() & (fold(F.col("_id")) != 0)).groupBy("_id").agg(F.lit(0).alias("_kind")).orderBy(*first).limit(unlabelled)
    chosen = saved(p.unionAll(u), "toxicity-sample")  # positives + unlabelled rows at most
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_kind", "_text")

    def features(batches):
        for b in batches:
            got = [sparse([t])[0].tobytes() for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_kind"), pa.array(got, pa.binary())], names=["_id", "_kind", "f"])

    found = rows.mapInArrow(features, f"_id {dict(chosen.dtypes)['_id']}, _kind int, f binary")
    # Both kinds together are at most positives + unlabelled texts of at most 2**BITS features; each is read on its own.
    found = saved(found.groupBy("_id", "_kind").agg(F.min("f").alias("f")), "toxicity-features")
    out = []
    for kind in (1, 0):
        flat, starts = [np.empty(0, np.int32)], [0]
        for r in found.filter(F.col("_kind") == kind).sort("_id").select("f").toLocalIterator():
            flat.append(np.frombuffer(bytes(r["f"]), np.int32))
            starts.append(starts[-1] + len(flat[-1]))
        out.append((np.concatenate(flat), np.array(starts, np.int64)))
    discard(found)
    return out if all(len(s) > 1 for _, s in out) else None, prior


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", positives: int = 2000, unlabelled: int = 4000) -> DataFrame:
    """``docs`` with tox_score (a column of that name is replaced)."""
    docs = docs.drop("tox_score")
    got, prior = sample(docs, labels, doc_id, text, positives, unlabelled)
    if got is None:
        return docs.withColumn("tox_score", F.lit(float(prior)))
    trained = train(*got, prior)
    del got
    sent = docs.sparkSession.sparkContext.broadcast(trained)  # at most 2**BITS weights

    def task(batches, text=text):
        weights, memo = sent.value, {}
        for b in batches:
            z = np.empty(b.num_rows)
            for i, t in enumerate(b.column(text).to_pylist()):
                has: set[int] = set()
                for w in text_words(t):
                    f = memo.get(w)
                    if f is None:
                        if len(memo) > 400_000:
                            memo.clear()
                        f = memo[w] = tuple(x for x in word_features(w) if x in weights)
                    has.update(f)
                z[i] = weights[-1] + sum(weights[x] for x in sorted(has))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sigmoid(z))], names=[*b.schema.names, "tox_score"])

    return docs.mapInArrow(task, StructType([*docs.schema.fields, StructField("tox_score", DoubleType())]))


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scored(docs, table(spark, sf_dir, "labels"))
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))
