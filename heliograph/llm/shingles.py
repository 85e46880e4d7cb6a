"""Word n-grams as 64-bit hashes, and the most frequent ones of a corpus.

The list of frequent n-grams only serves to order n-grams, rare ones first. Any list gives right results, as long as all
tasks use the same; a good one keeps passages that many documents share from making one key hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hashed_words, ngram_hashes, saved

#: A task names n-grams that it sees this often within so many n-grams; so many are kept in all.
LOCAL_COUNT, LOCAL_GRAMS, KEPT = 12, 1_000_000, 65_536


def shingle_sets(column, n: int, lower: bool):
    """For each text of an Arrow column its distinct n-grams in order of hash; a shorter text is one n-gram of its own, an empty one has none."""
    for h, at in hashed_words(column, lower):
        grams = ngram_hashes(h, n)
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if hi - lo >= n:
                yield np.unique(grams[lo : hi - n + 1])
            elif hi > lo:
                yield ngram_hashes(h[lo:hi], hi - lo)
            else:
                yield np.empty(0, np.uint64)


class Counter:
    """Names the n-grams that a task sees often. It holds LOCAL_GRAMS at most, and one text."""

    def __init__(self, least: int = LOCAL_COUNT):
        self.held, self.size, self.least = [], 0, least

    def add(self, s: np.ndarray) -> bool:
        """True once counted() is due."""
        self.held.append(s)
        self.size += len(s)
        return self.size >= LOCAL_GRAMS

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        gram, count = np.unique(np.concatenate([np.empty(0, np.uint64), *self.held]), return_counts=True)
        self.held, self.size = [], 0
        many = count >= self.least
        return gram[many].view(np.int64), count[many].astype(np.int64)


def most_frequent(rows: DataFrame, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of the n-grams that the tasks have named (gram, n) most often: those of the highest counts, taken in
    steps of a quarter octave, as far as ``kept`` allows. Only that many rows and a short list of steps reach the driver."""
    total = saved(rows.groupBy("gram").agg(F.sum("n").alias("n")), "ngram-counts")
    step = F.floor(4 * F.log2("n")).cast("int")
    sizes = {r["step"]: r["count"] for r in total.groupBy(step.alias("step")).count().collect()}
    least, held = 1 << 20, 0
    for k in sorted(sizes, reverse=True):
        held += sizes[k]
        if held > kept:
            break
        least = k
    got = total.filter(step >= least).toArrow()
    discard(total)
    gram, count = got.column("gram").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(gram)
    return gram[order], count[order]


def frequent(docs: DataFrame, text: str, n: int, lower: bool, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """The same for a table of texts. All texts are read; the list that comes to the driver is bounded by ``kept``."""

    def task(batches):
        counter = Counter()
        for b in batches:
            for s in shingle_sets(b.column(0), n, lower):
                if counter.add(s):
                    yield _named(counter)
        yield _named(counter)

    def _named(counter):
        gram, count = counter.counted()
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(count)], names=["gram", "n"])

    return most_frequent(docs.select(text).mapInArrow(task, "gram long, n long"), kept)


def weights(grams: np.ndarray, listed: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each n-gram its count in the list, 0 if it isn't there."""
    known, count = listed
    if not len(known) or not len(grams):
        return np.zeros(len(grams), np.int64)
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    return np.where(known[at] == grams, count[at], 0)
