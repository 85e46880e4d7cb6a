"""Operator 6: benchmark decontamination by greedy string tiling.

A text and a benchmark item that share a seed (``least`` consecutive words) are compared by running Karp-Rabin greedy
string tiling: matches of at least the search length are found by rolling hashes over words that are not marked yet, the
longest are marked first as tiles that overlap no other, and the search length falls until ``least``. The share of the
item's words that tiles cover decides, so a passage counts as well when its pieces were moved around. Where a tile covers part of
a match, what it leaves is a match of its own.

Words are runs of letters and digits, lower-cased. The benchmark is dealt with in blocks of bounded size, each broadcast
and run against all texts; with several, what a block gives is written and its broadcast goes before the next one is made.

Defined results: a null or empty text or item covers nothing; an item shorter than ``least`` words is sought whole; a
repeated item id is an item of its own per row, and a pair is reported once with its highest coverage; repeated
documents give a row each in clean() and one pair in contaminated(); of equally long matches the one that starts first in the item, then in the text,
is marked first; very long texts are read whole, and of them only words in shared seeds are tiled; columns other than the two named
on either side are not read, so their names can't clash; an empty table on either side finds nothing. Each BLOCK_BYTES of benchmark text is
one more pass over the documents.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, discard, gathered, long_window_hashes, saved, table

WORD = re.compile(r"\w+")
#: Bytes of benchmark text in one block.
BLOCK_BYTES = 8 << 20
LEAST, COVERAGE = 5, 0.5


def hashed(text: str | None, hasher: WordHasher) -> np.ndarray:
    ws = [w.encode("utf-8", "surrogatepass") for w in WORD.findall(text.lower())] if text else []
    return hasher(ws) if ws else np.empty(0, np.uint64)


def runs(free: np.ndarray, n: int) -> np.ndarray:
    """Starts of runs of n free words."""
    total = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(total[n:] == total[: len(total) - n]) if len(free) >= n else np.empty(0, np.int64)


def matches(a, b, free_a, free_b, n):
    """Maximal matches (length, i, j) of at least n free words, by rolling hashes and then word by word."""
    at_a, at_b = runs(free_a, n), runs(free_b, n)
    if not len(at_a) or not len(at_b):
        return []
    ha, hb = long_window_hashes(a, n)[at_a], long_window_hashes(b, n)[at_b]
    order = np.argsort(ha, kind="stable")
    lo, hi = np.searchsorted(ha[order], hb, "left"), np.searchsorted(ha[order], hb, "right")
    found = []
    done: dict[int, int] = {}  # by diagonal: where its last match ended in b
    for k in np.flatnonzero(hi > lo):
        j = int(at_b[k])
        for i in at_a[order[lo[k] : hi[k]]]:
            i = int(i)
            if done.get(i - j, -1) > j:
                continue
            m = min(len(a) - i, len(b) - j)
            stop = np.flatnonzero((a[i : i + m] != b[j : j + m]) | ~free_a[i : i + m] | ~free_b[j : j + m])
            m = int(stop[0]) if len(stop) else m
            if m >= n:
                found.append((m, i, j))
                done[i - j] = j + m
    return found


def tile(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (length, place in item, place in text), the longest first."""
    free_a, free_b, tiles = np.ones(len(item), bool), np.ones(len(text), bool), []
    n = max(least, min(20, len(item)))
    while True:
        found = sorted(matches(item, text, free_a, free_b, n), key=lambda m: (-m[0], m[1], m[2]))
        if found and found[0][0] > 2 * n:
            n = found[0][0]
            continue
        heapq.heapify(heap := [(-m, i, j) for m, i, j in found])
        while heap:
            m, i, j = heapq.heappop(heap)
            taken = np.flatnonzero(~(free_a[i : i - m] & free_b[j : j - m]))
            if not len(taken):
                free_a[i : i - m] = free_b[j : j - m] = False
                tiles.append((-m, i, j))
                continue
            ends = np.concatenate([[-1], taken, [-m]])  # what the tiles marked before leave of it waits for its turn
            for at, size in zip((ends[:-1] + 1).tolist(), (np.diff(ends) - 1).tolist(), strict=True):
                if size >= n:
                    heapq.heappush(heap, (-size, i + at, j + at))
        if n <= least:
            return tiles
        n = max(least, n // 2)


class Index:
    """Seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple], least: int):
        hasher = WordHasher()
        self.least, self.items = least, [(key, hashed(text, hasher)) for key, text in items]
        self.items = [(key, h) for key, h in self.items if len(h)]
        by: dict[int, tuple[list, list]] = {}
        for k, (_, h) in enumerate(self.items):
            n = min(least, len(h))
            seeds = np.unique(long_window_hashes(h, n))
            by.setdefault(n, ([], []))[0].append(seeds)
            by[n][1].append(np.full(len(seeds), k))
        self.seeds = {}
        for n, (s, k) in by.items():
            s, k = np.concatenate(s), np.concatenate(k)
            order = np.argsort(s, kind="stable")
            self.seeds[n] = s[order], k[order]

    def found(self, h: np.ndarray) -> list[tuple]:
        """(item key, coverage, tiles, longest tile) for the items that share a seed with a text."""
        near: dict[int, list] = {}
        for n, (seeds, owner) in self.seeds.items():
            own = long_window_hashes(h, n)
            lo, hi = np.searchsorted(seeds, own, "left"), np.searchsorted(seeds, own, "right")
            for j in np.flatnonzero(hi > lo):
                for k in owner[lo[j] : hi[j]]:
                    near.setdefault(int(k), []).append(int(j))
        out = []
        for k, at in near.items():
            key, item = self.items[k]
            n = min(self.least, len(item))
            inside = np.zeros(len(h) + 1, bool)  # only words in a shared seed can be in a tile
            for j in at:
                inside[j : j + n] = True
            keep = np.flatnonzero(inside[:-1])
            cut = np.flatnonzero(np.diff(keep) > 1) + 1
            text = np.insert(h[keep], cut, np.arange(len(cut), dtype=np.uint64) + np.uint64(1))  # words that no item has, where something is left out
            tiles = tile(item, text, n)
            out.append((key, sum(m for m, _, _ in tiles) / len(item), len(tiles), max((m for m, _, _ in tiles), default=0)))
        return out


class Blocks:
    """The benchmark cut by hash into ``n`` blocks of about BLOCK_BYTES of text; iterating gives their indexes."""

    def __init__(self, benchmark: DataFrame, item_id: str, text: str, least: int):
        self.least = least
        self.rows = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).filter("text is not null")
        self.n = -(-(self.rows.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0) // BLOCK_BYTES)

    def __iter__(self):
        for k in range(self.n):
            own = self.rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(self.n)) == k) if self.n > 1 else self.rows
            yield Index([(r["item_id"], r["text"]) for r in own.collect()], self.least)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest of each pair that reaches the coverage."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kinds = dict(rows.dtypes)["doc_id"], dict(benchmark.dtypes)[item_id]
    found = f"doc_id {kinds[0]}, item_id {kinds[1]}, coverage double, n_tiles long, longest long"
    cut = Blocks(benchmark, item_id, item_text, least)

    def parts():
        for index in cut:
            sent = rows.sparkSession.sparkContext.broadcast(index)

            def task(batches, sent=sent):
                hasher, index = WordHasher(), sent.value
                for b in batches:
                    ids, got = b.column("doc_id").to_pylist(), []
                    for i, t in enumerate(b.column("text").to_pylist()):
                        got += [(ids[i], *f) for f in index.found(hashed(t, hasher)) if f[1] >= coverage]
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], b.schema.field("doc_id").type), *(pa.array([g[k] for g in got]) for k in range(1, 5))], names=["doc_id", "item_id", "coverage", "n_tiles", "longest"])

            yield rows.mapInArrow(task, found)
            if cut.n > 1:
                sent.destroy()

    if not cut.n:
        return rows.sparkSession.createDataFrame([], found)
    out = gathered(parts(), "contamination-found") if cut.n > 1 else next(parts())
    best = F.max_by(F.struct("coverage", "n_tiles", "longest"), F.struct("coverage", "n_tiles", "longest")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that no item of the benchmark contaminates."""
    cut = Blocks(benchmark, item_id, item_text, least)
    for k, index in enumerate(cut):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def task(batches, sent=sent):
            hasher, index = WordHasher(), sent.value
            for b in batches:
                good = [all(f[1] < coverage for f in index.found(hashed(t, hasher))) for t in b.column(text).to_pylist()]
                yield b.filter(pa.array(good, pa.bool_()))

        left = docs.mapInArrow(task, docs.schema)
        if cut.n > 1:  # each pass is written, so that one block at a time is held
            left = saved(left, "contamination-left")
            sent.destroy()
            if k:
                discard(docs)
        docs = left
    return docs


def op6_decontaminate(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
