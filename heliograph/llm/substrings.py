"""Operator 8: removal of repeated word windows by FM-indexes over shards.

A window is ``length`` consecutive words. Each window has an anchor, the first n-gram in it in a common order (rare ones
before frequent ones), so equal windows have equal anchors in equal places, and the windows of a text that share an
anchor form a run whose words are a region. Anchors that occur once need nothing more. Equal regions are one class:
in all but its least document the whole run is removed. Where an anchor has several classes, one region of each goes to
the anchor's shard. A shard is a compressed FM-index (wavelet matrix over the Burrows-Wheeler transform, bit vectors
packed with block ranks); backward search in it gives the matching statistics of each region, how long a run that ends at a
word also stands elsewhere, up to ``length``. Where they reach it and the interval holds a smaller document, the window is removed. Windows made of frequent n-grams alone lie inside the passage that many documents
share; their regions are equal, so a passage of any frequency comes down to a few classes and no shard is hot.

Defined results: texts of fewer than ``length`` words, empty or null lose nothing; a null id takes no part; what a document
repeats of itself stays; rows that share an id are told apart by their text, and do not remove from each other; of several documents
with a window the least id keeps it, so there are no ties; very long texts are read whole; other columns are not read, so their names can't clash; an
empty table gives an empty result. Words are bytes between ASCII white space, kept as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hashed_words, long_window_hashes, ngram_hashes, saved, table, words
from .shingles import frequent, weights

LENGTH, N = 50, 5
#: Words of one FM-index; a shard is cut between anchors once it has so many.
SHARD_WORDS = 600_000


# The index.


class BitVector:
    """Bits packed in 64-bit words, with the count of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.ones = int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        w = i >> 6
        part = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(part)


class FmIndex:
    """Backward search over a text of symbols from 1; 0 separates and ends."""

    def __init__(self, text: np.ndarray, order: np.ndarray):
        self.order = order  # suffixes in order
        last = text[order - 1]  # Burrows-Wheeler transform
        self.levels = max(1, int(last.max()).bit_length())
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(last, minlength=int(last.max()) + 2))])
        self.bits, self.zeros = [], []
        for k in range(self.levels - 1, -1, -1):
            bit = (last >> k) & 1
            v = BitVector(bit.astype(np.uint8))
            self.bits.append(v)
            self.zeros.append(len(last) - v.ones)
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        self.size = len(order)

        self.origin = self._down(np.arange(len(self.starts) - 1), np.zeros(len(self.starts) - 1, np.int64))

    def _down(self, symbol, i):
        for k, (v, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            ones = v.rank(i)
            i = np.where(one, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform: down the wavelet matrix, less where the symbol's run starts."""
        return self._down(symbol, i) - self.origin[symbol]

    def step(self, symbol, lo, hi):
        """Intervals of the suffixes that start with the symbol and go on as those in lo to hi."""
        base = self.starts[symbol]
        return base + self.rank(symbol, lo), base + self.rank(symbol, hi)

    def statistics(self, text: np.ndarray, ends: np.ndarray, most: int):
        """Matching statistics of the indexed text with itself, by backward search from each place in ``ends``: the length, up to ``most``, of the
        longest run of symbols before it that stands at another place too, and the interval of the suffixes that start with that run."""
        ends = np.asarray(ends)
        length, low, high = np.full(len(ends), most), np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        alive, lo, hi = np.arange(len(ends)), low.copy(), high.copy()
        for k in range(most):
            at = ends[alive] - 1 - k
            symbol = text[at]  # at -1 that is the end, 0
            new_lo, new_hi = self.step(symbol, lo, hi)
            goes_on = (symbol > 0) & (new_hi - new_lo > 1)  # an interval of one holds nothing but the run itself
            stops = alive[~goes_on]
            length[stops], low[stops], high[stops] = k, lo[~goes_on], hi[~goes_on]
            alive, lo, hi = alive[goes_on], new_lo[goes_on], new_hi[goes_on]
            if not len(alive):
                break
        low[alive], high[alive] = lo, hi
        return length, low, high


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes by their first ``depth`` symbols at least (ties by place), by doubling; and the classes of equal beginnings of the
    last length up to ``depth``, with that length."""
    rank = text.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    done = 1
    while done < depth:
        second = np.concatenate([rank[done:], np.zeros(min(done, len(rank)), np.int64)])[: len(rank)]
        key = rank * (int(rank.max()) + 2) + second
        order = np.argsort(key, kind="stable")
        if done * 2 >= depth:
            break
        k = key[order]
        new = np.empty(len(rank), np.int64)
        new[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        rank, done = new, done * 2
    return order, rank, done


def repeated_windows(regions: list[np.ndarray], docs: np.ndarray, length: int) -> list[np.ndarray]:
    """Per region the starts of the windows that also occur in a region of a smaller document."""
    text = np.concatenate([np.append(r, 0) for r in regions])
    order, alike, reach = suffix_order(text, length + 1)
    index = FmIndex(text, order)
    sizes = np.array([len(r) for r in regions])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    count = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(regions)), count)
    local = np.arange(count.sum()) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    at = begin[owner] + local
    twice = np.bincount(alike) > 1  # a window whose first or last words occur once needs no search
    alive = np.flatnonzero(twice[alike[at]] & twice[alike[at + length - min(reach, length)]])
    reached, lo, hi = index.statistics(text, at[alive] + length, length)
    alive, lo, hi = (x[reached == length] for x in (alive, lo, hi))
    out = [np.empty(0, np.int64)] * len(regions)
    if not len(alive):
        return out
    whose = docs[np.searchsorted(begin, index.order, "right") - 1]
    first, back = np.unique(lo, return_inverse=True)  # intervals of windows of one length are equal or apart
    end = np.zeros(len(first), np.int64)
    end[back] = hi
    cuts = np.stack([first, end], axis=1).reshape(-1)
    least = np.minimum.reduceat(np.append(whose, np.iinfo(np.int64).max), cuts)[::2]
    smaller = least[back] < docs[owner[alive]]
    hits, place = owner[alive][smaller], local[alive][smaller]
    order = np.lexsort((place, hits))
    hits, place = hits[order], place[order]
    edges = np.flatnonzero(np.diff(hits)) + 1
    for part, ids in zip(np.split(place, edges), np.split(hits, edges), strict=True):
        if len(ids):
            out[ids[0]] = part
    return out


# Anchors.


def anchored(h: np.ndarray, listed, length: int, n: int):
    """Runs of windows with one anchor: (anchor hash, first window, last window, region hash with the anchor's place)."""
    g = ngram_hashes(h, n)
    w = weights(g, listed).astype(np.uint64)
    key = np.where(w > 0, (np.uint64(1) << np.uint64(63)) | (np.minimum(w, np.uint64(2**30)) << np.uint64(32)) | (g >> np.uint64(32)), g >> np.uint64(1))
    span = length - n + 1
    best, reach = np.arange(len(g)), 1
    while reach * 2 <= span:
        a, b = best[:-reach], best[reach:]
        best, reach = np.where(key[b] < key[a], b, a), reach * 2
    if reach < span:
        a, b = best[: len(best) - (span - reach)], best[span - reach :]
        best = np.where(key[b] < key[a], b, a)
    cuts = np.flatnonzero(np.diff(best)) + 1
    first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(best)]]) - 1
    anchor = best[first]
    powers = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)])  # a plain sum and two rolling hashes tell regions apart
    ends = last + length
    whole = long_window_hashes(h, length)
    region = whole[first] * np.uint64(0x9E3779B97F4A7C15) ^ (whole[last] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F) ^ (powers[ends] - powers[first]).astype(np.uint64)
    region = region + (anchor - first).astype(np.uint64) * np.uint64(0x165667B19E3779F9) + (last - first).astype(np.uint64) * np.uint64(0x27D4EB2F165667C5)
    return g[anchor], first, last, region


def runs(docs: DataFrame, listed, length: int, n: int) -> DataFrame:
    """anchor, region, doc_id, fp, s0, s1: first and last window of each run."""
    sent = docs.sparkSession.sparkContext.broadcast(listed)

    def task(batches):
        for b in batches:
            out, i = [], -1
            ids, fps = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("fp").to_numpy(zero_copy_only=False)
            for h, at in hashed_words(b.column("text")):
                for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    i += 1
                    if hi - lo < length:
                        continue
                    anchor, first, last, region = anchored(h[lo:hi], sent.value, length, n)
                    out.append((anchor.view(np.int64), region.view(np.int64), np.full(len(first), ids[i]), np.full(len(first), fps[i]), first.astype(np.int32), last.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["anchor", "region", "doc_id", "fp", "s0", "s1"])

    return docs.mapInArrow(task, "anchor long, region long, doc_id long, fp long, s0 int, s1 int")


_PIECE = "anchor long, region long, lo int, hi int"


def searched(reps: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Pieces (anchor, region, lo, hi), from the region's start, of the windows that a smaller document has too, by the anchors' shards."""
    asked = saved(reps.groupBy("doc_id", "fp").agg(F.collect_list(F.struct("anchor", "region", "s0", "s1")).alias("runs")), "substring-asked")
    joined = docs.join(asked, ["doc_id", "fp"])

    def cut(batches):
        for b in batches:
            for doc, text, found in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "runs")), strict=True):
                ws = words(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in found], pa.int64()) for c in ("anchor", "region")] + [pa.array([doc] * len(found), pa.int64()), pa.array([b" ".join(ws[r["s0"] : r["s1"] + length]) for r in found], pa.binary())],
                    names=["anchor", "region", "doc_id", "words"],
                )

    def search(batches):
        def shard(rows):
            text = pa.array([b" ".join(r[3] for r in rows)], pa.large_binary()).cast(pa.large_string(), safe=False)
            symbols, ids = np.unique(np.concatenate([h for h, _ in hashed_words(text)]), return_inverse=True)
            parts = np.split(ids + 1, np.cumsum([r[3].count(b" ") + 1 for r in rows])[:-1])
            found = repeated_windows(parts, np.array([r[2] for r in rows]), length)
            out = []
            for (anchor, region, _, _), at in zip(rows, found, strict=True):
                for run in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1) if len(at) else ():
                    out.append((anchor, region, int(run[0]), int(run[-1]) + length))
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64() if i < 2 else pa.int32()) for i in range(4)], names=["anchor", "region", "lo", "hi"])

        rows, size = [], 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("anchor", "region", "doc_id", "words")), strict=True):
                if size > SHARD_WORDS and row[0] != rows[-1][0]:
                    yield shard(rows)
                    rows, size = [], 0
                rows.append(row)
                size += row[3].count(b" ") + 2
        if rows:
            yield shard(rows)

    pieces = joined.select("doc_id", "text", "runs").mapInArrow(cut, "anchor long, region long, doc_id long, words binary")
    return pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(search, _PIECE)


def repeated(docs: DataFrame, length: int = LENGTH, n: int = N) -> DataFrame:
    """doc_id, fp, pieces: array<struct<lo, hi>> of word positions to remove. docs has doc_id, fp and text, no null id."""
    every = saved(runs(docs, frequent(docs, "text", n, lower=False), length, n), "substring-runs")
    shared = saved(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor"), "substring-anchors")
    both = saved(every.join(shared, "anchor"), "substring-shared")
    classes = both.groupBy("anchor", "region").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"))
    classes = saved(classes, "substring-classes")
    several = saved(classes.groupBy("anchor").agg((F.count(F.lit(1)) > 1).alias("several"), F.min("d0").alias("m0"), F.max("d1").alias("m1")).filter("m0 < m1").select("anchor", "several"), "substring-several")
    discard(every)
    ranked = saved(classes.join(several, "anchor"), "substring-ranked")
    placed = saved(both.join(ranked, ["anchor", "region"]), "substring-placed")
    discard(both)
    whole = placed.filter("doc_id > d0").select("doc_id", "fp", F.col("s0").alias("lo"), (F.col("s1") + length).alias("hi"))
    own = placed.filter("several and doc_id = d0")
    # One region of a class is searched; what is found holds for each of its places in that document.
    one = own.groupBy("anchor", "region").agg(F.min("fp").alias("fp"), F.min(F.struct("fp", "s0", "s1")).alias("at"), F.min("doc_id").alias("doc_id"))
    reps = saved(one.select("anchor", "region", "doc_id", "fp", "at.s0", "at.s1"), "substring-reps")
    found = saved(searched(reps, docs, length), "substring-found").withColumnRenamed("lo", "a").withColumnRenamed("hi", "b")
    again = own.join(found, ["anchor", "region"]).select("doc_id", "fp", (F.col("s0") + F.col("a")).alias("lo"), (F.col("s0") + F.col("b")).alias("hi"))
    pieces = whole.unionAll(again)
    return saved(pieces.groupBy("doc_id", "fp").agg(F.collect_list(F.struct("lo", "hi")).alias("pieces")), "substring-pieces")


def with_removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, n: int = N) -> DataFrame:
    """doc_id, n_words, n_removed, kept (binary: the kept words joined by spaces) of each row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("fp", F.xxhash64("text"))
    pieces = repeated(rows.filter("doc_id is not null"), length, n).withColumnRenamed("doc_id", "_doc").withColumnRenamed("fp", "_fp")
    joined = rows.join(pieces, (F.col("doc_id") == F.col("_doc")) & (F.col("fp") == F.col("_fp")), "left").select("doc_id", "text", "pieces")

    def task(batches):
        for b in batches:
            n_words, n_gone, kept = [], [], []
            for t, found in zip(b.column("text").to_pylist(), b.column("pieces").to_pylist(), strict=True):
                ws = words(t)
                if found:
                    edge = np.zeros(len(ws) + 1, np.int64)
                    np.add.at(edge, [p["lo"] for p in found], 1)
                    np.add.at(edge, [p["hi"] for p in found], -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    left = [w for w, s in zip(ws, stays, strict=True) if s]
                else:
                    left = ws
                n_words.append(len(ws))
                n_gone.append(len(ws) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(task, "doc_id long, n_words long, n_removed long, kept binary")


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def op8_substrings(spark, sf_dir):
    return with_removed(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
with w as (select doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, text, unnest(generate_series(1, len(ws)::bigint - 49)) as i, ws from w where len(ws) >= 50 and doc_id is not null),
h as (select doc_id, text, i, md5(array_to_string(ws[i:i + 49], ' ')) as h from s),
m as (select h, min(doc_id) as first_id from h group by h),
g as (select h.doc_id, h.text, h.i from h join m using (h) where m.first_id < h.doc_id),
c as (select distinct doc_id, text, i + j as k from g, (select unnest(range(0, 50)) as j)),
k as (select w.doc_id, w.text, w.ws, coalesce(list(c.k) filter (where c.k is not null), []) as gone from w left join c on w.doc_id = c.doc_id and w.text = c.text group by all)
select doc_id, len(ws)::bigint as n_words, len(gone)::bigint as n_removed,
  sha256(array_to_string(list_filter(ws, lambda x, p: not list_contains(gone, p)), ' ')) as kept_sha256 from k
"""
