"""Operator 4: Jaccard join of word n-gram sets by T-occurrence search.

Two sets link when 100 * |both| >= percent * |either|. Texts with equal sets are one class, found by a fingerprint of the
set. Classes are brought together in families, then each family is searched for all its links.

Families: sets that can link share an n-gram among the first of each (its head; n-grams in a common order, frequent ones
last), so heads are grouped by n-gram. A group of up to GROUP sets gives its pairs, and their common head n-grams are counted:
of two heads, the one that ends first in the common order has every common n-gram up to its end in both, so the overlap is
at most that count and what follows this head; it is also at most that count and what either set has behind their last common one. Pairs
that can still reach their overlap are edges. A larger group is joined to one of its sets instead, so two sets that share such an n-gram are
in one family whatever their count. Components of all edges are the families. Large families are told once more, from heads in an order
that has the n-grams of larger groups last: sets that such a passage alone brought together come apart.

Links: a family's sets are indexed by inverted lists over their n-grams, and each set is a query: the longest lists are set
aside (DivideSkip), the short ones merged on a heap with skips, what they leave is probed in the long lists by bisection, and
sets that reach their overlap are retained. A large family is cut by size (sets more than one band apart can't link) and by hash into
slots of bounded size, and each two slots that can link are searched in a task of their own. No pairs leave a task: for each
set it returns how many links it has there and the least set that these links connect it to.

Sizes: tasks hold one n-gram's group up to GROUP rows, or two slots (SLOT_GRAMS each, or one longer text). An n-gram that many
sets share but that no task has named (see shingles) makes one family of them; such a family costs what its slots do, with the square of its size.

Defined results: a text with fewer than n words has one n-gram, the whole; without words, or null, it has none and links
with nothing; a null id takes no part and has a null component; repeated rows are in one class and all reported; rows that share
an id but not a text are told apart by their sets; very long texts are read whole; which of several equal texts stands for a class
changes nothing; other columns are not read, so their names can't clash; an empty table gives an empty result. Fingerprints are 64-bit.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import marked, saved, table
from .components import components
from .shingles import Counter, most_frequent, shingle_sets, weights

N, PERCENT = 5, 75
#: An n-gram is named to the common order if a task sees it this often among LOCAL_GRAMS.
NAMED = 3
#: Sets of a group of which all pairs are counted.
GROUP = 128
#: Parts of a head that the place of an n-gram is told by.
LEVELS = 16
#: Rows of the grouped heads that are looked at together.
ROWS = 200_000
#: Fixed-width rows (some 100 bytes each in memory) to a broadcast.
BROADCAST_ROWS = 200_000
#: A slot of a family holds about so many n-grams, where each set counts for ROW_GRAMS more; smaller families are searched whole.
SLOT_GRAMS, ROW_GRAMS = 100_000, 250
_SLOTS = 1 << 32  # more than a band has


def ceil_div(a, b):
    return -(-a // b)


def least_overlap(n, percent):
    """Of a set of n with any set that it can link to."""
    return ceil_div(percent * n, 100)


def pair_overlap(n, m, percent):
    """Common n-grams that sets of n and m need: both >= percent / (100 + percent) * (n + m)."""
    return ceil_div(percent * (n + m), 100 + percent)


def fingerprint(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


# T-occurrence search.


def merged(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """(id, count) of the ids on at least ``least`` of the sorted lists: merged on a heap; ids that can't get there are skipped."""
    if least <= 0:
        least = 1
    heap = [(x[0], k) for k, x in enumerate(lists) if x]
    heapq.heapify(heap)
    at, out = [0] * len(lists), []
    while len(heap) >= least:
        first, popped = heap[0][0], []
        while heap and heap[0][0] == first:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            out.append((first, len(popped)))
            for k in popped:
                at[k] += 1
                if at[k] < len(lists[k]):
                    heapq.heappush(heap, (lists[k][at[k]], k))
            continue
        while heap and len(popped) < least - 1:
            popped.append(heapq.heappop(heap)[1])
        if not heap:
            break
        goal = heap[0][0]  # a smaller id is on the popped lists alone, which are too few
        for k in popped:
            at[k] = bisect_left(lists[k], goal, at[k])
            if at[k] < len(lists[k]):
                heapq.heappush(heap, (lists[k][at[k]], k))
    return out


class Lists:
    """Inverted lists of some sets, each in order of hash: the sets that hold an n-gram, by index."""

    def __init__(self, sets: list[np.ndarray]):
        self.k, self.sizes = len(sets), np.array([len(s) for s in sets])
        gram, owner = np.concatenate(sets), np.repeat(np.arange(self.k), self.sizes)
        order = np.argsort(gram, kind="stable")
        gram, self.owner = gram[order], owner[order]
        new = np.append(True, gram[1:] != gram[:-1])
        self.start = np.append(np.flatnonzero(new), len(gram))
        self.gram = gram[self.start[:-1]]
        self.place = (np.cumsum(new) - 1) * self.k + self.owner  # (list, set) as one number, in order

    def search(self, query: np.ndarray, percent: int = PERCENT, mu: float = 0.01) -> np.ndarray:
        """Indexes of the sets that link to the query."""
        none, n = np.empty(0, np.int64), len(query)
        fits = 100 * np.minimum(n, self.sizes) >= percent * np.maximum(n, self.sizes)
        if not n or not fits.any():
            return none
        need = pair_overlap(n, self.sizes, percent)
        least = int(need[fits].min())
        at = np.minimum(np.searchsorted(self.gram, query), len(self.gram) - 1)
        at = at[self.gram[at] == query]
        if len(at) < least:
            return none
        length = self.start[at + 1] - self.start[at]
        at = at[np.argsort(-length, kind="stable")]
        long = min(least - 1, int(least / (mu * log2(int(length.max())) + 1)))
        ends = zip(self.start[at[long:]].tolist(), self.start[at[long:] + 1].tolist(), strict=True)
        found = merged([self.owner[lo:hi].tolist() for lo, hi in ends], least - long)
        if not found:
            return none
        ids, count = np.array(found).T
        stays = fits[ids] & (count + long >= need[ids])
        ids, count = ids[stays], count[stays]
        for lo in range(0, long, 64):  # after each few lists, what can't get there any more goes
            if not len(ids):
                break
            some = at[lo : min(lo + 64, long)]
            asked = some[:, None] * self.k + ids
            where = np.minimum(np.searchsorted(self.place, asked), len(self.place) - 1)
            count = count + (self.place[where] == asked).sum(axis=0)
            stays = count + long - lo - len(some) >= need[ids]
            ids, count = ids[stays], count[stays]
        return ids


def t_occurrence(query: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """Indexes of the sets that link to the query. All are in order of hash."""
    sets = [s if len(s) else np.zeros(0, np.uint64) for s in sets]
    return Lists(sets).search(query, percent).tolist() if any(len(s) for s in sets) else []


def linked(first: dict[int, np.ndarray], second: dict[int, np.ndarray] | None, percent: int) -> list[tuple[int, int, int]]:
    """(name, least name that links lead to, links) of the sets that have links between the two sides, or within the first alone."""
    names = [*first, *(second or ())]
    lists, shift = Lists(list((first if second is None else second).values())), 0 if second is None else len(first)
    up, links = list(range(len(names))), [0] * len(names)

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for q, s in enumerate(first.values()):
        hits = (lists.search(s, percent) + shift).tolist()
        for x in hits:
            if x != q:
                links[q] += 1
                if second is not None:
                    links[x] += 1
                a, b = top(q), top(x)
                if a != b:
                    a, b = (a, b) if names[a] < names[b] else (b, a)
                    up[b] = a
    return [(name, names[top(x)], links[x]) for x, name in enumerate(names) if links[x]]


# Families.


_SURVEY = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("gram", pa.int64())])


def surveyed(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """One reading of all texts: doc_id, n, sig (size and fingerprint of each set) where gram is null, else a frequent gram and its count n."""

    def task(batches):
        counter = Counter(NAMED)

        def named():
            gram, count = counter.counted()
            none = pa.nulls(len(gram), pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.array(count), none, pa.array(gram)], schema=_SURVEY)

        for b in batches:
            sizes, sigs = [], []
            for s in shingle_sets(b.column("text"), n, True):
                sizes.append(len(s))
                sigs.append(fingerprint(s))
                if counter.add(s):
                    yield named()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()), pa.nulls(len(sizes), pa.int64())], schema=_SURVEY)
        yield named()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(task, "doc_id long, n long, sig long, gram long")


def heads(docs: DataFrame, text: str, n: int, percent: int, listed) -> DataFrame:
    """gram, sig, size: the first n-grams of each set, in the common order; size is LEVELS times its number of n-grams, and the part of the
    head that this one is in, which compresses better than its place. Equal sets within a task are given once."""
    sent = docs.sparkSession.sparkContext.broadcast(listed)  # bounded by the list's length

    def task(batches):
        seen, known = set(), sent.value
        for b in batches:
            out, size = [], 0
            for s in shingle_sets(b.column(0), n, True):
                if not len(s) or (sig := fingerprint(s)) in seen:
                    continue
                if len(seen) > 300_000:
                    seen.clear()
                seen.add(sig)
                k = len(s) - least_overlap(len(s), percent) + 1
                w = weights(s, known)
                out.append((s[:k] if not w.any() else s[np.argsort(w, kind="stable")[:k]], sig, len(s)))
                size += k
                if size > 500_000:
                    yield rows(out)
                    out, size = [], 0
            if out:
                yield rows(out)

    def rows(out):
        k = [len(x[0]) for x in out]
        size = np.concatenate([x[2] * LEVELS + np.arange(m) * LEVELS // m for x, m in zip(out, k, strict=True)])
        columns = np.concatenate([x[0] for x in out]).view(np.int64), np.repeat(np.array([x[1] for x in out], np.int64), k), size
        return pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["gram", "sig", "size"])

    return docs.select(text).mapInArrow(task, "gram long, sig long, size long")


def lacking(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """How many common n-grams of heads two sets need, as far as one of them tells (sizes as heads() gives them, there)."""

    def rest(n, part):  # behind the first of that part
        return n - 1 - ceil_div(part * (n - least_overlap(n, percent) + 1), LEVELS)

    (n, p), (m, q) = np.divmod(x, LEVELS), np.divmod(y, LEVELS)
    after = np.maximum(least_overlap(n, percent), least_overlap(m, percent)) - 1
    return np.maximum(pair_overlap(n, m, percent) - np.minimum(after, np.minimum(rest(n, p), rest(m, q))), 0)


def meetings(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, lack), a < b: the pairs of sets whose sizes can link, once for each small group that they share, with what they lack there; for
    larger groups each set with one of the group and -1. A large group's n-gram a and a number b of its sets come with -2. Groups come in
    order and are streamed; of a large one a single row is held."""
    size, many = GROUP, ROWS

    def task(batches):
        def given(a, b, lack, ordered=True):
            turn = (a > b) & ordered
            pair = np.where(turn, b, a), np.where(turn, a, b), lack.astype(np.int32)
            return pa.RecordBatch.from_arrays([*map(pa.array, pair)], names=["a", "b", "lack"])

        def pairs(gram, sig, n):
            for d in range(1, size):  # rows that stand d apart
                near = np.flatnonzero(gram[d:] == gram[:-d])
                if not len(near):
                    return
                x, y = n[near] // LEVELS, n[near + d] // LEVELS
                near = near[100 * np.minimum(x, y) >= percent * np.maximum(x, y)]
                if len(near):
                    yield given(sig[near], sig[near + d], lacking(n[near], n[near + d], percent))

        def looked_at(held, hot, last):
            """Gives what whole groups have; returns the rows that wait, and their n-gram if its group is known to be large."""
            gram, sig, n = (np.concatenate(x) for x in zip(*held, strict=True))
            new = np.append(True, (gram[1:] != gram[:-1]) | (sig[1:] != sig[:-1]))
            gram, sig, n = gram[new], sig[new], n[new]
            start = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            count = np.diff(np.append(start, len(gram)))
            large = (count > size) | (gram[start] == hot if hot is not None else False)
            if large.any():
                of = np.repeat(large, count)
                first = np.repeat(start, count)
                far = np.flatnonzero(of & (first != np.arange(len(gram))))
                if len(far):
                    yield given(sig[far], sig[first[far]], np.full(len(far), -1))
                yield given(gram[start[large]], count[large], np.full(int(large.sum()), -2), False)
            whole = (count > 1) & ~large
            waits = None
            if not last:
                whole[-1] = False
                lo = int(start[-1])
                hi = lo + 1 if large[-1] else len(gram)
                waits = (gram[lo:hi], sig[lo:hi], n[lo:hi]), int(gram[-1]) if large[-1] else None
            own = np.repeat(whole, count)
            yield from pairs(gram[own], sig[own], n[own])
            return waits

        held, hot, rows = [], None, 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(tuple(b.column(c).to_numpy() for c in ("gram", "sig", "size")))
            rows += b.num_rows
            if rows >= many:
                kept, hot = yield from looked_at(held, hot, False)
                held, rows = [kept], len(kept[0])
        if held:
            yield from looked_at(held, hot, True)

    return rows.repartition("gram").sortWithinPartitions("gram", "sig").mapInArrow(task, "a long, b long, lack int")


def related(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, large): edges between sets that can link, or that are in one large group; every link lies inside a component of these. Where
    large, no edge but the n-gram of a large group, and how many sets it has."""
    large = F.col("lack") == -2
    counted = meetings(rows, percent).groupBy("a", F.when(~large, F.col("b")).alias("b"))
    counted = counted.agg(F.count(F.lit(1)).alias("c"), F.min("lack").alias("least"), F.max("lack").alias("lack"), F.sum(F.when(large, F.col("b"))).alias("sets"))
    return counted.filter((F.col("least") < 0) | (F.col("c") >= F.col("lack"))).select("a", F.coalesce("b", "sets").alias("b"), F.col("b").isNull().alias("large"))


def with_list(listed, more):
    """A list of n-grams and counts, and another one's: where both have an n-gram, its highest count."""
    gram, count = (np.concatenate(x) for x in zip(listed, more, strict=True))
    by = np.lexsort((-count, gram))
    gram, count = gram[by], count[by]
    new = np.append(True, gram[1:] != gram[:-1])[: len(gram)]
    return gram[new], count[new]


def families(classes: DataFrame, docs: DataFrame, doc_id: str, text: str, n: int, percent: int, listed) -> DataFrame:
    """family, sig, first_id, n of the classes (sig, first_id, n) that may have links; all links are inside a family."""

    def told(docs, listed, of, name):
        edges = saved(related(heads(docs, text, n, percent, listed), percent), f"{name}-edges")
        found = components(edges.filter("not large"))
        member = saved(of.join(found.select(F.col("v").alias("sig"), F.col("label").alias("family")), "sig"), name)
        return member, edges.filter("large").select(F.col("a").alias("gram"), F.col("b").alias("n"))

    member, hot = told(docs, listed, classes, "jaccard-member")
    more = most_frequent(hot)
    if not len(more[0]):
        return member
    large = saved(member.groupBy("family").agg(F.sum(F.col("n") + ROW_GRAMS).alias("total")).filter(F.col("total") > SLOT_GRAMS).select("family"), "jaccard-wide")
    if large.isEmpty():
        return member
    own = saved(member.join(large, "family").select("sig", "first_id", "n"), "jaccard-again")
    rows = marked(docs.select(F.col(doc_id).cast("long").alias(doc_id), text), F.col(doc_id), own.select("first_id"), "_met").filter("_met")
    again, _ = told(rows, with_list(listed, more), own, "jaccard-apart")
    return member.join(large, "family", "left_anti").unionByName(again)


# Links.


def bands(percent: int) -> list[int]:
    """Least sizes of bands: a set can link to sets of its own band and of the two beside it alone."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // percent + 1)
    return out


def placed(member: DataFrame, percent: int) -> DataFrame:
    """family, i, j, slot, sig, first_id from member (family, sig, first_id, n): each set once for every two slots (i, j) that it is searched in."""
    member = member.withColumn("weight", (F.col("n") + ROW_GRAMS).cast("long"))
    large = saved(member.groupBy("family").agg(F.sum("weight").alias("total")).filter(F.col("total") > SLOT_GRAMS).select("family"), "jaccard-large")
    columns = "family", "i", "j", "slot", "sig", "first_id"
    zero = F.lit(0).cast("long")
    small = member.join(large, "family", "left_anti").select("family", zero.alias("i"), zero.alias("j"), zero.alias("slot"), "sig", "first_id")
    if large.isEmpty():
        return small
    band = F.size(F.filter(F.array(*map(F.lit, bands(percent))), lambda b: b <= F.col("n"))).cast("long")
    own = saved(member.join(large, "family").withColumn("band", band), "jaccard-banded")
    parts = saved(own.groupBy("family", "band").agg(F.ceil(F.sum("weight") / F.lit(SLOT_GRAMS)).cast("long").alias("parts")), "jaccard-parts")
    for name, by in (("before", 1), ("behind", -1)):
        beside = parts.select("family", (F.col("band") + by).alias("band"), F.col("parts").alias(name))
        own = own.join(beside, ["family", "band"], "left")
    own = own.join(parts, ["family", "band"]).withColumn("slot", F.col("band") * _SLOTS + F.pmod(F.xxhash64("sig"), F.col("parts")))

    def slots(count, band):
        every = F.transform(F.sequence(zero, F.greatest(F.coalesce(count, F.lit(1)) - 1, zero)), lambda q: band * _SLOTS + q)
        return F.when(count.isNotNull(), every).otherwise(F.array().cast("array<long>"))

    others = F.concat(slots(F.col("parts"), F.col("band")), slots(F.col("before"), F.col("band") - 1), slots(F.col("behind"), F.col("band") + 1))
    dealt = own.select("family", "slot", "sig", "first_id", F.explode(others).alias("o"))
    return small.unionByName(dealt.withColumn("i", F.least("slot", "o")).withColumn("j", F.greatest("slot", "o")).select(*columns))


def few(rows: DataFrame) -> bool:
    return rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def found_links(member: DataFrame, docs: DataFrame, doc_id: str, text: str, n: int, percent: int) -> DataFrame:
    """sig, least, n_links of the sets that have links, once for each two slots: how many there, and the least set that they lead to. A
    text whose set is not that of its class (another row of the same id) is passed over."""
    needed = saved(placed(member, percent), "jaccard-needed")
    rows = docs.select(F.col(doc_id).cast("long").alias("first_id"), F.col(text).alias("text"))
    if few(needed):
        rows = rows.join(F.broadcast(needed), "first_id")
    else:  # texts that are in no family stay where they are
        rows = marked(rows, F.col("first_id"), needed.select("first_id"), "_met").filter("_met").drop("_met").join(needed, "first_id")
    texts = rows.select("family", "i", "j", "slot", "sig", "text")

    def task(batches):
        at, sides = None, {}

        def searched():
            if at is None or not all(sides.get(k) for k in at[1:]):
                return
            got = linked(sides[at[1]], None if at[1] == at[2] else sides[at[2]], percent)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*got, strict=True)], names=["sig", "least", "n_links"])

        for b in batches:
            own = (b.column(c).to_pylist() for c in ("family", "i", "j", "slot", "sig"))
            for family, i, j, slot, sig, s in zip(*own, shingle_sets(b.column("text"), n, True), strict=True):
                if (family, i, j) != at:
                    yield from searched()
                    at, sides = (family, i, j), {}
                if fingerprint(s) == sig:
                    sides.setdefault(slot, {})[sig] = s
        yield from searched()

    return texts.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(task, "sig long, least long, n_links long")


def with_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (least id with an equal set), n_links (how many other classes its set links to),
    component_id."""
    return labelled_sets(docs, doc_id, text, n, percent).select("doc_id", "n_shingles", "class_id", "n_links", "component_id")


def labelled_sets(docs: DataFrame, doc_id: str, text: str, n: int, percent: int) -> DataFrame:
    """with_components, with sig (fingerprint of the set) and label (the same for all sets of a component)."""
    survey = saved(surveyed(docs, doc_id, text, n), "jaccard-survey")
    sized = survey.filter("gram is null").select("doc_id", "n", "sig")
    listed = most_frequent(survey.filter("gram is not null").select("gram", "n"))
    known = docs.filter(F.col(doc_id).isNotNull())
    classes = saved(sized.filter("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n")), "jaccard-classes")
    member = saved(families(classes, known, doc_id, text, n, percent, listed), "jaccard-families")
    found = saved(found_links(member, known, doc_id, text, n, percent), "jaccard-links")
    degree = found.groupBy(F.col("sig").alias("s")).agg(F.sum("n_links").alias("n_links"))
    labels = components(found.select(F.col("sig").alias("a"), F.col("least").alias("b"))).withColumnRenamed("v", "sig")
    inside = saved(member.select("sig", "first_id").join(labels, "sig").join(degree, F.col("sig") == F.col("s")).select("sig", "first_id", "label", "n_links"), "jaccard-inside")
    least = inside.groupBy(F.col("label").alias("l")).agg(F.min("first_id").alias("component"))
    inside = inside.join(least, inside.label == least.l).select(F.col("sig").alias("s"), "label", "n_links", "component")
    whole = saved(classes.join(inside, F.col("sig") == F.col("s"), "left").select(F.col("sig").alias("_sig"), F.col("first_id").alias("class_id"), "label", "n_links", "component"), "jaccard-whole")
    joined = sized.join(whole, (F.col("sig") == F.col("_sig")) & (F.col("n") > 0), "left")
    own = F.col("doc_id").isNotNull()
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(own, F.coalesce("class_id", "doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(own, F.coalesce("component", "class_id", "doc_id")).alias("component_id"), "sig", F.coalesce("label", "sig").alias("label"),
    )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their component; rows without an id stay. Rows that share an id are judged each by its
    own set: those in one component (equal sets, or linked ones) stay once, others beside each other. Of these the row with the least text stays, of equal texts the
    one whose row is least as JSON."""
    found = saved(labelled_sets(docs, doc_id, text, n, percent), "jaccard-found")
    if found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        gone = saved(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")), "jaccard-gone")
        if few(gone):
            return docs.join(F.broadcast(gone), F.col(doc_id) == F.col("_gone"), "left_anti")
        rows = marked(docs, F.col(doc_id).cast("long"), gone, "_met")  # rows that certainly stay are not moved
        return rows.filter("not _met").unionAll(rows.filter("_met").join(gone, F.col(doc_id) == F.col("_gone"), "left_anti")).drop("_met")
    several = found.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    judged = found.filter("doc_id is not null").join(several, "doc_id").filter("rows > 1 or doc_id <> component_id")
    judged = saved(judged.select(F.col("doc_id").alias("_id"), F.col("sig").alias("_sig"), F.col("label").alias("_label"), (F.col("doc_id") != F.col("component_id")).alias("_gone"), "rows").distinct(), "jaccard-judged")
    signed = saved(with_signatures(docs, text, n), "jaccard-signed")
    kept = signed.join(F.broadcast(judged) if few(judged) else judged, (F.col(doc_id) == F.col("_id")) & (F.col("_own") == F.col("_sig")), "left").filter("_gone is null or not _gone")
    order = Window.partitionBy("_id", "_label").orderBy(text, F.to_json(F.struct(*(c for c in docs.columns if c != text))))
    repeated = kept.filter("rows > 1").withColumn("_order", F.row_number().over(order)).filter("_order = 1")
    return repeated.select(*docs.columns).unionAll(kept.filter("rows is null").select(*docs.columns))


def with_signatures(docs: DataFrame, text: str, n: int) -> DataFrame:
    """``docs`` with _own, the fingerprint of each row's set."""
    schema = StructType([*docs.schema.fields, StructField("_own", LongType())])

    def task(batches):
        for b in batches:
            own = [fingerprint(s) for s in shingle_sets(b.column(text), n, True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int64())], names=[*b.schema.names, "_own"])

    return docs.mapInArrow(task, schema)


def op4_jaccard(spark, sf_dir):
    return with_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")
