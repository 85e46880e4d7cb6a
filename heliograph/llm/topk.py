"""Operator 10: exact top-k by inner product with block-at-a-time pruning.

Components are quantised to floor(scale * x). Each task holds its candidates as ranges of vec_id, cut in blocks; a block
keeps the largest and least value of each component. For a query, the sum over components of the larger of
q * max and q * min bounds every score in a block. Blocks are visited per query from the highest bound, scored through
their forward index (the block's matrix), and a query stops once the next bound is below its k-th score.
A bound that equals the k-th score is still visited, since ties go to the smaller id.

Queries are dealt with in groups of bounded size, each broadcast and run against all rows; only k rows per query and task
are shuffled. Defined results: vectors that are null, or hold null or non-finite components, and rows with a null id take no
part; vectors of another length than the query's are no candidates; repeated ids are separate rows and rank side by side,
and a query skips every row of its own id; very long vectors are whole rows of the index, and a sum beyond 2**53 is taken in integers;
other columns are not read, so their names can't clash; an empty table gives an empty result. The number of passes over the rows
grows with the queries, one for each GROUP_VALUES of their components: the work is queries times rows, less what bounds spare.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import gathered, saved, table

BLOCK = 256
#: Components of one group of queries; 8 bytes each.
GROUP_VALUES = 2_000_000
#: Bounds (a query and a block each) that a task holds at once; 16 bytes each, and a few times that while they are made.
BOUNDS = 1_000_000
_OUT = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """vec_id and q array<long>, for the vectors that take part."""
    v = F.col(embedding)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return vectors.filter(v.isNotNull() & F.col(vec_id).isNotNull() & fine).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q")
    )


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T as exact integers: in doubles where every sum is below 2**53, else in integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def keep_best(scores, ids, k):
    """Per row the k best (score down, id up) of two aligned matrices."""
    if scores.shape[1] <= k:
        order = np.lexsort((ids, -scores), axis=1)
    else:
        cut = -np.partition(-scores, k - 1, axis=1)[:, k - 1]  # everything at the k-th score stays until ids decide
        width = int((scores >= cut[:, None]).sum(axis=1).max())
        first = np.argsort(-scores, axis=1, kind="stable")[:, :width]
        scores, ids = np.take_along_axis(scores, first, 1), np.take_along_axis(ids, first, 1)
        order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


NONE = -(2**62)  # below any score, and safe to negate


def search(q_ids, q, ids, x, k, block=BLOCK):
    """Top k of each query among the rows x (in order of id); arrays query, vec, score. Also the share of blocks visited. Queries are
    taken BOUNDS // blocks at a time, so that their bounds and turns stay small whatever the number of blocks."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    cuts = np.arange(0, len(ids), block)
    high, low = np.maximum.reduceat(x, cuts, axis=0), np.minimum.reduceat(x, cuts, axis=0)
    step = max(1, BOUNDS // len(cuts))
    parts = [_search(q_ids[i : i + step], q[i : i + step], ids, x, k, block, cuts, high, low) for i in range(0, len(q), step)]
    found = [np.concatenate(c) for c in list(zip(*parts, strict=True))[:3]] if parts else [np.empty(0, np.int64)] * 3
    return *found, sum(p[3] for p in parts) / max(1, len(q) * len(cuts))


def _search(q_ids, q, ids, x, k, block, cuts, high, low):
    n = len(ids)
    bound = product(np.maximum(q, 0), high) + product(np.minimum(q, 0), low)
    turn = np.argsort(-bound, axis=1, kind="stable")
    best = np.full((len(q), k), NONE)
    who = np.full((len(q), k), np.iinfo(np.int64).max)
    alive, visited = np.arange(len(q)), 0
    for r in range(len(cuts)):
        at = turn[alive, r]
        alive = alive[bound[alive, at] >= best[alive, k - 1]]
        if not len(alive):
            break
        at = turn[alive, r]
        for b in np.unique(at):
            rows = alive[at == b]
            lo, hi = cuts[b], min(cuts[b] + block, n)
            visited += len(rows)
            s = product(q[rows], x[lo:hi])
            own = q_ids[rows][:, None] == ids[lo:hi][None, :]
            s[own] = NONE
            best[rows], who[rows] = keep_best(np.hstack([best[rows], s]), np.hstack([who[rows], np.where(own, np.iinfo(np.int64).max, ids[lo:hi][None, :])]), k)
    got = best > NONE
    return np.repeat(q_ids, got.sum(axis=1)), who[got], best[got], visited


def matrix(column: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and values by length of the vector."""
    lengths = np.diff(column.offsets.to_numpy())
    flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    return {int(d): (rows := np.flatnonzero(lengths == d), flat[starts[rows][:, None] + np.arange(d)[None, :]]) for d in np.unique(lengths)}


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows of ``vectors``, by score, then by smaller id."""
    spark = vectors.sparkSession
    sc = spark.sparkContext
    rows = quantised(vectors, vec_id, embedding, scale)
    asked = saved(quantised(queries, vec_id, embedding, scale), "topk-queries")
    size = asked.agg(F.sum(F.size("q") + 1).alias("n")).first()["n"] or 0
    groups = max(1, -(-size // GROUP_VALUES))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))

    def parts():
        for g in range(groups):
            own = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g) if groups > 1 else asked
            held: dict[int, list] = {}
            got = own.toArrow()  # one group: about GROUP_VALUES values
            for d, (at, m) in matrix(got.column("q").combine_chunks()).items() if got.num_rows else ():
                held[d] = [got.column("vec_id").to_numpy()[at], m]
            sent = sc.broadcast(held)

            def task(batches, sent=sent, k=k, block=block):
                mine: dict[int, list] = {}
                for b in batches:
                    for d, (at, m) in matrix(b.column("q")).items() if b.num_rows else ():
                        mine.setdefault(d, []).append((b.column("vec_id").to_numpy()[at], m))
                for d, got in mine.items():
                    if d in sent.value and d:
                        q_ids, q = sent.value[d]
                        a, b, s, _ = search(q_ids, q, np.concatenate([i for i, _ in got]), np.concatenate([m for _, m in got]), k, block)
                        for lo in range(0, len(a), 65536):
                            yield pa.RecordBatch.from_arrays([pa.array(v[lo : lo + 65536], pa.int64()) for v in (a, b, s)], names=["query_id", "vec_id", "score"])

            found = rows.mapInArrow(task, _OUT)
            yield found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
            if groups > 1:
                sent.destroy()

    # A query's rows are all in its group; of several groups, each is written and its broadcast goes before the next one is made.
    return gathered(parts(), "topk-found") if groups > 1 else next(parts())


def op10_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"))


OP10_SQL = r"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as q from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
e as (select vec_id, unnest(q) as x, generate_subscripts(q, 1) as i from v),
s as (select a.vec_id as query_id, b.vec_id, sum(a.x * b.x)::bigint as score from e a join e b on a.i = b.i and a.vec_id <> b.vec_id where a.vec_id % 20 = 0 group by 1, 2),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""
