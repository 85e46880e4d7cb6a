"""Helpers shared by the corpus operators: shared storage, words, hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD_RE = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only on one machine (tests) is a folder of our own made where that is unset.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="heliograph-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends here, and what is lost with an executor is read anew."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def gathered(parts, name: str) -> DataFrame:
    """The rows of some tables of one schema, one at least, written one after another to one saved table."""
    path = None
    for df in parts:
        path = path or shared_path(df.sparkSession, name)
        df.write.mode("append").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a saved table that nothing reads any more."""
    path = getattr(df, "saved_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


#: Cells of a map of keys (a power of two, 64 at least): a bit each, in a broadcast of an eighth of so many bytes.
MAP_CELLS = 1 << 25


def marked(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """``df`` with a column ``name``: false only where ``key`` is null or not among ``keys`` (one column of the same type). Others are told by
    the key's hash, so some are true as well; a join says which, and has only the true ones to move. The driver gets MAP_CELLS / 64 numbers at most."""
    import pyarrow as pa
    from pyspark.sql.types import BooleanType, LongType, StructField, StructType

    cells = MAP_CELLS
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(cells))
    own = keys.select(cell(F.col(keys.columns[0])).alias("c"))
    bits = own.groupBy(F.shiftright("c", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("c", F.lit(64)).cast("int"))).alias("bits")).toArrow()
    told = np.zeros(cells // 64, np.uint64)
    told[bits.column("at").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    sent = df.sparkSession.sparkContext.broadcast(told)

    def task(batches):
        told = sent.value
        for b in batches:
            c = b.column(b.num_columns - 1)
            at = c.fill_null(0).to_numpy().astype(np.uint64)
            hit = (told[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            hit &= c.is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(hit)], names=b.schema.names[:-1] + [name])

    asked = df.withColumn(name, F.when(key.isNotNull(), cell(key)))
    schema = StructType([*df.schema.fields, StructField(name, BooleanType())])
    assert asked.schema[name].dataType == LongType()
    return asked.mapInArrow(task, schema)


def aside(docs: DataFrame, *names: str):
    """``docs`` with its columns of these names renamed, and a function that gives them their names back."""
    taken = [c for c in docs.columns if c.lower() in names]

    def back(out: DataFrame) -> DataFrame:
        return out.withColumnsRenamed({f"_aside_{c}": c for c in taken})

    return docs.withColumnsRenamed({c: f"_aside_{c}" for c in taken}), back


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)).cast("long"), F.lit(0).cast("long"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def words(text: str | None) -> list[bytes]:
    """The words of a text; splitting bytes cuts at ASCII white space alone, as WORD_RE does."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection that spreads bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words with a bounded memo, and rolling hashes of their n-grams."""

    def __init__(self, memo: int = 400_000):
        import xxhash

        self._of, self._memo, self._max = xxhash.xxh3_64_intdigest, {}, memo

    def __call__(self, ws: list[bytes]) -> np.ndarray:
        memo = self._memo
        try:
            return np.array([memo[w] for w in ws], np.uint64)
        except KeyError:
            if len(memo) > self._max:
                memo.clear()
            of = self._of
            for w in set(ws).difference(memo):
                memo[w] = of(w)
            return np.array([memo[w] for w in ws], np.uint64)


_BASE = 0x9E3779B97F4A7C15


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, from the words' hashes (Horner's rule modulo 2**64, then mixed)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = h[:m].copy()
    base = np.uint64(_BASE)
    for j in range(1, n):
        out *= base
        out += h[j : j + m]
    return mix64(out)


def long_window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The same for long runs, from prefix sums: sum h[i+j] * b**j, freed of the offset by the inverse power."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    powers = np.empty(len(h), np.uint64)
    powers[0] = 1
    if len(h) > 1:
        powers[1:] = _BASE
        np.multiply.accumulate(powers, out=powers)
    total = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(h * powers)])
    inverse = np.empty(m, np.uint64)
    inverse[0] = 1
    if m > 1:
        inverse[1:] = pow(_BASE, -1, 1 << 64)
        np.multiply.accumulate(inverse, out=inverse)
    return mix64((total[n:] - total[:m]) * inverse)


# Words of whole columns, hashed in numpy.

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_AS_IS = np.arange(1, 257, dtype=np.uint64)
_LOWER = _AS_IS.copy()
_LOWER[0x41:0x5B] += np.uint64(32)
_BYTE_BASE = 0xD6E8FEB86659FD93
SLICE_BYTES = 1 << 20
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the byte base and of its inverse, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for base in (_BYTE_BASE, pow(_BYTE_BASE, -1, 1 << 64)):
            p = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p, out=p))
    return _powers[0], _powers[1]


def hashed_words(column, lower: bool = False):
    """(hashes of words, offsets of texts in them) for a few texts of an Arrow string column at a time, in order.

    A word's hash is a polynomial of its bytes, taken from one running sum over the slice's bytes; nulls have no words.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    letters = _LOWER if lower else _AS_IS
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        own, starts = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
        if not len(own):
            yield np.empty(0, np.uint64), np.zeros(len(starts), np.int64)
            continue
        power, inverse = _power_tables(len(own) + 1)
        solid = ~_SPACE[own]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        edge = starts[1:-1]
        edge = edge[(edge > 0) & (edge < len(own))]
        first[edge] = solid[edge]
        last[edge - 1] = solid[edge - 1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        value = letters[own]
        value *= power[: len(own)]
        total = np.empty(len(own) + 1, np.uint64)
        total[0] = 0
        np.add.accumulate(value, out=total[1:])
        h = (total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64)
        yield mix64(h), np.searchsorted(begin, starts)
