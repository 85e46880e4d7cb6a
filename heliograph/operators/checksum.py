"""DATASUM and CHECKSUM: a ones-complement sum is an associative aggregate, so pieces can be summed anywhere and folded once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import padded
from ..functions.cards import Card, serialize, text_value, upsert
from ..sources import files
from ..sources.hdu import ASCII, read_hdus

MASK = 0xFFFFFFFF
CHUNK = 64 << 20
# Characters that the ASCII form avoids.
_AVOID = set(range(0x3A, 0x41)) | set(range(0x5B, 0x61))


def fold(total: int) -> int:
    """The ones-complement sum of 32-bit words from their plain sum."""
    return 0 if total == 0 else total % MASK or MASK


def fold_column(total: Column) -> Column:
    return F.when(total == 0, F.lit(0).cast("long")).otherwise(F.when(total % MASK == 0, F.lit(MASK)).otherwise(total % MASK)).cast("long")


def add(a: int, b: int) -> int:
    return fold(a + b)


def word_sum(data: bytes) -> int:
    """Plain sum of big-endian words; a rest is filled with zeros."""
    data += b"\0" * (-len(data) % 4)
    return int(np.frombuffer(data, ">u4").sum(dtype=np.uint64))


def checksum(data: bytes) -> int:
    return fold(word_sum(data))


def encode(value: int, complement: bool = False) -> str:
    """16 ASCII characters: each byte as four that add up to it, kept off punctuation, rotated by one."""
    if complement:
        value ^= MASK
    out = np.zeros(16, np.int64)
    for i in range(4):
        byte = value >> (24 - 8 * i) & 0xFF
        parts = [byte // 4 + 0x30] * 4
        parts[0] += byte % 4
        while any(p in _AVOID for p in parts):
            for j in (0, 2):
                if parts[j] in _AVOID or parts[j + 1] in _AVOID:
                    parts[j] += 1
                    parts[j + 1] -= 1
        out[i::4] = parts
    return bytes(np.roll(out, 1).astype(np.uint8)).decode()


def decode(text: str, complement: bool = False) -> int:
    raw = np.roll(np.frombuffer(text.encode("latin-1"), np.uint8).astype(np.int64), -1) - 0x30
    if len(raw) != 16:
        raise ValueError("a checksum has 16 characters")
    value = fold(sum(int(raw[4 * k + i]) << (24 - 8 * i) for k in range(4) for i in range(4)))
    return value ^ MASK if complement else value


def range_sum(path: str, start: int, length: int) -> int:
    """Plain word sum of a byte range, read in pieces."""
    total = 0
    with files.open_read(path) as f:
        f.seek(start)
        while length > 0:
            data = f.read(min(CHUNK, length))
            if not data:
                break
            total += word_sum(data)
            length -= len(data)
    return total


def datasum(hdu) -> int:
    """DATASUM of an HDU's padded data; 0 where the file doesn't hold it."""
    return fold(range_sum(hdu.path, hdu.data_start, padded(hdu.data_len)))


def verify_datasum(hdu) -> bool:
    """True without the keyword."""
    stored = text_value(hdu.cards, "DATASUM")
    return stored is None or stored.strip().isdigit() and int(stored) == datasum(hdu)


def verify_checksum(hdu) -> bool:
    """True without the keyword; else header and data add up to all ones (or nothing)."""
    if text_value(hdu.cards, "CHECKSUM") is None:
        return True
    length = hdu.data_start - hdu.header_start + padded(hdu.data_len)
    return fold(range_sum(hdu.path, hdu.header_start, length)) in (0, MASK)


def stamped(cards: list[Card], total: int) -> list[Card]:
    """Cards with DATASUM and CHECKSUM for data of that plain sum."""
    cards = upsert(cards, "DATASUM", str(fold(total)), "data unit checksum")
    cards = upsert(cards, "CHECKSUM", "0" * 16, "HDU checksum")
    return upsert(cards, "CHECKSUM", encode(fold(word_sum(serialize(cards)) + total), complement=True))


def stamp_file(path: str) -> None:
    """Stamps every HDU of a file, by rewriting it."""
    import uuid

    new = f"{path}.new-{uuid.uuid4().hex}"
    with files.open_write(new) as out:
        for hdu in read_hdus(path):
            out.write(serialize(stamped(hdu.cards, range_sum(path, hdu.data_start, hdu.data_len))))
            with files.open_read(path) as f:
                f.seek(hdu.data_start)
                left = hdu.data_len
                while left:
                    data = f.read(min(CHUNK, left))
                    out.write(data)
                    left -= len(data)
            out.write((b" " if hdu.kind == ASCII else b"\0") * (padded(hdu.data_len) - hdu.data_len))
    files.move(new, path)


def datasums(spark, path: str, piece: int = CHUNK) -> DataFrame:
    """path, hdu_index, datasum: the sum as an aggregation over byte ranges, so one large HDU keeps many tasks busy."""
    import pyarrow as pa

    from .catalog import catalog

    piece -= piece % 2880
    found = catalog(spark, path).select("path", "hdu_index", "data_start", F.when(F.col("data_len") > 0, F.floor((F.col("data_len") + 2879) / 2880) * 2880).otherwise(0).cast("long").alias("n"))
    pieces = found.select("path", "hdu_index", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(piece).cast("long"))).alias("at"), "data_start", "n")

    def task(batches):
        for b in batches:
            rows = b.to_pylist()
            sums = [range_sum(r["path"], r["data_start"] + r["at"], min(piece, r["n"] - r["at"])) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("hdu_index"), pa.array(sums, pa.int64())], names=["path", "hdu_index", "s"])

    sums = pieces.repartition("path", "hdu_index", "at").mapInArrow(task, "path string, hdu_index int, s long")
    return sums.groupBy("path", "hdu_index").agg(fold_column(F.sum("s")).alias("datasum"))


def word_datasum(df: DataFrame, column: str) -> DataFrame:
    """datasum of 32-bit integers as they stand in an image, without bytes: one sum on the JVM."""
    word = F.col(column).cast("long")
    return df.agg(fold_column(F.sum(F.when(word < 0, word + (1 << 32)).otherwise(word))).alias("datasum"))
