"""2880-byte blocks of a FITS file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the FITS standard.
BLOCK, CARD = 2880, 80
CARDS_PER_BLOCK = BLOCK // CARD


def blocks_needed(n: int) -> int:
    return -(-n // BLOCK)


def padded(n: int) -> int:
    return blocks_needed(n) * BLOCK


def padded_column(n: Column) -> Column:
    """The same on the JVM, for catalog columns."""
    return (F.floor((n + (BLOCK - 1)) / F.lit(BLOCK)) * BLOCK).cast("long")


def pad_header(data: bytes) -> bytes:
    return data.ljust(padded(len(data)), b" ")


def pad_data(data: bytes) -> bytes:
    return data.ljust(padded(len(data)), b"\0")


def read_block(stream, index: int) -> bytes:
    stream.seek(index * BLOCK)
    data = stream.read(BLOCK)
    if len(data) != BLOCK:
        from .errors import UnexpectedEof

        raise UnexpectedEof(f"block {index} is not whole")
    return data


def write_block(stream, index: int, data: bytes) -> None:
    if len(data) != BLOCK:
        raise ValueError(f"a block has {BLOCK} bytes, not {len(data)}")
    stream.seek(index * BLOCK)
    stream.write(data)
