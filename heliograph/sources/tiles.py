"""Tile-compressed images: Rice and gzip decoding, in numpy where a block allows, and where tiles lie in the image."""

from __future__ import annotations

import zlib
from math import prod

import numpy as np

from ..functions.cards import find, float_value, int_value, need_int, text_value
from ..functions.errors import DecompressionError, UnsupportedCompression
from .schema import PIXELS, binary_columns

# Fixed values of the Rice coding by bytes of a pixel: bits of the block code, code of a raw block, bits of a raw pixel.
RICE = {1: (3, 6, 8), 2: (4, 14, 16), 4: (5, 25, 32)}


def rice_decode(data: bytes, pixels: int, block: int, size: int) -> np.ndarray:
    """Pixels of a Rice stream as signed 32-bit numbers (unsigned for single bytes). Bits beyond the end count as 0.

    Differences are decoded block by block. All bits of the stream are held as one array, whose ones give the unary parts;
    low bits of a block are then read together.
    """
    if size not in RICE:
        raise UnsupportedCompression(f"Rice with {size} bytes a pixel")
    code_bits, raw_code, raw_bits = RICE[size]
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    if len(bits) < 8 * size:
        raise DecompressionError("the stream ends before its first pixel")
    last = int.from_bytes(data[:size], "big")
    bits = np.concatenate([bits, np.zeros(max(64, pixels * raw_bits // max(1, block) + 4 * raw_bits), np.uint8)])
    ones = np.flatnonzero(bits)
    at = 8 * size
    steps = np.zeros(pixels, np.int64)
    weights = {n: (1 << np.arange(n - 1, -1, -1, dtype=np.int64)) for n in range(1, raw_bits + 1)}
    for lo in range(0, pixels, block):
        n = min(block, pixels - lo)
        code = int(bits[at : at + code_bits] @ weights[code_bits])
        at += code_bits
        if code == 0:  # all differences are 0
            continue
        if at > len(bits) - code_bits:
            raise DecompressionError("the stream is too short")
        if code > raw_code:  # raw differences
            raw = bits[at : at + n * raw_bits]
            if len(raw) < n * raw_bits:
                raw = np.concatenate([raw, np.zeros(n * raw_bits - len(raw), np.uint8)])
            value = raw.reshape(n, raw_bits) @ weights[raw_bits]
            at += n * raw_bits
        else:
            low = code - 1
            k = int(np.searchsorted(ones, at))
            high, tails = np.empty(n, np.int64), np.empty(n, np.int64)
            for i in range(n):  # each one ends a unary part; the low bits behind it are skipped
                if k >= len(ones):
                    raise DecompressionError("the stream is too short")
                one = int(ones[k])
                high[i], tails[i] = one - at, one + 1
                at = one + 1 + low
                k += 1
                if low:
                    k = k + int(np.searchsorted(ones[k : k + low + 1], at))
            value = high << low
            if low:
                value = value | (bits[tails[:, None] + np.arange(low)[None, :]] @ weights[low])
        steps[lo : lo + n] = np.where(value & 1, ~(value >> 1), value >> 1)
    total = (last + np.cumsum(steps)) & ((1 << 8 * size) - 1)
    return total.astype({1: np.uint8, 2: np.uint16, 4: np.uint32}[size]).view({1: np.uint8, 2: np.int16, 4: np.int32}[size]).astype(np.int32)


def rice_encode(pixels: np.ndarray, block: int, size: int) -> bytes:
    """The inverse, for fixtures and for writing tiled images."""
    code_bits, raw_code, raw_bits = RICE[size]
    mask = (1 << 8 * size) - 1
    v = pixels.astype(np.int64) & mask
    out = [f"{int(v[0]):0{8 * size}b}"]
    half = 1 << (8 * size - 1)
    d = (np.diff(v, prepend=v[0]) + half & mask) - half
    z = np.where(d < 0, ~(d << 1), d << 1)
    for lo in range(0, len(z), block):
        own = z[lo : lo + block]
        if not own.any():
            out.append("0" * code_bits)
            continue
        low = max(0, int(np.log2(max(1.0, own.mean() * 0.7))))
        low = min(low, raw_code - 1)
        if int((own >> low).sum()) + len(own) * (low + 1) >= len(own) * raw_bits:
            out.append(f"{raw_code + 1:0{code_bits}b}")
            out += [f"{int(x):0{raw_bits}b}" for x in own]
        else:
            out.append(f"{low + 1:0{code_bits}b}")
            out += ["0" * (int(x) >> low) + "1" + (f"{int(x) & ((1 << low) - 1):0{low}b}" if low else "") for x in own]
    text = "".join(out)
    text = text.ljust(-(-len(text) // 8) * 8, "0")
    return np.packbits(np.frombuffer(text.encode(), np.uint8) - 48).tobytes()


def gunzip(data: bytes) -> bytes:
    """gzip, else zlib, else bare deflate."""
    for bits in (31, 15, -15):
        try:
            return zlib.decompress(data, bits)
        except zlib.error:
            continue
    raise DecompressionError("neither gzip nor zlib nor deflate")


class Tiling:
    """How a tiled image is cut, coded and scaled."""

    def __init__(self, hdu):
        cards = hdu.cards
        self.bitpix, self.axes = hdu.image_bitpix, hdu.shape
        self.cut = [int_value(cards, f"ZTILE{i + 1}") or (self.axes[0] if i == 0 else 1) for i in range(len(self.axes))]
        self.kind = (text_value(cards, "ZCMPTYPE") or "").strip()
        if self.kind not in ("RICE_1", "RICE_ONE", "GZIP_1"):
            raise UnsupportedCompression(self.kind or "no ZCMPTYPE")
        for keyword in ("ZBLANK", "ZDITHER0"):
            if find(cards, keyword):
                raise UnsupportedCompression(f"{keyword} is not supported")
        if (text_value(cards, "ZQUANTIZ") or "NO_DITHER").strip() not in ("NO_DITHER", "NONE"):
            raise UnsupportedCompression("dithered images are not supported")
        values = {text_value(cards, f"ZNAME{i}"): int_value(cards, f"ZVAL{i}") for i in range(1, 10)}
        self.block, self.size = values.get("BLOCKSIZE") or 32, values.get("BYTEPIX") or 4
        if self.size not in RICE and self.block in RICE:  # some files swap the two
            self.block, self.size = self.size, self.block
        self.columns = {c.name: c for c in binary_columns(cards)}
        data = self.columns.get("COMPRESSED_DATA")
        if data is None or not data.item:
            raise UnsupportedCompression("no COMPRESSED_DATA")
        for name in ("UNCOMPRESSED_DATA", "GZIP_COMPRESSED_DATA", "ZBLANK"):
            if name in self.columns:
                raise UnsupportedCompression(f"column {name} is not supported")
        self.scale, self.zero = (float_value(cards, k) for k in ("ZSCALE", "ZZERO"))
        self.scaled = "ZSCALE" in self.columns or self.scale is not None
        if self.bitpix < 0 and self.kind != "GZIP_1" and not self.scaled:
            from ..functions.errors import InvalidBitpix

            raise InvalidBitpix("a Rice-coded image of floats without ZSCALE")
        self.counts = [-(-n // c) for n, c in zip(self.axes, self.cut, strict=True)]
        self.width, self.rows = hdu.table_shape()
        self.heap_start = int_value(cards, "THEAP") or self.width * self.rows

    @property
    def tiles(self) -> int:
        return prod(self.counts) if self.axes else 0

    def place(self, index: int) -> list[tuple[int, int]]:
        """(start, end) of a tile on each axis."""
        out = []
        for n, cut, count in zip(self.axes, self.cut, self.counts, strict=True):
            index, k = divmod(index, count)
            out.append((k * cut, min(n, (k + 1) * cut)))
        return out

    def decode(self, data: bytes, pixels: int, scale: float | None, zero: float | None) -> np.ndarray:
        """Pixels of a tile in the image's own type (native byte order)."""
        kind = np.dtype(PIXELS[self.bitpix]).newbyteorder("=")
        if self.kind == "GZIP_1":
            raw = gunzip(data)
            width = abs(self.bitpix) // 8
            coded = ">i4" if len(raw) == 4 * pixels and (width < 4 or self.scaled) else PIXELS[self.bitpix]
            if len(raw) < pixels * np.dtype(coded).itemsize:
                raise DecompressionError("a tile is too short")
            values = np.frombuffer(raw, coded, pixels)
        else:
            values = rice_decode(data, pixels, self.block, self.size)
        if self.scaled and self.bitpix < 0:
            return ((0.0 if zero is None else zero) + (1.0 if scale is None else scale) * values.astype(np.float64)).astype(kind)
        return values.astype(kind)


def read_tiles(stream, hdu, tiling: Tiling, lo: int, hi: int):
    """(index, pixels) of the tiles lo to hi."""
    from .codec import Heap

    heap = Heap(stream, hdu.data_start + tiling.heap_start, hdu.data_len - tiling.heap_start)
    stream.seek(hdu.data_start + lo * tiling.width)
    rows = stream.read((hi - lo) * tiling.width)
    for i in range(lo, hi):
        row = rows[(i - lo) * tiling.width : (i - lo + 1) * tiling.width]
        c = tiling.columns["COMPRESSED_DATA"]
        count, at = (int(x) for x in np.frombuffer(row, ">u4" if c.code == "P" else ">u8", 2, c.offset))
        own = {}
        for name, fixed in (("ZSCALE", tiling.scale), ("ZZERO", tiling.zero)):
            k = tiling.columns.get(name)
            own[name] = fixed if k is None else float(np.frombuffer(row, ">f8" if k.code == "D" else ">f4", 1, k.offset)[0])
        pixels = prod(b - a for a, b in tiling.place(i))
        yield i, tiling.decode(heap.read(at, at + count), pixels, own["ZSCALE"], own["ZZERO"])


def tiled_cards(bitpix: int, naxes: list[int], cut: list[int], kind: str, block: int = 32, size: int = 4, extra=()):
    """Cards of a tiled image without the table's own ones, for the writer."""
    from ..functions.cards import Card

    cards = [Card("ZIMAGE", True), Card("ZBITPIX", bitpix), Card("ZNAXIS", len(naxes))]
    cards += [Card(f"ZNAXIS{i + 1}", n) for i, n in enumerate(naxes)] + [Card(f"ZTILE{i + 1}", n) for i, n in enumerate(cut)]
    cards.append(Card("ZCMPTYPE", kind))
    if kind == "RICE_1":
        cards += [Card("ZNAME1", "BLOCKSIZE"), Card("ZVAL1", block), Card("ZNAME2", "BYTEPIX"), Card("ZVAL2", size)]
    return [*cards, *extra]


def need(cards, keyword):
    return need_int(cards, keyword)
