"""Bytes to Arrow and back: records of binary tables, heaps, fixed-width text and pixels. Whole batches at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.errors import InvalidValue, UnexpectedEof
from .schema import NUMPY, SIZES, AsciiColumn, Column, row_dtype

#: What descriptors of P columns can point to.
P_HEAP = 2**31 - 1
_ARROW = {"u1": pa.int16(), "i2": pa.int16(), "i4": pa.int32(), "i8": pa.int64(), "f4": pa.float32(), "f8": pa.float64()}


def native(values: np.ndarray) -> np.ndarray:
    """In the machine's byte order, contiguous; unsigned bytes become 16-bit."""
    if values.dtype == np.uint8:
        return values.astype(np.int16)
    return np.ascontiguousarray(values, values.dtype.newbyteorder("="))


def flat_array(values: np.ndarray, code: str, null_logical: bool = False) -> pa.Array:
    """A flat run of elements of one code."""
    if code == "L":
        return pa.array(values == ord("T"), pa.bool_(), mask=(values == 0) if null_logical else None)
    if code in "CM":
        v = native(values)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(v.real)), pa.array(np.ascontiguousarray(v.imag))], names=["re", "im"])
    return pa.array(native(values))


def scaled_array(values: np.ndarray, scale: float, zero: float) -> pa.Array:
    return pa.array(zero + scale * values.astype(np.float64))


def lists(items: pa.Array, sizes: list[int], rows: int) -> pa.Array:
    """Lists of a fixed size, nested: sizes from the inside out."""
    for n in sizes:
        count = len(items) // n if n else rows
        items = pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * n), items)
    return items


def text_array(cells: np.ndarray) -> pa.Array:
    """UTF-8 text of a fixed number of bytes, without trailing white space."""
    rows, width = cells.shape
    if not width or not rows:
        return pa.array([""] * rows, pa.string())
    data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), rows, [None, pa.py_buffer(np.ascontiguousarray(cells))])
    try:
        return pc.utf8_rtrim_whitespace(data.cast(pa.binary()).cast(pa.string()))
    except pa.ArrowInvalid as e:
        raise InvalidValue("text that isn't UTF-8") from e


#: A range of the heap is read as one if it is at most so many times what is wanted of it.
SPARSE = 4


class Heap:
    """The heap of a binary table, read in ranges."""

    def __init__(self, stream, start: int, length: int):
        self.stream, self.start, self.length = stream, start, length

    def read(self, lo: int, hi: int) -> bytes:
        if hi > self.length:
            raise UnexpectedEof("an array reaches beyond the heap")
        self.stream.seek(self.start + lo)
        return self.stream.read(hi - lo)


def heap_array(c: Column, cells: np.ndarray, heap: Heap, null_logical: bool = False, physical: bool = False) -> pa.Array:
    """Variable-length cells: descriptors (count, offset) into the heap, fetched in one range."""
    count, at = cells[:, 0].astype(np.int64), cells[:, 1].astype(np.int64)
    size = SIZES[c.item]
    length = -(-count // 8) if c.item == "X" else count * size
    full = length > 0
    lo, hi = (int(at[full].min()), int((at + length)[full].max())) if full.any() else (0, 0)
    if hi - lo > SPARSE * int(length.sum()) + (1 << 20):  # cells lie far apart: each is fetched
        cells_at = zip(at.tolist(), length.tolist(), strict=True)
        data = np.frombuffer(b"".join(heap.read(a, a + n) if n else b"" for a, n in cells_at), np.uint8)
        lo, at = 0, np.concatenate([[0], np.cumsum(length)[:-1]])
    else:
        data = np.frombuffer(heap.read(lo, hi), np.uint8) if hi > lo else np.empty(0, np.uint8)
    starts = np.where(full, at - lo, 0)
    ends = np.concatenate([[0], np.cumsum(length)])
    if not (full.sum() and np.array_equal(starts[full], ends[:-1][full]) and ends[-1] == len(data)):
        data = data[np.repeat(starts - ends[:-1], length) + np.arange(ends[-1])] if ends[-1] else data[:0]
    if c.item in "XB" and not (physical and c.scaled):
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
    if c.item == "A":
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        return pc.utf8_rtrim_whitespace(raw.cast(pa.binary()).cast(pa.string()))
    values = np.ascontiguousarray(data).view(NUMPY[c.item])
    items = scaled_array(values, c.scale, c.zero) if physical and c.scaled else flat_array(values, c.item, null_logical)
    return pa.ListArray.from_arrays(pa.array((ends // size).astype(np.int32)), items)


def heap_cuts(data: bytes, columns: list[Column], width: int, most: int) -> list[int]:
    """Row numbers at which a run of records is cut, so that a part's cells hold about ``most`` bytes of the heap, or one row does."""
    records = np.frombuffer(data, row_dtype(columns, width))
    size = np.zeros(len(records), np.int64)
    for i, c in enumerate(columns):
        if c.item:
            size += records[f"f{i}"].reshape(len(records), -1)[:, 0].astype(np.int64) * SIZES[c.item]
    total, cuts = np.cumsum(size), [0]
    while cuts[-1] < len(records):
        before = int(total[cuts[-1] - 1]) if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(total, before + most, "right"))))
    return cuts


def table_arrays(data: bytes, columns: list[Column], width: int, heap: Heap | None, null_logical=False, physical=False, tdim=False) -> list[pa.Array]:
    """The wanted columns of a run of records: one view of the bytes serves all of them."""
    records = np.frombuffer(data, row_dtype(columns, width)) if width else np.empty(0, np.uint8)
    rows, out = len(records), []
    for i, c in enumerate(columns):
        cells = records[f"f{i}"].reshape(rows, -1)
        if c.item:
            out.append(heap_array(c, cells, heap, null_logical, physical))
        elif c.code == "A":
            out.append(text_array(cells))
        elif c.code == "X" or c.code == "B" and c.repeat != 1 and not (physical and c.scaled):
            whole = pa.FixedSizeBinaryArray.from_buffers(pa.binary(c.width), rows, [None, pa.py_buffer(np.ascontiguousarray(cells))]) if c.width else pa.array([b""] * rows)
            out.append(whole.cast(pa.binary()))
        else:
            values = cells.reshape(-1)
            items = scaled_array(values, c.scale, c.zero) if physical and c.scaled and c.code in "BIJKED" else flat_array(values, c.code, null_logical)
            shaped = c.tdim if tdim and c.tdim and np.prod(c.tdim) == c.repeat else [] if c.repeat == 1 else [c.repeat]
            out.append(lists(items, shaped, rows))
    return out


def ascii_arrays(data: bytes, columns: list[AsciiColumn], width: int) -> list[pa.Array]:
    """Fixed-width fields of text records; the casts are Arrow's, over whole columns."""
    cells = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = []
    for c in columns:
        text = text_array(cells[:, c.offset : c.offset + c.width])
        if c.kind == "A":
            out.append(text)
            continue
        text = pc.utf8_trim_whitespace(text)
        try:
            if c.kind == "I":
                out.append(pc.replace_substring_regex(text, r"^\+", "").cast(pa.int64()))
            else:
                out.append(pc.replace_substring_regex(pc.replace_substring_regex(text, "[dD]", "E"), r"^\+", "").cast(pa.float64()))
        except pa.ArrowInvalid as e:
            raise InvalidValue(f"column {c.name}: {e}") from e
    return out


# Encoding.


def _floats(col: pa.Array) -> pa.Array:
    return pc.fill_null(col, float("nan"))


def _numbers(col: pa.Array, code: str) -> np.ndarray:
    if code == "L":
        filled = np.where(pc.fill_null(col, False).to_numpy(zero_copy_only=False), ord("T"), ord("F")).astype("u1")
        filled[col.is_null().to_numpy(zero_copy_only=False)] = 0
        return filled
    if code in "CM":
        re, im = (_floats(pc.struct_field(col, n)).to_numpy(zero_copy_only=False) for n in ("re", "im"))
        out = np.empty(len(re), NUMPY[code])
        out.real, out.imag = re, im  # a sum with 1j * im would turn an infinite part into NaN
        return out
    if code in "ED":
        return _floats(col).to_numpy(zero_copy_only=False).astype(NUMPY[code])
    if col.null_count:
        raise InvalidValue("integer columns of a table can't hold nulls")
    values = col.to_numpy(zero_copy_only=False)
    if len(values):
        info = np.iinfo(np.dtype(NUMPY[code]))
        if values.min() < info.min or values.max() > info.max:
            raise InvalidValue(f"a value does not fit in {code}")
    return values.astype(NUMPY[code])


def _flat(col: pa.Array) -> pa.Array:
    while pa.types.is_list(col.type) or pa.types.is_large_list(col.type):
        col = col.flatten()
    return col


def check_heap(c: Column, size: int) -> None:
    """Descriptors of P columns are 32-bit; a larger heap would be pointed into at the wrong place."""
    if c.code == "P" and size > P_HEAP:
        raise InvalidValue(f"column {c.name}: a heap of {size} bytes needs TFORM 1Q{c.item}, given as tforms")


def encode(batch: list[pa.Array], columns: list[Column], heap_at: int = 0) -> tuple[bytes, bytes]:
    """(records, heap) of a batch; descriptors count from ``heap_at``."""
    rows = len(batch[0]) if batch else 0
    width = sum(c.width for c in columns)
    records = np.zeros(rows, row_dtype(columns, width))
    heap: list[bytes] = []
    for i, (c, col) in enumerate(zip(columns, batch, strict=True)):
        if c.item:
            if pa.types.is_binary(col.type) or pa.types.is_string(col.type) or pa.types.is_large_binary(col.type):
                cells = [v if isinstance(v, bytes) else (v or "").encode() for v in col.to_pylist()]
                count = np.array([len(v or b"") for v in cells], np.int64)
                data = b"".join(v or b"" for v in cells)
                sizes = count
            else:
                if col.null_count:
                    col = pc.if_else(col.is_null(), pa.scalar([], col.type), col)
                count = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
                data = _numbers(_flat(col), c.item).tobytes()
                sizes = count * SIZES[c.item]
            at = heap_at + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if rows else np.empty(0, np.int64)
            check_heap(c, heap_at + int(sizes.sum()))
            records[f"f{i}"] = np.stack([count, at], axis=1)
            heap.append(data)
            heap_at += len(data)
        elif c.code == "A":
            raw = pc.fill_null(col, "").cast(pa.binary())
            longest = pc.max(pc.binary_length(raw)).as_py() or 0
            if longest > c.width:
                raise InvalidValue(f"column {c.name}: a text of {longest} bytes does not fit in {c.tform}")
            cells = np.full((rows, c.width), 32, np.uint8)
            if rows and c.width:
                cells[:] = np.array(raw.to_pylist(), f"S{c.width}").view(np.uint8).reshape(rows, c.width)
                cells[np.arange(c.width)[None, :] >= pc.binary_length(raw).to_numpy(zero_copy_only=False)[:, None]] = 32
            records[f"f{i}"] = cells
        elif c.code == "X" or c.code == "B" and (pa.types.is_binary(col.type) or pa.types.is_fixed_size_binary(col.type)):
            cells = [(v or b"").ljust(c.width, b"\0") for v in col.to_pylist()]
            if any(len(v) != c.width for v in cells):
                raise InvalidValue(f"column {c.name}: bytes do not fit in {c.tform}")
            records[f"f{i}"] = np.frombuffer(b"".join(cells), np.uint8).reshape(records[f"f{i}"].shape)
        else:
            flat = _flat(col)
            if len(flat) != rows * c.repeat:
                raise InvalidValue(f"column {c.name}: cells do not have {c.repeat} elements")
            records[f"f{i}"] = _numbers(flat, c.code).reshape(records[f"f{i}"].shape)
    return records.tobytes(), b"".join(heap)


def ascii_number(value: float, c: AsciiColumn) -> str:
    """A number of a text table: fixed for F, with an E or D exponent of two digits and a sign for E and D."""
    if c.kind == "F":
        return f"{value:.{c.decimals}f}"
    return f"{value:.{c.decimals}E}".replace("E", c.kind)


def encode_ascii(batch: list[pa.Array], columns: list[AsciiColumn], width: int) -> bytes:
    rows = len(batch[0]) if batch else 0
    cells = np.full((rows, width), 32, np.uint8)
    for c, col in zip(columns, batch, strict=True):
        values = col.to_pylist()
        if c.kind != "A" and col.null_count:
            raise InvalidValue(f"column {c.name}: a text table can't hold null numbers")
        if c.kind == "A":
            texts = [(v or "").encode().ljust(c.width) for v in values]
        else:
            texts = [(str(v) if c.kind == "I" else ascii_number(v, c)).encode().rjust(c.width) for v in values]
        if any(len(t) > c.width for t in texts):
            raise InvalidValue(f"column {c.name}: a value does not fit in {c.tform}")
        if rows:
            cells[:, c.offset : c.offset + c.width] = np.frombuffer(b"".join(texts), np.uint8).reshape(rows, c.width)
    return cells.tobytes()
