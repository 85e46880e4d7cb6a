"""Spark data source "fits": any HDU of one file or many as a DataFrame.

Options of reading
  hdu              index or EXTNAME; else the first HDU with data
  columns          comma-separated names: only these are decoded (a user schema does the same)
  layout           rows (default: one row per axis-1 line, row_index and data) or pixels (i1..iN from 0, flat, value)
  section          "start:end" of flat pixel indexes; gives flat and value
  rows             "start:end": rows of a table, or axis-1 lines of an image; only these bytes are read
  region           "s1:e1,s2:e2,..." ends exclusive, one per axis
  physical         apply TSCAL/TZERO, or BSCALE/BZERO and BLANK (undefined pixels become NaN, or null with blankAsNull)
  nullLogical      a logical byte 0 is null instead of false
  tdim             reshape arrays by TDIMn
  rowIndex         add _row (from 0); with pushdown, filters on it choose the bytes that are read
  path column      pathColumn=true adds _path
  rowsPerPartition rows of a partition; else about 64 MiB
  mode             permissive (default) or failfast: how headers after the first are judged

A table column never holds more than its bytes say: logical values other than T are false, text loses trailing white space.
Files are listed on the driver; headers are read there for the schema and, while there are few files, for cutting large
ones into row ranges. With many files each is planned where it is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..functions.cards import float_value, int_value
from ..functions.errors import InvalidValue, UnexpectedEof
from . import files
from .codec import Heap, ascii_arrays, heap_cuts, native, table_arrays
from .hdu import ASCII, BINARY, TILED, Hdu, choose, read_hdus
from .schema import PIXELS, ascii_columns, ascii_field, binary_columns, pixel_type, spark_field
from .tiles import Tiling, read_tiles

PARTITION_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
#: Lines of at least so many bytes are read one by one where a region wants less than a quarter of each; lines looked at together.
SEEK_BYTES, LINES = 4096, 1 << 20
#: Up to so many files are opened while planning.
PLANNED_FILES = 64


def flag(options, name: str) -> bool:
    return str(options.get(name, "false")).lower() == "true"


def span(text: str) -> tuple[int, int]:
    lo, colon, hi = text.partition(":")
    try:
        lo, hi = int(lo), int(hi)
    except ValueError as e:
        raise InvalidValue(f"{text!r} is no range start:end") from e
    if not colon or lo < 0 or hi < lo:
        raise InvalidValue(f"{text!r} is no range start:end")
    return lo, hi


class Plan:
    """What the options ask of one HDU."""

    def __init__(self, hdu: Hdu, options: dict):
        self.hdu, self.options = hdu, options
        self.physical, self.null_logical, self.tdim = (flag(options, n) for n in ("physical", "nullLogical", "tdim"))
        self.row_index, self.path_column = flag(options, "rowIndex"), flag(options, "pathColumn")
        self.blank_null = flag(options, "blankAsNull")
        self.table = hdu.kind in (ASCII, BINARY)
        if self.table:
            self.columns = ascii_columns(hdu.cards) if hdu.kind == ASCII else binary_columns(hdu.cards)
            self.count = hdu.table_shape()[1]
            width, rows = hdu.table_shape()
            self.unit = max(1, width + (max(0, hdu.data_len - width * rows) // rows if rows else 0))  # with a row's share of the heap
        else:
            self.bitpix, self.axes = hdu.image_bitpix, hdu.shape
            self.line = self.axes[0] if self.axes else 0
            self.count = int(np.prod(self.axes[1:], dtype=object)) if self.axes and self.line else 0
            self.unit = max(1, self.line * abs(self.bitpix) // 8)
            self.scale, self.zero, self.blank = float_value(hdu.cards, "BSCALE"), float_value(hdu.cards, "BZERO"), int_value(hdu.cards, "BLANK")
        self.check()

    def check(self) -> None:
        if r := self.options.get("rows"):
            if span(r)[1] > self.count:
                raise UnexpectedEof(f"rows {r} of {self.count}")
        if self.table:
            return
        total = self.count * self.line
        if (s := self.options.get("section")) and span(s)[1] > total:
            raise UnexpectedEof(f"section {s} of {total} pixels")
        if r := self.options.get("region"):
            ranges = [span(x) for x in r.split(",")]
            if len(ranges) != len(self.axes) or any(hi > n for (_, hi), n in zip(ranges, self.axes, strict=True)):
                raise InvalidValue(f"region {r} of axes {self.axes}")

    def fields(self) -> list[T.StructField]:
        extra = [T.StructField("_path", T.StringType())] if self.path_column else []
        if self.table:
            make = ascii_field if self.hdu.kind == ASCII else lambda c: spark_field(c, self.physical, self.tdim)
            fields = [make(c) for c in self.columns]
            wanted = [n.strip() for n in self.options.get("columns", "").split(",") if n.strip()]
            if wanted:
                by = {f.name: f for f in fields}
                missing = [n for n in wanted if n not in by]
                if missing:
                    raise InvalidValue(f"no column {missing[0]!r}")
                fields = [by[n] for n in wanted]
            return [*([T.StructField("_row", T.LongType())] if self.row_index else []), *fields, *extra]
        value = T.DoubleType() if self.physical else pixel_type(self.bitpix)
        if "section" in self.options:
            return [T.StructField("flat", T.LongType()), T.StructField("value", value), *extra]
        if self.options.get("layout", "rows") == "pixels":
            return [*(T.StructField(f"i{k + 1}", T.LongType()) for k in range(len(self.axes))), T.StructField("flat", T.LongType()), T.StructField("value", value), *extra]
        return [T.StructField("row_index", T.LongType()), T.StructField("data", T.ArrayType(value)), *extra]

    def limits(self) -> tuple[int, int]:
        """The rows or lines that can matter."""
        lo, hi = span(self.options["rows"]) if "rows" in self.options else (0, self.count)
        if not self.table and "section" in self.options:
            a, b = span(self.options["section"])
            lo, hi = max(lo, a // max(1, self.line)), min(hi, -(-b // max(1, self.line)))
        if not self.table and "region" in self.options:
            first = last = 0
            stride = 1
            ranges = [span(x) for x in self.options["region"].split(",")]
            for (a, b), n in zip(ranges[1:], self.axes[1:], strict=True):
                first, last, stride = first + a * stride, last + (b - 1) * stride, stride * n
            lo, hi = max(lo, first), min(hi, last + 1)
            if any(b <= a for a, b in ranges):
                hi = lo
        return lo, max(lo, hi)

    def wanted_lines(self, lo: int, hi: int) -> np.ndarray:
        """Of the lines lo to hi those inside the region, ascending (axis 1 runs fastest)."""
        lines = np.arange(lo, hi)
        if "region" in self.options:
            rest = lines.copy()
            keep = np.ones(len(lines), bool)
            for (a, b), n in zip([span(x) for x in self.options["region"].split(",")][1:], self.axes[1:], strict=True):
                at = rest % n
                rest //= n
                keep &= (at >= a) & (at < b)
            lines = lines[keep]
        return lines

    # Reading.

    def batches(self, schema: T.StructType, lo: int, hi: int):
        with files.open_read(self.hdu.path) as f:
            yield from (self.table_batches if self.table else self.image_batches)(f, schema, lo, hi)

    def table_batches(self, f, schema, lo, hi):
        by = {c.name: c for c in self.columns}
        names = [n for n in schema.names if n not in ("_row", "_path")]
        if missing := [n for n in names if n not in by]:
            raise InvalidValue(f"no column {missing[0]!r} in {self.hdu.path}")
        columns = [by[n] for n in names]
        width, rows = self.hdu.table_shape()
        heap = None
        if self.hdu.kind == BINARY:
            start = int_value(self.hdu.cards, "THEAP") or width * rows
            heap = Heap(f, self.hdu.data_start + start, self.hdu.data_len - start)
        step = max(1, BATCH_BYTES // max(1, width))
        of_heap = any(c.item for c in columns) if self.hdu.kind == BINARY else False
        for a in range(lo, hi, step):
            b = min(hi, a + step)
            f.seek(self.hdu.data_start + a * width)
            data = f.read((b - a) * width)
            cuts = heap_cuts(data, columns, width, BATCH_BYTES) if of_heap else [0, b - a]
            for x, y in zip(cuts, cuts[1:], strict=False):
                part = data[x * width : y * width] if len(cuts) > 2 else data
                arrays = dict(zip(names, ascii_arrays(part, columns, width) if self.hdu.kind == ASCII else table_arrays(part, columns, width, heap, self.null_logical, self.physical, self.tdim), strict=True))
                yield self.batch(schema, arrays, y - x, {"_row": lambda x=a + x, y=a + y: pa.array(np.arange(x, y))})

    def batch(self, schema, arrays, n, made):
        out = []
        for name in schema.names:
            out.append(arrays[name] if name in arrays else pa.array([self.hdu.path] * n, pa.string()) if name == "_path" else made[name]())
        return pa.RecordBatch.from_arrays(out, names=schema.names)

    def physical_values(self, values: np.ndarray) -> pa.Array:
        if not self.physical:
            return pa.array(native(values))
        out = (self.zero or 0.0) + (1.0 if self.scale is None else self.scale) * values.astype(np.float64)
        if self.bitpix > 0 and self.blank is not None:
            bad = values == np.array(self.blank).astype(np.int64).astype(native(values[:0]).dtype if self.bitpix != 8 else np.uint8)
        else:
            bad = np.isnan(out)
        if self.blank_null:
            return pa.array(out, mask=bad)
        out[bad] = np.nan
        return pa.array(out)

    def lines(self, f, lo, hi):
        """(first line, matrix of lines) in pieces."""
        if self.hdu.kind == TILED:
            yield from self.tiled_lines(f, lo, hi)
            return
        step = max(1, BATCH_BYTES // self.unit)
        for a in range(lo, hi, step):
            b = min(hi, a + step)
            f.seek(self.hdu.data_start + a * self.unit)
            yield a, np.frombuffer(f.read((b - a) * self.unit), PIXELS[self.bitpix]).reshape(b - a, self.line)

    def region_lines(self, f, lo, hi, first, last):
        """(lines, matrix of their pixels first to last) of the region in pieces: runs of lines beside each other are read as one,
        unless the pixels are a small part of long lines, which are then read one by one."""
        pixel = abs(self.bitpix) // 8
        wide = last - first
        alone = self.unit >= SEEK_BYTES and 4 * wide < self.line
        kind, step = PIXELS[self.bitpix], max(1, BATCH_BYTES // (wide * pixel if alone else self.unit))
        for a in range(lo, hi, LINES):
            lines = self.wanted_lines(a, min(hi, a + LINES))
            for run in np.split(lines, np.flatnonzero(np.diff(lines) != 1) + 1) if len(lines) else ():
                for k in range(0, len(run), step):
                    part = run[k : k + step]
                    if alone:
                        data = []
                        for line in part.tolist():
                            f.seek(self.hdu.data_start + line * self.unit + first * pixel)
                            data.append(f.read(wide * pixel))
                        yield part, np.frombuffer(b"".join(data), kind).reshape(len(part), wide)
                    else:
                        f.seek(self.hdu.data_start + int(part[0]) * self.unit)
                        yield part, np.frombuffer(f.read(len(part) * self.unit), kind).reshape(len(part), self.line)[:, first:last]

    def tiled_lines(self, f, lo, hi):
        """Tiles of a band that lie beside each other along axis 1 are put together before their lines are cut out."""
        tiling = Tiling(self.hdu)
        across, counts = tiling.counts[0], tiling.counts[1:]
        few = range(1)
        if counts and hi > lo:  # bands of the slabs along the last axis that hold these lines
            deep, slab = int(np.prod(self.axes[1:-1], dtype=np.int64)), int(np.prod(counts[:-1], dtype=np.int64))
            few = range(lo // deep // tiling.cut[-1] * slab, ((hi - 1) // deep // tiling.cut[-1] + 1) * slab)
        for band in few:
            box = tiling.place(band * across)[1:]
            shape = [b - a for a, b in box]
            grid = np.indices(shape[::-1]).reshape(len(shape), -1)[::-1] if shape else np.zeros((0, 1), np.int64)
            line = np.zeros(grid.shape[1] if shape else 1, np.int64)
            for k in range(len(shape) - 1, -1, -1):
                line = line * self.axes[k + 1] + grid[k] + box[k][0]
            keep = np.flatnonzero((line >= lo) & (line < hi))
            if not len(keep):
                continue
            whole = np.empty((len(line), self.line), np.dtype(PIXELS[self.bitpix]).newbyteorder("="))
            for i, pixels in read_tiles(f, self.hdu, tiling, band * across, (band + 1) * across):
                a, b = tiling.place(i)[0]
                whole[:, a:b] = pixels.reshape(len(line), b - a)
            order = keep[np.argsort(line[keep])]
            for run in np.split(order, np.flatnonzero(np.diff(line[order]) != 1) + 1):
                yield int(line[run[0]]), whole[run]

    def image_batches(self, f, schema, lo, hi):
        ranges = [span(x) for x in self.options["region"].split(",")] if "region" in self.options else None
        first, last = ranges[0] if ranges else (0, self.line)
        section = span(self.options["section"]) if "section" in self.options else None
        if ranges and self.hdu.kind != TILED:
            pieces = self.region_lines(f, lo, hi, first, last)
        else:
            whole = ((self.wanted_lines(a, a + len(data)), a, data) for a, data in self.lines(f, lo, hi))
            pieces = ((lines, data[lines - a, first:last]) for lines, a, data in whole)
        for lines, data in pieces:
            if not len(lines):
                continue
            values = self.physical_values(data.reshape(-1))
            if "data" in schema.names or not {"flat", "value"} & set(schema.names):
                ends = pa.array(np.arange(len(lines) + 1, dtype=np.int32) * (last - first))
                yield self.batch(schema, {"data": pa.ListArray.from_arrays(ends, values)} if "data" in schema.names else {}, len(lines), {"row_index": lambda lines=lines: pa.array(lines.astype(np.int64)), **self.axis_arrays(lines, first, last)})
                continue
            flat = (lines[:, None] * self.line + np.arange(first, last)[None, :]).reshape(-1)
            made = {"flat": lambda flat=flat: pa.array(flat.astype(np.int64)), "value": lambda values=values: values, **self.axis_arrays(lines, first, last)}
            batch = self.batch(schema, {}, len(flat), made)
            if section:
                batch = batch.filter(pa.array((flat >= section[0]) & (flat < section[1])))
            yield batch

    def axis_arrays(self, lines, first, last):
        def axis(k):
            if k == 0:
                return pa.array(np.tile(np.arange(first, last, dtype=np.int64), len(lines)))
            rest = lines
            for n in self.axes[1:k]:
                rest = rest // n
            return pa.array(np.repeat((rest % self.axes[k]).astype(np.int64), last - first))

        return {f"i{k + 1}": (lambda k=k: axis(k)) for k in range(len(self.axes))}


class Piece(InputPartition):
    def __init__(self, path: str, lo: int | None = None, hi: int | None = None, plan: Plan | None = None):
        self.path, self.lo, self.hi, self.plan = path, lo, hi, plan


class FitsReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.wanted, self.range = options, schema, None

    def partitions(self):
        listed = files.listing(self.options["path"])
        few = len(listed) <= PLANNED_FILES or "rowsPerPartition" in self.options
        pieces = []
        for path, size in listed:
            if not few and size <= PARTITION_BYTES:
                pieces.append(Piece(path))
                continue
            plan = make_plan(path, self.options)
            lo, hi = self.bounds(plan)
            step = int(self.options.get("rowsPerPartition", 0)) or max(1, PARTITION_BYTES // plan.unit)
            if not plan.table and plan.hdu.kind == TILED:
                deep = int(np.prod(Tiling(plan.hdu).cut[1:2] or [1]))
                step = -(-step // deep) * deep
            pieces += [Piece(path, a, min(hi, a + step), plan) for a in range(lo, hi, step)]
        return pieces or [Piece(listed[0][0], 0, 0)]

    def bounds(self, plan: Plan) -> tuple[int, int]:
        lo, hi = plan.limits()
        if self.range:
            lo, hi = max(lo, self.range[0]), min(hi, self.range[1])
        return lo, max(lo, hi)

    def read(self, piece):
        plan = piece.plan or make_plan(piece.path, self.options)
        lo, hi = (piece.lo, piece.hi) if piece.lo is not None else self.bounds(plan)
        yield from plan.batches(self.wanted, lo, hi)


class PushingReader(FitsReader):
    """Takes filters on _row and row_index; Spark keeps them too, so that they only narrow what is read."""

    def pushFilters(self, filters):  # noqa: N802
        lo, hi = 0, 2**62
        for f in filters:
            if getattr(f, "attribute", None) in (("_row",), ("row_index",)) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, EqualTo):
                    lo, hi = max(lo, f.value), min(hi, f.value + 1)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    lo = max(lo, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    hi = min(hi, f.value + isinstance(f, LessThanOrEqual))
            yield f
        self.range = (lo, hi)


def make_plan(path: str, options: dict) -> Plan:
    return Plan(choose(read_hdus(path, options.get("mode") == "failfast"), options.get("hdu")), options)


class _Options(dict):
    """Options by the names used here, whatever the case Spark passes on."""

    _NAMES = ("hdu", "columns", "layout", "section", "rows", "region", "physical", "nullLogical", "tdim", "rowIndex", "pathColumn", "rowsPerPartition", "mode", "blankAsNull", "pushdown", "path")

    def __init__(self, given):
        low = {k.lower(): v for k, v in dict(given).items()}
        super().__init__({n: low[n.lower()] for n in self._NAMES if n.lower() in low} | {k: v for k, v in low.items() if k not in {n.lower() for n in self._NAMES}})


class FitsDataSource(DataSource):
    @classmethod
    def name(cls):
        return "fits"

    def schema(self):
        options = _Options(self.options)
        first = files.listing(options["path"])[0][0]
        return T.StructType(make_plan(first, options).fields())

    def reader(self, schema):
        options = _Options(self.options)
        return (PushingReader if flag(options, "pushdown") else FitsReader)(options, schema)

    def writer(self, schema, overwrite):
        from .sink import FitsWriter

        return FitsWriter({k.lower(): v for k, v in dict(self.options).items()}, schema, overwrite)


def register(spark) -> None:
    """Makes format("fits") known to the session; workers get the code by value."""
    import pyspark.cloudpickle

    import heliograph

    pyspark.cloudpickle.register_pickle_by_value(heliograph)
    spark.dataSource.register(FitsDataSource)


def read_fits(spark, path: str, hdu=None, columns=None, schema=None, **options):
    """spark.read.format("fits") with filters on _row and row_index pushed down."""
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("fits").option("pushdown", "true")
    if hdu is not None:
        reader = reader.option("hdu", str(hdu))
    if columns:
        reader = reader.option("columns", ",".join(columns))
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    return (reader.schema(schema) if schema is not None else reader).load(path)
