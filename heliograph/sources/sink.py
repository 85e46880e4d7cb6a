"""Writing DataFrames as FITS: tasks write raw segments, the commit puts header and segments together.

Options of writing
  kind       table (default), ascii or image
  extname    EXTNAME of the HDU
  tforms     "name=TFORM;name=TFORM" (for ascii tables as well); else by type, with arrays of variable length, whose descriptors
             are 64-bit (Q) where the heap is too large for 32-bit ones
  strlen     bytes of text columns without a TFORM (default 64)
  scale      "name=TSCAL,TZERO;..." cards only: values are stored as they are
  bitpix, naxes   of an image; rows are row_index (its order) and data, an axis-1 line each
  cards      JSON list of [keyword, value, comment] to add to the header
  checksum   stamp DATASUM and CHECKSUM
  primary    true: an image as the primary HDU instead of an extension
  single     true (default for paths that end in .fits): one file, segments in order of partition; false: a folder with a
             file per task, which needs no joining and scales with the tasks
Mode append adds an HDU to the file. A new file appears by a rename, so readers see it whole or not at all; a second
attempt of a task writes a segment of its own, and only those that Spark has committed are used.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from ..functions.blocks import padded
from ..functions.cards import Card, serialize
from ..functions.errors import InvalidValue
from . import codec, files
from .codec import check_heap, encode, encode_ascii
from .hdu import extension_cards, primary_cards
from .schema import PIXELS, AsciiColumn, Column, default_tform, layout, parse_ascii_tform, row_dtype


@dataclass
class Segment(WriterCommitMessage):
    partition: int
    rows: int = 0
    heap: int = 0
    path: str = ""
    heap_path: str = ""


@dataclass
class Target:
    """What is written: cards that don't depend on the rows, and how rows become bytes."""

    kind: str
    columns: list = field(default_factory=list)
    width: int = 0
    bitpix: int = 0
    naxes: list[int] = field(default_factory=list)
    primary: bool = False
    extra: list[Card] = field(default_factory=list)
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)
    #: Columns as segments have them: descriptors that no TFORM was given for are 64-bit until the size of the heap is known.
    wide: list = field(default_factory=list)

    @classmethod
    def of(cls, options: dict, schema: T.StructType) -> Target:
        extra = [Card("EXTNAME", options["extname"])] if "extname" in options else []
        extra += [Card(k, v, *c) for k, v, *c in json.loads(options.get("cards", "[]"))]
        kind = options.get("kind", "table")
        forms = dict(f.split("=", 1) for f in options.get("tforms", "").split(";") if f)
        if missing := [n for n in forms if n not in schema.names]:
            raise InvalidValue(f"no column {missing[0]!r}")
        if kind == "image":
            return cls(kind, bitpix=int(options["bitpix"]), naxes=[int(n) for n in options["naxes"].split(",") if n], primary=options.get("primary") == "true", extra=extra)
        if kind == "ascii":
            default = {"string": f"A{options.get('strlen', 64)}", "double": "E25.16", "float": "E15.7"}
            at, columns = 0, []
            for f in schema.fields:
                c = AsciiColumn(f.name, *parse_ascii_tform(forms.get(f.name) or default.get(f.dataType.simpleString(), "I20")), at)
                columns.append(c)
                at += c.width
            return cls(kind, columns, at, extra=extra)
        if kind != "table":
            raise InvalidValue(f"kind {kind!r}")
        columns = layout([(f.name, forms.get(f.name) or default_tform(f, int(options.get("strlen", 64)))) for f in schema.fields])
        scale = {n: tuple(map(float, v.split(","))) for n, v in (s.split("=", 1) for s in options.get("scale", "").split(";") if s)}
        for c, f in zip(columns, schema.fields, strict=True):
            c.tdim = (f.metadata or {}).get("tdim", [])
        free = {f.name for f in schema.fields if f.name not in forms and "tform" not in (f.metadata or {})}
        wide = layout([(c.name, f"{c.repeat}Q{c.item}" if c.code == "P" and c.name in free else c.tform) for c in columns])
        for c, w in zip(columns, wide, strict=True):
            w.tdim = c.tdim
        return cls(kind, columns, sum(c.width for c in columns), extra=extra, scale=scale, wide=wide)

    def for_heap(self, size: int) -> Target:
        """With the narrowest descriptors for a heap of so many bytes."""
        if self.kind != "table" or size <= codec.P_HEAP:
            return self
        return replace(self, columns=self.wide, width=sum(c.width for c in self.wide))

    def cards(self, rows: int, heap: int) -> list[Card]:
        if self.kind == "image":
            axes = self.naxes or []
            return [*(primary_cards(self.bitpix, axes) if self.primary else extension_cards("IMAGE", self.bitpix, axes)), *self.extra]
        cards = extension_cards("TABLE" if self.kind == "ascii" else "BINTABLE", 8, [self.width, rows], heap, 1, len(self.columns))
        for i, c in enumerate(self.columns, 1):
            cards += [Card(f"TTYPE{i}", c.name), Card(f"TFORM{i}", c.tform)]
            if isinstance(c, AsciiColumn):
                cards.append(Card(f"TBCOL{i}", c.offset + 1))
                continue
            if c.tdim:
                cards.append(Card(f"TDIM{i}", f"({','.join(map(str, c.tdim))})"))
            if c.name in self.scale:
                cards += [Card(f"TSCAL{i}", self.scale[c.name][0]), Card(f"TZERO{i}", self.scale[c.name][1])]
        return [*cards, *self.extra]

    def encode(self, batch: pa.RecordBatch, heap_at: int) -> tuple[bytes, bytes]:
        if self.kind == "table":
            return encode(list(batch.columns), self.wide, heap_at)
        if self.kind == "ascii":
            return encode_ascii(list(batch.columns), self.columns, self.width), b""
        data = batch.column("data")
        line = self.naxes[0] if self.naxes else 0
        if data.null_count or (len(data) and pc.any(pc.not_equal(pc.list_value_length(data), line)).as_py()):
            raise InvalidValue(f"a line of the image does not have {line} pixels")
        values = data.flatten()
        if values.null_count:
            raise InvalidValue("pixels can't be null")
        kind = np.dtype(PIXELS[self.bitpix])
        got = values.to_numpy(zero_copy_only=False)
        if kind.kind in "iu" and len(got):
            info = np.iinfo(kind)
            if got.min() < info.min or got.max() > info.max:
                raise InvalidValue(f"a pixel does not fit in BITPIX {self.bitpix}")
        return got.astype(kind).tobytes(), b""

    def rebased(self, data: bytes, by: int) -> bytes:
        """Records of a segment in this target's columns, with descriptors that point further into the heap by so many bytes."""
        if self.kind != "table" or not any(c.item for c in self.columns):
            return data
        if not by and [c.tform for c in self.columns] == [c.tform for c in self.wide]:
            return data
        found = np.frombuffer(data, row_dtype(self.wide, sum(c.width for c in self.wide)))
        records = np.empty(len(found), row_dtype(self.columns, self.width))
        for i, c in enumerate(self.columns):
            records[f"f{i}"] = found[f"f{i}"]
            if c.item:
                records[f"f{i}"][:, 1] += by
        return records.tobytes()


CHUNK = 32 << 20


def copied(out, path: str, change=None, unit: int = 1):
    with files.open_read(path) as f:
        step = max(1, CHUNK // max(1, unit)) * max(1, unit)
        while data := f.read(step):
            out.write(change(data) if change else data)


MINIMAL_PRIMARY = serialize(primary_cards(8, []))


class FitsWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.options, self.schema, self.overwrite = options, schema, overwrite
        self.path = options["path"].rstrip("/")
        self.single = options.get("single", str(self.path.endswith((".fits", ".fit", ".fts")))).lower() == "true"
        self.target = Target.of(options, schema)
        self.stage = f"{self.path}.parts-{uuid.uuid4().hex}"
        if files.exists(self.path) and not overwrite and (not self.single or options.get("mode_append", "true") != "true"):
            raise FileExistsError(self.path)

    def write(self, iterator):
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"{self.stage}/{context.partitionId():08d}-{context.taskAttemptId()}"
        found = Segment(context.partitionId())
        out = heap = None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                data, more = self.target.encode(batch, found.heap)
                if out is None:
                    found.path = f"{name}.rows"
                    out = files.open_write(found.path)
                out.write(data)
                if more:
                    if heap is None:
                        found.heap_path = f"{name}.heap"
                        heap = files.open_write(found.heap_path)
                    heap.write(more)
                    found.heap += len(more)
                found.rows += batch.num_rows
        finally:
            for f in (out, heap):
                if f:
                    f.close()
        return found

    def assemble(self, out, segments: list[Segment]) -> None:
        """Header, rows, heap and padding."""
        rows, heap = sum(s.rows for s in segments), sum(s.heap for s in segments)
        target = self.target.for_heap(heap)
        if target.kind == "table":
            for c in target.columns:
                if c.item:
                    check_heap(c, heap)
        if target.kind == "image" and target.naxes and rows != int(np.prod(target.naxes[1:], dtype=object)):
            raise InvalidValue(f"{rows} lines for axes {target.naxes}")
        out.write(serialize(target.cards(rows, heap)))
        unit = target.width or (target.naxes[0] * abs(target.bitpix) // 8 if target.naxes else 1)
        stored, at = sum(c.width for c in target.wide) or unit, 0
        for s in segments:
            if s.path:
                copied(out, s.path, lambda data, by=at: target.rebased(data, by), stored)
            at += s.heap
        for s in segments:
            if s.heap_path:
                copied(out, s.heap_path)
        size = rows * unit + heap
        out.write((b" " if target.kind == "ascii" else b"\0") * (padded(size) - size))

    def commit(self, messages):
        segments = sorted((m for m in messages if m), key=lambda m: m.partition)
        try:
            if self.single:
                self.put(self.path, segments, append=files.exists(self.path) and not self.overwrite)
            else:
                if self.overwrite:
                    files.remove(self.path)
                for s in segments or [Segment(0)]:
                    self.put(f"{self.path}/part-{s.partition:05d}.fits", [s], append=False)
        finally:
            files.remove(self.stage)

    def put(self, path: str, segments: list[Segment], append: bool) -> None:
        new = f"{path}.new-{uuid.uuid4().hex}"
        with files.open_write(new) as out:
            if append:
                copied(out, path)
            elif not self.target.primary:
                out.write(MINIMAL_PRIMARY)
            self.assemble(out, segments)
        if self.options.get("checksum", "false") == "true":
            from ..operators.checksum import stamp_file

            stamp_file(new)
        files.move(new, path)

    def abort(self, messages):
        files.remove(self.stage)


def write_fits(df, path: str, mode: str = "errorifexists", **options) -> None:
    """df.write.format("fits"), with the width of text columns taken from the data where no TFORM is given (one more pass)."""
    from pyspark.sql import functions as F

    from .fits import register

    register(df.sparkSession)
    if options.get("kind", "table") != "image":
        given = {f.split("=", 1)[0] for f in options.get("tforms", "").split(";") if f}
        texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in given and "tform" not in (f.metadata or {})]
        if texts:
            widest = df.agg(*(F.max(F.octet_length(F.col(f"`{n}`"))).alias(f"w{i}") for i, n in enumerate(texts))).first()
            form = (lambda n: f"A{n}") if options.get("kind") == "ascii" else (lambda n: f"{n}A")
            found = ";".join(f"{n}={form(max(1, widest[f'w{i}'] or 1))}" for i, n in enumerate(texts))
            options["tforms"] = ";".join(x for x in (options.get("tforms", ""), found) if x)
    if "cards" in options and not isinstance(options["cards"], str):
        options["cards"] = json.dumps(options["cards"])
    writer = df.write.format("fits").mode("append" if mode in ("append", "errorifexists") else mode)
    if mode == "errorifexists":
        if files.exists(path):
            raise FileExistsError(path)
    for k, v in options.items():
        writer = writer.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    writer.save(path)


def write_local(path: str, hdus: list[tuple[list[Card], bytes]]) -> None:
    """A file from (cards, data) of each HDU, on the driver: for small files, edits and fixtures."""
    new = f"{path}.new-{uuid.uuid4().hex}"
    with files.open_write(new) as out:
        for cards, data in hdus:
            out.write(serialize(cards))
            out.write(data + (b" " if any(c.keyword == "XTENSION" and str(c.value).strip() == "TABLE" for c in cards) else b"\0") * (padded(len(data)) - len(data)))
    files.move(new, path)


def table_hdu(columns: list[tuple[str, str, pa.Array]], extname: str | None = None, extra: list[Card] | None = None) -> tuple[list[Card], bytes]:
    """(cards, data) of a binary table from (name, TFORM, values)."""
    cols: list[Column] = layout([(n, f) for n, f, _ in columns])
    data, heap = encode([v for _, _, v in columns], cols)
    target = Target("table", cols, sum(c.width for c in cols), extra=([Card("EXTNAME", extname)] if extname else []) + (extra or []))
    rows = len(columns[0][2]) if columns else 0
    return target.cards(rows, len(heap)), data + heap


def image_hdu(pixels: np.ndarray, bitpix: int, naxes: list[int], primary: bool = False, extra: list[Card] | None = None) -> tuple[list[Card], bytes]:
    """(cards, data) of an image; pixels run along the first axis fastest."""
    cards = primary_cards(bitpix, naxes) if primary else extension_cards("IMAGE", bitpix, naxes)
    data = np.asarray(pixels).reshape(-1).astype(PIXELS[bitpix]).tobytes()
    if len(data) != int(np.prod(naxes, dtype=object)) * abs(bitpix) // 8 * bool(naxes):
        raise InvalidValue(f"pixels do not fill axes {naxes}")
    return [*cards, *(extra or [])], data
