"""Columns of tables and pixels of images: from header keywords to Spark and numpy types, and back."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import types as T

from ..functions.cards import Card, float_value, int_value, text_value
from ..functions.errors import InvalidBitpix, InvalidValue, MissingKeyword

# Bytes and numpy types of the format's codes.
SIZES = {"L": 1, "X": 1, "B": 1, "I": 2, "J": 4, "K": 8, "E": 4, "D": 8, "C": 8, "M": 16, "A": 1, "P": 8, "Q": 16}
NUMPY = {"L": "u1", "X": "u1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "C": ">c8", "M": ">c16", "A": "u1"}
PIXELS = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
_COMPLEX = lambda t: T.StructType([T.StructField("re", t), T.StructField("im", t)])
SCALARS = {"L": T.BooleanType(), "B": T.ShortType(), "I": T.ShortType(), "J": T.IntegerType(), "K": T.LongType(), "E": T.FloatType(), "D": T.DoubleType(), "C": _COMPLEX(T.FloatType()), "M": _COMPLEX(T.DoubleType())}
PIXEL_TYPES = {8: T.ShortType(), 16: T.ShortType(), 32: T.IntegerType(), 64: T.LongType(), -32: T.FloatType(), -64: T.DoubleType()}
_BINARY = re.compile(r"\s*([0-9]*)\s*([LXBIJKEDCMA]|[PQ]([LXBIJKEDCMA]))")
_ASCII = re.compile(r"\s*(?:A([0-9]+)|I([0-9]+)|([FED])([0-9]+)\.([0-9]+))\s*")
_TDIM = re.compile(r"\s*\(\s*([0-9]+(?:\s*,\s*[0-9]+)*)\s*\)\s*")


@dataclass
class Column:
    """A column of a binary table. ``item`` is the element code of a variable-length array."""

    name: str
    repeat: int
    code: str
    item: str = ""
    offset: int = 0
    tdim: list[int] = field(default_factory=list)
    scale: float = 1.0
    zero: float = 0.0
    original: str | None = None

    @property
    def width(self) -> int:
        return -(-self.repeat // 8) if self.code == "X" else self.repeat * SIZES[self.code]

    @property
    def tform(self) -> str:
        return f"{self.repeat}{self.code}{self.item}"

    @property
    def scaled(self) -> bool:
        return (self.scale, self.zero) != (1.0, 0.0)


def parse_tform(text: str) -> tuple[int, str, str]:
    """(repeat, code, element code of P and Q)."""
    m = _BINARY.match(text)
    if not m:
        raise InvalidValue(f"TFORM {text!r}")
    return int(m[1] or 1), m[2][0], m[3] or ""


def parse_tdim(text: str) -> list[int] | None:
    m = _TDIM.fullmatch(text)
    return [int(n) for n in m[1].split(",")] if m else None


def unique_names(names: list[str | None]) -> list[str]:
    """Names as Spark needs them: _cN for missing ones, a number behind repeated ones (also where only the case differs)."""
    out: list[str] = []
    seen: set[str] = set()
    for i, name in enumerate(names):
        name = name or f"_c{i + 1}"
        tried, n = name, 1
        while tried.lower() in seen:
            n += 1
            tried = f"{name}_{n}"
        seen.add(tried.lower())
        out.append(tried)
    return out


def binary_columns(cards: list[Card]) -> list[Column]:
    n = int_value(cards, "TFIELDS")
    if n is None:
        raise MissingKeyword("TFIELDS")
    names = [(text_value(cards, f"TTYPE{i + 1}") or "").strip() or None for i in range(n)]
    out, at = [], 0
    for i, name in enumerate(unique_names(names)):
        form = text_value(cards, f"TFORM{i + 1}")
        if form is None:
            raise MissingKeyword(f"TFORM{i + 1}")
        repeat, code, item = parse_tform(form)
        scale, zero = float_value(cards, f"TSCAL{i + 1}"), float_value(cards, f"TZERO{i + 1}")
        c = Column(name, repeat, code, item, at, parse_tdim(text_value(cards, f"TDIM{i + 1}") or "") or [], 1.0 if scale is None else scale, zero or 0.0, names[i])
        out.append(c)
        at += c.width
    return out


def row_dtype(columns: list[Column], width: int) -> np.dtype:
    """One record of the table; columns that are not wanted leave gaps."""
    formats = [("u1", (c.width,)) if c.code in "XA" or c.code == "B" and c.repeat != 1 else (">u4", (2,)) if c.code == "P" else (">u8", (2,)) if c.code == "Q" else (NUMPY[c.code], (c.repeat,)) for c in columns]
    return np.dtype({"names": [f"f{i}" for i in range(len(columns))], "formats": formats, "offsets": [c.offset for c in columns], "itemsize": width})


def nested(kind: T.DataType, depth: int) -> T.DataType:
    for _ in range(depth):
        kind = T.ArrayType(kind)
    return kind


def spark_type(c: Column, physical: bool = False, tdim: bool = False) -> T.DataType:
    code = c.item or c.code
    if c.code == "A":
        return T.StringType()
    if code == "A":
        return T.StringType()
    if code == "X" or code == "B" and (c.item or c.repeat != 1) and not (physical and c.scaled):
        return T.BinaryType()
    scalar = T.DoubleType() if physical and c.scaled and code in "BIJKED" else SCALARS[code]
    if c.item:
        return T.ArrayType(scalar)
    if tdim and c.tdim and np.prod(c.tdim) == c.repeat:
        return nested(scalar, len(c.tdim))
    return scalar if c.repeat == 1 else T.ArrayType(scalar)


def spark_field(c: Column, physical: bool = False, tdim: bool = False) -> T.StructField:
    meta = {"tform": c.tform} | ({"tdim": c.tdim} if c.tdim else {}) | ({"tscal": c.scale, "tzero": c.zero} if c.scaled else {}) | ({"ttype": c.original} if c.original != c.name and c.original else {})
    return T.StructField(c.name, spark_type(c, physical, tdim), True, meta)


@dataclass
class AsciiColumn:
    name: str
    kind: str  # A, I, F, E or D
    width: int
    decimals: int = 0
    offset: int = 0

    @property
    def tform(self) -> str:
        return f"{self.kind}{self.width}" + (f".{self.decimals}" if self.kind in "FED" else "")


def parse_ascii_tform(text: str) -> tuple[str, int, int]:
    m = _ASCII.fullmatch(text)
    if not m:
        raise InvalidValue(f"TFORM {text!r}")
    if m[1] or m[2]:
        return ("A", int(m[1]), 0) if m[1] else ("I", int(m[2]), 0)
    return m[3], int(m[4]), int(m[5])


def ascii_columns(cards: list[Card]) -> list[AsciiColumn]:
    """Columns with offsets from 0; TBCOLn counts from 1."""
    n = int_value(cards, "TFIELDS")
    if n is None:
        raise MissingKeyword("TFIELDS")
    names = unique_names([(text_value(cards, f"TTYPE{i + 1}") or "").strip() or None for i in range(n)])
    out = []
    for i, name in enumerate(names):
        form, start = text_value(cards, f"TFORM{i + 1}"), int_value(cards, f"TBCOL{i + 1}")
        if form is None or start is None:
            raise MissingKeyword(f"TFORM{i + 1}" if form is None else f"TBCOL{i + 1}")
        if start < 1:
            raise InvalidValue(f"TBCOL{i + 1} = {start}")
        out.append(AsciiColumn(name, *parse_ascii_tform(form), start - 1))
    return out


ASCII_TYPES = {"A": T.StringType(), "I": T.LongType(), "F": T.DoubleType(), "E": T.DoubleType(), "D": T.DoubleType()}


def ascii_field(c: AsciiColumn) -> T.StructField:
    return T.StructField(c.name, ASCII_TYPES[c.kind], True, {"tform": c.tform})


def pixel_type(bitpix: int) -> T.DataType:
    if bitpix not in PIXEL_TYPES:
        raise InvalidBitpix(str(bitpix))
    return PIXEL_TYPES[bitpix]


_CODES = {T.BooleanType: "L", T.ByteType: "I", T.ShortType: "I", T.IntegerType: "J", T.LongType: "K", T.FloatType: "E", T.DoubleType: "D"}


def code_of(kind: T.DataType) -> str:
    if isinstance(kind, T.StructType) and [f.name for f in kind.fields] == ["re", "im"]:
        return "C" if isinstance(kind.fields[0].dataType, T.FloatType) else "M"
    code = _CODES.get(type(kind))
    if code is None:
        raise InvalidValue(f"a table can't hold {kind.simpleString()}")
    return code


def default_tform(f: T.StructField, width: int = 64) -> str:
    """TFORM of a Spark column: metadata ``tform`` if it has one, else by type; arrays are of variable length."""
    if "tform" in (f.metadata or {}):
        return f.metadata["tform"]
    kind = f.dataType
    if isinstance(kind, T.StringType):
        return f"{width}A"
    if isinstance(kind, T.BinaryType):
        return "1PB"
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        while isinstance(inner, T.ArrayType):
            inner = inner.elementType
        return f"1P{code_of(inner)}"
    return f"1{code_of(kind)}"


def layout(forms: list[tuple[str, str]]) -> list[Column]:
    """Columns from (name, TFORM), with offsets."""
    out, at = [], 0
    for name, form in forms:
        c = Column(name, *parse_tform(form), at, original=name)
        out.append(c)
        at += c.width
    return out
