"""Calibration, masks and casts as column expressions: all of it stays in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.errors import InvalidBitpix, InvalidValue

# Ranges of the integer types by bits; unsigned for single bytes.
RANGES = {8: (0, 255), 16: (-(2**15), 2**15 - 1), 32: (-(2**31), 2**31 - 1), 64: (-(2**63), 2**63 - 1)}
_NAMES = {8: "smallint", 16: "smallint", 32: "int", 64: "bigint", -32: "float", -64: "double"}


def physical(raw: Column, scale: float = 1.0, zero: float = 0.0) -> Column:
    """zero + scale * raw in doubles, in this order."""
    return F.lit(float(zero)) + F.lit(float(scale)) * raw.cast("double")


def physical_array(raw: Column, scale: float = 1.0, zero: float = 0.0) -> Column:
    return F.transform(raw, lambda x: physical(x, scale, zero))


def half_away(v: Column) -> Column:
    """Rounds halves away from zero."""
    whole = F.when(v < 0, -F.floor(-v)).otherwise(F.floor(v)).cast("double")
    return F.when(F.abs(v) >= 2.0**52, v).otherwise(F.when(F.abs(v - whole) >= 0.5, whole + F.signum(v)).otherwise(whole))


def saturated(v: Column, bits: int) -> Column:
    """A double as an integer of so many bits: beyond the range the nearest end, NaN is 0, fractions are cut off."""
    lo, hi = RANGES[bits]
    cut = F.when(v < 0, -F.floor(-F.greatest(v, F.lit(-(2.0**62))))).otherwise(F.floor(F.least(v, F.lit(2.0**62))))
    if bits == 64:
        body = F.when(v >= 2.0**63, F.lit(hi)).when(v <= -(2.0**63), F.lit(lo)).when(F.abs(v) < 2.0**62, cut.cast("bigint")).otherwise(v.cast("bigint"))
    else:
        body = F.when(v >= float(hi), F.lit(hi)).when(v <= float(lo), F.lit(lo)).otherwise(cut)
    return F.when(v.isNull(), F.lit(None)).when(F.isnan(v), F.lit(0)).otherwise(body).cast(_NAMES[bits])


def raw(value: Column, scale: float, zero: float, bitpix: int) -> Column:
    """The stored number of a physical value: (value - zero) / scale, rounded half away from zero, held in the type's range."""
    if bitpix not in _NAMES:
        raise InvalidBitpix(str(bitpix))
    if scale == 0:
        raise InvalidValue("a scale of 0 can't be reversed")
    v = (value.cast("double") - F.lit(float(zero))) / F.lit(float(scale))
    return v.cast(_NAMES[bitpix]) if bitpix < 0 else saturated(half_away(v), bitpix)


def wrapped(value: int, bits: int) -> int:
    """An integer cut to so many bits, unsigned for 8."""
    value &= (1 << bits) - 1
    return value if bits == 8 or value < 1 << (bits - 1) else value - (1 << bits)


def undefined(pixel: Column, bitpix: int, blank: int | None = None) -> Column:
    """True where a pixel is BLANK (cut to the pixel's width), or NaN for floats."""
    if bitpix < 0:
        return F.isnan(pixel)
    return F.lit(False) if blank is None else pixel == F.lit(wrapped(blank, bitpix))


def undefined_mask(pixels: Column, bitpix: int, blank: int | None = None) -> Column:
    """array<boolean> for a line of pixels; null if none is undefined."""
    if bitpix > 0 and blank is None:
        return F.lit(None).cast("array<boolean>")
    mask = F.transform(pixels, lambda p: undefined(p, bitpix, blank))
    return F.when(F.exists(pixels, lambda p: undefined(p, bitpix, blank)), mask)


def physical_pixel(pixel: Column, bitpix: int, scale: float = 1.0, zero: float = 0.0, blank: int | None = None, as_null: bool = False) -> Column:
    """Calibrated value; NaN (or null) where the pixel is undefined."""
    none = F.lit(None).cast("double") if as_null else F.lit(float("nan"))
    return F.when(undefined(pixel, bitpix, blank), none).otherwise(physical(pixel, scale, zero))


def physical_line(pixels: Column, bitpix: int, **options) -> Column:
    return F.transform(pixels, lambda p: physical_pixel(p, bitpix, **options))


def cast_pixel(pixel: Column, source: int, target: int) -> Column:
    """A pixel of one BITPIX as another: integers wrap, floats are cut off and saturate, NaN becomes 0."""
    if target < 0:
        return pixel.cast(_NAMES[target])
    if source < 0:
        return saturated(pixel.cast("double"), target)
    if target == 64:
        return pixel.cast("bigint")
    size = 1 << target
    low = F.pmod(pixel.cast("bigint"), F.lit(size))
    return (low if target == 8 else F.when(low >= size // 2, low - size).otherwise(low)).cast(_NAMES[target])


def unsigned(raw_column: Column, bits: int) -> Column:
    """Unsigned integers kept by the usual offset (TZERO or BZERO of half the range); 64 bits need a decimal."""
    if bits == 64:
        return raw_column.cast("decimal(20,0)") + F.lit(2**63).cast("decimal(20,0)")
    return raw_column.cast({16: "int", 32: "bigint"}[bits]) + F.lit(1 << (bits - 1))


# Which stored types a typed column read takes.
READABLE = {"int": "IJK", "bigint": "IJK", "float": "ED", "double": "DEJK", "string": "A"}


def typed(df, name: str, target: str):
    """A column of a decoded table as int, bigint, float, double or string, from the stored types that each may come from."""
    form = df.schema[name].metadata.get("tform", "").lstrip("0123456789")
    if target not in READABLE or form and form[0] not in READABLE[target]:
        raise InvalidValue(f"{name} of type {form} can't be read as {target}")
    kind = df.schema[name].dataType.typeName()
    column = F.col(name)
    if kind == "array":
        return F.transform(column, lambda x: _typed(x, target)).alias(name)
    return _typed(column, target, kind).alias(name)


def _typed(column: Column, target: str, kind: str | None = None) -> Column:
    if target == "int" and kind == "long":
        return cast_pixel(column, 64, 32)
    return column.cast(target)
