"""HDUs and headers of files as DataFrames, and the text summary of a file."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import padded
from ..functions.cards import Card, ComplexInt, format_card, int_value
from ..functions.errors import FitsError
from ..sources import files
from ..sources.hdu import ASCII, BINARY, GROUPS, IMAGE, PRIMARY, TILED, Hdu, read_hdus
from .checksum import verify_checksum, verify_datasum

CATALOG = (
    "path string, hdu_index int, kind string, extname string, bitpix int, naxes array<bigint>, header_start bigint, data_start bigint, data_len bigint, padded_len bigint, "
    "pcount bigint, gcount bigint, tfields int, z_bitpix int, z_axes array<bigint>, z_tiles array<bigint>, z_type string, datasum_ok boolean, checksum_ok boolean, _corrupt string"
)
HEADERS = "path string, hdu_index int, pos int, keyword string, vtype string, v_bool boolean, v_int bigint, v_float double, v_str string, v_re double, v_im double, comment string"


def _paths(spark, path: str) -> DataFrame:
    """Paths of the files, a task for each few of them."""
    found = [(p,) for p, _ in files.listing(path)]
    df = spark.createDataFrame(found, "path string")
    return df.repartition(max(1, min(len(found), 4 * spark.sparkContext.defaultParallelism)))


def _by_value():
    import pyspark.cloudpickle

    import heliograph

    pyspark.cloudpickle.register_pickle_by_value(heliograph)


def describe(hdu: Hdu, integrity: bool) -> dict:
    tiled = hdu.kind == TILED
    axes = hdu.shape if tiled else None
    has = {c.keyword for c in hdu.cards}
    return {
        "path": hdu.path, "hdu_index": hdu.index, "kind": hdu.kind, "extname": hdu.extname, "bitpix": hdu.bitpix, "naxes": hdu.naxes, "header_start": hdu.header_start, "data_start": hdu.data_start,
        "data_len": hdu.data_len, "padded_len": padded(hdu.data_len), "pcount": hdu.pcount, "gcount": hdu.gcount, "tfields": hdu.tfields, "z_bitpix": int_value(hdu.cards, "ZBITPIX") if tiled else None, "z_axes": axes,
        "z_tiles": [int_value(hdu.cards, f"ZTILE{i + 1}") or (n if i == 0 else 1) for i, n in enumerate(axes)] if tiled else None, "z_type": next((str(c.value).strip() for c in hdu.cards if c.keyword == "ZCMPTYPE"), None) if tiled else None,
        "datasum_ok": verify_datasum(hdu) if integrity and "DATASUM" in has else None, "checksum_ok": verify_checksum(hdu) if integrity and "CHECKSUM" in has else None, "_corrupt": None,
    }


def catalog(spark, path: str, integrity: bool = False, failfast: bool = False) -> DataFrame:
    """One row per HDU. With ``integrity`` checksums are verified, null where there is none. A file that can't be read gives a row
    that says why in _corrupt, or with ``failfast`` an error."""
    _by_value()
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(CATALOG))

    def task(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                try:
                    rows = [describe(h, integrity) for h in read_hdus(p, failfast)]
                except (FitsError, OSError) as e:
                    if failfast:
                        raise
                    rows = [{n: None for n in schema.names} | {"path": p, "_corrupt": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return _paths(spark, path).mapInArrow(task, CATALOG)


def header_row(path: str, index: int, pos: int, card: Card) -> dict:
    v = card.value
    row = dict.fromkeys(("v_bool", "v_int", "v_float", "v_str", "v_re", "v_im"))
    kind = None
    if isinstance(v, bool):
        kind, row["v_bool"] = "logical", v
    elif isinstance(v, int):
        kind, row["v_int"] = "integer", v
    elif isinstance(v, float):
        kind, row["v_float"] = "float", v
    elif isinstance(v, str):
        kind, row["v_str"] = "string", v
    elif isinstance(v, (complex, ComplexInt)):
        kind = "complex_int" if isinstance(v, ComplexInt) else "complex"
        row["v_re"], row["v_im"] = (float(v.re), float(v.im)) if kind == "complex_int" else (v.real, v.imag)
    return {"path": path, "hdu_index": index, "pos": pos, "keyword": card.keyword, "vtype": kind, **row, "comment": card.comment}


def headers(spark, path: str) -> DataFrame:
    """One row per card, CONTINUE strings merged."""
    _by_value()
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(HEADERS))

    def task(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist([header_row(p, h.index, i, c) for h in read_hdus(p) for i, c in enumerate(h.cards)], schema=schema)

    return _paths(spark, path).mapInArrow(task, HEADERS)


def primary(df: DataFrame) -> DataFrame:
    return df.filter("hdu_index = 0")


def by_index(df: DataFrame, index: int) -> DataFrame:
    return df.filter(F.col("hdu_index") == index)


def by_name(df: DataFrame, name: str) -> DataFrame:
    """Of the HDUs with exactly that EXTNAME the first in each file."""
    first = df.filter(F.col("extname") == name).groupBy(F.col("path").alias("_path")).agg(F.min("hdu_index").alias("_first"))
    return df.join(first, (F.col("path") == F.col("_path")) & (F.col("hdu_index") == F.col("_first"))).drop("_path", "_first")


def key(df: DataFrame, keyword: str, kind: str = "string") -> DataFrame:
    """path, hdu_index, value: the first card of that keyword that has a value, as logical, integer, float (integers are taken) or string."""
    value = {"logical": F.col("v_bool"), "integer": F.col("v_int"), "float": F.coalesce("v_float", F.col("v_int").cast("double")), "string": F.col("v_str")}[kind]
    return df.filter((F.col("keyword") == keyword) & F.col("vtype").isNotNull()).groupBy("path", "hdu_index").agg(F.min_by(value, "pos").alias("value"))


# Text.

# Headings of the summary.
_HEADINGS = {PRIMARY: "Primary", IMAGE: "IMAGE extension", ASCII: "TABLE extension", BINARY: "BINTABLE extension", GROUPS: "Random Groups", TILED: "Compressed Image"}


def hdu_text(h: Hdu) -> str:
    name = f" (EXTNAME: {h.extname})" if h.extname and h.kind != PRIMARY else ""
    lines = [f"HDU {h.index}: {_HEADINGS[h.kind]}{name}"]
    if h.kind in (ASCII, BINARY):
        width, rows = h.naxes
        lines += [f"  Columns: {h.tfields}", f"  Rows: {rows}", f"  Row width: {width} bytes"]
        if h.kind == BINARY and h.pcount:
            lines.append(f"  Heap size: {h.pcount} bytes")
        lines.append(f"  Data size: {width * rows} bytes")
        return "\n".join(lines)
    bitpix, axes = (h.image_bitpix, h.shape) if h.kind == TILED else (h.bitpix, h.naxes)
    lines += [f"  BITPIX: {bitpix}", f"  NAXIS: {len(axes)}"]
    if axes:
        lines.append(f"  Dimensions: [{', '.join(map(str, axes))}]")
    if h.kind == GROUPS:
        lines += [f"  Parameters: {h.pcount}", f"  Groups: {h.gcount}"]
    return "\n".join([*lines, f"  Data size: {h.data_len} bytes"])


def file_text(path: str, verbose: bool = False) -> str:
    parts = []
    for h in read_hdus(path):
        text = hdu_text(h)
        if verbose:
            text += "".join(f"\n    {format_card(c).decode('latin-1').rstrip()}" for c in h.cards)
        parts.append(text)
    return "\n\n".join(parts) + "\n"
