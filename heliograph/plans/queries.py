"""Queries over FITS: each encodes a table, reads it back through the data source and applies an operator. With their SQL.

Encoding is part of each query on purpose: encoder, scan and operator are all exercised, and SQL on the source tables
says what must come out.
"""

from __future__ import annotations

import gzip

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.blocks import padded_column
from ..functions.cards import Card
from ..operators import calibration, catalog, checksum, edit
from ..operators.handle import FitsHandle
from ..sources.fits import read_fits
from ..sources.hdu import primary_cards
from ..sources.sink import table_hdu, write_fits, write_local
from ..sources.tiles import rice_encode, tiled_cards
from .work import shared_path, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def encoded(df: DataFrame, name: str, **options) -> str:
    path = shared_path(df.sparkSession, f"{name}.fits")
    write_fits(df, path, extname=name.upper(), **options)
    return path


def lines_image(df: DataFrame, name: str, key: str, data, bitpix: int, width: int, rows: int, axes: str | None = None, **options) -> str:
    """An image whose lines are rows of the table in order of a unique key."""
    lines = df.select(F.col(key).alias("row_index"), data.alias("data")).orderBy("row_index")
    return encoded(lines, name, kind="image", bitpix=bitpix, naxes=axes or f"{width},{rows}", **options)


def column_image(df: DataFrame, name: str, key: str, value, bitpix: int, **options) -> str:
    """An image of one pixel a line: a column in order of its key."""
    return lines_image(df, name, key, F.array(value), bitpix, 1, df.count(), **options)


def keyed(df: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Lines back beside the key that gave their order."""
    order = source.select(key, (F.row_number().over(Window.orderBy(key)) - 1).cast("bigint").alias("row_index"))
    return order.join(df, "row_index").drop("row_index")


# Binary tables.


@query("select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def bintable_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_fits(spark, encoded(table(spark, sf_dir, "customer"), "customer"))


@query("select o_orderkey, o_totalprice from orders")
def bintable_project(spark, sf_dir):
    path = encoded(table(spark, sf_dir, "orders").withColumn("o_orderdate", F.unix_micros(F.col("o_orderdate").cast("timestamp"))), "orders")
    return read_fits(spark, path, columns=["o_orderkey", "o_totalprice"])


_ORDERS = "select *, row_number() over (order by o_orderkey) - 1 as n from orders"


@query(f"select n as _row, o_orderkey, o_orderstatus from ({_ORDERS}) where n >= 100 and n < 300")
def bintable_row_range(spark, sf_dir):
    path = encoded(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey"), "orders")
    return read_fits(spark, path, rowIndex=True).filter("_row >= 100 and _row < 300")


@query(f"select o_orderkey from ({_ORDERS}) where n >= 50 and n < 60")
def bintable_range_option(spark, sf_dir):
    path = encoded(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey"), "orders")
    return read_fits(spark, path, columns=["o_orderkey"], rows="50:60")


@query("select p_partkey, p_name, p_size from (select *, row_number() over (order by p_partkey) - 1 as n from part) where n = 42")
def bintable_single_row(spark, sf_dir):
    path = encoded(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").orderBy("p_partkey"), "part")
    return read_fits(spark, path, rowIndex=True).filter("_row = 42").drop("_row")


def _embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


@query("select vec_id, i::int as pos, embedding[i]::double as value from embeddings, (select unnest(generate_series(1, 64)) as i)")
def bintable_array_cell(spark, sf_dir):
    path = encoded(_embeddings(spark, sf_dir), "embeddings", tforms="embedding=64E")
    return read_fits(spark, path).select("vec_id", F.posexplode("embedding")).select("vec_id", (F.col("pos") + 1).alias("pos"), F.col("col").cast("double").alias("value"))


@query("select vec_id, ((i - 1) // 8)::int as r, ((i - 1) % 8)::int as c, embedding[i]::double as value from embeddings, (select unnest(generate_series(1, 64)) as i)")
def bintable_tdim(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    meta = df.withMetadata("embedding", {"tform": "64E", "tdim": [8, 8]})
    got = read_fits(spark, encoded(meta, "embeddings"), tdim=True)
    rows = got.select("vec_id", F.posexplode("embedding").alias("r", "line"))
    return rows.select("vec_id", "r", F.posexplode("line").alias("c", "v")).select("vec_id", "r", "c", F.col("v").cast("double").alias("value"))


@query("select p_partkey, p_size % 2 = 0 as even, (p_size & 255)::smallint as low, lower(lpad(to_hex(p_size & 255), 2, '0')) as bits from part")
def bintable_logical_bit_byte(spark, sf_dir):
    size = F.col("p_size")
    df = table(spark, sf_dir, "part").select("p_partkey", (size % 2 == 0).alias("even"), size.bitwiseAND(255).cast("short").alias("low"), F.unhex(F.lpad(F.hex(size.bitwiseAND(255)), 2, "0")).alias("bits"))
    got = read_fits(spark, encoded(df, "part", tforms="low=1B;bits=8X"))
    return got.withColumn("bits", F.lower(F.hex("bits")))


@query("select s_suppkey, s_acctbal as re, -s_acctbal as im, s_acctbal::float::double as cre, (2 * s_acctbal)::float::double as cim from supplier")
def bintable_complex(spark, sf_dir):
    v = F.col("s_acctbal")
    df = table(spark, sf_dir, "supplier").select("s_suppkey", F.struct(v.alias("re"), (-v).alias("im")).alias("m"), F.struct(v.cast("float").alias("re"), (2 * v).cast("float").alias("im")).alias("c"))
    got = read_fits(spark, encoded(df, "supplier"))
    return got.select("s_suppkey", "m.re", "m.im", F.col("c.re").cast("double").alias("cre"), F.col("c.im").cast("double").alias("cim"))


@query("select p_partkey, 10 + 2.0::double * p_size as size from part")
def bintable_scaling(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("size"))
    return read_fits(spark, encoded(df, "part", scale="size=2,10"), physical=True)


@query("select p_partkey, 10 + 2.0::double * p_size as size from part")
def bintable_scaling_column(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("size"))
    got = read_fits(spark, encoded(df, "part", scale="size=2,10"))
    meta = got.schema["size"].metadata
    return got.withColumn("size", calibration.physical(F.col("size"), meta["tscal"], meta["tzero"]))


@query(f"select n as _row, o_custkey::int as k, o_totalprice as price from ({_ORDERS})")
def bintable_typed_cast(spark, sf_dir):
    path = encoded(table(spark, sf_dir, "orders").orderBy("o_orderkey").select("o_custkey", "o_totalprice"), "orders")
    h = FitsHandle(spark, path).hdu("ORDERS")
    return h.read_col("o_custkey", "int").withColumnRenamed("o_custkey", "k").join(h.read_col("o_totalprice", "double").withColumnRenamed("o_totalprice", "price"), "_row")


# Images.


def _vectors(spark, sf_dir, bitpix, value, name, **options):
    df = _embeddings(spark, sf_dir)
    n = df.count()
    path = lines_image(df, name, "vec_id", F.transform("embedding", value), bitpix, 64, n, **options)
    return df, path


def _image_sql(value: str, kind: str) -> str:
    return f"select vec_id, i::int as pos, {value}::{kind} as value from (select vec_id, i, embedding[i]::double as x from embeddings, (select unnest(generate_series(1, 64)) as i))"


def _image(spark, sf_dir, bitpix, value, name):
    df, path = _vectors(spark, sf_dir, bitpix, value, name)
    got = keyed(read_fits(spark, path), df, "vec_id").select("vec_id", F.posexplode("data").alias("pos", "value"))
    return got.withColumn("pos", F.col("pos") + 1)


@query(_image_sql("floor(abs(x) * 100) % 256", "smallint"))
def image_u8(spark, sf_dir):
    return _image(spark, sf_dir, 8, lambda x: (F.floor(F.abs(x.cast("double")) * 100) % 256).cast("short"), "u8")


@query(_image_sql("floor(x * 1000)", "smallint"))
def image_i16(spark, sf_dir):
    return _image(spark, sf_dir, 16, lambda x: F.floor(x.cast("double") * 1000).cast("short"), "i16")


@query(_image_sql("floor(x * 1000000)", "int"))
def image_i32(spark, sf_dir):
    return _image(spark, sf_dir, 32, lambda x: F.floor(x.cast("double") * 1000000).cast("int"), "i32")


@query(_image_sql("floor(x * 1000000000)", "bigint"))
def image_i64(spark, sf_dir):
    return _image(spark, sf_dir, 64, lambda x: F.floor(x.cast("double") * 1000000000).cast("bigint"), "i64")


@query(_image_sql("x", "double"))
def image_f32(spark, sf_dir):
    return _image(spark, sf_dir, -32, lambda x: x, "f32").withColumn("value", F.col("value").cast("double"))


@query(_image_sql("x * 3", "double"))
def image_f64(spark, sf_dir):
    return _image(spark, sf_dir, -64, lambda x: x.cast("double") * 3, "f64")


_PIXELS = "(select n * 64 + i - 1 as flat, n, i, x from (select n, i, embedding[i]::double as x from (select embedding, row_number() over (order by vec_id) - 1 as n from embeddings), (select unnest(generate_series(1, 64)) as i)))"


@query(f"select flat, x as value from {_PIXELS} where flat >= 100 and flat < 1000")
def image_section(spark, sf_dir):
    _, path = _vectors(spark, sf_dir, -32, lambda x: x, "f32")
    return read_fits(spark, path, section="100:1000").withColumn("value", F.col("value").cast("double"))


@query(f"select n as row_index, i::int as pos, x as value from {_PIXELS} where n >= 10 and n < 20")
def image_rows(spark, sf_dir):
    _, path = _vectors(spark, sf_dir, -32, lambda x: x, "f32")
    got = read_fits(spark, path).filter("row_index >= 10 and row_index < 20")
    return got.select("row_index", F.posexplode("data").alias("pos", "value")).select("row_index", (F.col("pos") + 1).alias("pos"), F.col("value").cast("double").alias("value"))


@query(f"select i - 1 as i1, n as i2, flat, x as value from {_PIXELS} where i - 1 >= 5 and i - 1 < 9 and n >= 3 and n < 30")
def image_region(spark, sf_dir):
    _, path = _vectors(spark, sf_dir, -32, lambda x: x, "f32")
    return read_fits(spark, path, region="5:9,3:30", layout="pixels").withColumn("value", F.col("value").cast("double"))


@query(f"select (i - 1) % 8 as i1, (i - 1) // 8 as i2, n as i3, x as value from {_PIXELS} where (i - 1) % 8 >= 1 and (i - 1) % 8 < 4 and (i - 1) // 8 >= 2 and (i - 1) // 8 < 7 and n >= 4 and n < 9")
def image_region_cube(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    rows = df.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", k * 8 + 1, 8))).alias("k", "line"))
    path = lines_image(rows.withColumn("row", F.col("vec_id") * 8 + F.col("k")), "cube", "row", F.col("line"), -32, 8, 0, axes=f"8,8,{df.count()}")
    got = read_fits(spark, path, region="1:4,2:7,4:9", layout="pixels")
    return got.select("i1", "i2", "i3", F.col("value").cast("double").alias("value"))


# Calibration and masks.


def _sizes(spark, sf_dir, cards, bitpix=32):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return df, column_image(df, "size", "p_partkey", F.col("p_size"), bitpix, cards=cards)


def _one(df, source, key):
    return keyed(df, source, key).select(key, F.col("data")[0].alias("value"))


@query("select p_partkey, 100 + 2.5::double * p_size as value from part")
def image_physical(spark, sf_dir):
    df, path = _sizes(spark, sf_dir, [["BSCALE", 2.5], ["BZERO", 100.0]])
    return _one(read_fits(spark, path, physical=True), df, "p_partkey")


@query("select event_id, (user_id % 65536)::int as value from events")
def image_unsigned16(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 65536).cast("int").alias("u"))
    path = column_image(df, "u16", "event_id", calibration.raw(F.col("u"), 1.0, 32768.0, 16), 16, cards=[["BSCALE", 1.0], ["BZERO", 32768.0]])
    got = _one(read_fits(spark, path), df, "event_id")
    return got.withColumn("value", calibration.unsigned(F.col("value"), 16))


@query("select p_partkey, least(greatest(round((p_retailprice - 1000) / 0.01), -32768), 32767)::smallint as value from part")
def image_reverse_clamp(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    path = column_image(df, "price", "p_partkey", calibration.raw(F.col("p_retailprice"), 0.01, 1000.0, 16), 16)
    return _one(read_fits(spark, path), df, "p_partkey")


@query("select p_partkey, case when p_size <> 7 then 1 + 0.5::double * p_size end as value from part")
def image_blank(spark, sf_dir):
    df, path = _sizes(spark, sf_dir, [["BSCALE", 0.5], ["BZERO", 1.0], ["BLANK", 7]])
    return _one(read_fits(spark, path, physical=True, blankAsNull=True), df, "p_partkey")


@query("select count(*) filter (p_size = 7) as undefined, count(*) as pixels from part")
def blank_mask_count(spark, sf_dir):
    _, path = _sizes(spark, sf_dir, [["BLANK", 7]])
    got = read_fits(spark, path).withColumn("mask", calibration.undefined_mask(F.col("data"), 32, 7))
    return got.select(F.size(F.filter(F.coalesce("mask", F.array(F.lit(False))), lambda m: m)).alias("k")).agg(F.sum("k").alias("undefined"), F.count(F.lit(1)).alias("pixels"))


@query("select p_partkey, least(greatest(trunc(p_retailprice * 100 - 100000), -32768), 32767)::smallint as value from part")
def pixel_cast_saturate(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    path = column_image(df, "price", "p_partkey", F.col("p_retailprice") * 100 - 100000, -64)
    image = FitsHandle(spark, path).hdu("PRICE").image("smallint")
    return _one(image, df, "p_partkey")


@query("select p_partkey, (((p_size * 5000 + 32768) % 65536) - 32768)::smallint as value from part")
def pixel_cast_wrap(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    path = column_image(df, "size", "p_partkey", F.col("p_size") * 5000, 32)
    return _one(FitsHandle(spark, path).hdu("SIZE").image("smallint"), df, "p_partkey")


# Catalog and headers.


def _three(spark, sf_dir) -> str:
    """An empty primary, a table of nations and an image."""
    path = encoded(table(spark, sf_dir, "nation").orderBy("n_nationkey"), "nation")
    df = _embeddings(spark, sf_dir)
    lines = df.select(F.col("vec_id").alias("row_index"), F.col("embedding").alias("data")).orderBy("row_index")
    write_fits(lines, path, mode="append", extname="VECTORS", kind="image", bitpix=-32, naxes=f"64,{df.count()}")
    return path


@query(
    """select * from (values (0, 'primary', null, 0::bigint), (1, 'binary_table', 'NATION', null), (2, 'compressed', null, null)) as t(hdu_index, kind, extname, data_len) where hdu_index = 0
    union all select 1, 'binary_table', 'NATION', (count(*) * (8 + max(strlen(n_name))))::bigint from nation
    union all select 2, 'image', 'VECTORS', count(*) * 256 from embeddings"""
)
def hdu_catalog(spark, sf_dir):
    return catalog.catalog(spark, _three(spark, sf_dir)).select("hdu_index", "kind", "extname", "data_len")


@query("select n_nationkey, n_name, n_regionkey from nation")
def hdu_by_name(spark, sf_dir):
    path = _three(spark, sf_dir)
    return read_fits(spark, path, hdu="NATION").join(F.broadcast(catalog.by_name(catalog.catalog(spark, path), "NATION").select("hdu_index")), F.col("hdu_index") == 1).drop("hdu_index")


@query("select 'N' || n_nationkey as keyword, n_name as value from nation")
def header_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()
    path = shared_path(spark, "keys.fits")
    write_local(path, [([*primary_cards(8, []), *(Card(f"N{r[0]}", r[1]) for r in rows)], b"")])
    return catalog.headers(spark, path).filter("vtype = 'string' and keyword rlike '^N[0-9]+$'").select("keyword", F.col("v_str").alias("value"))


@query("select string_agg(n_name, '; ' order by n_nationkey) as names from nation")
def header_continue(spark, sf_dir):
    text = "; ".join(r[0] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect())
    path = shared_path(spark, "long.fits")
    write_local(path, [([*primary_cards(8, []), Card("NAMES", text)], b"")])
    return catalog.key(catalog.headers(spark, path), "NAMES").select(F.col("value").alias("names"))


@query("select 'random_groups' as kind, 6::bigint as pcount, 2::bigint as gcount, 144::bigint as data_len")
def random_groups_meta(spark, sf_dir):
    path = shared_path(spark, "groups.fits")
    write_local(path, [([*primary_cards(-32, [0, 3, 4, 1, 1, 1]), Card("GROUPS", True), Card("PCOUNT", 6), Card("GCOUNT", 2)], b"\0" * 144)])
    return catalog.catalog(spark, path).select("kind", "pcount", "gcount", "data_len")


@query("select 2::int as hdu_index, (ceil(count(*) * 256 / 2880.0) * 2880)::bigint as padded_len, (ceil(count(*) * 256 / 2880.0) * 2880)::bigint as computed from embeddings")
def padded_sizes(spark, sf_dir):
    df = catalog.by_index(catalog.catalog(spark, _three(spark, sf_dir)), 2)
    return df.select("hdu_index", "padded_len", padded_column(F.col("data_len")).alias("computed"))


# Text tables.


@query("select s_suppkey, s_name, s_nationkey::bigint as s_nationkey from supplier")
def ascii_char_int(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return read_fits(spark, encoded(df, "supplier", kind="ascii", tforms="s_suppkey=I12;s_nationkey=I6"))


@query("select s_suppkey, round(s_acctbal, 2) as s_acctbal from supplier")
def ascii_float_f(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return read_fits(spark, encoded(df, "supplier", kind="ascii", tforms="s_suppkey=I12;s_acctbal=F14.2"))


@query("select c_custkey, c_acctbal, c_acctbal as d from customer")
def ascii_exp(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_acctbal").alias("d"))
    return read_fits(spark, encoded(df, "customer", kind="ascii", tforms="c_custkey=I12;c_acctbal=E25.17;d=D25.17"))


# Integrity.


@query("select case when s = 0 then 0 when s % 4294967295 = 0 then 4294967295 else s % 4294967295 end::bigint as datasum from (select sum(o_orderkey) as s from orders)")
def datasum(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey")
    path = column_image(df, "keys", "o_orderkey", F.col("o_orderkey").cast("int"), 32)
    return checksum.datasums(spark, path).filter("hdu_index = 1").select("datasum")


@query("select case when s = 0 then 0 when s % 4294967295 = 0 then 4294967295 else s % 4294967295 end::bigint as datasum from (select sum(o_orderkey) as s from orders)")
def datasum_native(spark, sf_dir):
    path = encoded(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("int").alias("k")), "orders")
    return checksum.word_datasum(read_fits(spark, path), "k")


def _stamped(spark, sf_dir) -> str:
    return encoded(table(spark, sf_dir, "nation"), "nation", checksum=True)


@query("select i::int as hdu_index, true as datasum_ok, true as checksum_ok from (select unnest([0, 1]) as i)")
def checksum_verify(spark, sf_dir):
    return catalog.catalog(spark, _stamped(spark, sf_dir), integrity=True).select("hdu_index", "datasum_ok", "checksum_ok")


@query("select i::int as hdu_index, i = 0 as datasum_ok, i = 0 as checksum_ok from (select unnest([0, 1]) as i)")
def checksum_corrupt(spark, sf_dir):
    from ..sources import files
    from ..sources.hdu import read_hdus

    path = _stamped(spark, sf_dir)
    with files.open_read(path) as f:
        data = bytearray(f.read())
    data[read_hdus(path)[1].data_start] ^= 1
    with files.open_write(path) as f:
        f.write(bytes(data))
    return catalog.catalog(spark, path, integrity=True).select("hdu_index", "datasum_ok", "checksum_ok")


# Variable-length arrays.


@query("select user_id, event_id, i::int as pos from (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as i from events)")
def vla_words(spark, sf_dir):
    df = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("ids"))
    got = read_fits(spark, encoded(df, "events", tforms="ids=1PK"))
    return got.select("user_id", F.posexplode("ids").alias("pos", "event_id"))


@query("select p_partkey, (p_size % 3)::int as n, coalesce((p_size % 3) * 10, 0)::bigint as total from part")
def vla_empty(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.array_repeat(F.lit(10), (F.col("p_size") % 3).cast("int")).alias("a"))
    got = read_fits(spark, encoded(df, "part", tforms="a=1QJ"))
    return got.select("p_partkey", F.size("a").alias("n"), F.aggregate("a", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


@query("select doc_id, text, md5(text) as digest from documents")
def vla_text(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("text"))
    got = read_fits(spark, encoded(df, "documents"))
    return got.select("doc_id", F.col("text").cast("string").alias("text"), F.md5("text").alias("digest"))


# Tiles.


def tiled_file(path: str, pixels: np.ndarray, bitpix: int, naxes: list[int], cut: list[int], kind: str, size: int = 4, scale=None) -> None:
    """A tiled image of a few tiles: fixtures for the reader, coded on the driver."""
    from ..sources.schema import PIXELS

    image = pixels.reshape(naxes[::-1])
    tiles = []
    for y in range(0, naxes[1], cut[1]):
        for x in range(0, naxes[0], cut[0]):
            own = image[y : y + cut[1], x : x + cut[0]].reshape(-1)
            stored = PIXELS[bitpix] if bitpix > 0 and scale is None else ">i4"
            tiles.append(rice_encode(own.astype(np.int64), 32, size) if kind == "RICE_1" else gzip.compress(own.astype(stored).tobytes()))
    columns = [("COMPRESSED_DATA", "1PB", pa.array(tiles, pa.binary()))]
    if scale is not None:
        columns += [("ZSCALE", "1D", pa.array([scale[0]] * len(tiles))), ("ZZERO", "1D", pa.array([scale[1]] * len(tiles)))]
    cards, data = table_hdu(columns, "TILED", tiled_cards(bitpix, naxes, cut, kind, 32, size))
    write_local(path, [(primary_cards(8, []), b""), (cards, data)])


def _tiled(spark, sf_dir, bitpix, kind, cut, size=4, scale=None, factor=1):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size").orderBy("p_partkey")
    got = df.toPandas()
    path = shared_path(spark, "tiled.fits")
    tiled_file(path, got["p_size"].to_numpy() * factor, bitpix, [10, len(got) // 10], cut, kind, size, scale)
    pixels = read_fits(spark, path, hdu="TILED", layout="pixels").select("flat", "value")
    order = df.select("p_partkey", (F.row_number().over(Window.orderBy("p_partkey")) - 1).cast("bigint").alias("flat"))
    return order.join(pixels, "flat").select("p_partkey", "value")


@query("select p_partkey, p_size as value from part")
def tile_gzip_i32(spark, sf_dir):
    return _tiled(spark, sf_dir, 32, "GZIP_1", [10, 1])


@query("select p_partkey, (p_size * 100)::smallint as value from part")
def tile_rice_i16(spark, sf_dir):
    return _tiled(spark, sf_dir, 16, "RICE_1", [10, 4], 2, factor=100)


@query("select p_partkey, p_size * 1000 as value from part")
def tile_rice_i32(spark, sf_dir):
    return _tiled(spark, sf_dir, 32, "RICE_1", [4, 3], 4, factor=1000)


@query("select p_partkey, (100 + 0.25 * p_size)::double as value from part")
def tile_quantized_f32(spark, sf_dir):
    return _tiled(spark, sf_dir, -32, "RICE_1", [10, 1], 4, (0.25, 100.0)).withColumn("value", F.col("value").cast("double"))


# Edits.


@query("select p_partkey, p_size * 2 as p_size from part")
def update_column(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size").orderBy("p_partkey")
    path = encoded(df, "part")
    new = read_fits(spark, path, rowIndex=True).select("_row", (F.col("p_size") * 2).alias("value"))
    edit.update_column(spark, path, "PART", "p_size", new)
    return read_fits(spark, path)


@query("select 'OBSERVER' as keyword, 'someone' as value union all select 'EXTNAME', 'RENAMED'")
def upsert_key(spark, sf_dir):
    path = encoded(table(spark, sf_dir, "region"), "region")
    edit.upsert_key(path, 1, "OBSERVER", "someone", "who")
    edit.upsert_key(path, 1, "EXTNAME", "RENAMED")
    return catalog.headers(spark, path).filter("hdu_index = 1 and keyword in ('OBSERVER', 'EXTNAME')").select("keyword", F.col("v_str").alias("value"))


@query("select n_nationkey, n_name, n_regionkey from nation")
def extract_hdu(spark, sf_dir):
    target = shared_path(spark, "nation.fits")
    from ..sources import files

    files.open_write(target).close()
    edit.extract(_three(spark, sf_dir), "NATION", target)
    return read_fits(spark, target, hdu=1)


@query(f"select n as row_index, i::int as pos, -x as value from {_PIXELS}")
def replace_image(spark, sf_dir):
    _, path = _vectors(spark, sf_dir, -32, lambda x: x, "f32")
    new = read_fits(spark, path).withColumn("data", F.transform("data", lambda x: -x))
    edit.replace_image(spark, path, "F32", new)
    got = read_fits(spark, path).select("row_index", F.posexplode("data").alias("pos", "value"))
    return got.select("row_index", (F.col("pos") + 1).alias("pos"), F.col("value").cast("double").alias("value"))


@query("select 3::int as hdus, count(*) as rows from nation")
def create_and_fill(spark, sf_dir):
    """A file built up by the handle: an empty image, then an empty table; rows come by appending."""
    path = shared_path(spark, "built.fits")
    h = FitsHandle.create(spark, path)
    h.create_image("ZEROS", 16, [4, 3])
    write_fits(table(spark, sf_dir, "nation"), path, mode="append", extname="NATION")
    return read_fits(spark, path, hdu="NATION").agg(F.lit(len(h)).cast("int").alias("hdus"), F.count(F.lit(1)).alias("rows"))


@query("select count(*) as rows, sum(c_custkey)::bigint as keys from customer")
def folder_of_files(spark, sf_dir):
    """A folder with a file per task, which neither writing nor reading has to join."""
    path = shared_path(spark, "customers")
    write_fits(table(spark, sf_dir, "customer").repartition(4, "c_custkey"), path, single=False, extname="CUSTOMER")
    return read_fits(spark, path, hdu="CUSTOMER").agg(F.count(F.lit(1)).alias("rows"), F.sum("c_custkey").alias("keys"))


# The source among Spark's relational operators; these are Spark's own, not the format's.


def lineitems(spark, sf_dir, columns) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(*columns)
    return read_fits(spark, encoded(df, "lineitem"), hdu="LINEITEM", columns=columns)


@query("select l_returnflag, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_price, count(*) as n from lineitem group by 1")
def fits_groupby(spark, sf_dir):
    df = lineitems(spark, sf_dir, ["l_returnflag", "l_quantity", "l_extendedprice"])
    return df.groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.count(F.lit(1)).alias("n"))


@query("select c_mktsegment, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey group by 1")
def fits_join(spark, sf_dir):
    o = read_fits(spark, encoded(table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice"), "orders"))
    c = read_fits(spark, encoded(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "customer"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)::int as rank from orders")
def fits_window(spark, sf_dir):
    o = read_fits(spark, encoded(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "orders"))
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    return o.select("o_custkey", "o_orderkey", rank.alias("rank"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def fits_topk(spark, sf_dir):
    o = read_fits(spark, encoded(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "orders"))
    return o.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10)

