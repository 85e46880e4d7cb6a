"""Queries over headers, handles, tile kinds and odd cells, beside those of queries.py and written as they are."""

from __future__ import annotations

import gzip
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.cards import Card
from ..functions.errors import MissingKeyword
from ..operators import catalog, checksum
from ..operators.handle import FitsHandle
from ..sources import files
from ..sources.fits import read_fits
from ..sources.hdu import primary_cards
from ..sources.schema import PIXELS
from ..sources.sink import image_hdu, table_hdu, write_fits, write_local
from ..sources.tiles import rice_encode, tiled_cards
from .queries import _one, column_image, encoded, lines_image, query
from .work import shared_path, table

# Headers.


def _nations(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()


def _header(spark, cards) -> str:
    path = shared_path(spark, "header.fits")
    write_local(path, [([*primary_cards(8, []), *cards], b"")])
    return path


@query(
    "select 'I' || n_nationkey as keyword, 'integer' as vtype, n_regionkey::double as number, null::boolean as yes, 'region of ' || n_name as comment from nation "
    "union all select 'F' || n_nationkey, 'float', n_nationkey + 0.25, null, null from nation union all select 'L' || n_nationkey, 'logical', null, n_nationkey % 2 = 0, 'is it even' from nation"
)
def header_types(spark, sf_dir):
    cards = []
    for k, name, region in _nations(spark, sf_dir):
        cards += [Card(f"I{k}", region, f"region of {name}"), Card(f"F{k}", k + 0.25), Card(f"L{k}", k % 2 == 0, "is it even")]
    got = catalog.headers(spark, _header(spark, cards)).filter("keyword rlike '^[IFL][0-9]+$'")
    return got.select("keyword", "vtype", F.coalesce(F.col("v_int").cast("double"), "v_float").alias("number"), F.col("v_bool").alias("yes"), "comment")


@query("select 'C' || n_nationkey as keyword, n_nationkey + 0.5 as re, -n_regionkey::double as im from nation")
def header_complex(spark, sf_dir):
    path = _header(spark, [Card(f"C{k}", complex(k + 0.5, -region)) for k, _, region in _nations(spark, sf_dir)])
    return catalog.headers(spark, path).filter("vtype = 'complex'").select("keyword", F.col("v_re").alias("re"), F.col("v_im").alias("im"))


@query("select 'D' || n_nationkey as keyword, (n_nationkey + 0.5) * 1000 as value, 'note' as comment from nation")
def header_d_exponent(spark, sf_dir):
    """Cards with a D exponent, which are read but never written, put in as bytes."""
    rows = _nations(spark, sf_dir)
    path = _header(spark, [Card(f"D{k}", 0) for k, *_ in rows])
    with files.open_read(path) as f:
        data = f.read()
    for k, *_ in rows:
        at = data.index(f"D{k}".ljust(8).encode() + b"=")
        data = data[:at] + f"{f'D{k}':8}= {f'{k}.5D+03':>20} / note".ljust(80).encode() + data[at + 80 :]
    with files.open_write(f"{path}.d") as f:
        f.write(data)
    found = catalog.headers(spark, f"{path}.d").filter("keyword rlike '^D[0-9]+$'")
    return found.select("keyword", F.col("v_float").alias("value"), "comment")


@query("select 'COMMENT' as keyword, 'about ' || n_name as comment from nation union all select 'HISTORY', 'added ' || n_name from nation")
def header_commentary(spark, sf_dir):
    cards = [Card(word, None, f"{verb} {name}") for _, name, _ in _nations(spark, sf_dir) for word, verb in (("COMMENT", "about"), ("HISTORY", "added"))]
    return catalog.headers(spark, _header(spark, cards)).filter("keyword in ('COMMENT', 'HISTORY') and vtype is null").select("keyword", "comment")


@query("select 'count' as keyword, count(*) as number from nation union all select 'missing', 0")
def handle_keys(spark, sf_dir):
    h = FitsHandle(spark, encoded(table(spark, sf_dir, "nation"), "nation")).hdu("NATION")
    h.write_key("ROWS", len(_nations(spark, sf_dir)), "rows here")
    h.write_key("RATIO", 0.5)
    h.write_key("FULL", True)
    assert h.read_key("RATIO", float) == 0.5 and h.read_key("FULL", bool) is True
    try:
        missing = h.read_key("NOTHERE", int)
    except MissingKeyword:
        missing = 0
    return spark.createDataFrame([("count", h.read_key("ROWS", int)), ("missing", missing)], "keyword string, number long")


@query("select 0 as pos, 'primary' as kind, null as extname union all select 1, 'bintable', 'NATION' union all select 2, 'bintable', 'REGION'")
def handle_iterates(spark, sf_dir):
    path = encoded(table(spark, sf_dir, "nation"), "nation")
    write_fits(table(spark, sf_dir, "region"), path, mode="append", extname="REGION")
    f = FitsHandle(spark, path)
    assert f.primary().hdu.index == 0 and len(f) == 3
    return spark.createDataFrame([(i, "bintable" if "bin" in h.info()["kind"].lower() else "primary", h.hdu.extname) for i, h in enumerate(f)], "pos int, kind string, extname string")


@query("select 'HDU 0: Primary' as line union all select '  Rows: ' || count(*) from nation union all select '  Columns: 2' union all select 'HDU 1: BINTABLE extension (EXTNAME: NATION)' union all select '  Row width: 33 bytes' union all select '  Data size: ' || 33 * count(*) || ' bytes' from nation")
def summary_text(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    text = FitsHandle(spark, encoded(df, "nation", tforms="n_name=25A")).summary()
    wanted = ("HDU", "  Rows", "  Columns", "  Row width", "  Data size: 8")
    lines = [x for x in text.split("\n") if x.startswith(wanted)]
    return spark.createDataFrame([(x,) for x in lines], "line string")


@query("select true as fails")
def file_cut_short(spark, sf_dir):
    """A row says why a file can't be read; here the data of a table isn't whole."""
    path = encoded(table(spark, sf_dir, "nation"), "nation")
    with files.open_read(path) as f:
        data = f.read()
    with files.open_write(f"{path}.cut") as f:
        f.write(data[: 2 * 2880 + 10])
    return catalog.catalog(spark, f"{path}.cut").groupBy().agg(F.max(F.col("_corrupt").isNotNull()).alias("fails"))


@query("select n_nationkey, n_nationkey::bigint * 123456789 % 4294967296 as value from nation")
def checksum_text(spark, sf_dir):
    rows = [(k, checksum.decode(checksum.encode(k * 123456789 % 2**32))) for k, *_ in _nations(spark, sf_dir)]
    return spark.createDataFrame(rows, "n_nationkey int, value long")


# Tables.


@query("select count(*) - count(*) as rows, 2 as columns, 2 as text_columns from nation")
def empty_tables(spark, sf_dir):
    f = FitsHandle.create(spark, shared_path(spark, "empty.fits"))
    f.create_table("BIN", [("a", "1J"), ("b", "3A")])
    f.create_table("TXT", [("a", "I8"), ("b", "A5")], ascii_table=True)
    binary, text = f.hdu("BIN").table(), f.hdu("TXT").table()
    return binary.select(F.col("a").cast("string")).unionAll(text.select(F.col("a").cast("string"))).agg(F.count(F.lit(1)).alias("rows"), F.lit(len(binary.columns)).alias("columns"), F.lit(len(text.columns)).alias("text_columns"))


@query("select n as _row, p_size::bigint as p_size from (select p_size, row_number() over (order by p_partkey) - 1 as n from part) where n >= 10 and n < 30")
def typed_column_range(spark, sf_dir):
    path = encoded(table(spark, sf_dir, "part").select("p_partkey", "p_size").orderBy("p_partkey"), "part")
    return FitsHandle(spark, path).hdu("PART").read_col("p_size", "bigint", (10, 30))


@query("select n as _row, p_name from (select p_name, row_number() over (order by p_partkey) - 1 as n from part)")
def typed_column_text(spark, sf_dir):
    path = encoded(table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy("p_partkey"), "part")
    return FitsHandle(spark, path).hdu("PART").read_col("p_name", "string")


@query("select n as _row, s_name, s_nationkey::bigint as s_nationkey from (select *, row_number() over (order by s_suppkey) - 1 as n from supplier) where n between 3 and 7")
def ascii_rows(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey").orderBy("s_suppkey")
    path = encoded(df, "supplier", kind="ascii", tforms="s_suppkey=I12;s_nationkey=I6")
    return read_fits(spark, path, rowIndex=True, columns=["s_name", "s_nationkey"]).filter("_row between 3 and 7")


@query(
    "select p_partkey, case p_size % 3 when 0 then 'inf' when 1 then 'nan' else p_size::varchar end as re, case p_size % 5 when 0 then '-inf' when 1 then 'nan' else (p_size + 1)::varchar end as im from part"
)
def bintable_complex_special(spark, sf_dir):
    size, real = F.col("p_size"), lambda x: F.lit(float(x))
    re = F.when(size % 3 == 0, real("inf")).when(size % 3 == 1, real("nan")).otherwise(size.cast("double"))
    im = F.when(size % 5 == 0, real("-inf")).when(size % 5 == 1, real("nan")).otherwise((size + 1).cast("double"))
    got = read_fits(spark, encoded(table(spark, sf_dir, "part").select("p_partkey", F.struct(re.alias("re"), im.alias("im")).alias("z")), "part"))
    text = lambda c: F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(c.cast("int").cast("string"))
    return got.select("p_partkey", text(F.col("z.re")).alias("re"), text(F.col("z.im")).alias("im"))


@query("select c_custkey, (c_custkey * 37 % 3000)::int as n, ((c_custkey * 37 % 3000) * ((c_custkey * 37 % 3000) + 1) / 2)::bigint as total from customer")
def vla_large_cells(spark, sf_dir):
    """Cells of up to 12 kB, in another order than the heap's when read back."""
    n = F.col("c_custkey") * 37 % 3000
    a = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>"))
    got = read_fits(spark, encoded(table(spark, sf_dir, "customer").select("c_custkey", a.alias("a")), "customer"), rowsPerPartition=500)
    return got.select("c_custkey", F.size("a").alias("n"), F.aggregate("a", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


# Images and tiles.


def _sizes_as(spark, sf_dir, target):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return _one(FitsHandle(spark, column_image(df, "size", "p_partkey", F.col("p_size"), 16)).hdu("SIZE").image(target), df, "p_partkey")


@query("select p_partkey, p_size::float as value from part")
def image_as_float(spark, sf_dir):
    return _sizes_as(spark, sf_dir, "float")


@query("select p_partkey, p_size::double as value from part")
def image_as_double(spark, sf_dir):
    return _sizes_as(spark, sf_dir, "double")


@query("select p_partkey, p_size::bigint as value from part")
def image_as_long(spark, sf_dir):
    return _sizes_as(spark, sf_dir, "bigint")


@query("select (i - 1)::bigint as x, n as y, floor(embedding[i]::double * 1000)::int as value from (select embedding, row_number() over (order by vec_id) - 1 as n from embeddings), (select unnest(generate_series(3, 5)) as i) where n >= 20 and n < 40")
def image_region_narrow(spark, sf_dir):
    """A part of few pixels of some lines, of which only these bytes are read."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    data = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("int"))
    path = lines_image(df, "vectors", "vec_id", data, 32, 64, df.count())
    got = read_fits(spark, path, hdu="VECTORS", region="2:5,20:40", layout="pixels")
    return got.select(F.col("i1").alias("x"), F.col("i2").alias("y"), "value")


@query("select 32 as z_bitpix, '[10, ' || count(*) // 10 || ']' as z_axes, '[10, 2]' as z_tiles, 'GZIP_1' as z_type from part")
def tile_keywords(spark, sf_dir):
    path = _coded(spark, sf_dir, 32, "gzip", [10, 2])[0]
    text = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    return catalog.catalog(spark, path).filter("extname = 'TILED'").select("z_bitpix", text("z_axes").alias("z_axes"), text("z_tiles").alias("z_tiles"), "z_type")


def _coded(spark, sf_dir, bitpix: int, coding: str, cut: list[int]):
    """(path, table) of a tiled image of part sizes, ten to a line, coded on the driver."""
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size").orderBy("p_partkey")
    got = np.array([r["p_size"] for r in df.select("p_size").collect()])
    rows, tiles = len(got) // 10, []
    deflate = lambda data: (lambda z: z.compress(data) + z.flush())(zlib.compressobj(9, zlib.DEFLATED, -15))
    pack = {"gzip": gzip.compress, "zlib": zlib.compress, "deflate": deflate}
    for y in range(0, rows, cut[1]):
        own = got.reshape(-1, 10)[y : y + cut[1]].reshape(-1)
        tiles.append(rice_encode(own, 32, abs(bitpix) // 8) if coding == "rice" else pack[coding](own.astype(PIXELS[bitpix]).tobytes()))
    cards, data = table_hdu([("COMPRESSED_DATA", "1PB", pa.array(tiles, pa.binary()))], "TILED", tiled_cards(bitpix, [10, rows], cut, "RICE_1" if coding == "rice" else "GZIP_1", 32, abs(bitpix) // 8))
    path = shared_path(spark, "tiled.fits")
    write_local(path, [(primary_cards(8, []), b""), (cards, data), image_hdu(np.zeros(0), 8, [])])
    return path, df


def _tile_query(bitpix: int, coding: str, cut: list[int]):
    def run(spark, sf_dir):
        path, df = _coded(spark, sf_dir, bitpix, coding, cut)
        lines = read_fits(spark, path, hdu="TILED").select(F.col("row_index").alias("line"), F.transform("data", lambda x: x.cast("double")).alias("data"))
        return lines.select(F.size("data").alias("n"), F.aggregate("data", F.lit(0.0), lambda s, x: s + x).alias("total"), "line")

    run.__name__ = f"tile_{coding}_{'f' if bitpix < 0 else 'i' if bitpix > 8 else 'u'}{abs(bitpix)}"
    query("select count(*)::int as n, sum(p_size)::double as total, line from (select p_size, (row_number() over (order by p_partkey) - 1) // 10 as line from part) group by line")(run)


for _bitpix, _coding, _cut in ((8, "rice", [10, 3]), (8, "gzip", [10, 1]), (16, "gzip", [10, 2]), (64, "gzip", [10, 1]), (-32, "gzip", [10, 4]), (-64, "gzip", [10, 1]), (32, "zlib", [10, 1]), (32, "deflate", [10, 5])):
    _tile_query(_bitpix, _coding, _cut)
