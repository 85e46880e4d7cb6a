import gzip
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heliograph.cli import run
from heliograph.functions.cards import Card
from heliograph.functions.errors import InvalidValue, UnsupportedCompression
from heliograph.operators import calibration, catalog, checksum, edit
from heliograph.operators.handle import FitsHandle
from heliograph.plans.queries import tiled_file
from heliograph.sources import codec, files
from heliograph.sources.fits import read_fits
from heliograph.sources.hdu import choose, extension_cards, primary_cards, read_hdus
from heliograph.sources.schema import layout, parse_ascii_tform, parse_tdim, parse_tform, unique_names
from heliograph.sources.sink import FitsWriter, Segment, image_hdu, table_hdu, write_fits, write_local
from heliograph.sources.tiles import gunzip, rice_decode, rice_encode



def rows(df):
    return [tuple(r) for r in df.collect()]


def image_file(path, values, bitpix, naxes, extra=()):
    write_local(path, [(primary_cards(8, []), b""), image_hdu(np.array(values), bitpix, naxes, extra=[Card("EXTNAME", "I"), *extra])])
    return path


def test_forms():
    assert parse_tform("16X") == (16, "X", "") and parse_tform("D") == (1, "D", "") and parse_tform("1PE(7)") == (1, "P", "E") and parse_tform("QJ") == (1, "Q", "J")
    assert parse_tdim("(3, 4)") == [3, 4] and parse_tdim("3") is None
    assert parse_ascii_tform("E15.7") == ("E", 15, 7) and parse_ascii_tform("A10") == ("A", 10, 0)
    assert unique_names(["a", None, "A", "a"]) == ["a", "_c2", "A_2", "a_3"]
    with pytest.raises(InvalidValue):
        parse_tform("5Z")


@pytest.mark.parametrize(
    ("bitpix", "values"),
    [(8, [0, 1, 255]), (16, [0, 1, -1, -(2**15), 2**15 - 1]), (32, [0, -(2**31), 2**31 - 1]), (64, [0, -(2**63), 2**63 - 1]), (-32, [0.0, 1.5, -2.5, 1e30]), (-64, [0.0, 1.5, 1e200])],
)
def test_pixels_round_trip(spark, tmp_path, bitpix, values):
    path = image_file(f"{tmp_path}/a.fits", values, bitpix, [len(values)])
    got = read_fits(spark, path, "I").first()
    assert got.row_index == 0 and got.data == pytest.approx(values, rel=1e-7)


def test_regions(spark, tmp_path):
    path = image_file(f"{tmp_path}/a.fits", range(30), 32, [6, 5])
    got = read_fits(spark, path, "I", region="1:4,2:4")
    assert rows(got) == [(2, [13, 14, 15]), (3, [19, 20, 21])]
    assert [r.value for r in read_fits(spark, path, "I", section="4:9").collect()] == [4, 5, 6, 7, 8]
    assert rows(read_fits(spark, path, "I", rows="1:2")) == [(1, list(range(6, 12)))]
    cube = image_file(f"{tmp_path}/c.fits", range(24), 32, [4, 3, 2])
    got = read_fits(spark, cube, "I", region="1:3,0:2,0:2", layout="pixels").orderBy("flat")
    assert [r.value for r in got.collect()] == [1, 2, 5, 6, 13, 14, 17, 18]
    for bad in ({"region": "0:7,0:1"}, {"region": "0:1"}, {"section": "0:31"}, {"rows": "3:9"}):
        with pytest.raises(Exception):  # noqa: B017
            read_fits(spark, path, "I", **bad).collect()


def test_calibration(spark, tmp_path):
    path = image_file(f"{tmp_path}/a.fits", range(5), 16, [5], [Card("BSCALE", 2.0), Card("BZERO", 100.0)])
    assert read_fits(spark, path, "I", physical=True).first().data == [100, 102, 104, 106, 108]
    path = image_file(f"{tmp_path}/u.fits", [0, -32768, 32767], 16, [3], [Card("BSCALE", 1.0), Card("BZERO", 32768.0)])
    assert read_fits(spark, path, "I", physical=True).first().data == [32768, 0, 65535]
    path = image_file(f"{tmp_path}/b.fits", [100, -32768, 200, -32768], 16, [4], [Card("BLANK", -32768)])
    got = read_fits(spark, path, "I", physical=True).first().data
    assert got[0] == 100 and got[2] == 200 and math.isnan(got[1]) and math.isnan(got[3])
    assert read_fits(spark, path, "I", physical=True, blankAsNull=True).first().data == [100, None, 200, None]
    raw = read_fits(spark, path, "I")
    assert raw.select(calibration.undefined_mask(F.col("data"), 16, -32768)).first()[0] == [False, True, False, True]
    assert raw.select(calibration.undefined_mask(F.col("data"), 16, 5)).first()[0] is None
    native = raw.select(calibration.physical_line(F.col("data"), 16, blank=-32768, as_null=True)).first()[0]
    assert native == [100, None, 200, None]


def column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_reverse_and_casts(spark):
    df = column(spark, [0.0, 127.5, 255.0, -1.0, 256.0, -2.5, 2.5, float("nan"), 1e30, -1e30])
    assert [r[0] for r in df.select(calibration.raw(F.col("v"), 1, 0, 8)).collect()] == [0, 128, 255, 0, 255, 0, 3, 0, 255, 0]
    assert [r[0] for r in df.select(calibration.raw(F.col("v"), 1, 0, 64)).collect()][-2:] == [2**63 - 1, -(2**63)]
    assert [r[0] for r in df.select(calibration.cast_pixel(F.col("v"), -64, 16)).collect()] == [0, 127, 255, -1, 256, -2, 2, 0, 32767, -32768]
    ints = column(spark, [70000, -1, 300], "int")
    assert [r[0] for r in ints.select(calibration.cast_pixel(F.col("v"), 32, 16)).collect()] == [4464, -1, 300]
    assert [r[0] for r in ints.select(calibration.cast_pixel(F.col("v"), 32, 8)).collect()] == [112, 255, 44]
    assert calibration.wrapped(-1, 8) == 255 and calibration.wrapped(40000, 16) == -25536
    with pytest.raises(InvalidValue):
        calibration.raw(F.col("v"), 0, 0, 16)


def table_file(path, columns, extra=None):
    write_local(path, [(primary_cards(8, []), b""), table_hdu(columns, "T", extra)])
    return path


def test_table_types(spark, tmp_path):
    pair = pa.array([{"re": 1.0, "im": -2.0}, {"re": 0.5, "im": 0.0}], pa.struct([("re", pa.float64()), ("im", pa.float64())]))
    columns = [
        ("id", "1J", pa.array([1, 2], pa.int32())), ("name", "12A", pa.array(["alpha", None])), ("ok", "1L", pa.array([True, None])), ("bytes", "4B", pa.array([b"\x01\x02\xff\x00", b"abcd"])), ("u", "1B", pa.array([255, 0], pa.int16())),
        ("vec", "3E", pa.array([[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]], pa.list_(pa.float32()))), ("bits", "16X", pa.array([b"\xa5\x0f", b"\0\0"])), ("m", "1M", pair), ("var", "1PI", pa.array([[], [7, 8, 9]], pa.list_(pa.int16()))), ("big", "1QD", pa.array([[0.5], None], pa.list_(pa.float64()))),
    ]
    df = read_fits(spark, table_file(f"{tmp_path}/t.fits", columns), "T")
    got = df.collect()
    assert (got[0].id, got[0].name, got[0].ok, got[0].u, got[0].vec, got[0]["var"], got[0].big) == (1, "alpha", True, 255, [1, 2, 3], [], [0.5])
    assert (got[1].name, got[1].ok, got[1]["var"], got[1].big) == ("", False, [7, 8, 9], [])
    assert bytes(got[0].bytes) == b"\x01\x02\xff\x00" and bytes(got[0].bits) == b"\xa5\x0f" and got[0].m.im == -2
    assert read_fits(spark, f"{tmp_path}/t.fits", "T", nullLogical=True).collect()[1].ok is None
    assert df.schema["vec"].metadata["tform"] == "3E"
    only = read_fits(spark, f"{tmp_path}/t.fits", "T", columns=["var", "id"])
    assert only.columns == ["var", "id"] and only.count() == 2
    with pytest.raises(Exception):  # noqa: B017
        read_fits(spark, f"{tmp_path}/t.fits", "T", columns=["nothing"]).schema  # noqa: B018


def test_ranges_and_scaling(spark, tmp_path):
    path = table_file(f"{tmp_path}/t.fits", [("ID", "1J", pa.array([10, 20, 30, 40, 50], pa.int32())), ("V", "1J", pa.array([1, 2, 3, 4, 5], pa.int32()))], [Card("TSCAL2", 2.0), Card("TZERO2", 10.0)])
    assert rows(read_fits(spark, path, "T", columns=["ID"], rows="1:3")) == [(20,), (30,)]
    assert [r.V for r in read_fits(spark, path, "T", physical=True).collect()] == [12, 14, 16, 18, 20]
    pushed = read_fits(spark, path, "T", rowIndex=True, rowsPerPartition=1).filter("_row >= 3")
    assert pushed.rdd.getNumPartitions() == 2 and [r.ID for r in pushed.collect()] == [40, 50]
    h = FitsHandle(spark, path).hdu("T")
    assert [r.ID for r in h.read_col("ID", "bigint", (1, 3)).collect()] == [20, 30]
    for bad in ("string", "float"):
        with pytest.raises(InvalidValue):
            h.read_col("ID", bad)


def test_text_table(spark, tmp_path):
    path = f"{tmp_path}/a.fits"
    df = spark.createDataFrame([("a", 42, 1.5e10, 0.25), ("  b", -7, -2.5e-7, 3.0)], "NAME string, N long, E double, F double").coalesce(1)
    write_fits(df, path, kind="ascii", tforms="NAME=A10;N=I8;E=D25.17;F=F8.3")
    assert rows(read_fits(spark, path)) == [("a", 42, 1.5e10, 0.25), ("  b", -7, -2.5e-7, 3.0)]
    with pytest.raises(Exception):  # noqa: B017
        write_fits(spark.createDataFrame([(123456,)], "n long"), f"{tmp_path}/b.fits", kind="ascii", tforms="n=I3")


def test_sink(spark, tmp_path):
    df = spark.range(1000).select(F.col("id"), F.transform(F.sequence(F.lit(0), F.col("id") % 3), lambda x: x + F.col("id")).alias("a")).repartitionByRange(4, "id").sortWithinPartitions("id")
    path = f"{tmp_path}/t.fits"
    write_fits(df, path, extname="T", checksum=True)
    assert [r.a for r in read_fits(spark, path, "T").orderBy("id").collect()] == [[i + k for k in range(i % 3 + 1)] for i in range(1000)]
    assert [r.id for r in read_fits(spark, path, "T").collect()] == list(range(1000))
    assert all(r.checksum_ok and r.datasum_ok for r in catalog.catalog(spark, path, integrity=True).collect())
    with pytest.raises(FileExistsError):
        write_fits(df, path)
    write_fits(df.limit(3), path, mode="append", extname="MORE")
    assert [h.extname for h in read_hdus(path)] == [None, "T", "MORE"]
    write_fits(df.limit(0), path, mode="overwrite", extname="NONE")
    assert read_fits(spark, path, "NONE").count() == 0
    write_fits(df, f"{tmp_path}/folder", single=False)
    assert read_fits(spark, f"{tmp_path}/folder", 1).count() == 1000
    with pytest.raises(Exception):  # noqa: B017
        write_fits(spark.createDataFrame([(1,), (None,)], "n int"), f"{tmp_path}/null.fits")
    assert not [p for p in tmp_path.iterdir() if ".parts-" in p.name or ".new-" in p.name]


def test_checksum_vectors():
    assert checksum.encode(1234567890) == "dCW2fBU0dBU0dBU0" and checksum.decode("dCW2fBU0dBU0dBU0") == 1234567890
    assert checksum.encode(0) == "0" * 16 and checksum.checksum(b"\0" * 2880) == 0 and checksum.checksum(b"\xff" * 2880) == 0xFFFFFFFF
    assert checksum.add(0xFFFFFFFF, 1) == 1


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1), st.booleans())
def test_checksum_text(value, complement):
    text = checksum.encode(value, complement)
    assert text.isalnum() and checksum.decode(text, complement) in (value, value ^ 0xFFFFFFFF if value in (0, 0xFFFFFFFF) else value)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**15), 2**15 - 1), min_size=1, max_size=150), st.sampled_from([2, 4]), st.sampled_from([4, 32]))
def test_rice_round_trip(values, size, block):
    assert rice_decode(rice_encode(np.array(values), block, size), len(values), block, size).tolist() == values


def test_rice_and_gzip():
    assert rice_decode(bytes([0, 0x2A, 0]), 5, 4, 2).tolist() == [42] * 5
    smooth = np.cumsum(np.random.default_rng(1).integers(-3, 4, 1000))
    assert rice_decode(rice_encode(smooth, 32, 4), 1000, 32, 4).tolist() == smooth.tolist()
    assert gunzip(gzip.compress(b"abc")) == b"abc"


@pytest.mark.parametrize(("kind", "cut"), [("RICE_1", [7, 1]), ("RICE_1", [3, 2]), ("GZIP_1", [7, 2]), ("GZIP_1", [2, 5])])
def test_tiles(spark, tmp_path, kind, cut):
    values = np.arange(35) * 11 - 100
    tiled_file(f"{tmp_path}/t.fits", values, 32, [7, 5], cut, kind)
    got = read_fits(spark, f"{tmp_path}/t.fits", "TILED", rowsPerPartition=2).orderBy("row_index")
    assert [x for r in got.collect() for x in r.data] == values.tolist()
    part = read_fits(spark, f"{tmp_path}/t.fits", "TILED", region="1:3,2:4").orderBy("row_index")
    assert [x for r in part.collect() for x in r.data] == values.reshape(5, 7)[2:4, 1:3].reshape(-1).tolist()


def test_tiles_not_supported(spark, tmp_path):
    tiled_file(f"{tmp_path}/t.fits", np.arange(4), 32, [2, 2], [2, 1], "GZIP_1")
    edit.upsert_key(f"{tmp_path}/t.fits", 1, "ZCMPTYPE", "GZIP_2")
    from heliograph.sources.tiles import Tiling

    with pytest.raises(UnsupportedCompression):
        Tiling(read_hdus(f"{tmp_path}/t.fits")[1])


def test_edits(spark, tmp_path):
    path = table_file(f"{tmp_path}/t.fits", [("a", "1J", pa.array([1, 2, 3], pa.int32())), ("s", "1PB", pa.array([b"x", b"", b"yz"]))])
    h = FitsHandle(spark, path)
    h.hdu("T").write_col("a", read_fits(spark, path, "T", rowIndex=True).select("_row", (F.col("a") * 10).alias("value")))
    assert [(r.a, bytes(r.s)) for r in read_fits(spark, path, "T").collect()] == [(10, b"x"), (20, b""), (30, b"yz")]
    with pytest.raises(InvalidValue):
        h.hdu("T").write_col("a", spark.createDataFrame([(0, 1)], "_row long, value long"))
    h.hdu("T").write_key("WHO", "me")
    assert h.hdu("T").read_key("WHO") == "me" and h.hdu("T").read_key("TFIELDS", int) == 2
    h.create_image("Z", 16, [3, 2])
    h.hdu("Z").write_image(spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5, 6])], "row_index long, data array<int>"))
    assert h.hdu("Z").ndarray().shape == (3, 2) and h.hdu("Z").info()["bitpix"] == 16
    with pytest.raises(Exception):  # noqa: B017
        h.hdu("Z").write_image(spark.createDataFrame([(0, [1, 2, 3])], "row_index long, data array<int>"))
    h.hdu("T").extract(f"{tmp_path}/x.fits")
    assert read_fits(spark, f"{tmp_path}/x.fits", 1).count() == 3 and open(f"{tmp_path}/x.fits", "rb").read(5760).count(b"END     ") == 2
    with pytest.raises(InvalidValue):
        choose(read_hdus(path), "NONE")


def test_headers_are_read_once(spark, tmp_path, monkeypatch):
    from heliograph.operators import handle

    calls = []
    monkeypatch.setattr(handle, "read_hdus", lambda path: calls.append(path) or read_hdus(path))
    path = image_file(f"{tmp_path}/a.fits", range(6), 16, [3, 2])
    h = FitsHandle(spark, path)
    assert len(h) == 2 and [x.hdu.kind for x in h] == ["primary", "image"] and h.primary().info()["shape"] == [] and len(calls) == 1
    h.hdu("I").write_key("A", 1)
    assert h.hdu("I").read_key("A", int) == 1 and len(calls) == 2
    other = FitsHandle(spark, path)
    other.hdu("I").write_key("A", 2)  # seen by the first handle
    assert h.hdu("I").read_key("A", int) == 2
    image_file(path, range(4), 16, [2, 2])
    assert h.hdu(1).info()["shape"] == [2, 2]


def test_catalog_and_text(spark, tmp_path):
    path = image_file(f"{tmp_path}/a.fits", range(6), 16, [3, 2])
    got = {r.hdu_index: r for r in catalog.catalog(spark, path).collect()}
    assert got[1].naxes == [3, 2] and got[1].data_len == 12 and got[1].padded_len == 2880 and got[1].extname == "I"
    open(f"{tmp_path}/bad.fits", "wb").write(b"nothing")
    bad = catalog.catalog(spark, f"{tmp_path}/bad.fits").first()
    assert bad._corrupt and bad.kind is None
    text = run(["info", path])
    assert text == "HDU 0: Primary\n  BITPIX: 8\n  NAXIS: 0\n  Data size: 0 bytes\n\nHDU 1: IMAGE extension (EXTNAME: I)\n  BITPIX: 16\n  NAXIS: 2\n  Dimensions: [3, 2]\n  Data size: 12 bytes\n"
    assert "XTENSION= 'IMAGE   '" in run(["info", "-v", path])
    run(["extract", path, "I", f"{tmp_path}/out.fits"])
    assert read_fits(spark, f"{tmp_path}/out.fits", 1).first().data == [0, 1, 2]
    with pytest.raises(ValueError):
        run([])
    assert catalog.key(catalog.headers(spark, path), "NAXIS1", "float").first().value == 3.0


def test_many_files(spark, tmp_path):
    for i in range(70):
        table_file(f"{tmp_path}/{i:03d}.fits", [("n", "1J", pa.array([i, i], pa.int32()))])
    df = read_fits(spark, str(tmp_path), "T", pathColumn=True)
    assert df.rdd.getNumPartitions() == 70 and df.agg(F.sum("n"), F.countDistinct("_path")).first() == (2 * sum(range(70)), 70)


def test_stream(spark, tmp_path):
    from heliograph.streaming.files import stream_catalog

    (tmp_path / "in").mkdir()
    image_file(f"{tmp_path}/in/a.fits", range(6), 16, [3, 2])
    q = stream_catalog(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("hdus").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert spark.table("hdus").count() == 2


def test_extension_kinds():
    with pytest.raises(Exception):  # noqa: B017
        extension_cards("NOISE", 8, [])


def test_complex_cells_keep_infinite_parts():
    z = pa.StructArray.from_arrays([pa.array([1.0, float("inf"), float("nan")]), pa.array([float("inf"), 0.0, -1.0])], names=["re", "im"])
    data, _ = codec.encode([z], layout([("z", "1M")]))
    assert np.array_equal(np.frombuffer(data, ">f8"), [1, np.inf, np.inf, 0, np.nan, -1], equal_nan=True)


def test_descriptors_of_32_bits_do_not_wrap():
    cells = pa.array([b"abc"], pa.binary())
    with pytest.raises(InvalidValue):
        codec.encode([cells], layout([("a", "1PB")]), 2**31 - 2)
    assert codec.encode([cells], layout([("a", "1QB")]), 2**32 + 5)[0][-8:] == (2**32 + 5).to_bytes(8, "big")


def test_a_small_region_reads_few_bytes(spark, tmp_path, monkeypatch):
    from heliograph.sources import files
    from heliograph.sources import fits as source

    path = f"{tmp_path}/image.fits"
    pixels = np.arange(2000 * 1000).reshape(1000, 2000)
    write_local(path, [image_hdu(pixels, 32, [2000, 1000], primary=True)])
    read = []

    class Counting:
        def __init__(self, f):
            self.f = f

        def read(self, *n):
            data = self.f.read(*n)
            read.append(len(data))
            return data

        def seek(self, *a):
            return self.f.seek(*a)

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

    real = files.open_read
    monkeypatch.setattr(files, "open_read", lambda p: Counting(real(p)))
    plan = source.make_plan(path, {"path": path, "region": "50:60,500:520"})
    lo, hi = plan.limits()
    read.clear()
    got = [r for b in plan.batches(source.T.StructType(plan.fields()), lo, hi) for r in b.to_pylist()]
    assert [r["row_index"] for r in got] == list(range(500, 520)) and [r["data"] for r in got] == pixels[500:520, 50:60].tolist()
    assert sum(read) == 20 * 10 * 4


def test_cells_of_the_heap_come_in_parts(tmp_path):
    sizes = [5, 0, 3, 100, 1, 0]
    cells = pa.array([list(range(n)) for n in sizes], pa.list_(pa.int32()))
    columns = layout([("a", "1PJ")])
    data, heap = codec.encode([cells], columns)
    assert codec.heap_cuts(data, columns, 8, 40) == [0, 3, 4, 6]

    class Held:
        def read(self, lo, hi):
            return heap[lo:hi]

    assert codec.table_arrays(data, columns, 8, Held())[0].to_pylist() == cells.to_pylist()


@pytest.mark.parametrize("most, form", [(10**6, "1PJ"), (1000, "1QJ")])
def test_a_large_heap_gets_wide_descriptors(spark, tmp_path, monkeypatch, most, form):
    monkeypatch.setattr(codec, "P_HEAP", most)
    rows = [(i, list(range(i)), f"n{i}") for i in range(40)]
    schema = spark.createDataFrame(rows[:1], "k long, a array<int>, name string").schema

    def write(path, **options):
        writer, segments = FitsWriter({"path": path, **options}, schema, False), []
        for k, part in enumerate((rows[:15], rows[15:28], rows[28:])):  # no segment's heap is large
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.int64(), pa.list_(pa.int32()), pa.string()), strict=True)], names=schema.names)
            own = [f"{writer.stage}/{k}.rows", f"{writer.stage}/{k}.heap"]
            data = writer.target.encode(batch, 0)
            for name, x in zip(own, data, strict=True):
                with files.open_write(name) as f:
                    f.write(x)
            segments.append(Segment(k, len(part), len(data[1]), *own))
        writer.commit(segments)

    path = f"{tmp_path}/cells.fits"
    write(path)
    got = read_fits(spark, path, rowsPerPartition=7)
    assert got.schema["a"].metadata["tform"] == form
    assert sorted((r.k, r.a, r.name) for r in got.collect()) == rows
    if form == "1QJ":
        with pytest.raises(InvalidValue, match="needs TFORM 1QJ"):
            write(f"{tmp_path}/given.fits", tforms="a=1PJ")
