"""A file handle over the operators: typed columns, images and keys by HDU. It holds a path and the headers, never the data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cards import ComplexInt, bool_value, float_value, int_value, text_value
from ..functions.errors import InvalidValue, MissingKeyword
from ..sources import files
from ..sources.fits import read_fits
from ..sources.hdu import ASCII, BINARY, Hdu, choose, read_hdus
from . import edit
from .calibration import cast_pixel, typed
from .catalog import file_text

_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64, "float": -32, "double": -64}


class FitsHandle:
    def __init__(self, spark: SparkSession, path: str):
        if not files.exists(path):
            raise FileNotFoundError(path)
        self.spark, self.path = spark, path
        self._stamp, self._hdus = None, []

    @classmethod
    def create(cls, spark: SparkSession, path: str, overwrite: bool = False) -> FitsHandle:
        edit.create(path, overwrite)
        return cls(spark, path)

    def hdus(self) -> list[Hdu]:
        """All HDUs, read again only when the file has changed, by this handle or another."""
        stamp = files.stamp(self.path)
        if stamp != self._stamp:
            self._stamp, self._hdus = stamp, read_hdus(self.path)
        return self._hdus

    def __len__(self) -> int:
        return len(self.hdus())

    def __iter__(self):
        return (HduHandle(self, h) for h in self.hdus())

    def hdu(self, which) -> HduHandle:
        return HduHandle(self, choose(self.hdus(), which))

    def primary(self) -> HduHandle:
        return self.hdu(0)

    def summary(self, verbose: bool = False) -> str:
        return file_text(self.path, verbose)

    def create_image(self, extname: str, bitpix: int, naxes: list[int]) -> HduHandle:
        edit.add_image(self.path, bitpix, naxes, extname)
        return self.hdu(len(self) - 1)

    def create_table(self, extname: str, columns: list[tuple[str, str]], ascii_table: bool = False) -> HduHandle:
        edit.add_table(self.path, columns, extname, ascii_table)
        return self.hdu(len(self) - 1)


class HduHandle:
    def __init__(self, file: FitsHandle, hdu: Hdu):
        self.file, self.hdu = file, hdu

    def info(self) -> dict:
        """shape and bitpix of an image, rows and columns of a table."""
        h = self.hdu
        if h.kind in (ASCII, BINARY):
            return {"kind": h.kind, "rows": h.naxes[1], "columns": h.tfields}
        return {"kind": h.kind, "shape": h.shape, "bitpix": h.image_bitpix}

    # Keys.

    def read_key(self, keyword: str, kind: type = str):
        value = {int: int_value, float: float_value, bool: bool_value, str: text_value}[kind](self.hdu.cards, keyword)
        if value is None:
            raise MissingKeyword(keyword)
        return value

    def write_key(self, keyword: str, value: int | float | bool | str | complex | ComplexInt, comment: str | None = None) -> None:
        edit.upsert_key(self.file.path, self.hdu.index, keyword, value, comment)
        self.hdu = self.file.hdus()[self.hdu.index]

    # Tables.

    def table(self, **options) -> DataFrame:
        return read_fits(self.file.spark, self.file.path, self.hdu.index, **options)

    def read_col(self, name: str, target: str, rows: tuple[int, int] | None = None) -> DataFrame:
        """_row and the column as int, bigint, float, double or string; ``rows`` reads start to end alone."""
        more = {"rows": f"{rows[0]}:{rows[1]}"} if rows else {}
        df = self.table(columns=[name], rowIndex=True, **more)
        return df.select("_row", typed(df, name, target))

    def write_col(self, name: str, values: DataFrame) -> None:
        edit.update_column(self.file.spark, self.file.path, self.hdu.index, name, values)
        self.hdu = self.file.hdus()[self.hdu.index]

    # Images.

    def image(self, target: str | None = None, **options) -> DataFrame:
        """Lines of pixels (options section, rows and region choose some), cast to a type where one is named."""
        df = self.table(**options)
        if target is None:
            return df
        if target not in _BITS:
            raise InvalidValue(target)
        source = self.hdu.image_bitpix
        if "data" in df.columns:
            return df.withColumn("data", F.transform("data", lambda p: cast_pixel(p, source, _BITS[target])))
        return df.withColumn("value", cast_pixel(F.col("value"), source, _BITS[target]))

    def write_image(self, lines: DataFrame) -> None:
        edit.replace_image(self.file.spark, self.file.path, self.hdu.index, lines)

    def ndarray(self, **options) -> np.ndarray:
        """The image on the driver, shaped by NAXIS in its order (the first axis runs fastest in memory; nothing is transposed)."""
        rows = self.image(**options).orderBy("row_index").select("data").toArrow()
        data = rows.column("data").combine_chunks()
        flat = data.flatten().to_numpy(zero_copy_only=False) if len(data) else np.empty(0)
        return flat.reshape(self.hdu.shape) if not options else flat

    def extract(self, target: str) -> None:
        edit.extract(self.file.path, self.hdu.index, target)
