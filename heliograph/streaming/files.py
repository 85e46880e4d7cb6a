"""New FITS files as a stream: Structured Streaming finds the files, each batch reads their headers, and no data, where it runs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.catalog import CATALOG, describe
from ..sources.hdu import read_hdus


def stream_catalog(spark: SparkSession, path: str, glob: str = "*.fits", files_per_trigger: int = 1000) -> DataFrame:
    """A streaming DataFrame with a catalog row per HDU of each file that appears in the folder."""
    import pyspark.cloudpickle

    import heliograph

    pyspark.cloudpickle.register_pickle_by_value(heliograph)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(CATALOG))
    kind = "path string, modificationTime timestamp, length bigint, content binary"
    found = spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(path)

    def task(batches):
        for b in batches:
            for name in b.column("path").to_pylist():
                yield pa.RecordBatch.from_pylist([describe(h, False) for h in read_hdus(name)], schema=schema)

    return found.select("path").mapInArrow(task, CATALOG)
