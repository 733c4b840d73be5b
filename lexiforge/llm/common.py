"""Shared helpers: reading, lineage cuts and Arrow batch maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..plans.lineage_cut import cut as checkpointed
from ..plans.lineage_cut import written

__all__ = ["checkpointed", "lean", "map_rows", "pieces", "read_table", "spark_schema", "tokenizer_path", "written"]

#: Rows and bytes of text that a Python step turns into lists at once; keeps a worker's memory flat whatever the Arrow batch holds.
ROWS_AT_ONCE, BYTES_AT_ONCE = 2048, 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file of that name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(batch: pa.RecordBatch | pa.Table, most_rows: int = ROWS_AT_ONCE, most_bytes: int = BYTES_AT_ONCE) -> Iterator:
    """Slices of at most most_rows rows and about most_bytes of strings; a longer text is a slice of its own."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy()
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, min(at + most_rows, int(np.searchsorted(ends, before + most_bytes, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, giving memory that Arrow has freed back to the system after each batch and at the end, so that idle workers stay small."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()

        def source() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                pool.release_unused()

        yield from run(source())
        pool.release_unused()

    return whole


def map_rows(df: DataFrame, rows: Callable[..., Iterator | list], schema: str) -> DataFrame:
    """Apply rows(columns...) to column lists of at most ROWS_AT_ONCE rows and about BYTES_AT_ONCE of text; it returns a list of output columns."""
    out = spark_schema(df.sparkSession, schema)
    names = [f.name for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        for batch in batches:
            for part in pieces(batch):
                cols = rows(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=target.field(n).type) for c, n in zip(cols, names, strict=True)], schema=target)

    return df.mapInArrow(lean(run), out)


def spark_schema(spark: SparkSession, ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)
