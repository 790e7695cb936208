"""Arrow-batched maps over text columns, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

TEXT = "__text"
PIECE_BYTES = 4 << 20


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def pieces(batch: pa.RecordBatch, text: str = TEXT, max_bytes: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows with max_bytes of text at most, or one longer row."""
    sizes = pc.binary_length(column(batch, text)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + max_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to


def map_texts(df: DataFrame, text: str, keep: Sequence[str], ddl: str, prepare: Callable[[], Callable[[pa.Array, pa.RecordBatch], list[pa.Array] | None]]) -> DataFrame:
    """df's columns `keep` and those of ddl, which prepare()(texts, rows) makes from each piece of rows."""
    made = StructType.fromDDL(ddl)
    source = df.select(*keep, F.col(text).alias(TEXT))
    schema = StructType([*source.schema.fields[:-1], *made.fields])
    out = to_arrow_schema(schema)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = prepare()
        for batch in batches:
            for rows in pieces(batch):
                arrays = make(rows.column(n).cast(pa.string()), rows)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:n], *(a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, list(out)[n:], strict=True))],
                    schema=out,
                )

    return source.mapInArrow(run, schema)


def emit_rows(df: DataFrame, text: str, keep: Sequence[str], ddl: str, prepare: Callable[[], Callable[[pa.Array, pa.RecordBatch], list]]) -> DataFrame:
    """Rows of schema ddl, any number per piece, which prepare()(texts, rows) gives as arrays of one length."""
    source = df.select(*keep, F.col(text).alias(TEXT))
    schema = StructType.fromDDL(ddl)
    out = to_arrow_schema(schema)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = prepare()
        for batch in batches:
            for rows in pieces(batch):
                arrays = make(rows.column(n).cast(pa.string()), rows)
                if len(arrays[0]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a, f.type) if isinstance(a, np.ndarray) else a.cast(f.type) for a, f in zip(arrays, out, strict=True)],
                        schema=out,
                    )

    return source.mapInArrow(run, schema)


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """One list per row: values[bounds[i]:bounds[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
