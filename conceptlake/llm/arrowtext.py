"""Arrow helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

#: Bounds of what is held as Python objects at once: rows, and bytes (a longer text is alone).
ROWS, BYTES = 512, 2 << 20


def sizes(column: pa.Array) -> np.ndarray:
    """About how many bytes each value has."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if pa.types.is_struct(kind):
        return np.sum([sizes(f) for f in column.flatten()], axis=0) if kind.num_fields else np.zeros(len(column), np.int64)
    return np.full(len(column), 8, np.int64)


def slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``ROWS`` rows, and of about ``BYTES`` of column ``at``, in order."""
    ends = np.cumsum(sizes(batch.column(at)))
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        n = int(np.searchsorted(ends[start : start + ROWS], before + BYTES, "right"))
        n = max(1, n)
        yield batch.slice(start, n)
        start += n


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one buffer, with n + 1 offsets; nulls are empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def map_text(
    df: DataFrame,
    keep: list[str],
    schema: list[tuple[str, T.DataType]],
    start: Callable[[], Callable[[list], list[tuple]]],
    text: str = "text",
) -> DataFrame:
    """Add columns computed from whole texts, without a shuffle.

    ``keep`` columns pass through untouched, but for one that has the name of a new column, which gives way to it;
    ``start`` is called once per task and returns a function from a list of texts (None for null) to a list of tuples, one
    for each new column of ``schema``.
    """
    keep = [c for c in keep if c not in {n for n, _ in schema}]
    source = df.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    out = T.StructType([*[source.schema[c] for c in keep], *[T.StructField(n, k) for n, k in schema]])
    kinds = [arrow_type(k) for _, k in schema]
    names = [*keep, *[n for n, _ in schema]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                rows = step(part.column(part.num_columns - 1).to_pylist())
                cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
                arrays = [pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *arrays], names=names)

    return source.mapInArrow(run, out)
