"""Batches of texts as flat byte arrays, for the vectorised operators.

A column of texts becomes one uint8 array and the byte offsets of its rows; null counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most bytes of text that a vectorised step handles at once; longer texts are cut at places that don't change the result.
CHUNK_BYTES = 4 << 20


def flat(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): row i is bytes[offsets[i]:offsets[i + 1]]."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32, len(col) + 1 + col.offset)[col.offset :].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, name: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most so many bytes of text, one row at least."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    total, at = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > at and total + n > most:
            yield batch.slice(at, i - at)
            total, at = 0, i
        total += n
    yield batch.slice(at)


def joined(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The rows in larger batches, for narrow rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def arrow_rows(spark, rows: int = 1024) -> None:
    """Fewer rows in an Arrow batch, as texts can be very long; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


@contextmanager
def batches_of(spark, rows: int) -> Iterator[None]:
    """So many rows in an Arrow batch for what runs inside; the setting before comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def free(name: str, taken: list[str]) -> str:
    """The name, with underscores before it until no column has it in any case."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = "_" + name
    return name
