"""Small helpers for functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes of text that a task handles at once; a longer document makes a chunk of its own.
CHUNK_BYTES = 2 << 20


def lengths(text: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each value, 0 for null."""
    return pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``limit`` bytes of text, in order."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(lengths(batch.column(text)))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values' bytes end to end, and the n + 1 offsets into them; null counts as empty."""
    text = pc.fill_null(text, "")
    if text.offset:
        text = pa.concat_arrays([text])
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def flat_binary(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As ``flat``, of binary values without null."""
    kind = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, kind)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
