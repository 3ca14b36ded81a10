"""Bytes of Arrow columns, for the functions that run in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and the places where its rows end, the first one's start before them."""
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8), ends
