"""Arrow batches on the Python workers in small pieces, and memory handed back after a task."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

#: Bytes of a piece; a row is never cut.
PIECE = 8 << 20


def pieces(batches, size: int = PIECE):
    """Slices of the batches of about ``size`` bytes; what the task held is given back to the system after the last."""
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()
    give_back()


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
