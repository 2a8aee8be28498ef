"""Small helpers for operators that work on Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: A batch is worked on in slices of about so many bytes of text, whatever its rows hold.
SLICE_BYTES = 8 << 20


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's values as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, in batches of about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size + 64
        yield batch.slice(start)
    release()


def word_table() -> bytes:
    """For ``bytes.translate``: A-Z become a-z; 0-9, a-z and bytes of non-ASCII letters stay; the rest become spaces."""
    keep = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in keep else 0x20 for b in range(256))


def release() -> None:
    """Give memory that a finished partition held back to the system: Python workers live on, and share their machine with the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library; there is nothing to trim
        pass
