"""Array primitives over Arrow string columns: whole batches of texts are handled as one byte array."""
import ctypes
import sys

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SLICE_BYTES = 2_000_000


def _mixed_bytes():
    x = np.arange(1, 257, dtype=np.uint64)
    return mix(x * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def mix(x):
    """A bijective finaliser on uint64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any substring of a byte array, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self):
        self.size = 0
        self.table = _mixed_bytes()

    def _reserve(self, n):
        if n > self.size:
            self.size = max(n, SLICE_BYTES + 1)
            ones = np.full(self.size, BASE, dtype=np.uint64)
            ones[0] = 1
            self.power = np.cumprod(ones)
            ones = np.full(self.size, BASE_INVERSE, dtype=np.uint64)
            ones[0] = 1
            self.inverse = np.cumprod(ones)

    def prefix(self, buf):
        self._reserve(len(buf) + 1)
        out = np.empty(len(buf) + 1, dtype=np.uint64)
        out[0] = 0
        np.cumsum(self.table[buf] * self.power[: len(buf)], out=out[1:])
        return out

    def spans(self, prefix, start, end):
        return mix((prefix[end] - prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def text_slices(column, limit=SLICE_BYTES):
    """Yields (first row, end row, bytes, row offsets) over a string column; nulls are empty texts.

    A slice holds about ``limit`` bytes, or one text if that is longer.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def is_space():
    table = np.ones(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def is_alnum():
    """Digits, letters and every byte of a non-ASCII character."""
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


def lower_table():
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


def word_bounds(buf, offsets, wordly):
    """Start and end of each word and, for each document, its first word's number (one more entry at the end)."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    word = wordly[buf]
    before = np.empty(len(buf), dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    inner = offsets[:-1]
    before[inner[inner < len(buf)]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(len(buf), dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    inner = offsets[1:]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def worker_cache(name, make):
    """What this worker process keeps from one task to the next: one thing at a time, ``name``d, so that the caches of
    several stages never lie side by side."""
    held = vars(sys).setdefault("_chronotext_cache", {})
    if name not in held:
        drop_worker_cache()
        held[name] = make()
    return held[name]


def drop_worker_cache():
    """Frees what tasks of an earlier stage keep in this worker process."""
    held = vars(sys).get("_chronotext_cache")
    if held:
        held.clear()


def give_back():
    """Gives freed memory of this worker process back to the system, and has large blocks go back at once from now on."""
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 21)  # M_MMAP_THRESHOLD: fixed, so that it doesn't grow with what was freed
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library: its allocator decides
        pass


def lean(function, keeps_cache=False):
    """A function for ``mapInArrow`` that leaves no memory behind in the worker process, which lives on for later stages."""
    def run(batches):
        if not keeps_cache:
            drop_worker_cache()
        give_back()
        yield from function(batches)
        give_back()
    return run
