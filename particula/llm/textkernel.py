"""Array kernels on Arrow text columns, used inside tasks.

A text column arrives as one byte buffer with offsets. The kernels cut it into
pieces of whole documents (about ``PIECE_BYTES`` each; one longer document is a
piece of its own) and find words and their hashes with numpy, without a Python
object per word. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PIECE_BYTES = 1 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: A fixed odd 64-bit value for every byte, so that short words spread well.
_BYTE_VALUE = (np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93)) ^ U64(0x94D049BB133111EB)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Rows of an Arrow batch where texts go to Python; Spark's own default suits short rows.
BATCH_ROWS = 1000


def short_batches(docs: DataFrame) -> DataFrame:
    """``docs``, after its session was told to send texts in short Arrow batches, unless it has a setting of its own."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH_ROWS))
    return docs


def release() -> None:
    """Give what a task used back to the system: workers live on and wait beside others for their next task."""
    global _powers
    _powers = (np.ones(1, U64), np.ones(1, U64))
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """``run``, a function on Arrow batches, that releases its memory when its task ends."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes in the (first, last) ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Digits, ASCII letters and every byte of a non-ASCII character.
WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Everything but ASCII white space.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its len+1 offsets into them."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    col = col.cast(pa.large_string() if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else pa.large_binary())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_large_string(col.type) else b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(col: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole documents."""
    data, off = text_buffer(col)
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        with np.errstate(over="ignore"):
            _powers = tuple(
                np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, b, U64))]) for b in (_BASE, _BASE_INV)
            )
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any stretch follows, see ``stretch_hash``."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE_VALUE[data] * up[:-1], out=out[1:])
    return out


def stretch_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end): equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


def words(data: np.ndarray, off: np.ndarray, kind: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document the index of its first word (len+1 entries).

    A word is a longest run of bytes of ``kind`` inside one document.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = kind[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray, kind: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words with A-Z lowered, and each document's first word."""
    low = LOWER[data]
    starts, ends, first = words(low, off, kind)
    return stretch_hash(prefix_hash(low), starts, ends), first


def owner(first: np.ndarray) -> np.ndarray:
    """The document of every word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
