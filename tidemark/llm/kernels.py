"""NumPy kernels over the UTF-8 buffers of Arrow string columns.

They work on runs of whole texts of about ``CHUNK`` bytes (a longer text is a
run of its own), so that their arrays stay in a processor's cache. No Python
object is made per word.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True  # the white space of the word pattern [^\x20\x09-\x0D]+
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32  # A-Z only

_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)  # the lowest i bytes
OTHER_SEED = 0xBF58476D1CE4E5B9


def tidied(run):
    """``run`` for mapInArrow, which gives freed memory back to the system when a task ends: Python workers live on."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return task


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of :func:`mix`."""
    x = x ^ (x >> U(33))
    x = x * U(pow(0xC4CEB9FE1A85EC53, -1, 1 << 64))
    x = x ^ (x >> U(33))
    x = x * U(pow(0xFF51AFD7ED558CCD, -1, 1 << 64))
    return x ^ (x >> U(33))


def multipliers(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers, the same for the same seed everywhere."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed & 0xFFFFFFFFFFFFFFFF)) | U(1)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def runs(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of texts with about ``size`` bytes together, one text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, bytes, offsets) of each run of texts."""
    data, offsets = text_buffers(column)
    for i, j in runs(offsets, size):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes that do not cross a text's border."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before &= ~border[:n]
    after &= ~border[1:]
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, equal for equal bytes wherever they stand; another ``seed`` gives another hash.

    Each eight bytes of a span (fewer at its end) are mixed with a key that belongs to their place in
    it; the mixed numbers are added up and mixed with the length. Nothing in it is a polynomial of the
    bytes, so no pattern of letters makes hashes of long words meet.
    """
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    more = np.maximum(size - 1, 0) >> 3  # eights after the first
    keys = multipliers(int(more.max(initial=0)) + 1, seed + 0x2545F4914F6CDD1D)
    total = mix((eight[starts] & _MASKS[np.minimum(size, 8)]) + keys[0])
    long = np.flatnonzero(more)
    if len(long):
        more = more[long]
        first = np.cumsum(more) - more
        place = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        value = eight[np.repeat(starts[long], more) + 8 * place] & _MASKS[np.minimum(np.repeat(size[long], more) - 8 * place, 8)]
        total[long] += np.add.reduceat(mix(value + keys[place]), first)
    return mix(total + size.astype(U) * U(0xD6E8FEB86659FD93))


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every window of ``n`` hashes, by windows of doubling width mixed in pairs (the last pair may overlap)."""
    out, width = mix(hashes + U(n)), 1
    while width < n:
        step = min(width, n - width)
        out = mix(out[: len(out) - step] * U(0x9E3779B97F4A7C15 + 2 * width) + out[step:])
        width += step
    return out


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the lines with a word, without the white space around them."""
    starts, ends = spans(~SPACE[data], offsets)
    begin, stop = spans(data != 10, offsets)
    first, after = np.searchsorted(starts, begin), np.searchsorted(starts, stop)
    some = after > first
    return starts[first[some]], ends[after[some] - 1]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the offsets of each text's words among them."""
    starts, ends = spans(~SPACE[data], offsets)
    return span_hashes(LOWER[data] if lower else data, starts, ends), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's windows of ``k`` words and their offsets.

    A text of 1 to k-1 words has one shingle, made of all its words; one without words has none.
    """
    n = np.diff(offsets)
    out_n = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_offsets = np.concatenate([[0], np.cumsum(out_n)])
    if not len(hashes):
        return np.zeros(0, U), out_offsets
    times = multipliers(k, 5)
    padded = np.concatenate([hashes, np.zeros(k, U)])
    joined = sum((padded[i : i + len(hashes)] * times[i] for i in range(1, k)), hashes * times[0])
    local = np.arange(len(hashes)) - np.repeat(offsets[:-1], n)
    keep = local < np.repeat(out_n, n)
    for t in np.flatnonzero((n > 0) & (n < k)):
        own = hashes[offsets[t] : offsets[t + 1]]
        joined[offsets[t]] = (own * times[: len(own)]).sum(dtype=U) + U(len(own))
    return mix(joined[keep]), out_offsets
