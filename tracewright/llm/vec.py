"""NumPy helpers that hash the words of a whole Arrow batch at once.

A word's hash is a polynomial over its bytes modulo 2^64, taken from running sums: the sum of ``table[byte] * B**i`` over
the word, times ``B**-start``, so equal words get equal hashes wherever they stand. Work goes in windows of a few MB cut
at word ends, so memory is bounded for very long texts too.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def tidy(run):
    """``run``, a function over batches, with the memory that it no longer uses given back to the system at its end.

    A worker lives on for other tasks and stages, and what its allocators keep is memory that its neighbours lack.
    """

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return whole


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP: np.ndarray | None = None
_DOWN: np.ndarray | None = None
_TABLE = np.random.default_rng(20240817).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def byte_table(separators: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(byte -> lowered byte, byte -> is part of a word)."""
    low, part = np.arange(256, dtype=np.uint8), np.ones(256, bool)
    if lower:
        low[65:91] += 32
    part[list(separators)] = False
    return low, part


#: Words end at ASCII white space only.
SPACED = byte_table(b" \t\n\x0b\x0c\r")
#: Words are runs of ASCII letters and digits and of all other characters past ASCII.
LETTERS = byte_table(bytes(i for i in range(128) if not chr(i).isalnum()))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, start offsets and the end) of a string column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def closed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``text_bytes`` of texts that each get a line feed at their end, so that no word or line spans two of them."""
    return text_bytes(pc.binary_join_element_wise(column.cast(pa.large_string()).fill_null(""), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())))


def gathered(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the parts from ``starts`` to ``ends`` of ``flat``, one after another; where each begins, and the end)."""
    sizes = ends - starts
    stops = np.concatenate(([0], np.cumsum(sizes)))
    return flat[np.arange(stops[-1]) + np.repeat(starts - stops[:-1], sizes)], stops


def _window_hashes(data: np.ndarray, table) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if _UP is None or len(_UP) <= len(data):
        n = max(WINDOW * 2, len(data)) + 1
        _UP, _DOWN = _powers(_BASE, n), _powers(_INVERSE, n)
    low, part = table
    inside = part[data]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[low[data]] * _UP[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64)), starts


def words(data: np.ndarray, offsets: np.ndarray, table=SPACED) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end) of texts laid end to end.

    Texts have to be separated for this; where one ends in the middle of a run, the run is cut there.
    """
    _, part = table
    n, hashes, starts = len(data), [], []
    cuts = [0]
    while cuts[-1] < n:
        at = cuts[-1] + WINDOW
        if at >= n:
            cuts.append(n)
            break
        step = 1 << 12
        while at < n:  # go on to the next byte between words
            gap = np.flatnonzero(~part[data[at : at + step]])
            if len(gap):
                at += int(gap[0])
                break
            at, step = at + step, step * 2
        cuts.append(min(at, n))
    for a, b in zip(cuts, cuts[1:], strict=False):
        h, s = _window_hashes(data[a:b], table)
        hashes.append(h)
        starts.append(s + a)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, np.searchsorted(s, offsets)


def separated(column: pa.Array, table=SPACED) -> tuple[np.ndarray, np.ndarray]:
    """``words`` of a string column, each text followed by a separator so that no word spans two texts."""
    data, offsets = text_bytes(column)
    k = len(offsets) - 1
    spaced = np.full(len(data) + k, 32, np.uint8)
    shift = np.repeat(np.arange(k), np.diff(offsets))
    spaced[np.arange(len(data)) + shift] = data
    return words(spaced, offsets + np.arange(k + 1), table)


def slices(batch: pa.RecordBatch, name: str, most: int = WINDOW) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, a row at least."""
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(name)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the k-word shingles of one text, sorted; one of the whole text where it has fewer words."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(n, k)
    total = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        total = mix(total + hashes[i : n - width + 1 + i] + np.uint64(width))
    return np.unique(total)
