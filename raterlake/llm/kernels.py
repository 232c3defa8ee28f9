"""numpy kernels over the texts of an Arrow batch: words, shingles, window minima.

All of them work on a run of documents whose bytes lie one after the other, so
the cost is a few array passes a byte and no Python step a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Documents are gone through in runs of about so many bytes; a longer document is a run of its own.
RUN_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: ASCII that is neither letter nor digit parts words; bytes from 128 belong to words.
_LOOSE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit constants, the same on every executor."""
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


_BYTES = constants(11, 256)
#: A second set of values and base, for hashes that are independent of the first.
_BYTES_2, _BASE_2 = constants(12, 256), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE_2_INVERSE = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))


@lru_cache(maxsize=4)
def _powers(n: int, second: bool) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = (_BASE_2, _BASE_2_INVERSE) if second else (_BASE, _BASE_INVERSE)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(21, int(n).bit_length())
    up, down = _powers(size, second)
    return up[:n], down[:n]


def text_runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) for runs of about RUN_BYTES. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + RUN_BYTES, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, parting: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that do not part words, and the words' offsets by document. No word crosses a document's end."""
    inside = ~parting[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[:1] = True
    np.logical_not(inside[:-1], out=before[1:])
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1:] = True
    np.logical_not(inside[1:], out=after[:-1])
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix(data: np.ndarray, second: bool = False) -> np.ndarray:
    """Running polynomial hash of bytes or of 64-bit tokens; with span_hash it gives the hash of any span of them in O(1). ``second`` gives a hash independent of the first."""
    values = (_BYTES_2 if second else _BYTES)[data] if data.dtype == np.uint8 else mix(data) if second else data
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values * powers(len(data), second)[0], dtype=np.uint64, out=total[1:])
    return total


def span_hash(total: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    return mix((total[ends] - total[starts]) * powers(len(total), second)[1][starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, loose: bool = False):
    """Hash of each word, the words' offsets by document, and the words' starts and ends.

    Words are runs of bytes other than the six ASCII white-space characters; with
    ``loose`` other ASCII punctuation parts words too.
    """
    if lower:
        data = _LOWER[data]
    starts, ends, by_doc = spans(data, offsets, _LOOSE if loose else _SPACE)
    return span_hash(prefix(data), starts, ends), by_doc, starts, ends


def shingles(words: np.ndarray, by_doc: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each document, repeats included, and their offsets.

    With ``short`` a document of 1 to n-1 words has one shingle, its whole sequence.
    """
    weights = constants(23, n)
    count = len(words) - n + 1
    counts = np.diff(by_doc)
    if count > 0:
        rolled = words[:count] * weights[0]
        for j in range(1, n):
            rolled = rolled + words[j : j + count] * weights[j]
        keep = np.ones(count, bool)
        for j in range(1, n):  # shingles that would cross the end of a document
            at = by_doc[1:-1] - j
            keep[at[(at >= 0) & (at < count)]] = False
        rolled = mix(rolled[keep])
    else:
        rolled = np.zeros(0, np.uint64)
    sizes = np.maximum(counts - n + 1, 0)
    few = np.flatnonzero((counts > 0) & (counts < n)) if short else ()
    if not len(few):
        return rolled, np.concatenate([[0], np.cumsum(sizes)])
    whole = []
    for d in few:
        w = words[by_doc[d] : by_doc[d + 1]]
        whole.append((w * weights[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w)))
    out = np.insert(rolled, np.concatenate([[0], np.cumsum(sizes)])[few], mix(np.array(whole, np.uint64)))
    sizes[few] = 1
    return out, np.concatenate([[0], np.cumsum(sizes)])


def minima(values: np.ndarray, offsets: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """(documents, functions): the least of each document's values under each multiplicative permutation; the largest number for an empty set."""
    out = np.full((len(offsets) - 1, len(multipliers)), np.uint64(2**64 - 1), np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        at = offsets[:-1][full]
        for k, a in enumerate(multipliers):
            out[full, k] = np.minimum.reduceat(values * a, at)
    return out


def anchors(hashed: np.ndarray, ends: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share their anchor, the leftmost least value among ``reach`` neighbours.

    ``hashed[i]`` is the value at position i, ``ends[i]`` says whether a window may
    start there. Returns the first and last window start of each run and its
    anchor. Equal windows have the same anchor at the same place inside, wherever
    they occur.
    """
    n = len(hashed)
    if n < reach:  # no window fits
        e = np.zeros(0, np.int64)
        return e, e, e
    low = (hashed & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width = 1
    while width * 2 <= reach:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if width < reach:
        low = np.minimum(low[: len(low) - (reach - width)], low[reach - width :])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ok = ends[: len(at)]
    starts = np.flatnonzero(ok)
    if not len(starts):
        e = np.zeros(0, np.int64)
        return e, e, e
    anchor = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], starts[last], anchor[first]
