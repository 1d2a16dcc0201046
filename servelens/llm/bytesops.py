"""Vectorised work on the bytes of many texts at once (numpy, inside tasks).

Texts of an Arrow batch are looked at as one byte array with bounds.  Hashes are
polynomials modulo 2**64 over fixed random byte values, mixed at the end: any
span's hash comes from two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: A-Z to a-z, as for ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
LETTERS = np.ones(256, bool)
LETTERS[0:0x30] = LETTERS[0x3A:0x61] = LETTERS[0x7B:0x80] = False

class _Kept(dict):
    """A cache that isn't sent along with the functions that use it."""

    def __reduce__(self):
        return _Kept, ()


_powers = _Kept()


def powers(n: int, base: int = _ODD) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        step = np.full(max(n, 1 << 20) + 1, base, np.uint64)
        step[0] = 1
        have = _powers[base] = np.multiply.accumulate(step)
    return have[: n + 1]


_INVERSE = pow(_ODD, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P with P[i] the polynomial of the first i bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data))[:-1], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end); equal bytes hash alike wherever they stand."""
    raw = (sums[ends] - sums[starts]) * powers(len(sums), _INVERSE)[starts]
    return mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray):
    """(starts, ends, text number) of the maximal runs of bytes in ``inside``; texts cut runs."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    mark = inside[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    before = np.concatenate(([False], mark[:-1])) & ~cut[:-1]
    after = np.concatenate((mark[1:], [False])) & ~cut[1:]
    starts, ends = np.flatnonzero(mark & ~before), np.flatnonzero(mark & ~after) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, by the words' hashes; callers drop windows that cross texts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out = out * np.uint64(0xFF51AFD7ED558CCD) + words[j:j + n]
    return mixed(out)


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive keys: block-wise running minima from both sides."""
    n = len(keys)
    if n < w:
        return keys[:0]
    if w == 1:
        return keys
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(keys.dtype).max, keys.dtype)
    padded[:n] = keys
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1: n])


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, bounds); nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if column.offset:
        column = pa.concat_arrays([column])
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0]: bounds[-1]]
    return data, bounds - bounds[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``limit`` bytes of text, or of one longer text: bounds a task's memory."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, at = np.cumsum(sizes), 0
        while at < len(sizes):
            base = upto[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(upto, base + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def list_array(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column out of its concatenated values and lengths."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
