"""Vectorised text kernels over Arrow string columns.

Spark hands a task its rows as Arrow batches; a string column of a batch is one
byte buffer with row offsets.  The kernels here work on that buffer directly
(numpy, no Python loop over words), in slices of bounded size, so a task's
memory does not depend on how many rows a batch holds.  A text is never cut:
a slice is one or more whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD6E8FEB86659FD93 | 1
_powers: dict[tuple[int, bool], np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (or of its inverse), grown on demand."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        b = pow(base, -1, 1 << 64) if inverse else base
        out = np.full(1 << max(n - 1, 1 << 15).bit_length(), b, np.uint64)
        out[0] = 1
        have = _powers[base, inverse] = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise a 64-bit value so that every bit depends on all of it."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Slice:
    """Whole texts of a batch: rows lo..hi, their bytes, and offsets into them."""

    __slots__ = ("lo", "hi", "buf", "off")

    def __init__(self, lo: int, hi: int, buf: np.ndarray, off: np.ndarray):
        self.lo, self.hi, self.buf, self.off = lo, hi, buf, off


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a column into slices of whole texts of about ``limit`` bytes."""
    buf, off = buffers(col)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield Slice(lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def spans(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of bytes with is_word), and where each text's words begin.

    Words never cross texts.  The third array has one entry per text and one more.
    """
    flag = is_word[buf]
    n = len(flag)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    left = np.empty(n, bool)
    left[0], left[1:] = False, flag[:-1]
    left[off[off < n]] = False
    right = np.empty(n, bool)
    right[-1], right[:-1] = False, flag[1:]
    right[off[off > 0] - 1] = False
    starts = np.flatnonzero(flag & ~left)
    ends = np.flatnonzero(flag & ~right) + 1
    return starts, ends, np.searchsorted(starts, off)


def prefix(values: np.ndarray, base: int = _P) -> np.ndarray:
    """Prefix sums of value[i] * base**i, so that any range hashes in two lookups."""
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values.astype(np.uint64) * powers(base, len(values)), out=out[1:])
    return out


def ranges(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int = _P) -> np.ndarray:
    """64-bit hash of each range lo..hi; equal content gives equal hashes."""
    h = (sums[hi] - sums[lo]) * powers(base, len(sums), True)[lo]
    return mix(h + (hi - lo).astype(np.uint64) * np.uint64(_Q))


#: Words above this many bytes are hashed one by one.
LONG_WORD = 64
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes.

    Eight bytes enter at a time and everything is mixed after each, so the hash
    has no algebraic form in the bytes: a sum of bytes times powers (as
    ``ranges`` is) maps some long words, such as a Thue-Morse word and its
    complement, to one value under every base.
    """
    size = ends - starts
    h = mix(size.astype(np.uint64) * np.uint64(_Q) + np.uint64(_P))
    # the eight bytes from each position on
    eight = np.ndarray((len(buf) + 1,), "<u8", np.concatenate((buf, np.zeros(8, np.uint8))), strides=(1,))
    short = size <= LONG_WORD
    live = np.flatnonzero(short & (size > 0)) if not short.all() else np.arange(len(size))
    done = 0
    while len(live):
        left = size[live] - done
        h[live] = mix((h[live] ^ (eight[starts[live] + done] & _FIRST_BYTES[np.minimum(left, 8)])) * np.uint64(_P))
        done += 8
        live = live[left > 8]
    for i in np.flatnonzero(~short).tolist():
        h[i] = int.from_bytes(blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def grams(values: np.ndarray, n: int, base: int = _Q) -> np.ndarray:
    """Hash of every n consecutive values, also across texts; len(values)-n+1 of them."""
    count = len(values) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix(values, base)
    return mix((sums[n:] - sums[:-n]) * powers(base, count, True))


def starts_within(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """For windows of n items: whether one that starts at each item ends in the same text.

    ``first`` says where each text's items begin (one entry more than texts).
    """
    ok = np.zeros(max(total, 0), bool)
    if total:
        room = np.repeat(first[1:], np.diff(first)) - np.arange(total)
        ok = room >= n
    return ok


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    have, out = 1, v
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: len(out) - (w - have)], out[w - have :])
    return out


def anchors(gram: np.ndarray, valid: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content-defined anchors of windows of w consecutive grams.

    ``gram``: a hash per position; ``valid``: whether the window that starts at
    a position exists.  Every valid window is dealt to its smallest gram
    (leftmost of equals), which depends on the window's content alone, so equal
    windows have equal anchors at the same distance.  Returns the anchors'
    positions and the first and last window start dealt to each.
    """
    none = np.zeros(0, np.int64)
    if len(gram) < w:
        return none, none, none
    v = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    at = (sliding_min(v, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(valid[: len(at)])
    if not len(starts):
        return none, none, none
    at = at[starts]
    new = np.empty(len(at), bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    cut = np.flatnonzero(new)
    return at[cut], starts[cut], starts[np.append(cut[1:], len(at)) - 1]


def expand(lo: np.ndarray, count: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... (count[0] of them), then those of lo[1], and so on."""
    total = int(count.sum())
    before = np.cumsum(count) - count
    return np.arange(total) - np.repeat(before - lo, count)
