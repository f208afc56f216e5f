"""Word spans and 64-bit hashes over flat UTF-8 buffers, with numpy inside Arrow batches.

Words are maximal runs of bytes other than space and 0x09-0x0D. A text is handled whole; batches are cut into slices
of about SLICE bytes (or one text, if it is longer), so memory is bounded by the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 21
BLOCK = 1 << 19
LONG_WORD = 64
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, BLOCK + LONG_WORD + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), BLOCK + LONG_WORD + 1)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def flat_binary(blobs: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column; null counts as empty."""
    if isinstance(blobs, pa.ChunkedArray):
        blobs = blobs.combine_chunks()
    blobs = pc.fill_null(blobs, b"").cast(pa.large_binary())
    _, offsets, data = blobs.buffers()
    offs = np.frombuffer(offsets, np.int64)[blobs.offset : blobs.offset + len(blobs) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch | pa.Table, column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch | pa.Table]:
    """Parts of batch with about limit bytes of text each, at least a row."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch[column]), 0)
    size = size.combine_chunks() if isinstance(size, pa.ChunkedArray) else size
    end = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(end, (end[at - 1] if at else 0) + limit, side="right"))
        to = max(to, at + 1)
        yield batch.slice(at, to - at)
        at = to


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def is_space_free(data: np.ndarray) -> np.ndarray:
    return ~((data == 32) | ((data >= 9) & (data <= 13)))


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at the texts' borders, and each text's first run (one more at the end)."""
    if not len(inside):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    first = np.empty_like(inside)
    first[0], first[1:] = inside[0], inside[1:] & ~inside[:-1]
    last = np.empty_like(inside)
    last[-1], last[:-1] = inside[-1], inside[:-1] & ~inside[1:]
    full = offs[:-1][offs[:-1] < offs[1:]]
    first[full] = inside[full]
    ends = offs[1:][offs[:-1] < offs[1:]] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, in blocks that bound the memory."""
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, low + BLOCK, side="left")))
        s, e = starts[at:to] - low, ends[at:to] - low
        n = min(int(e[-1]), BLOCK + LONG_WORD)
        sums = np.zeros(n + 1, U)
        np.cumsum((data[low : low + n].astype(U) + U(1)) * _POW[:n], out=sums[1:])
        size = e - s
        e = np.minimum(e, n)
        out[at:to] = mix((sums[e] - sums[s]) * _INV[s] + size.astype(U) * U(0xD6E8FEB86659FD93))
        at = to
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def windows(values: np.ndarray, k: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """Polynomial hashes of all k consecutive values, built by doubling; windows may cross texts."""
    base |= 1
    if len(values) < k:
        return np.empty(0, U)
    done, at, out, cur, width, power = 0, 0, None, values, 1, base & 0xFFFFFFFFFFFFFFFF
    rest, factor = k, 1
    n = len(values) - k + 1
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                part = cur[at : at + n] * U(factor)
                out = part if out is None else out + part
                at += width
                factor = factor * power & 0xFFFFFFFFFFFFFFFF
            rest >>= 1
            if rest:
                cur = cur[:-width] + cur[width:] * U(power)
                width *= 2
                power = power * power & 0xFFFFFFFFFFFFFFFF
    return out


def window_texts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions at which a window of k words of one text starts, and each text's number of them."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    total = int(n.sum())
    base = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    return base + np.arange(total), n
