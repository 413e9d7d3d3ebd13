"""Vectorised kernels over columns of UTF-8 text.

Texts stay in the Arrow buffer they arrive in: one byte array for a batch and
the offsets of its rows.  Nothing here makes a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at a time; bounds the 8-byte temporaries of the kernels.
SLICE = 1 << 16
#: Bytes of a word that have a weight of their own; longer words are chained.
REACH = 1 << 12

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0] = 1
    have = 1
    while have < n:
        step = min(have, n - have)
        with np.errstate(over="ignore"):
            out[have : have + step] = out[:step] * _U(pow(base, have, 1 << 64))
        have += step
    return out


_pw = _powers(_BASE, SLICE + 1)
_ipw = _powers(_BASE_INV, SLICE + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64; a bijection of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


#: White space of the contracts: space, and bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_VALUE = mix(np.arange(256, dtype=_U) + _U(0x5151))
_VALUE[65:91] = _VALUE[97:123]  # A-Z hash as a-z
_VALUE[SPACE] = 0
#: Weights of the places in a word: unrelated numbers, as powers of one base would
#: give equal sums to words of regular build.
_WEIGHT = mix(np.arange(REACH, dtype=_U) + _U(0x9D3F)) | _U(1)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and off[-1] > off[0] else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batches, text_index: int, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of the batches with about ``limit`` bytes of text each (one row at least)."""
    for batch in batches:
        data, off = text_buffer(batch.column(text_index))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            to = min(to, n)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def gathered(batches, text_index: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in batches of at least ``limit`` bytes of text, but for the last."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text_index).nbytes
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of words of each row."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off) - 1, np.int64)
    gap = SPACE[data]
    first = np.zeros(n + 1, bool)  # a row begins here
    first[off] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = gap[:-1]
    starts = np.flatnonzero(~gap & (before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = gap[1:]
    ends = np.flatnonzero(~gap & (after | first[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


def _long_hash(part: np.ndarray) -> np.ndarray:
    """Hash of one word of more than REACH bytes: its pieces' sums, chained."""
    h = np.zeros(1, _U)
    with np.errstate(over="ignore"):
        for a in range(0, len(part), REACH):
            vals = _VALUE[part[a : a + REACH]]
            h = mix(h ^ (vals * _WEIGHT[: len(vals)]).sum())
    return h[0]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words with A-Z lower-cased; SLICE bytes at a time."""
    out = np.empty(len(starts), _U)
    size = ends - starts
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            s0 = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, s0 + SLICE, "right")))
            rel = starts[at:to] - s0
            if ends[to - 1] - s0 <= SLICE:
                vals = _VALUE[data[s0 : ends[to - 1]]]
                place = np.arange(len(vals), dtype=np.int64)
                place -= np.repeat(rel, np.diff(np.append(rel, len(vals))))
                vals *= _WEIGHT[place & (REACH - 1)]
                out[at:to] = np.add.reduceat(vals, rel)
            at = to
        for i in np.flatnonzero(size > REACH).tolist():
            out[i] = _long_hash(data[starts[i] : ends[i]])
        return mix(out ^ (size.astype(_U) << _U(1)))


def ragged(lengths: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Indices begins[i], begins[i]+1, ... (lengths[i] of them) for every i, in one array."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(begins - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row, and their number by row.

    A row with fewer than k words, but one at least, has its whole sequence as
    one shingle; a row without words has none.
    """
    n = len(words)
    ends = np.cumsum(counts)
    begins = ends - counts
    many = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    with np.errstate(over="ignore"):
        full = np.zeros(max(n - k + 1, 0), _U)
        for j in range(k):
            full += words[j : j + len(full)] * _U(pow(_BASE, j + 1, 1 << 64))
        full = mix(full)
        out = np.empty(int(many.sum()), _U)
        at = np.cumsum(many) - many
        big = counts >= k
        out[ragged(many[big], at[big])] = full[ragged(many[big], begins[big])]
        for r in np.flatnonzero((counts > 0) & (counts < k)):
            h = words[begins[r] : ends[r]] * _pw[1 : counts[r] + 1]
            out[at[r]] = mix(np.array([h.sum() ^ _U(int(counts[r]) << 32)], _U))[0]
    return out, many


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of integers, byte plane after byte plane (packs well)."""
    return np.ascontiguousarray(values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(blob: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8").reshape(-1)
