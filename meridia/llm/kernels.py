"""Vectorised text kernels: words, shingles and lines as 64-bit hashes.

All of them work on the raw UTF-8 buffer of an Arrow string column, in blocks
of about 256 KB, so memory does not depend on the number of rows in a
batch.  A text longer than a block is cut at separators only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C17 | 3  # odd, 3 mod 4
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=np.uint64)
#: Odd multipliers for combining neighbouring hashes.
MULT = np.random.default_rng(20240608).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
#: ``[\x20\x09-\x0D]``: what separates words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        tables = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, base & (2**64 - 1), _U)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _powers[:] = tables
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]`` (unsigned bytes)."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U) * MULT[255])


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(at) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_blocks(offsets: np.ndarray, block: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that together hold about ``block`` bytes; one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + block, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of these rows, in order, and the number of words of each row."""
    if len(data) <= 2 * BLOCK:
        return _words_of(data, offsets, lower)
    # a row longer than a block, alone: cut it at separators
    hashes, count, i = [], 0, 0
    gaps = np.flatnonzero(SPACE[data])
    while i < len(data):
        k = int(np.searchsorted(gaps, i + BLOCK))
        j = int(gaps[k]) if k < len(gaps) else len(data)
        if j <= i:
            j = len(data)
        h, _ = _words_of(data[i:j], np.array([0, j - i]), lower)
        hashes.append(h)
        count += len(h)
        i = j
    assert len(offsets) == 2
    return np.concatenate(hashes), np.array([count])


def _words_of(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    counts = np.zeros(len(offsets) - 1, np.int64)
    if n == 0:
        return np.zeros(0, _U), counts
    if lower:
        data = LOWER[data]
    word = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    np.logical_or(~word[:-1], cut[1:n], out=before[1:])
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_or(~word[1:], cut[1:n], out=after[:-1])
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    counts += np.bincount(rows, minlength=len(counts))
    return span_hashes(data, starts, ends), counts


def combine(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k neighbouring hashes (len - k + 1 of them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = hashes[:n] * MULT[0]
    for j in range(1, k):
        out += hashes[j : j + n] * MULT[j]
    return mix(out + _U(k))


def shingles_of(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row, sorted by row and hash, with the row of each.

    A row of fewer than k words, but not none, has one shingle: all its words.
    """
    row = np.repeat(np.arange(len(counts)), counts)
    whole = combine(hashes, k)
    ok = row[: len(whole)] == row[k - 1 :] if len(whole) else np.zeros(0, bool)
    values, rows = [whole[ok]], [row[: len(whole)][ok]]
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)
    for m in range(1, k):
        short = np.flatnonzero(counts == m)
        if len(short):
            out = np.zeros(len(short), _U)
            for j in range(m):
                out += hashes[first[short] + j] * MULT[j]
            values.append(mix(out + _U(m)))
            rows.append(short)
    value, at = np.concatenate(values), np.concatenate(rows)
    if len(values) > 1:
        order = np.argsort(at, kind="stable")
        value, at = value[order], at[order]
    return distinct_by_row(value, at)


def distinct_by_row(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, sorted, for values whose rows ascend (``value`` is sorted in place)."""
    lead = np.flatnonzero(np.diff(row)) + 1
    for i, j in zip([0, *lead.tolist()], [*lead.tolist(), len(value)], strict=True):
        value[i:j].sort()  # many small sorts are far cheaper than one by two keys
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], row[new]


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum (modulo 2**64) of the values of each row."""
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def probe_table(bins: int, attempts: int = 4096, seed: int = 97) -> np.ndarray:
    """For optimal densification: the bins that an empty bin asks, attempt by attempt."""
    return np.random.default_rng(seed).integers(0, bins, (attempts, bins))


def one_permutation(values: np.ndarray, rows: np.ndarray, n: int, bins: int, probes: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of n rows with optimal densification: (n, bins) of uint64.

    The high bits of a hash give its bin; an empty bin takes the value of the
    first filled bin in its own random order, the same order for every row.  Rows
    without values hold zeros.
    """
    shift = _U(64 - int(bins - 1).bit_length())
    assert 1 << (64 - int(shift)) == bins
    at = (values >> shift).view(np.int64)
    at += rows * bins
    out = np.full(n * bins, ~_U(0))  # no hash is taken for this value, at a loss of 1 in 2**64
    np.minimum.at(out, at, values)
    out = out.reshape(n, bins)
    full = out != ~_U(0)
    out[~full] = 0
    r, b = np.nonzero(~full & full.any(axis=1)[:, None])
    for t in range(len(probes)):
        if not len(r):
            break
        p = probes[t, b]
        hit = full[r, p]
        out[r[hit], b[hit]] = out[r[hit], p[hit]]
        r, b = r[~hit], b[~hit]
    if len(r):  # next to impossible after so many attempts: the first filled bin
        p = full[r].argmax(axis=1)
        out[r, b] = out[r, p]
    return out


def band_keys(signature: np.ndarray, bands: int, width: int) -> np.ndarray:
    """A key of each band of ``width`` signature values: (n, bands)."""
    out = np.empty((len(signature), bands), _U)
    for b in range(bands):
        acc = np.full(len(signature), b + 1, _U) * MULT[200]
        for j in range(width):
            acc += signature[:, b * width + j] * MULT[j]
        out[:, b] = mix(acc)
    return out


def int64_lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Values, cut into lists of these lengths, as an Arrow list<int64> column."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64) if values.dtype == _U else values.astype(np.int64)))
