"""Vectorised byte work on Arrow text columns: prefix hashes, words, shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
_rng = np.random.default_rng(20240229)
#: A random value for every byte, and an odd base; the inverse makes hashes free of the position.
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_rng.integers(1, 1 << 62)) * 4 + 3
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column end to end, and the bounds of each row (nulls are empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """h with h[e] - h[s] the polynomial hash of bytes s to e, times BASE ** s."""
    h = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(BYTE[raw] * powers(BASE, len(raw)), out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans, the same wherever a string stands."""
    return (h[end] - h[start]) * powers(INVERSE, len(h))[start]


#: Separators of words: space and 0x09 to 0x0D.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the number of words before it (one more at the end)."""
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = ~SEPARATOR[raw]
    start = inside[1:-1] & ~inside[:-2]
    stop = inside[1:-1] & ~inside[2:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    start[edges] = inside[1:-1][edges]
    stop[edges - 1] = inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every word of a text column (A-Z lower-cased), and each row's bounds among them."""
    raw, bounds = flat(col)
    raw = LOWER[raw]
    starts, ends, rows = words(raw, bounds)
    return mix(span_hash(prefix_hash(raw), starts, ends)), rows


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct n-word shingles of one text, from its word hashes; fewer words make one shingle."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    size = len(hashes) - n + 1
    out = np.full(size, 0x9E3779B97F4A7C15 * n & MASK, dtype=np.uint64)
    for i in range(n):
        out = mix(out ^ hashes[i : i + size]) + np.uint64(i)
    return np.unique(out)


def shingle_starts(hashes: np.ndarray, n: int) -> np.ndarray:
    """The shingle of the n words from each word on, whatever text they are of."""
    out = np.full(max(0, len(hashes) - n + 1), 0x9E3779B97F4A7C15 * n & MASK, dtype=np.uint64)
    for i in range(n):
        out = mix(out ^ hashes[i : i + len(out)]) + np.uint64(i)
    return out


def shingle_rows(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """shingles() of every text at once: all sets end to end, each sorted, and their bounds."""
    counts = np.diff(rows)
    found, owner = [], []
    if len(hashes) >= n:
        out = shingle_starts(hashes, n)
        row = np.repeat(np.arange(len(counts)), counts)
        whole = row[: len(out)] == row[n - 1 :]
        found.append(out[whole])
        owner.append(row[: len(out)][whole])
    for r in np.flatnonzero((counts > 0) & (counts < n)):
        found.append(shingles(hashes[rows[r] : rows[r + 1]], n))
        owner.append(np.full(len(found[-1]), r))
    if not found:
        return hashes, np.zeros(len(counts) + 1, dtype=np.int64)
    h, r = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[first], r[first]
    return h, np.searchsorted(r, np.arange(len(counts) + 1))
