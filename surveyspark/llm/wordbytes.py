"""Words and rolling hashes of whole Arrow batches, vectorised over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: White space of the contracts: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything of ASCII but letters and digits.
NON_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that are hashed at once; a longer text is hashed alone.
PIECE = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BYTE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base^0 .. base^n modulo 2^64, or of the inverse of the base."""
    key = int(inverse)
    if len(_powers.get(key, ())) <= n:
        size = max(n + 1, PIECE + 1)
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        out = np.ones(size, np.uint64)
        out[1:] = base & _MASK
        np.multiply.accumulate(out, out=out)
        if size > 16 * PIECE:
            return out
        _powers[key] = out
    return _powers[key][: n + 1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = the polynomial of data[i:j], scaled by base^i."""
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data))[:-1], out=h[1:])
    return h


def range_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges; equal for equal bytes wherever they stand."""
    return mixed((h[ends] - h[starts]) * powers(len(h) - 1, inverse=True)[starts] + (ends - starts).astype(np.uint64))


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of at most `size` bytes together, or of one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, of): byte ranges of words, and for each text the first word's index (one more entry at the end)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = np.empty(n + 1, bool)
    gap[:-1] = separator[data]
    gap[-1] = True
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = gap[: n - 1]
    starts = np.flatnonzero(~gap[:-1] & (before | edge[:-1]))
    ends = np.flatnonzero(~gap[:-1] & (gap[1:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, of) of the words, A-Z lower-cased; see `words`."""
    starts, ends, of = words(data, offsets, separator)
    return range_hash(prefix_hash(LOWER[data]), starts, ends), starts, ends, of


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each place on; those that run over the end of a text are the caller's to leave out."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = (out ^ hashes[k : k + m]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mixed(out)
