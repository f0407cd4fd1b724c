"""Vectorised text kernels over Arrow buffers: words, word hashes, shingles and rolling windows.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D of a text's UTF-8 form. Hashes are 64-bit; a word's
hash is a polynomial over random byte values, a sequence's a polynomial over mixed word hashes, and both end in a
finaliser. No per-word Python runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_BASE, _WORD_BASE, _SECOND_BASE = U(0x9E3779B97F4A7C15 | 1), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)
_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U)
_LOWER = _VALUES.copy()
_LOWER[65:91] = _VALUES[97:123]
_SEATS = np.random.default_rng(7).integers(1, 2**63, 8, dtype=np.int64).astype(U) | U(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n; the first 2^20 are kept for the next call."""
    key = int(base)
    if key in _POWERS and len(_POWERS[key][0]) >= n:
        return _POWERS[key]
    size = max(1 << 20, n)
    up, down = np.full(size, base, U), np.full(size, U(pow(key, -1, 2**64)), U)
    up[0] = down[0] = 1
    found = np.cumprod(up), np.cumprod(down)
    if size == 1 << 20:
        _POWERS[key] = found
    return found


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    return data[first : int(offsets[-1]) if len(offsets) else 0], offsets - first


def blocks(offsets: np.ndarray, most: int = 2 << 20, rows: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about `most` bytes and at most `rows` texts (a longer text stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n, i + rows)
        yield i, j
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte places of the words, and the number of the first word of each text (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SEP[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start, end = word.copy(), word
    start[1:] &= ~word[:-1] | edge[1:n]
    ends = end & np.concatenate((~word[1:] | edge[1:n], [True]))
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_runs(starts: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of words within `most` bytes (a longer word stands alone)."""
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + most, "right")))
        yield i, j
        i = j


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool, seed: int = 0) -> np.ndarray:
    return part_hashes(data, starts, ends, [ends], lower, seed)[0]


def part_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, cuts: list[np.ndarray], lower: bool, seed: int = 0) -> list[np.ndarray]:
    """For each array of cuts (starts < cut <= ends) the hashes of the words' beginnings up to it; memory stays near that of 1 MiB of text, or of the longest word. Each seed is a hash of its own."""
    base = U((int(_BASE) + 2 * seed * int(_WORD_BASE)) % 2**64)
    out = [np.empty(len(starts), U) for _ in cuts]
    for i, j in word_runs(starts, ends):
        lo = int(starts[i])
        part = data[lo : int(ends[j - 1])]
        up, down = _powers(base, len(part))
        total = np.cumsum((_LOWER if lower else _VALUES)[part] * up[: len(part)])
        at = starts[i:j] - lo
        before, back = np.where(at > 0, total[at - 1], U(0)), down[at]
        for found, cut in zip(out, cuts, strict=True):
            found[i:j] = mix((total[cut[i:j] - lo - 1] - before) * back + (cut[i:j] - starts[i:j]).astype(U) * U(0xA24BAED4963EE407))
    return out


def hashed_words(data: np.ndarray, offsets: np.ndarray, lower: bool, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) over all texts, block by block so that memory stays near the input's size."""
    parts, first, seen = [], [np.zeros(1, np.int64)], 0
    for i, j in blocks(offsets):
        part = data[offsets[i] : offsets[j]]
        starts, ends, at = word_bounds(part, offsets[i : j + 1] - offsets[i])
        parts.append(word_hashes(part, starts, ends, lower, seed))
        first.append(at[1:] + seen)
        seen += len(starts)
    return np.concatenate(parts) if parts else np.zeros(0, U), np.concatenate(first)


def windows(hashes: np.ndarray, width: int, second: bool = False) -> np.ndarray:
    """Hash of each run of `width` words, by its first word; runs may cross texts, so mask them with inside(). second: another hash, independent of the first."""
    if second:
        hashes = mix(hashes ^ U(0xE7037ED1A0B428DB))
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    up, down = _powers(_SECOND_BASE if second else _WORD_BASE, len(hashes))
    total = np.concatenate((np.zeros(1, U), np.cumsum(hashes * up[: len(hashes)])))
    return mix((total[width:] - total[:-width]) * down[:n] + U(width))


def inside(first: np.ndarray, width: int) -> np.ndarray:
    """For each word: whether `width` words from it on lie in its text."""
    counts = np.diff(first)
    last = np.repeat(first[1:], counts)
    return np.arange(len(last)) + width <= last


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every shingle; a text of 1 to width-1 words has its whole sequence as one shingle."""
    counts = np.diff(first)
    n = len(hashes)
    text_of = np.repeat(np.arange(len(counts)), counts)
    hash_parts, text_parts = [], []
    if n >= width:
        ok = np.flatnonzero(inside(first, width)[: n - width + 1])
        if len(ok):
            total = np.full(len(ok), U(width))
            for k in range(width):
                total += hashes[ok + k] * _SEATS[k]
            hash_parts.append(mix(total))
            text_parts.append(text_of[ok])
    for size in range(1, width):
        texts = np.flatnonzero(counts == size)
        if len(texts):
            total = np.full(len(texts), U(size))
            for k in range(size):
                total += hashes[first[texts] + k] * _SEATS[k]
            hash_parts.append(mix(total))
            text_parts.append(texts)
    if not hash_parts:
        return np.zeros(0, U), np.zeros(0, np.int64)
    hashed, texts = np.concatenate(hash_parts), np.concatenate(text_parts)
    order = np.argsort(texts, kind="stable")
    return hashed[order], texts[order]


def distinct_sets(hashed: np.ndarray, texts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct hashes of each text in ascending order; those of text i are hashes[first[i]:first[i + 1]]."""
    if not len(hashed):
        return hashed, np.zeros(n + 1, np.int64)
    order = np.lexsort((hashed, texts))
    h, t = hashed[order], texts[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    h, t = h[new], t[new]
    return h, np.searchsorted(t, np.arange(n + 1))


def shingle_sets(texts: pa.Array, lower: bool = True, width: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, hashes, first) for blocks of texts i to j: their distinct shingle hashes."""
    data, offsets = buffers(texts)
    for i, j in blocks(offsets):
        part = data[offsets[i] : offsets[j]]
        starts, ends, first = word_bounds(part, offsets[i : j + 1] - offsets[i])
        hashed, owner = shingles(word_hashes(part, starts, ends, lower), first, width)
        yield i, j, *distinct_sets(hashed, owner, j - i)
