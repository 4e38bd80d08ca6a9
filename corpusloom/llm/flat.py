"""Texts of a batch as flat numpy arrays: code points, words and their 64-bit hashes.

Helpers for the operators that run numpy inside Arrow batches. A batch is worked on in
blocks of a bounded number of characters, so memory does not follow the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_CHARS = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (shift, multiply, shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _code_table() -> np.ndarray:
    """A pseudo-random 64-bit code for every code point."""
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * MULTIPLIER)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2**64, for ``n`` positions."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_CHARS + 4096)
        up, down = np.full(size, MULTIPLIER), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


_codes: list[np.ndarray] = []


def codes() -> np.ndarray:
    if not _codes:
        _codes.append(_code_table())
    return _codes[0]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash per span of ``values`` (64-bit codes), equal for equal spans.

    A prefix sum of codes times falling powers gives every span in one subtraction; the
    power of its start makes it independent of the place.
    """
    up, down = _power_tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * down[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(np.uint64))


def blocks(texts: list[str], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` characters (or one longer text) each."""
    low = size = 0
    for i, text in enumerate(texts):
        if i > low and size + len(text) > limit:
            yield low, i
            low, size = i, 0
        size += len(text) + 1
    if low < len(texts):
        yield low, len(texts)


def slices(texts: pa.Array, limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of an Arrow column like :func:`blocks`, with their texts; null is empty.
    Only one range at a time is held as Python strings."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes + 1)
    low = 0
    while low < len(texts):
        start = ends[low] - sizes[low] - 1
        high = max(low + 1, int(np.searchsorted(ends, start + limit, side="right")))
        yield low, high, [t or "" for t in texts.slice(low, high - low).to_pylist()]
        low = high


def _is_space(cp: np.ndarray) -> np.ndarray:
    return (cp == 32) | ((cp >= 9) & (cp <= 13))


def _block_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    cp = points(" ".join(texts) + " ")
    space = _is_space(cp)
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
    lower = np.where((cp >= 65) & (cp <= 90), cp + 32, cp)
    hashes = span_hashes(codes()[lower], starts, ends)
    stops = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, stops)


def pieces(text: str, limit: int = BLOCK_CHARS) -> Iterator[str]:
    """A long text cut at blanks into parts of about ``limit`` characters; a longer
    word stays whole."""
    low = 0
    while len(text) - low > limit:
        cut = low + limit
        while cut < len(text) and not (text[cut] == " " or "\t" <= text[cut] <= "\r"):
            cut += 1
        yield text[low:cut]
        low = cut
    yield text[low:]


def words(texts: list[str]) -> Iterator[np.ndarray]:
    """The hashes of each text's words, in order: runs of ``[^\\x20\\x09-\\x0D]`` with
    A-Z lower-cased."""
    for low, high in blocks(texts):
        if high - low == 1 and len(texts[low]) > BLOCK_CHARS:
            yield np.concatenate([_block_words([p])[0] for p in pieces(texts[low])])
            continue
        hashes, stops = _block_words(texts[low:high])
        start = 0
        for stop in stops:
            yield hashes[start:stop]
            start = stop


def shingles(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash per run of ``size`` words; the whole sequence when there are fewer;
    nothing without words."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    size = min(size, n)
    total = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        total = total * MULTIPLIER + word_hashes[j : n - size + 1 + j]
    return mix(total + np.uint64(size))


_folded: list[np.ndarray] = []


def folded() -> np.ndarray:
    """For every code point its lower-case code point, 0 for all but letters and digits."""
    if not _folded:
        table = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            char = chr(i)
            if char.isalnum():
                lower = char.lower()
                table[i] = ord(lower) if len(lower) == 1 else i
        _folded.append(table)
    return _folded[0]
