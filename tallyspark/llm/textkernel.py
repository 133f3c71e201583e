"""Word and shingle hashing over whole Arrow text columns, without Python loops
over words: prefix sums of a polynomial give every word's hash at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: An odd base, its inverse modulo 2^64, and the finaliser's multipliers.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
#: Bytes hashed at once (a longer text is hashed whole, by itself).
CHUNK = 1 << 19

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything of ASCII but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SAME = np.arange(256, dtype=np.uint8)


class Memo:
    """What a process has computed; it doesn't travel to other ones."""

    def __init__(self) -> None:
        self.arrays: list[np.ndarray] = []

    def __reduce__(self):
        return Memo, ()


_powers = Memo()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n, modulo 2^64."""
    kept = _powers.arrays
    if not kept or len(kept[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        kept.clear()
        with np.errstate(over="ignore"):
            for b in (BASE, INVERSE):
                a = np.full(size, b, dtype=np.uint64)
                a[0] = 1
                kept.append(np.cumprod(a))
    return kept[0][:n], kept[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h *= MIX[0]
    h ^= h >> np.uint64(33)
    h *= MIX[1]
    h ^= h >> np.uint64(33)
    return h


def seeded(h: np.ndarray, seed: int) -> np.ndarray:
    return mixed(h ^ mixed(np.array([seed + 1], dtype=np.uint64) * np.uint64(BASE)))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column and its offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.type != pa.string():
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about size bytes."""
    data, offsets = raw(texts)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        end = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        end = min(max(end, first + 1), rows)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per text the index of its first word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    apart = separators[data]
    before, after = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
    before[0] = after[-1] = True
    before[1:] = apart[:-1]
    after[:-1] = apart[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = True
    after[edges - 1] = True
    inside = ~apart
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hashes of data[start:end], after the byte map fold."""
    n = len(data)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((fold[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * MIX[0])


def shingles(hashes: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, in order, and per text the index of its
    first one. Fewer than k words make one shingle, no word makes none."""
    counts = np.diff(firsts)
    total = np.zeros(len(hashes), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            c = np.uint64(pow(BASE, 2 * j + 3, 1 << 64))
            total[: len(hashes) - j] += hashes[j:] * c
        out = mixed(total)
        ends = np.repeat(firsts[1:], counts)
        keep = np.arange(len(hashes)) + k <= ends
        short = np.flatnonzero((counts > 0) & (counts < k))
        for d in short:
            own = hashes[firsts[d] : firsts[d + 1]]
            t = np.uint64(0)
            for j, h in enumerate(own):
                t += h * np.uint64(pow(BASE, 2 * j + 3, 1 << 64))
            out[firsts[d]] = mixed(np.array([t + np.uint64(len(own))], dtype=np.uint64))[0]
        keep[firsts[short]] = True
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    return out[keep], np.concatenate([[0], np.cumsum(made)])


def text_shingles(texts: pa.Array, k: int, separators: np.ndarray = SPACE, fold: np.ndarray = LOWER) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, shingle hashes, per-text offsets) by chunk."""
    for first, end, data, offsets in chunks(texts):
        starts, ends, firsts = words(data, offsets, separators)
        hashes = span_hashes(data, starts, ends, fold) if len(starts) else np.zeros(0, np.uint64)
        yield first, end, *shingles(hashes, firsts, k)
