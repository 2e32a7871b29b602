"""64-bit fingerprints of words, shingles and byte strings, by prefix polynomial hashes over whole buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 21
BASE = 0x9E3779B97F4A7C13
INVERSE = pow(BASE, -1, 1 << 64)
TABLE = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACES = np.isin(np.arange(256), [32, *range(9, 14)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
ODD = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all others, one to one."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of the base and of its inverse, modulo 2**64, as far as they were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            one = np.ones(1, np.uint64)
            self.up = np.cumprod(np.concatenate([one, np.full(n - 1, BASE, np.uint64)]))
            self.down = np.cumprod(np.concatenate([one, np.full(n - 1, INVERSE, np.uint64)]))

    def prefix(self, data: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
        """H with H[j] - H[i] the hash of data[i:j], shifted by i places."""
        self.grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * self.up[: len(data)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.down[start]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each starts, one more at the end. A null is an empty text."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs_of(texts: pa.Array, most: int = PIECE) -> Iterator[pa.Array]:
    """The texts in runs of at most `most` bytes, or one longer text."""
    _, offsets = buffers(texts)
    row = 0
    while row < len(texts):
        last = min(len(texts), max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1))
        yield texts[row:last]
        row = last


def pieces(size: int, stops: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Cuts [0, size) at some of the sorted stops, each piece as long as `most` allows, or longer where no stop comes earlier."""
    start = 0
    while start < size:
        k = int(np.searchsorted(stops, start + most, "right")) - 1
        end = int(stops[k]) if k >= 0 and stops[k] > start else int(stops[k + 1]) if k + 1 < len(stops) else size
        yield start, min(end, size)
        start = min(end, size)


def word_hashes(data: np.ndarray, offsets: np.ndarray, powers: Powers, table: np.ndarray = TABLE[LOWER], spaces: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A to Z lower-cased unless another table says so, parted by `spaces`, the first word of each text, one more at the end, and the words' starts and ends."""
    space = spaces[data]
    inner = np.ones(len(data) + 1, bool)
    inner[offsets] = False  # no word goes on across the start of a text
    before = np.concatenate([[True], space])[: len(data)] | ~inner[:-1]
    starts = np.flatnonzero(~space & before)
    after = np.concatenate([space[1:], [True]]) | ~inner[1:] if len(data) else space
    ends = np.flatnonzero(~space & after) + 1
    hashes = np.zeros(len(starts), np.uint64)
    for a, b in pieces(len(data), np.append(starts[1:], len(data))):
        i, j = np.searchsorted(starts, [a, b])
        h = powers.prefix(data[a:b], table)
        s, e = starts[i:j] - a, ends[i:j] - a
        hashes[i:j] = mix(powers.between(h, s, e) + (e - s).astype(np.uint64) * ODD[4])
    return hashes, np.searchsorted(starts, offsets), starts, ends


def shingle_sets(texts: pa.Array, width: int, powers: Powers, most: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of each text: of `width` words, or of all words of a shorter text."""
    data, offsets = buffers(texts)
    bounds = np.append(offsets[:-1], len(data))
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(bounds, offsets[row] + most, "right")) - 1)
        last = min(last, len(texts))
        words, firsts, _, _ = word_hashes(data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row], powers)
        n = max(0, len(words) - width + 1)
        full = np.full(n, 0, np.uint64)
        for k in range(width):
            full += words[k : k + n] * ODD[k]
        full = mix(full)
        for r in range(row, last):
            a, b = int(firsts[r - row]), int(firsts[r - row + 1])
            if b - a >= width:
                yield r, np.unique(full[a : b - width + 1])
            elif b > a:
                h = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for k in range(b - a):
                        h += words[a + k] * ODD[k]
                yield r, mix(np.array([h], np.uint64))
            else:
                yield r, np.zeros(0, np.uint64)
        row = last
