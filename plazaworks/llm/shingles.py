"""Word shingles of whole texts as 64-bit hashes, computed over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words in a shingle.
WIDTH = 5
#: Texts are hashed together up to so many bytes; a longer one is cut at white space.
_CHUNK = 1 << 19

_SPACE = 32
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[9:14] = _SPACE
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 2 * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 1 << 62)) * 8 + 5


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as were needed so far."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, _CHUNK + 1)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up, cls.down


def _word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in data and their places; a word also ends where a text starts."""
    low = _FOLD[data]
    inside = low != _SPACE
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = starts[starts < len(data)]
    first[at] = inside[at]
    begin = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    end = np.flatnonzero(last) + 1
    up, down = _Powers.of(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[low] * up[: len(data)], out=total[1:])
    return mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64)), begin


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, texts, hashes, text of each): whole texts together, or one long text by itself."""
    n = len(offsets) - 1
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _CHUNK, side="right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= _CHUNK:
            hashes, begin = _word_hashes(data[lo:hi], offsets[i:j] - lo)
            yield i, j - i, hashes, np.searchsorted(offsets[i : j + 1] - lo, begin, side="right") - 1
        else:
            parts = []
            while lo < hi:
                cut = min(lo + _CHUNK, hi)
                if cut < hi:
                    gaps = np.flatnonzero(_FOLD[data[lo:cut]] == _SPACE)
                    if len(gaps):
                        cut = lo + int(gaps[-1]) + 1
                    else:  # one word longer than a chunk
                        gaps = np.flatnonzero(_FOLD[data[cut:hi]] == _SPACE)
                        cut = cut + int(gaps[0]) + 1 if len(gaps) else hi
                parts.append(_word_hashes(data[lo:cut], np.zeros(1, dtype=np.int64))[0])
                lo = cut
            hashes = np.concatenate(parts)
            yield i, 1, hashes, np.zeros(len(hashes), dtype=np.int64)
        i = j


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text its distinct shingles, sorted, as signed 64-bit hashes.

    Words are runs of bytes other than white space, A-Z in lower case. A text
    of fewer than WIDTH words has one shingle, the whole sequence; a text
    without words, or null, has none.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    for _, count, words, text in _pieces(data, offsets):
        bounds = np.searchsorted(text, np.arange(count + 1))
        long = max(0, len(words) - WIDTH + 1)
        shingles = np.zeros(long, dtype=np.uint64)
        for k in range(WIDTH):
            shingles += words[k : k + long] * _PLACE[k]
        shingles = mixed(shingles).view(np.int64)
        for b, e in zip(bounds, bounds[1:], strict=False):
            if e - b >= WIDTH:
                yield np.unique(shingles[b : e - WIDTH + 1])
            elif e > b:
                short = (words[b:e] * _PLACE[WIDTH : WIDTH + e - b]).sum(dtype=np.uint64)
                yield mixed(np.array([short + np.uint64(e - b)])).view(np.int64)
            else:
                yield np.zeros(0, dtype=np.int64)


def lists_of(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))
