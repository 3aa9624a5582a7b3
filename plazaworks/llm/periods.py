"""Periodic runs: stretches of a text whose words repeat with one period four times or more.

The detector reads words as they are appended. On level k the text is cut into
blocks of L = 2^k words, and each completed block is a catcher: it waits for
its own words to come again at a distance p of 2L to 4L - 1. Hashes of all
windows of L words, made from those of the level below, tell where it does;
two catchers wait for each window that a new word ends. What a catcher has
caught is compared word by word, to the left once and to the right with each
word that comes, as long as it goes on: squares of one period that overlap are
one run that way.

A run of period p and at least 4p words holds, in its second period, a whole
block of the level with 2L <= p < 4L whose words also stand at distance p on
both sides of it, so that is asked of a catch before anything is compared. Where
a block lies in a run of a smaller period q <= L / 4, it comes again at every
q-th word; of these only the one at the same place of its own run can be a
larger period's. That leaves a bounded number of comparisons for each block.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazaworks.llm.shared import fresh

#: A run has at least so many words, and at least so many times its period; fewer than four times aren't all found.
MIN_WORDS, MIN_TIMES = 6, 4
#: What a level keeps of its windows, in lengths of its block, and the first stretch that is compared at once.
_KEPT, _STRIDE = 10, 64
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29))


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of windows from those of their halves. Equal windows have equal hashes; others are told apart by comparing words."""
    a, b, shift = _MIX
    x = left * a + (right ^ (right >> shift)) * b
    return x ^ (x >> shift)


@dataclass
class _Level:
    """Hashes of windows of size words, of those that start at base and later."""

    size: int
    base: int
    hashes: np.ndarray


@dataclass
class RunDetector:
    """All runs of a text that is appended in any stretches.

    open: where the runs and squares that reach the text's end start, by
    period, among them multiples of a smallest period; closed: the smallest
    period of runs that ended, by start and end. A stretch as long as several
    of two periods has their common divisor as a period too, and is one maximal
    stretch for all its multiples.
    """

    min_words: int = MIN_WORDS
    min_times: int = MIN_TIMES
    open: dict[int, int] = field(default_factory=dict)
    closed: dict[tuple[int, int], int] = field(default_factory=dict)
    _levels: list[_Level] = field(default_factory=list)
    _words: np.ndarray = field(default_factory=lambda: np.empty(1024, np.int64))
    _n: int = 0

    def __post_init__(self) -> None:
        if self.min_times < MIN_TIMES:
            raise ValueError(f"runs of fewer than {MIN_TIMES} periods aren't all found")

    def append(self, words: np.ndarray) -> None:
        """More words, as numbers that are equal where the words are."""
        old, self._n = self._n, self._n + len(words)
        if self._n > len(self._words):
            self._words = np.concatenate([self._words[:old], np.empty(max(self._n, 2 * old) - old, np.int64)])
        self._words[old : self._n] = words
        for period, start in list(self.open.items()):
            end = self._right(old, period)
            if end < self._n:
                del self.open[period]
                self._close(start, end, period)
        self._smallest(old)
        size, k = 1, 0
        while 4 * size <= self._n:
            self._advance(k, size, old)
            size, k = 2 * size, k + 1
        for level in self._levels:
            drop = max(0, self._n - _KEPT * level.size - level.base)
            if drop > len(level.hashes) // 2:
                level.base, level.hashes = level.base + drop, level.hashes[drop:].copy()

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs so far, by start and period; period is the smallest one."""
        whole = dict(self.closed)
        for p, start in self.open.items():
            if self._long(self._n - start, p):
                whole[start, self._n] = min(p, whole.get((start, self._n), p))
        return sorted((start, end - start, p) for (start, end), p in whole.items())

    def _long(self, length: int, period: int) -> bool:
        return length >= max(self.min_words, self.min_times * period)

    def _close(self, start: int, end: int, period: int) -> None:
        if self._long(end - start, period):
            self.closed[start, end] = min(period, self.closed.get((start, end), period))

    def _right(self, at: int, period: int) -> int:
        """The first place from at on whose word isn't the one a period before."""
        words, n, stride = self._words, self._n, _STRIDE
        while at < n:
            to = min(n, at + stride)
            differ = words[at:to] != words[at - period : to - period]
            if differ.any():
                return at + int(differ.argmax())
            at, stride = to, 2 * stride
        return n

    def _left(self, at: int, period: int) -> int:
        """The first place of the stretch up to at (without it) whose words come again a period later."""
        words, stride = self._words, _STRIDE
        while at > 0:
            to = max(0, at - stride)
            differ = words[to:at] != words[to + period : at + period]
            if differ.any():
                return at - int(differ[::-1].argmax())
            at, stride = to, 2 * stride
        return 0

    def _smallest(self, old: int) -> None:
        """Period 1, below what blocks can catch: stretches of one word that begin within the new words or just before them."""
        words, n = self._words, self._n
        least = max(self.min_words, self.min_times) - 1
        first = max(1, old - least)
        if n - first < least:
            return
        same = np.concatenate([[False], words[first:n] == words[first - 1 : n - 1], [False]])
        turns = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(turns[::2], turns[1::2], strict=True):
            if b - a >= least and 1 not in self.open:
                self._caught(first + int(a), 1, old)

    def _caught(self, place: int, period: int, old: int) -> tuple[int, int]:
        """Start and end of the stretch of a period around a place whose word also stands a period before it."""
        start = self._left(place - period, period)
        end = self._right(place, period)
        if end == self._n:
            self.open[period] = start
        elif end > old:
            self._close(start, end, period)
        return start, end

    def _windows(self, k: int, size: int) -> int:
        """Adds the level's new windows; the start of the first of them."""
        if k == len(self._levels):
            self._levels.append(_Level(size, 0, np.empty(0, np.uint64)))
        level, n = self._levels[k], self._n
        new = level.base + len(level.hashes)
        if k == 0:
            made = self._words[new:n].astype(np.uint64)
        else:
            below = self._levels[k - 1]
            half, to = size // 2, n - size + 1
            made = _mixed(below.hashes[new - below.base : to - below.base], below.hashes[new + half - below.base : to + half - below.base])
        level.hashes = np.concatenate([level.hashes, made]) if len(level.hashes) else made
        return new

    def _advance(self, k: int, size: int, old: int) -> None:
        """The catchers of a level meet the windows that the new words end."""
        new = self._windows(k, size)
        level, n = self._levels[k], self._n
        hashes, base = level.hashes, level.base
        # The window at i and the blocks two and three before its own; a catch has the same words a period before the block as well.
        window = np.arange(max(new, 4 * size), n - size + 1)
        found = []
        for back in (2, 3):
            block = (window // size - back) * size
            hit = hashes[window - base] == hashes[block - base]
            if hit.any():
                i, s = window[hit], block[hit]
                before = 2 * s - i
                sound = before >= max(base, 0)
                i, s, before = i[sound], s[sound], before[sound]
                same = hashes[before - base] == hashes[s - base]
                found.append((i[same], s[same]))
        if not found:
            return
        i, s = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(i):
            self._meet(i, s, size, old)

    def _meet(self, i: np.ndarray, s: np.ndarray, size: int, old: int) -> None:
        keep = self._aligned(i, s, size)
        i, s = i[keep], s[keep]
        if not len(i):
            return
        order = np.lexsort((i, i - s))
        i, s = i[order], s[order]
        periods = i - s
        cuts = np.flatnonzero(np.diff(periods, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(i)], strict=True):
            period, at = int(periods[a]), a
            while at < b:
                if period in self.open and self.open[period] <= s[at]:
                    break  # The stretch goes on to the end and holds all that follow.
                _, end = self._caught(int(i[at]), period, old)
                at += max(1, int(np.searchsorted(i[at:b], end - size, "right")))

    def _aligned(self, i: np.ndarray, s: np.ndarray, size: int) -> np.ndarray:
        """Of the catches of blocks that lie in a run of a period up to size / 4, only those at the same place of another such run."""
        first = int(s.min())
        small = [(a, b, p) for (a, b), p in [*self.closed.items(), *(((a, self._n), p) for p, a in self.open.items())] if 4 * p <= size <= b - a and b > first]
        keep = np.ones(len(i), bool)
        if not small:
            return keep
        owner = np.full(self._n - first, -1, np.int64)
        # By falling period, so that of a run's multiples the smallest period's stretch owns the place.
        for k, (a, b, _) in sorted(enumerate(small), key=lambda x: -x[1][2]):
            owner[max(0, a - first) : max(0, b - size + 1 - first)] = k
        starts = np.array([a for a, _, _ in small])
        mine, other = owner[s - first], owner[i - first]
        held = mine >= 0
        both = held & (other >= 0)
        keep[held] = False
        there = np.flatnonzero(both & (mine != other))
        keep[there] = s[there] - starts[mine[there]] == i[there] - starts[other[there]]
        return keep


def numbered(words: list) -> np.ndarray:
    """A number for each word, the same for equal ones."""
    number = defaultdict(count().__next__)
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def without_repeats(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that lie in no run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


def repeated_inside(n: int, key: str | None) -> np.ndarray | None:
    """Which original word each of n words of a planted document is; None for the nine in ten, and those without key, that are left as they are."""
    h = zlib.crc32(key.encode()) if key is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def _row(text: str | None, key: str | None) -> tuple:
    words = (text or "").encode().split()
    ids = numbered(words)
    order = repeated_inside(len(words), key)
    if order is not None:
        ids = ids[order]
    detector = RunDetector()
    detector.append(ids)
    runs = detector.runs()
    if runs:
        stay = np.flatnonzero(without_repeats(len(ids), runs))
        stay = stay if order is None else order[stay]
        words = [words[k] for k in stay]
    elif order is not None:
        words = [words[k] for k in order]
    return [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], b" ".join(words).decode()


_RESULT = "struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"


def with_runs(df: DataFrame, text: str = "text", name: str = "periods", planted_by: str | None = None) -> DataFrame:
    """df with a struct column: runs, an array of (start, length, period) by start and period, and collapsed, the text's words without repetitions.

    Words are separated by ASCII white space and numbered from 0. A run is a
    stretch of words with smallest period q and at least max(6, 4q) words that
    no neighbouring word extends. collapsed has the words that lie in no run
    after its first q words, joined by single blanks; it is never null.
    planted_by names an integer column by which one text in ten is made
    repetitive first (see repeated_inside()); rows without a number there
    aren't. A null or empty text has no words and no runs. Each row is judged
    by itself: repeated rows fare alike, an empty table gives an empty table,
    and other columns stay, whatever their names.
    """
    (made,) = fresh(df, name)
    keys = (F.col(f"`{planted_by}`").cast("long") if planted_by else F.lit(None)).cast("string")

    @F.pandas_udf(_RESULT)
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, keys in batches:
            yield pd.DataFrame([_row(t, k) for t, k in zip(texts, keys, strict=True)], columns=["runs", "collapsed"])

    return df.select(*[F.col(f"`{c}`") for c in df.columns], found(F.col(f"`{text}`"), keys).alias(made))


def digest(runs: Column) -> Column:
    """Each run's start,length,period and a line feed, one after the other, as SHA-256."""
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return F.sha2(F.array_join(lines, ""), 256)


def longest(runs: Column) -> Column:
    """The run with most words, of equal ones the first, then that of the smallest period; null if there is none."""
    ordered = F.array_sort(F.transform(runs, lambda r: F.struct((-r["length"]).alias("falling"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    return F.get(ordered, F.lit(0))


def run_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of (doc_id, text), one text in ten planted by its id; see with_runs()."""
    read = with_runs(docs.select("doc_id", "text"), planted_by="doc_id").select("doc_id", "periods.*")
    read = read.withColumn("top", longest(F.col("runs")))
    return read.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"), digest(F.col("runs")).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
