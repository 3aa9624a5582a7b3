"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs, and decoding.

Leaf p of a pre-token's tree holds the rank of the pair that starts at symbol
p, joined with p itself, so that the root is the leftmost pair of the lowest
rank. A merge changes three leaves and their ancestors. Trees of equal size
are kept as rows of one array and take their merges in step. The tree of a very
long pre-token takes all merges of the root's rank in one step, from left to
right, where no merge of a lower rank can come of them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plazaworks.llm.pretokens import CachedIds, byte_letters, special_tokens
from plazaworks.llm.shared import fresh

_NEVER = np.int64(1) << 62
#: Trees that merge in step hold at most so many leaves together, and a tree of so many takes merges of one rank at once.
_LEAVES, _LONG = 1 << 21, 1 << 12


class Merges:
    """The merges of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self._size = len(vocab) + 1
        keys = np.array([vocab[a] * self._size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order
        self._made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self._bytes = np.array([vocab[letter] for letter in byte_letters()], dtype=np.int64)
        # The lowest rank of a merge that takes a token; a merge whose token goes into none of a lower rank than its own
        # can't bring about one that comes before its equals.
        lowest = np.full(max(vocab.values()) + 1, _NEVER)
        for side in (0, 1):
            np.minimum.at(lowest, np.array([vocab[p[side]] for p in pairs], dtype=np.int64), np.arange(len(pairs)))
        self._together = lowest[self._made] > np.arange(len(pairs))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; _NEVER for pairs that don't merge or lack a side (-1)."""
        key = left * self._size + right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (left >= 0) & (right >= 0), self._ranks[at], _NEVER)

    def __call__(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        leaves = 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
        out: list[np.ndarray] = [None] * len(raw)
        for width in np.unique(leaves).tolist():
            of = np.flatnonzero(leaves == width)
            if width >= _LONG:
                for i in of.tolist():
                    out[i] = self._merged_long(raw[i], width)
                continue
            step = max(1, _LEAVES // width)
            for k in range(0, len(of), step):
                part = of[k : k + step]
                for i, ids in zip(part.tolist(), self._merged([raw[i] for i in part], size[part], width), strict=True):
                    out[i] = ids
        return out

    def _merged(self, words: list[bytes], size: np.ndarray, width: int) -> list[np.ndarray]:
        n = len(words)
        places = np.arange(width)
        inside = places < size[:, None]
        symbol = np.full((n, width + 1), -1, dtype=np.int64)  # the last column stands for the end
        symbol[:, :width][inside] = self._bytes[np.frombuffer(b"".join(words), dtype=np.uint8)]
        after = np.where(places + 1 < size[:, None], places + 1, width)
        before = np.broadcast_to(places - 1, (n, width)).copy()
        before = np.concatenate((before, np.zeros((n, 1), dtype=np.int64)), axis=1)
        tree = np.full((n, 2 * width), _NEVER, dtype=np.int64)
        ranks = self._rank(symbol[:, :width], np.take_along_axis(symbol, after, 1))
        tree[:, width:] = np.where(ranks < _NEVER, ranks * width + places, _NEVER)
        at = width
        while at > 1:
            tree[:, at // 2 : at] = np.minimum(tree[:, at : 2 * at : 2], tree[:, at + 1 : 2 * at : 2])
            at //= 2
        rows = np.flatnonzero(tree[:, 1] < _NEVER)
        while len(rows):
            rank, p = np.divmod(tree[rows, 1], width)
            q = after[rows, p]
            r = after[rows, q]
            symbol[rows, p] = self._made[rank]
            symbol[rows, q] = -1
            after[rows, p] = r
            before[rows, r] = p
            self._set(tree, rows, q, np.full(len(rows), _NEVER), width)
            self._renew(tree, symbol, after, rows, p, width)
            o = before[rows, p]
            has = o >= 0
            self._renew(tree, symbol, after, rows[has], o[has], width)
            rows = rows[tree[rows, 1] < _NEVER]
        left = symbol[:, :width] >= 0
        return np.split(symbol[:, :width][left], np.cumsum(left.sum(axis=1))[:-1])

    def _merged_long(self, word: bytes, width: int) -> np.ndarray:
        """As _merged() for one word: each step takes the pairs of the root's rank that don't overlap, or the leftmost alone."""
        size = len(word)
        symbol = np.full(width + 1, -1, dtype=np.int64)  # the last one stands for the end
        symbol[:size] = self._bytes[np.frombuffer(word, dtype=np.uint8)]
        places = np.arange(width + 1)
        after, before = np.minimum(places + 1, width), places - 1
        after[size - 1 :] = width
        tree = np.full(2 * width, _NEVER, dtype=np.int64)
        tree[width:] = self._rank(symbol[:width], symbol[after[:width]])
        at = width
        while at > 1:
            tree[at // 2 : at] = np.minimum(tree[at : 2 * at : 2], tree[at + 1 : 2 * at : 2])
            at //= 2
        while (rank := int(tree[1])) < _NEVER:
            found = np.ones(1, dtype=np.int64)
            if self._together[rank]:
                while found[0] < width:
                    found = np.stack((2 * found, 2 * found + 1), axis=1).ravel()
                    found = found[tree[found] == rank]
                p = found - width
                # Of a chain of pairs that share symbols (aaaa) every second one is taken, from its left end.
                chained = np.zeros(len(p), dtype=bool)
                chained[1:] = after[p[:-1]] == p[1:]
                begin = np.maximum.accumulate(np.where(chained, 0, np.arange(len(p))))
                p = p[(np.arange(len(p)) - begin) % 2 == 0]
            else:
                while found[0] < width:
                    found = 2 * found + (tree[2 * found] != rank)
                p = found - width
            q = after[p]
            r = after[q]
            symbol[p], symbol[q] = self._made[rank], -1
            after[p], before[r] = r, p
            o = before[p]
            changed = np.concatenate((p, o[o >= 0]))
            leaves = np.concatenate((changed, q))
            tree[width + leaves] = np.concatenate((self._rank(symbol[changed], symbol[after[changed]]), np.full(len(q), _NEVER)))
            up = np.unique(leaves + width >> 1)
            while up[0]:
                tree[up] = np.minimum(tree[2 * up], tree[2 * up + 1])
                up = up >> 1
                if len(up) > 1:
                    up = up[np.concatenate(([True], up[1:] != up[:-1]))]
        return symbol[:width][symbol[:width] >= 0]

    def _renew(self, tree: np.ndarray, symbol: np.ndarray, after: np.ndarray, rows: np.ndarray, p: np.ndarray, width: int) -> None:
        rank = self._rank(symbol[rows, p], symbol[rows, after[rows, p]])
        self._set(tree, rows, p, np.where(rank < _NEVER, rank * width + p, _NEVER), width)

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, p: np.ndarray, value: np.ndarray, width: int) -> None:
        at = p + width
        tree[rows, at] = value
        while width > 1:
            at = at >> 1
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
            width >>= 1


class Pieces:
    """The bytes of each token; ids that are no token's have none."""

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        of = {letter: bytes([b]) for b, letter in enumerate(byte_letters())}
        vocab = tokenizer.get_vocab(with_added_tokens=True)
        pieces = [b""] * (max(vocab.values()) + 1)
        for token, number in vocab.items():
            pieces[number] = b"".join(of[c] for c in token) if all(c in of for c in token) else token.encode()
        self._size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        self._begin = np.cumsum(self._size) - self._size
        self._data = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def __call__(self, ids: np.ndarray) -> str:
        ids = ids[(ids >= 0) & (ids < len(self._size))]
        size = self._size[ids]
        shift = np.cumsum(size) - size
        return self._data[np.repeat(self._begin[ids] - shift, size) + np.arange(int(size.sum()))].tobytes().decode("utf-8", "replace")


def merge_ids(path: str) -> CachedIds:
    """Ids as the library gives them, each new pre-token by the segment tree; truncation and padding unused."""
    tokenizer = Tokenizer.from_file(path)
    return CachedIds(tokenizer, Merges(path), special_tokens(tokenizer))


_OPEN: dict[tuple[str, str], CachedIds | Pieces] = {}


def _worker(kind, path: str):
    """One encoder or decoder a worker, kept for its later tasks."""
    if (kind.__name__, path) not in _OPEN:
        _OPEN[kind.__name__, path] = kind(path)
    return _OPEN[kind.__name__, path]


#: Rows turned into ids or text before they are handed on.
_ROWS = 512


def _with_column(batch: pa.RecordBatch, column: pa.Array, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])


def encode(df: DataFrame, path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """df with a column of token ids (array<int>) of the whole text; a null or empty text has none.

    Rows and other columns, null and repeated ids among them, stay as they
    are; name gets underscores until it is new; an empty table gives an empty
    table.
    """
    (name,) = fresh(df, name)
    at = df.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _worker(merge_ids, path)
        for whole in batches:
            for k in range(0, len(whole), _ROWS):
                batch = whole.slice(k, _ROWS)
                ids = list(ids_of(batch.column(at).to_pylist()))
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, dtype=np.int32)
                yield _with_column(batch, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), name)

    schema = df.select("*", F.array().cast("array<int>").alias(name)).schema
    return df.mapInArrow(work, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """df with the text of a column of token ids.

    A null list and an empty one give the empty text; ids that are no token's
    and null ids within a list give nothing, bytes that aren't UTF-8 the
    replacement character. Rows and other columns stay as they are; name gets
    underscores until it is new; an empty table gives an empty table.
    """
    (name,) = fresh(df, name)
    at = df.columns.index(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of = _worker(Pieces, path)
        for whole in batches:
            for k in range(0, len(whole), _ROWS):
                batch = whole.slice(k, _ROWS)
                lists = batch.column(at)
                flat = pc.fill_null(lists.values, -1).to_numpy(zero_copy_only=False)
                ends = lists.offsets.to_numpy()
                texts = [text_of(flat[a:b]) if valid else "" for a, b, valid in zip(ends.tolist(), ends[1:].tolist(), lists.is_valid().to_pylist(), strict=False)]
                yield _with_column(batch, pa.array(texts, pa.string()), name)

    schema = df.select("*", F.lit("").alias(name)).schema
    return df.mapInArrow(work, schema)
