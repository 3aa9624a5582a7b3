"""Byte-level BPE pre-tokens of many texts at once, and token ids through a cache of pre-tokens.

The pattern is the usual one of byte-level vocabularies: contractions, letters,
numbers and other characters with one blank before, and white space. Classes
of characters come from the tokenizer itself, asked once for each character
that occurs, so that they agree with it whatever its Unicode tables are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

_NONE, _LETTER, _NUMBER, _SPACE, _OTHER = range(5)
#: Texts are cut together up to so many characters; a longer text is cut by itself.
CHUNK = 1 << 19
#: Pre-tokens a worker remembers before it starts anew; bounds its memory.
REMEMBERED = 500_000


class PreTokens:
    """Cuts texts into pre-tokens: words() gives them and how many each text has."""

    def __init__(self, tokenizer: Tokenizer):
        self._cut = tokenizer.pre_tokenizer.pre_tokenize_str
        self._class = np.zeros(0x110000, dtype=np.uint8)

    def _classify(self, chars: np.ndarray) -> None:
        for code in chars:
            c = chr(code)
            alone = [kind for kind, before in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")) if len(self._cut(before + c)) == 1]
            self._class[code] = alone[0] if alone else _SPACE

    def words(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        whole = "".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        n = len(codes)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        starts = np.concatenate(([0], np.cumsum(lengths)))
        if not n:
            return [], np.zeros(len(texts), dtype=np.int64)
        kind = self._class[codes]
        if not kind.all():
            self._classify(np.unique(codes[kind == _NONE]))
            kind = self._class[codes]
        head = np.zeros(n + 1, dtype=bool)  # where a text starts, or all end
        head[starts] = True
        run = head[:n].copy()  # where a run of one class starts
        run[1:] |= kind[1:] != kind[:-1]
        blank = codes == 32
        space = kind == _SPACE
        # A run takes the blank before it; the last of several white spaces stands alone unless it is that blank.
        first = run.copy()
        first[1:] &= ~(blank[:-1] & ~space[1:] & ~head[1:n])
        last_space = space.copy()
        last_space[:-1] &= ~space[1:] & ~head[1:n]
        last_space[-1] = False
        last_space &= ~head[1:]
        first |= last_space
        self._contractions(codes, kind, first, head)
        begin = np.flatnonzero(first)
        counts = np.diff(np.searchsorted(begin, starts))
        cut = begin.tolist()
        return [whole[a:b] for a, b in zip(cut, [*cut[1:], n], strict=True)], counts

    @staticmethod
    def _contractions(codes: np.ndarray, kind: np.ndarray, first: np.ndarray, head: np.ndarray) -> None:
        """An apostrophe that starts a pre-token takes s, t, m, d, re, ve or ll with it."""
        n = len(codes)
        at = np.flatnonzero((codes == ord("'")) & first)
        at = at[at + 1 < n]
        at = at[~head[at + 1]]
        one = np.isin(codes[at + 1], [ord(c) for c in "stmd"])
        two = np.zeros(len(at), dtype=bool)
        fits = (at + 2 < n) & ~head[np.minimum(at + 2, n)]
        for a, b in ("re", "ve", "ll"):
            two[fits] |= (codes[at[fits] + 1] == ord(a)) & (codes[at[fits] + 2] == ord(b))
        for found, size in ((at[one], 1), (at[two & ~one], 2)):
            first[found + 1] = False
            after = found + size + 1
            after = after[after < n]
            first[after] |= (kind[after] == _LETTER) | head[after]


class _Numbers(dict):
    """Numbers keys as they come; added holds the latest."""

    def __init__(self):
        self.added: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.added.append(key)
        return number


class CachedIds:
    """Token ids of texts; new pre-tokens go to encode, which gives the ids of each."""

    def __init__(self, tokenizer: Tokenizer, encode: Callable[[list[str]], list[list[int]]], special: dict[str, int], remembered: int = REMEMBERED):
        self._pre, self._encode, self._special, self._most = PreTokens(tokenizer), encode, special, remembered
        self._clear()

    def _clear(self) -> None:
        self._number = _Numbers()
        self._flat, self._ends = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def _learn(self, words: list[str]) -> np.ndarray:
        """Numbers of words among those remembered."""
        if len(self._number) > self._most:
            self._clear()
        numbers = np.fromiter(map(self._number.__getitem__, words), dtype=np.int64, count=len(words))
        if new := self._number.added:
            ids = self._encode(new)
            self._number.added = []
            size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            self._flat = np.concatenate((self._flat, np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(size.sum()))))
            self._ends = np.concatenate((self._ends, self._ends[-1] + np.cumsum(size)))
        return numbers

    def _plain(self, texts: list[str]) -> Iterator[np.ndarray]:
        words, counts = self._pre.words(texts)
        numbers = self._learn(words)
        if not len(numbers):
            yield from (np.zeros(0, dtype=np.uint32) for _ in texts)
            return
        flat, ends = self._flat, self._ends
        begin, size = ends[numbers], ends[numbers + 1] - ends[numbers]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = flat[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        bounds = total[np.concatenate(([0], np.cumsum(counts)))]
        for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            yield ids[a:b]

    def _split(self, text: str) -> list[str | int]:
        """A text with special tokens: the parts between them, and their ids."""
        parts: list[str | int] = [text]
        for token, number in self._special.items():
            parts = [y for x in parts for y in (self._between(x, token, number) if isinstance(x, str) else [x])]
        return parts

    @staticmethod
    def _between(text: str, token: str, number: int) -> list[str | int]:
        out: list[str | int] = []
        for piece in text.split(token):
            out += [number, piece]
        return out[1:]

    def __call__(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """For each text its ids; null is the empty text."""
        batch: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if any(token in text for token in self._special):
                yield from self._plain(batch)
                batch, size = [], 0
                parts = self._split(text)
                ids = self._plain([x for x in parts if isinstance(x, str)])
                yield np.concatenate([np.array([x], dtype=np.uint32) if isinstance(x, int) else next(ids) for x in parts])
                continue
            if batch and size + len(text) > CHUNK:
                yield from self._plain(batch)
                batch, size = [], 0
            batch.append(text)
            size += len(text)
        yield from self._plain(batch)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def special_tokens(tokenizer: Tokenizer) -> dict[str, int]:
    """Added tokens, which are found in texts before anything else."""
    return {str(token.content): number for number, token in tokenizer.get_added_tokens_decoder().items()}


def library_ids(path: str) -> CachedIds:
    """Ids by the tokenizers library: its model encodes each new pre-token."""
    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    letters = dict(enumerate(byte_letters()))

    def encode(words: list[str]) -> list[list[int]]:
        return [[token.id for token in model.tokenize(word.encode().decode("latin-1").translate(letters))] for word in words]

    return CachedIds(tokenizer, encode, special_tokens(tokenizer))


_OPEN: dict[str, CachedIds] = {}


def worker_ids(path: str) -> CachedIds:
    """The worker's encoder for a vocabulary: later tasks of the same worker find its cache filled."""
    if path not in _OPEN:
        _OPEN[path] = library_ids(path)
    return _OPEN[path]
