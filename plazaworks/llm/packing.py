"""Packing of token ids into sequences: first-fit decreasing in randomised groups.

Documents are cut into pieces of at most CAPACITY ids. Groups of pieces, drawn
by a hash, are packed independently; a tournament tree of the bins' free
places finds the first bin that a piece fits in.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazaworks.llm.pretokens import worker_ids
from plazaworks.llm.shared import stored

CAPACITY = 1024
#: The id that ends a document.
END = 0
#: Pieces of a group, on average.
GROUP = 8192
SEED = 17


class FirstFit:
    """Bins of one capacity under a tournament tree: each node knows the most free places below it."""

    def __init__(self, bins: int, capacity: int):
        self._width = 1 << max(0, bins - 1).bit_length()
        self._most = [capacity] * (2 * self._width)

    def place(self, size: int) -> tuple[int, int]:
        """(bin, free places in it before): the first bin that has room for size."""
        most, at = self._most, 1
        while at < self._width:
            at *= 2
            if most[at] < size:
                at += 1
        free = most[at]
        most[at] = free - size
        found = at - self._width
        while at > 1:
            at //= 2
            most[at] = max(most[2 * at], most[2 * at + 1])
        return found, free


def first_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each size, the largest placed first, equal ones in the order given."""
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    tree = FirstFit(len(sizes), capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        bins[i], free = tree.place(int(sizes[i]))
        offsets[i] = capacity - free
    return bins, offsets


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cut(path: str, capacity: int, end: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = worker_ids(path)
        for batch in batches:
            out = []
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of(batch.column(1).to_pylist()), strict=True):
                whole = np.append(ids, end).astype("<u4")
                for start in range(0, len(whole), capacity):
                    piece = whole[start : start + capacity]
                    out.append((doc, start, len(piece), zlib.crc32(piece), len(whole)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in _PIECES.split(", ")])

    return work


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, group: int = GROUP, seed: int = SEED) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece.

    Each document's ids, by the tokenizers library with the vocabulary at path,
    and the end id after them are cut into pieces; a null or empty text is the
    end id alone. A null id stays null; rows that repeat an id are documents of
    their own. sequence_id is unique across groups. Other columns of docs are
    not read; an empty table gives an empty table.
    """
    text = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    pieces = text.mapInArrow(_cut(path, capacity, end), _PIECES).withColumn("uid", F.monotonically_increasing_id())
    pieces = stored(pieces, "pieces")
    groups = -(-max(1, pieces.count()) // group)

    def packed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("uid", ignore_index=True)
        bins, offsets = first_fit_decreasing(frame["length"].to_numpy(), capacity)
        return frame.drop(columns=["uid", "g"]).assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(packed, f"{_PIECES}, sequence_id long, offset long")
