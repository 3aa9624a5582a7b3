"""Token ids in binary files with Elias-Fano coded document boundaries.

A file holds a shard, documents of a range of ids in ascending order:

    magic | ids, little-endian, 2 or 4 bytes each | ends of documents | document ids | footer | its length | magic

Ends (ids before each document's end) and document ids (less the first) are
ascending and so are Elias-Fano coded: low bits packed, high bits in unary
with the place of every 64th one kept. Documents without an id come first in
the first shard; only their number is kept.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plazaworks.llm.pretokens import worker_ids
from plazaworks.llm.shared import filesystem, shared_dir, stored

MAGIC = b"TOKENEF1"
#: The id that ends a document.
END = 2
#: Bytes of ids that reading a whole shard takes at once, unless one document is longer.
READ = 4 << 20
_SAMPLE = 64


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest width bits of each value, one after another, as bytes."""
    bits = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits.ravel(), bitorder="little")


class EliasFano:
    """An ascending sequence of non-negative numbers; [i] finds one without unpacking the others."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, places: np.ndarray):
        self.n, self.width, self._low, self._high, self._places = n, width, low, high, places

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        width = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        ones = (values >> np.uint64(width)) + np.arange(n, dtype=np.uint64)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        high[ones.astype(np.int64)] = 1
        return cls(n, width, _pack_bits(values, width), np.packbits(high, bitorder="little"), ones[::_SAMPLE].astype("<u4" if len(high) < 1 << 32 else "<u8"))

    def _select(self, i: int) -> int:
        """The place of the i-th one among the high bits."""
        at = int(self._places[i // _SAMPLE])
        left = i % _SAMPLE
        while True:
            ones = np.flatnonzero(np.unpackbits(self._high[at // 8 : at // 8 + 64], bitorder="little")[at % 8 :])
            if len(ones) > left:
                return at + int(ones[left])
            left -= len(ones)
            at = (at // 8 + 64) * 8

    def __getitem__(self, i: int) -> int:
        first = i * self.width
        word = int.from_bytes(self._low[first // 8 : (first + self.width) // 8 + 1].tobytes(), "little") >> first % 8
        return (self._select(i) - i << self.width) | word & ((1 << self.width) - 1)

    def __iter__(self) -> Iterator[int]:
        """All in order, unpacked by stretches."""
        for k in range(0, self.n, 1 << 14):
            count = min(1 << 14, self.n - k)
            begin = self._select(k) // 8
            end = self._select(k + count - 1) // 8 + 1
            ones = np.flatnonzero(np.unpackbits(self._high[begin:end], bitorder="little"))
            skip = int(np.searchsorted(ones, self._select(k) - 8 * begin))
            high = ones[skip : skip + count] + 8 * begin - np.arange(k, k + count)
            first = k * self.width
            bits = np.unpackbits(self._low[first // 8 : -(-(first + count * self.width) // 8)], bitorder="little")[first % 8 :][: count * self.width]
            low = (bits.reshape(count, self.width).astype(np.int64) << np.arange(self.width)).sum(axis=1)
            yield from ((high.astype(np.int64) << self.width) | low).tolist()

    def __len__(self) -> int:
        return self.n

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBBQQ", self.n, self.width, self._places.itemsize, len(self._low), len(self._high))
        return head + self._low.tobytes() + self._high.tobytes() + self._places.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, width, item, low, high = struct.unpack_from("<QBBQQ", raw)
        at = struct.calcsize("<QBBQQ")
        data = np.frombuffer(raw, dtype=np.uint8)
        return cls(n, width, data[at : at + low], data[at + low : at + low + high], np.frombuffer(raw, dtype=f"<u{item}", offset=at + low + high))


def write_shard(uri: str, docs: Iterator[tuple[int | None, np.ndarray]], width: int) -> dict | None:
    """Writes (id, token ids) pairs in their order; gives the shard's figures, or None without documents."""
    first = next(docs, None)
    if first is None:
        return None
    system, path = filesystem(uri)
    ends, names, nulls, total = [], [], 0, 0
    with system.open_output_stream(path) as out:
        out.write(MAGIC)
        for doc, ids in (x for source in ((first,), docs) for x in source):
            if len(ids) and int(ids.max()) >= 1 << 8 * width:
                raise ValueError(f"id {int(ids.max())} of document {doc} doesn't fit into {width} bytes")
            out.write(ids.astype(f"<u{width}").tobytes())
            total += len(ids)
            ends.append(total)
            if doc is None:
                nulls += 1
            else:
                names.append(doc)
        base = names[0] if names else 0
        bounds = EliasFano.of(np.array(ends, dtype=np.uint64)).to_bytes()
        ids_ = EliasFano.of(np.array([x - base for x in names], dtype=np.uint64)).to_bytes()
        footer = json.dumps({"width": width, "ids": total, "docs": len(ends), "nulls": nulls, "first": base, "bounds": len(bounds), "names": len(ids_)}).encode()
        out.write(bounds + ids_ + footer + struct.pack("<I", len(footer)) + MAGIC)
    return {"docs": len(ends), "ids": total}


class Shard:
    """A written shard; documents are read by their place without the rest of the file."""

    def __init__(self, uri: str):
        system, path = filesystem(uri)
        self._file = system.open_input_file(path)
        size = self._file.size()
        tail = self._file.read_at(len(MAGIC) + 4, size - len(MAGIC) - 4)
        if tail[4:] != MAGIC:
            raise ValueError(f"{uri} is no complete shard")
        length = struct.unpack("<I", tail[:4])[0]
        at = size - len(MAGIC) - 4 - length
        self.about = json.loads(self._file.read_at(length, at))
        self.ends = EliasFano.from_bytes(self._file.read_at(self.about["bounds"], at - self.about["names"] - self.about["bounds"]))
        self.names = EliasFano.from_bytes(self._file.read_at(self.about["names"], at - self.about["names"]))

    def __len__(self) -> int:
        return self.about["docs"]

    def _ids(self, begin: int, end: int) -> np.ndarray:
        width = self.about["width"]
        return np.frombuffer(self._file.read_at((end - begin) * width, len(MAGIC) + begin * width), dtype=f"<u{width}")

    def __getitem__(self, i: int) -> np.ndarray:
        """The ids of the i-th document."""
        return self._ids(self.ends[i - 1] if i else 0, self.ends[i])

    def docs(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, ids before it in the shard, ids) of each document in order."""
        names, begin, most = iter(self.names), 0, READ // self.about["width"]
        held, low, high = np.zeros(0), 0, 0
        for i, end in enumerate(self.ends):
            if end > high:
                low, high = begin, min(max(begin + most, end), self.about["ids"])
                held = self._ids(low, high)
            doc = None if i < self.about["nulls"] else self.about["first"] + next(names)
            yield doc, begin, held[begin - low : end - low]
            begin = end

    def close(self) -> None:
        self._file.close()


def id_width(path: str, end: int = END) -> int:
    """Bytes an id takes by the largest one of the vocabulary file at path, added tokens included."""
    largest = max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0)
    return 2 if max(largest, end) < 1 << 16 else 4


def write_token_files(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """Writes docs in ascending id order; gives (shard, file, docs, ids, base), base the ids in all shards before.

    Ids come from the tokenizers library with the vocabulary file at path, the
    end id after each document's; they take 2 bytes where the largest id of the
    file and the end id fit, else 4. Null texts are empty, null ids come first,
    rows that repeat an id keep all their texts. A task that is run again
    writes a file of another name; only files in the table returned count. No
    other columns are read; an empty table gives a table without shards.
    """
    width = id_width(path, end)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = worker_ids(path)
        shard = TaskContext.get().partitionId()

        def pairs() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                for doc, ids in zip(batch.column(0).to_pylist(), ids_of(batch.column(1).to_pylist()), strict=True):
                    yield doc, np.append(ids, end)

        uri = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.tok"
        if about := write_shard(uri, pairs(), width):
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [uri], "docs": [about["docs"]], "ids": [about["ids"]]})

    text = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ordered = text.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    shards = stored(ordered.mapInArrow(work, "shard long, file string, docs long, ids long"), "shards")
    # One row a file, about 100 bytes: a million files are 100 MB, which one task sums up.
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return shards.withColumn("base", F.coalesce(before, F.lit(0)))


def read_token_files(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files; start counts the ids of all documents before it.

    Ids of documents that were null are null; a table without files gives no
    rows. Rows of shards that repeat are read as often.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard, rows = Shard(uri), []
                for doc, begin, ids in shard.docs():
                    rows.append((doc, base + begin, len(ids), zlib.crc32(ids.astype("<u4"))))
                    if len(rows) == 1 << 14:
                        yield _rows(rows)
                        rows = []
                shard.close()
                yield _rows(rows)

    return shards.repartition(max(1, shards.count())).mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_file_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents written to the shared folder and read back from there: (doc_id, start, n_tokens, ids_crc32).

    Odd rows as write_token_files() has them: each row of docs gives one,
    whatever its id and text, and other columns don't matter; an empty table
    gives an empty table.
    """
    folder = shared_dir(docs.sparkSession, "tokens")
    system, where = filesystem(folder)
    system.create_dir(where, recursive=True)
    return read_token_files(write_token_files(docs, path, folder, id_col, text_col))
