"""The event log as a streaming data source by ids: a reader starts at its cursor, and an id that commits late isn't passed over."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from plazaworks.session import shipped
from plazaworks.streaming.log import SCHEMA

#: Ids of a folder of the log, which is what a task reads, and how long an open gap between ids is waited for.
BLOCK, WAIT_MS = 100_000, 60_000

#: SCHEMA as Spark takes it from Arrow; Parquet's older timestamps are of nanoseconds.
_ARROW = pa.schema([("id", pa.int64()), *((c, pa.string()) for c in ("user_id", "turn_id", "kind", "payload")), ("created_at", pa.timestamp("us", tz="UTC"))])
#: Ids from the first to the last, both included.
Range = tuple[int, int]


def append_log(rows: DataFrame, path: str, block: int = BLOCK) -> None:
    """Adds rows to a log whose folders hold a block of ids each. block is the same for all writers and readers."""
    rows.withColumn("block", F.floor(F.col("id") / block)).repartition("block").write.mode("append").partitionBy("block").parquet(path)


def without(ranges: list[Range], holes: list[Range]) -> list[Range]:
    """The parts of ascending ranges that ascending holes leave."""
    found, at = [], 0
    for low, high in ranges:
        while at < len(holes) and holes[at][1] < low:
            at += 1
        k = at
        while k < len(holes) and holes[k][0] <= high:
            if low < holes[k][0]:
                found.append((low, holes[k][0] - 1))
            low = holes[k][1] + 1
            k += 1
        if low <= high:
            found.append((low, high))
    return found


def missing(ids: pa.Array, low: int, high: int) -> list[Range]:
    """The ranges of ids from low to high that aren't among ids."""
    here = [low - 1, *pc.unique(ids.sort()).to_pylist(), high + 1]
    return [(a + 1, b - 1) for a, b in zip(here, here[1:]) if b - a > 1]


@dataclass
class Stretch(InputPartition):
    """A block's ranges of ids."""

    block: int
    ranges: list[Range]


class LogReader(DataSourceStreamReader):
    """Offsets are the largest id seen, through, the gaps below it that are still open, and those that were given up.

    All but the ids in gaps are delivered. A batch is what lies between two
    offsets: ids after the first's through, and those in its gaps that are in
    the second's gaps no more, but for what the second gives up. A gap is given
    up when it was open for the time to wait, as that of a transaction that was
    rolled back; what comes for it later is lost, as for any reader by cursor.
    What a batch holds doesn't depend on when it is read, so one that is run
    again gives the same rows.

    Finding an offset takes the ids, and nothing else, of the blocks from the
    last one on and of those with gaps, one at a time; blocks whose files tell
    by their row counts that they are full aren't read. The offset that was
    reached is kept in the folder position, from which a reader that is started
    again goes on.
    """

    def __init__(self, options: dict[str, str]):
        self._path, self._position = options["path"], options["position"]
        self._after = options.get("after")
        self._block, self._wait = int(options.get("block", BLOCK)), int(options.get("wait_ms", WAIT_MS))
        self._base: dict | None = None
        self._since: dict[Range, int] = {}

    def _files(self, block: int) -> list[str]:
        system, base = fs.FileSystem.from_uri(self._path)
        found = system.get_file_info(fs.FileSelector(f"{base}/block={block}", allow_not_found=True))
        return sorted(f.path for f in found if f.is_file and f.base_name.endswith(".parquet") and f.base_name[0] not in "._")

    def _blocks(self) -> list[int]:
        system, base = fs.FileSystem.from_uri(self._path)
        found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return sorted(int(f.base_name[6:]) for f in found if f.base_name.startswith("block="))

    def _gaps_of(self, block: int, low: int, high: int | None) -> tuple[list[Range], int | None]:
        """(gaps, largest id) of a block's ids from low to high, or to its largest."""
        system, _ = fs.FileSystem.from_uri(self._path)
        files = self._files(block)
        first, last = block * self._block, (block + 1) * self._block - 1
        if sum(pq.ParquetFile(system.open_input_file(f)).metadata.num_rows for f in files) == self._block:
            return [], last if high is None else high
        ids = pa.chunked_array([c for f in files for c in pq.ParquetFile(system.open_input_file(f)).read(columns=["id"])["id"].cast("int64").chunks], "int64")
        ids = ids.filter(pc.and_(pc.greater_equal(ids, low), pc.less_equal(ids, last if high is None else high))).combine_chunks()
        top = high if high is not None else (pc.max(ids).as_py() if len(ids) else None)
        return (missing(ids, max(low, first), top) if top is not None else []), top

    def _kept(self) -> dict | None:
        """The last position that was written whole."""
        system, base = fs.FileSystem.from_uri(self._position)
        for f in sorted(system.get_file_info(fs.FileSelector(base, allow_not_found=True)), key=lambda f: f.base_name, reverse=True):
            if f.base_name.endswith(".json"):
                with system.open_input_file(f.path) as read:
                    return json.loads(read.read())
        return None

    def _keep(self, offset: dict) -> None:
        system, base = fs.FileSystem.from_uri(self._position)
        system.create_dir(base, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(base)) if f.base_name.endswith(".json")]
        name = f"{base}/{time.time_ns():020d}-{uuid.uuid4().hex}"
        with system.open_output_stream(f"{name}.part") as out:
            out.write(json.dumps(offset).encode())
        system.move(f"{name}.part", f"{name}.json")
        for path in sorted(old)[:-1]:
            system.delete_file(path)

    def _start(self) -> dict:
        if self._base is None:
            self._base = self._kept()
            if self._base is None:
                blocks = self._blocks()
                through = int(self._after) if self._after is not None else (self._gaps_of(blocks[-1], 0, None)[1] if blocks else 0)
                self._base = {"through": through or 0, "gaps": "[]", "lost": "[]"}
                self._keep(self._base)
        return self._base

    def initialOffset(self) -> dict:
        return self._start()

    def latestOffset(self) -> dict:
        base, now = self._start(), int(time.time() * 1000)
        through, known = base["through"], [(a, b, t) for a, b, t in json.loads(base["gaps"])]
        open_now: list[Range] = []
        for low, high, _ in known:
            for block in range(low // self._block, high // self._block + 1):
                first = block * self._block
                open_now += self._gaps_of(block, max(low, first), min(high, first + self._block - 1))[0]
        since = {(a, b): t for a, b, t in known} | self._since
        low = through + 1
        for block in (b for b in self._blocks() if b >= low // self._block):
            gaps, top = self._gaps_of(block, max(low, block * self._block), None)
            if top is None or top < low:
                continue
            if low < block * self._block:
                open_now.append((low, block * self._block - 1))
            open_now += gaps
            through, low = top, top + 1
        # What is left of a gap has been open as long as the gap.
        age = {g: min([t for (a, b), t in since.items() if a <= g[0] and g[1] <= b], default=now) for g in open_now}
        self._since = age
        lost = sorted(g for g, t in age.items() if now - t >= self._wait)
        gaps = sorted((*g, t) for g, t in age.items() if now - t < self._wait)
        return {"through": through, "gaps": json.dumps(gaps), "lost": json.dumps(lost)}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        self._base = start
        span = lambda offset, name: [(a, b) for a, b, *_ in json.loads(offset[name])]
        ranges = span(start, "gaps")
        if end["through"] > start["through"]:
            ranges = [*ranges, (start["through"] + 1, end["through"])]
        left = without(ranges, sorted(span(end, "gaps") + span(end, "lost")))
        of: dict[int, list[Range]] = {}
        for low, high in left:
            for block in range(low // self._block, high // self._block + 1):
                first = block * self._block
                of.setdefault(block, []).append((max(low, first), min(high, first + self._block - 1)))
        return [Stretch(block, found) for block, found in sorted(of.items())]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self._path)
        for file in self._files(partition.block):
            for batch in pq.ParquetFile(system.open_input_file(file)).iter_batches(columns=_ARROW.names):
                ids, wanted = batch["id"], pa.array([False] * len(batch))
                for low, high in partition.ranges:
                    wanted = pc.or_(wanted, pc.and_(pc.greater_equal(ids, low), pc.less_equal(ids, high)))
                found = batch.filter(wanted)
                yield pa.RecordBatch.from_arrays([found[f.name].cast(f.type, safe=False) for f in _ARROW], schema=_ARROW)

    def commit(self, end: dict) -> None:
        self._keep(end)


class LogSource(DataSource):
    """Options: path of the log, position (a folder of the reader's own), after (its cursor; what is new without it), block and wait_ms."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogReader:
        return LogReader({k.lower(): v for k, v in self.options.items()})


def read_log_by_id(spark: SparkSession, path: str, position: str, after: int | None = None, wait_ms: int = WAIT_MS, block: int = BLOCK) -> DataFrame:
    """Rows of append_log()'s log as a stream: those after a reader's cursor, or without one what comes from now on.

    position is a folder that outlives the query, one for each reader. See LogReader.
    """
    shipped(spark).dataSource.register(LogSource)
    options = {"path": path, "position": position, "wait_ms": str(wait_ms), "block": str(block)} | ({} if after is None else {"after": str(after)})
    return spark.readStream.format("event_log").options(**options).load()
