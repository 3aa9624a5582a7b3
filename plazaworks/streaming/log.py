"""The append-only event log as a stream: frames for readers, turns and admissions with keyed state, vectors filled in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from plazaworks.operators.paging import assembled_calls

SCHEMA = "id long, user_id string, turn_id string, kind string, payload string, created_at timestamp"
#: Kinds that readers know.
KINDS = ("turn.started", "reply.delta", "reply.done", "tool.started", "tool.done", "places", "people", "event", "error", "turn.done")


def read_log(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """The log's files as a stream; what was read is kept by the query's checkpoint, not by an id."""
    return spark.readStream.schema(schema).parquet(path)


def for_user(log: DataFrame, user_id: str, after: int | None = None) -> DataFrame:
    """A user's rows of known kinds, after a cursor if one is given."""
    found = log.filter((F.col("user_id") == user_id) & F.col("kind").isin(*KINDS))
    return found if after is None else found.filter(F.col("id") > after)


def cursor_of(header: str | None) -> int | None:
    """The id to go on after; None for a reader who starts with what is new. Anything but a number from 0 on is refused."""
    text = (header or "").strip()
    if not text:
        return None
    if not text.isdigit():
        raise ValueError(f"no cursor: {header!r}")
    return int(text)


def frame(id_: Column, kind: Column, payload: Column) -> Column:
    """A server-sent event."""
    return F.concat(F.lit("id: "), id_.cast("string"), F.lit("\nevent: "), kind, F.lit("\ndata: "), payload, F.lit("\n\n"))


def parsed_frames(text: str) -> Iterator[dict[str, str]]:
    """Fields of each server-sent event: data lines joined, comments skipped."""
    for block in text.replace("\r\n", "\n").split("\n\n"):
        fields: dict[str, list[str]] = {}
        for line in block.split("\n"):
            if line and not line.startswith(":"):
                name, _, value = line.partition(":")
                fields.setdefault(name, []).append(value.removeprefix(" "))
        if "data" in fields:
            yield {k: "\n".join(v) for k, v in fields.items()}


#: State of a turn is dropped when nothing came for so long, by the log's own times: of a finished one, and of one that never finished. Rows may be late by the last.
DONE_FOR, OPEN_FOR, LATE_FOR = "10 minutes", "1 day", "1 hour"
#: Keyed state of many entries needs this store; the session's setting is checked, not changed.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_CALL = "index: int, id: string, name: string, arguments: string, whole: boolean"


def with_store(spark: SparkSession) -> SparkSession:
    """The session, if its streams keep state entry by entry; an error says which setting does."""
    if spark.conf.get(STORE[0], None) != STORE[1]:
        raise ValueError(f"streams with keyed state need {STORE[0]}={STORE[1]}")
    return spark


class Turns(StatefulProcessor):
    """A turn's state: parts of its reply by id, parts of its tool calls by index and id, and the finished reply.

    Each part is an entry, written when it comes and not again. A timer drops
    all of a turn when the log is long enough past the last that came for it.
    """

    def __init__(self, done_ms: int, open_ms: int):
        self._ms = {True: done_ms, False: open_ms}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._parts = handle.getMapState("parts", "id long", "part string")
        self._calls = handle.getMapState("calls", "index int, id long", "call string, name string, arguments string")
        self._end = handle.getValueState("end", "text string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changed, last = False, timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            last = max(last, int(frame["created_at"].max().timestamp() * 1000))
            for row in frame.itertuples(index=False):
                changed |= self._taken(row)
        done = self._end.exists()
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        self._handle.registerTimer(last + self._ms[done])
        if changed:
            text = self._end.get()[0] if done else "".join(part for _, (part,) in sorted((k[0], tuple(v)) for k, v in self._parts.iterator()))
            yield pd.DataFrame({"turn_id": [key[0]], "text": [text], "done": [done], "calls": [self._assembled()]})

    def _taken(self, row) -> bool:
        """Whether the row tells anything new."""
        if row.kind == "tool.delta":
            at = (int(row.index_), int(row.id))
            if self._calls.containsKey(at):
                return False
            self._calls.updateValue(at, (row.call, row.name, row.arguments))
            return True
        if self._end.exists():
            return False
        if row.kind == "reply.done":
            self._end.update((row.part,))
            self._parts.clear()
            return True
        if self._parts.containsKey((int(row.id),)):
            return False
        self._parts.updateValue((int(row.id),), (row.part,))
        return True

    def _assembled(self) -> list[dict]:
        """The calls by index: the last id and name that aren't empty, arguments joined in the order of ids."""
        calls: dict[int, dict] = {}
        for (index, _), (call, name, arguments) in sorted((tuple(k), tuple(v)) for k, v in self._calls.iterator()):
            known = calls.setdefault(index, {"index": index, "id": "", "name": "", "arguments": ""})
            known["id"], known["name"], known["arguments"] = call or known["id"], name or known["name"], known["arguments"] + arguments
        return [c | {"whole": bool(c["id"] and c["name"])} for c in calls.values()]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self._parts, self._calls, self._end):
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


def _ms(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


def assembled_turns(log: DataFrame, done_for: str = DONE_FOR, open_for: str = OPEN_FOR, late_for: str = LATE_FOR) -> DataFrame:
    """(turn_id, text, done, calls) whenever something new comes for a turn: deltas in the order of their ids, a finished reply in their place, and its tool calls.

    A delta that comes late, its id below those seen, goes where it belongs; a
    row that comes again changes nothing. Parts of a reply are kept until it is
    done. What is kept of a turn goes when the log has gone on for done_for
    after the last that came for it, or for open_for if it isn't done, and for
    late_for, by which rows may be late. Time is the rows' created_at; rows
    without it are left out. calls are those of calls_in_log(), as an array.
    """
    with_store(log.sparkSession)
    part = F.from_json("payload", "text string, index int, id string, name string, arguments string")
    filled = lambda c: F.coalesce(F.col(f"p.{c}"), F.lit(""))
    read = log.filter(F.col("kind").isin("reply.delta", "reply.done", "tool.delta") & F.col("created_at").isNotNull()).withWatermark("created_at", late_for)
    read = read.select("turn_id", "id", "kind", "created_at", part.alias("p"))
    rows = read.select("turn_id", "id", "kind", "created_at", filled("text").alias("part"), F.coalesce("p.index", F.lit(0)).alias("index_"), filled("id").alias("call"), filled("name").alias("name"), filled("arguments").alias("arguments"))
    return rows.groupBy("turn_id").transformWithStateInPandas(Turns(_ms(done_for), _ms(open_for)), f"turn_id string, text string, done boolean, calls array<struct<{_CALL}>>", "Update", "EventTime")


def assembled_replies(log: DataFrame, done_for: str = DONE_FOR, open_for: str = OPEN_FOR, late_for: str = LATE_FOR) -> DataFrame:
    """(turn_id, text, done) of assembled_turns(), of replies alone."""
    return assembled_turns(log.filter("kind <> 'tool.delta'"), done_for, open_for, late_for).select("turn_id", "text", "done")


class Admission(StatefulProcessor):
    """An event's state: how many go, and who, each guest an entry. Requests are answered in their order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._held = handle.getValueState("held", "n long")
        self._guests = handle.getMapState("guests", "user_id string", "outcome string")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        for user in initialState["user_id"]:
            if not self._guests.containsKey((user,)):
                self._guests.updateValue((user,), ("already",))
                self._held.update((self._n() + 1,))

    def _n(self) -> int:
        return self._held.get()[0] if self._held.exists() else 0

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(["seq", "user_id"])
        held, out = self._n(), []
        for row in asked.itertuples(index=False):
            if self._guests.containsKey((row.user_id,)):
                outcome = self._guests.getValue((row.user_id,))[0]
            elif pd.isna(row.capacity) or held < row.capacity:
                outcome, held = "going", held + 1
                self._guests.updateValue((row.user_id,), (outcome,))
            else:
                outcome = "full"
            out.append((key[0], row.user_id, row.seq, outcome))
        self._held.update((held,))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "seq", "outcome"])

    def close(self) -> None:
        pass


def admitted_stream(requests: DataFrame, events: DataFrame, going: DataFrame) -> DataFrame:
    """(event_id, user_id, seq, outcome) for each of a stream of requests (event_id, user_id, seq): going, already or full, as mutations.admitted() has them.

    events (event_id, capacity) and going (event_id, user_id), those who go when
    the stream begins, are tables. Requests are answered in the order in which
    they come, within a batch by seq; a repeated one is answered as before.
    Requests for unknown events get no answer. An event's requests meet in one
    task, as each depends on those before it; its state is its guests.
    """
    with_store(requests.sparkSession)
    named = lambda df, *more: df.select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("string").alias("user_id"), *more)
    known = named(requests, F.col("seq").cast("long").alias("seq")).join(events.select(F.col("event_id").cast("long").alias("event_id"), F.col("capacity").cast("double").alias("capacity")), "event_id")
    return known.groupBy("event_id").transformWithStateInPandas(Admission(), "event_id long, user_id string, seq long, outcome string", "Append", "None", named(going).groupBy("event_id"))


def calls_in_log(log: DataFrame) -> DataFrame:
    """(turn_id, index, id, name, arguments, whole) of the tool calls whose parts a log of turns holds, see paging.assembled_calls()."""
    part = F.from_json("payload", "index int, id string, name string, arguments string")
    parts = log.filter(F.col("kind") == "tool.delta").select("turn_id", F.col("id").alias("seq"), part.alias("p"))
    return assembled_calls(parts.select("turn_id", "seq", F.coalesce("p.index", F.lit(0)).alias("index"), "p.id", "p.name", "p.arguments"), "turn_id", "seq")


def fill_in_batches(stale: DataFrame, embed: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Vectors for the rows of a stream of stale ones, as far as it goes now, in a Parquet table with a folder for each batch.

    A batch that is run again after a failure overwrites its own folder, so
    each row is there once. Readers find the folder's number in column batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        embed(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stale.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
