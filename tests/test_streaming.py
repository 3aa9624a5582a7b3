import json
import random
import shutil

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plazaworks.operators import mutations
from plazaworks.sources.embed import HashEmbedder, with_vectors
from plazaworks.streaming import log


@pytest.fixture
def keyed(spark):
    """Streams of this test keep state entry by entry."""
    spark.conf.set(*log.STORE)
    yield
    spark.conf.unset(log.STORE[0])


def write(spark, rows, path):
    spark.createDataFrame(rows, log.SCHEMA.replace("timestamp", "string")).withColumn("created_at", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


def row(i, user, turn, kind, text=""):
    return (i, user, turn, kind, json.dumps({"text": text}), None)


def test_cursors():
    assert [log.cursor_of(x) for x in (None, "", " ", "0", " 17 ")] == [None, None, None, 0, 17]
    for bad in ("-1", "x", "1.5"):
        with pytest.raises(ValueError):
            log.cursor_of(bad)


def test_frames_round_trip(spark):
    df = spark.createDataFrame([(1, "reply.delta", '{"a":1}')], "id long, kind string, payload string")
    text = df.select(log.frame(F.col("id"), F.col("kind"), F.col("payload")).alias("f")).first().f
    assert list(log.parsed_frames(text)) == [{"id": "1", "event": "reply.delta", "data": '{"a":1}'}]
    assert list(log.parsed_frames(": beat\r\n\r\ndata: a\r\ndata:b\r\n\r\nid: 3\n\n")) == [{"data": "a\nb"}]


def test_replies_are_assembled_once_across_restarts(spark, tmp_path, keyed):
    path, checkpoint = (str(tmp_path / x) for x in ("log", "checkpoint"))
    got = {}

    def keep(batch, _):
        for r in batch.collect():
            got[r.turn_id] = (r.text, r.done)

    def run():
        query = log.assembled_replies(log.read_log(spark, path)).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(120)

    write(spark, [row(2, "u", "a", "reply.delta", "lo"), row(1, "u", "a", "reply.delta", "hel"), row(3, "u", "b", "reply.delta", "x"), row(4, "u", "a", "tool.started")], path)
    run()
    assert got == {"a": ("hello", False), "b": ("x", False)}
    write(spark, [row(2, "u", "a", "reply.delta", "lo"), row(5, "u", "a", "reply.delta", "!"), row(6, "u", "b", "reply.done", "whole"), row(7, "u", "b", "reply.delta", "late")], path)
    run()
    assert got == {"a": ("hello!", False), "b": ("whole", True)}
    # A delta with a smaller id that comes late goes where it belongs, until the reply is done.
    write(spark, [row(0, "u", "a", "reply.delta", "> "), row(3, "u", "b", "reply.delta", "late")], path)
    run()
    assert got == {"a": ("> hello!", False), "b": ("whole", True)}


class Handle:
    """State of one key and its timers, as a task sees them."""

    def __init__(self):
        self.states, self.timers, self.written = {}, [], 0

    def _new(self, name):
        return self.states.setdefault(name, State(self))

    getMapState = lambda self, name, *_: self._new(name)
    getValueState = lambda self, name, *_: self._new(name)
    listTimers = lambda self: iter(self.timers)
    deleteTimer = lambda self, at: self.timers.remove(at)
    registerTimer = lambda self, at: self.timers.append(at)


class State(dict):
    def __init__(self, handle):
        self.handle = handle

    def updateValue(self, key, value):
        self.handle.written += 1
        self[key] = value

    containsKey = dict.__contains__
    getValue = dict.__getitem__
    iterator = dict.items
    exists = lambda self: None in self
    get = lambda self: self[None]
    update = lambda self, value: self.updateValue(None, value)


class Clock:
    def getCurrentWatermarkInMs(self):
        return 0


def test_state_of_a_turn_is_written_by_entry_and_expires():
    handle, turns = Handle(), log.Turns(600, 86_400)
    turns.init(handle)

    def feed(*rows):
        frame = pd.DataFrame([(i, k, p, 0, "", "", "", pd.Timestamp(1, unit="s")) for i, k, p in rows], columns=["id", "kind", "part", "index_", "call", "name", "arguments", "created_at"])
        return [(r.text[0], bool(r.done[0])) for r in turns.handleInputRows(("t",), iter([frame]), Clock())]

    assert feed((2, "reply.delta", "b")) == [("b", False)] and handle.timers == [87_400]
    assert feed((1, "reply.delta", "a")) == [("ab", False)] and feed((1, "reply.delta", "a")) == [] and handle.written == 2
    assert feed((3, "reply.done", "whole"), (4, "reply.delta", "x")) == [("whole", True)] and handle.timers == [1600]
    assert handle.states["parts"] == {} and feed((5, "reply.delta", "y")) == []
    assert list(turns.handleExpiredTimer(("t",), Clock(), None)) == [] and not any(handle.states.values())


def test_turns_with_calls_in_a_stream(spark, tmp_path, keyed):
    path, checkpoint = (str(tmp_path / x) for x in ("log", "checkpoint"))
    part = lambda i, turn, **p: (i, "u", turn, "tool.delta", json.dumps(p), None)
    first = [part(1, "a", index=0, id="c1", name="find", arguments='{"q":'), part(4, "a", index=1, name="join"), row(5, "u", "a", "reply.delta", "so")]
    second = [part(3, "a", index=0, id="", arguments='"tea"}'), part(2, "a", index=1, id="c2", arguments="{}"), part(1, "a", index=0, id="c1", name="find", arguments='{"q":'), part(9, "b", index=0, arguments="x"), row(10, "u", "a", "reply.done", "so be it")]
    got = {}

    def keep(batch, _):
        got.update({r.turn_id: (r.text, r.done, [tuple(c) for c in r.calls]) for r in batch.collect()})

    for rows in (first, second):
        write(spark, rows, path)
        # A new query each time: what was kept of the turn comes from the checkpoint.
        log.assembled_turns(log.read_log(spark, path)).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(120)
    assert got == {"a": ("so be it", True, [(0, "c1", "find", '{"q":"tea"}', True), (1, "c2", "join", "{}", True)]), "b": ("", False, [(0, "", "", "x", False)])}
    batch = {tuple(r) for r in log.calls_in_log(spark.read.parquet(path).dropDuplicates(["id"])).collect()}
    assert batch == {(turn, *c) for turn, (_, _, calls) in got.items() for c in calls}


@pytest.mark.parametrize("splits", [1, 4])
def test_admission_in_a_stream_equals_the_batch(spark, tmp_path, keyed, splits):
    rng = random.Random(splits)
    asked = [(rng.randrange(5), f"u{rng.randrange(25)}", k) for k in range(140)]
    events = spark.createDataFrame([(0, 4), (1, None), (2, 1), (3, 30)], "event_id long, capacity int")
    going = spark.createDataFrame([(0, "u1"), (0, "u2"), (2, "u3"), (3, "u4")], "event_id long, user_id string")
    schema, path, checkpoint = "event_id long, user_id string, seq int", str(tmp_path / "asked"), str(tmp_path / "checkpoint")
    got = {}

    def keep(batch, _):
        for r in batch.collect():
            assert got.setdefault((r.event_id, r.user_id), r.outcome) == r.outcome

    for k in range(splits):
        part = [r for r in asked if r[2] * splits // len(asked) == k]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        stream = log.admitted_stream(spark.readStream.schema(schema).parquet(path), events, going)
        stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(120)
    wanted = mutations.admitted(spark.createDataFrame(asked, schema), events, going).collect()
    assert got == {(r.event_id, r.user_id): r.outcome for r in wanted} and set(got.values()) == {"going", "already", "full"}


def test_keyed_state_needs_its_store(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        log.assembled_replies(spark.createDataFrame([], log.SCHEMA))


def test_tool_calls_in_a_log(spark):
    part = lambda i, turn, **p: (i, "u", turn, "tool.delta", json.dumps(p), None)
    rows = [part(1, "a", index=0, id="c1", name="find", arguments='{"q":'), part(3, "a", index=0, id="", arguments='"tea"}'), part(2, "a", index=1, id="c2", arguments="{}"), part(4, "a", index=1, name="join"), part(5, "b", index=0, arguments="x"), row(6, "u", "a", "reply.delta", "t")]
    df = spark.createDataFrame(rows, log.SCHEMA.replace("timestamp", "string"))
    found = sorted(map(tuple, log.calls_in_log(df).collect()))
    assert found == [("a", 0, "c1", "find", '{"q":"tea"}', True), ("a", 1, "c2", "join", "{}", True), ("b", 0, "", "", "x", False)]


def test_readers_see_their_own_known_kinds(spark, tmp_path):
    path = str(tmp_path / "log")
    write(spark, [row(1, "u", "a", "reply.delta"), row(2, "v", "b", "reply.delta"), row(3, "u", "a", "secret"), row(4, "u", "a", "turn.done")], path)
    read = spark.read.parquet(path)
    assert [r.id for r in log.for_user(read, "u").orderBy("id").collect()] == [1, 4]
    assert [r.id for r in log.for_user(read, "u", after=1).collect()] == [4]


def test_vectors_are_filled_in_batches(spark, tmp_path):
    path, sink, checkpoint = (str(tmp_path / x) for x in ("in", "sink", "checkpoint"))
    spark.createDataFrame([(1, "Tea and walks"), (2, " "), (3, None), (4, "tea and walks")], "id long, body string").write.parquet(path)
    stream = spark.readStream.schema("id long, body string").parquet(path)
    log.fill_in_batches(stream, lambda b: with_vectors(b, HashEmbedder(8)), sink, checkpoint).awaitTermination(120)
    # The same batch again, as after a failure before it was noted as done, leaves one copy.
    shutil.rmtree(checkpoint)
    log.fill_in_batches(stream, lambda b: with_vectors(b, HashEmbedder(8)), sink, checkpoint).awaitTermination(120)
    assert spark.read.parquet(sink).count() == 4
    found = {r.id: (r.embedding, r.embedding_model) for r in spark.read.parquet(sink).collect()}
    assert found[1] == found[4] and len(found[1][0]) == 8 and found[2] == found[3] == (None, "hash-1")


def test_texts_whose_embedding_failed_are_left_for_the_next_time(spark):
    class Faulty(HashEmbedder):
        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise OSError("no service")
            return super().embed(texts)[1:] if any("short" in t for t in texts) else super().embed(texts)

    df = spark.createDataFrame([(k, t) for k, t in enumerate(["good", "bad", "good", "short", "fine", " "])], "k int, body string").coalesce(1)
    rows = {r.k: r for r in with_vectors(df, Faulty(4), batch=2).collect()}
    # Batches of two filled texts: the first and second fail whole, the third is one text, and a blank one has no vector for good.
    assert [rows[k].embedding_model for k in range(6)] == [None, None, None, None, "hash-1", "hash-1"] and [rows[k].embedding is None for k in range(6)] == [True] * 4 + [False, True]
