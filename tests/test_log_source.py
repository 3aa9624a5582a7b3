"""The log by ids: cursors, ids that commit late, gaps that are given up, restarts."""

import json
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plazaworks.streaming import source
from plazaworks.streaming.log import SCHEMA

BLOCK = 10


def put(spark, path, *ids):
    rows = [(i, "u", f"t{i}", "reply.delta", json.dumps({"text": str(i)}), "2024-01-01") for i in ids]
    df = spark.createDataFrame(rows, SCHEMA.replace("timestamp", "string")).withColumn("created_at", F.to_timestamp("created_at"))
    source.append_log(df, path, BLOCK)


class Reading:
    """A query over a log that is run again and again from its checkpoint."""

    def __init__(self, spark, path, folder, after=None, wait_ms=3_600_000):
        self.spark, self.path, self.folder, self.after, self.wait_ms, self.batches = spark, path, folder, after, wait_ms, []

    def run(self):
        got = []
        read = source.read_log_by_id(self.spark, self.path, f"file://{self.folder}/position", self.after, self.wait_ms, BLOCK)
        query = read.writeStream.foreachBatch(lambda df, n: got.extend((r.id, r.payload, str(r.created_at)) for r in df.collect())).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert all(json.loads(p)["text"] == str(i) and t == "2024-01-01 00:00:00" for i, p, t in got)
        return sorted(i for i, *_ in got)


def test_ranges():
    assert source.without([(1, 10), (20, 25)], [(3, 4), (8, 22)]) == [(1, 2), (5, 7), (23, 25)]
    assert source.without([(5, 6)], [(1, 9)]) == [] and source.without([(5, 6)], []) == [(5, 6)] and source.without([], [(1, 2)]) == []
    assert source.missing(pa.array([5, 3, 3], "int64"), 2, 7) == [(2, 2), (4, 4), (6, 7)]
    assert source.missing(pa.array([], "int64"), 2, 7) == [(2, 7)] and source.missing(pa.array([2, 3], "int64"), 2, 3) == []


@pytest.mark.parametrize("seed", range(20))
def test_ranges_as_sets(seed):
    rng = random.Random(seed)

    def some():
        ids = sorted(rng.sample(range(40), rng.randrange(30)))
        return [(i, i) for i in ids], set(ids)

    (ranges, a), (holes, b) = some(), some()
    assert {i for low, high in source.without(ranges, holes) for i in range(low, high + 1)} == a - b
    whole = source.missing(pa.array(sorted(a), "int64"), 0, 39)
    assert {i for low, high in whole for i in range(low, high + 1)} == set(range(40)) - a
    assert {i for low, high in source.without([(0, 39)], whole) for i in range(low, high + 1)} == a


def test_an_id_that_commits_late_comes_once(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    put(spark, path, *range(1, 6), 8, 9, 25)
    reading = Reading(spark, path, tmp_path / "a", after=2)
    assert reading.run() == [3, 4, 5, 8, 9, 25]
    assert reading.run() == []
    put(spark, path, 7, 26)
    assert reading.run() == [7, 26]
    put(spark, path, 6, *range(10, 25), 40)
    assert reading.run() == [6, *range(10, 25), 40]
    put(spark, path, *range(27, 40))
    assert reading.run() == list(range(27, 40))
    assert reading.run() == []


def test_gaps_are_given_up_after_the_time_to_wait(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    put(spark, path, 1, 2, 5)
    reading = Reading(spark, path, tmp_path / "a", after=0, wait_ms=300)
    assert reading.run() == [1, 2, 5]
    time.sleep(0.5)
    put(spark, path, 6)
    assert reading.run() == [6]
    put(spark, path, 3, 4, 7)
    assert reading.run() == [7]


def test_a_reader_without_a_cursor_begins_with_what_is_new(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    put(spark, path, 1, 2, 3)
    reading = Reading(spark, path, tmp_path / "a")
    assert reading.run() == []
    put(spark, path, 4, 6)
    assert reading.run() == [4, 6]
    put(spark, path, 5)
    assert reading.run() == [5]
    assert Reading(spark, path, tmp_path / "b", after=4).run() == [5, 6]
    assert Reading(spark, f"file://{tmp_path}/none", tmp_path / "c", after=4).run() == []


def test_a_batch_read_again_gives_the_same_rows(tmp_path, spark):
    path = f"file://{tmp_path}/log"
    put(spark, path, 1, 2, 5, 12)
    options = {"path": path, "position": f"file://{tmp_path}/p", "after": "0", "block": str(BLOCK)}
    reader = source.LogReader(options)
    start, end = reader.initialOffset(), reader.latestOffset()
    ids = lambda: sorted(i for p in reader.partitions(start, end) for b in reader.read(p) for i in b["id"].to_pylist())
    first = ids()
    put(spark, path, 3, 13)
    assert first == [1, 2, 5, 12] == ids() and reader.partitions(end, end) == []
    reader.partitions(start, end), reader.commit(end)
    again = source.LogReader(options)
    assert again.initialOffset() == end and again.latestOffset()["through"] == 13
    put(spark, path, 4, *range(6, 12), *range(14, 20))
    assert json.loads(again.latestOffset()["gaps"]) == [] and again.latestOffset()["through"] == 19
