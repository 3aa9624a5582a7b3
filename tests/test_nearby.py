"""Places near each other, and tables of viewers, against all pairs."""

import dataclasses
import math
import random

import pytest
from pyspark.sql import functions as F

from plazaworks.functions import geo
from plazaworks.operators import nearby, pairs, ranking

L = F.lit


def points(rng, n, where):
    lat, lon, wide = where
    return [(k, max(-90.0, min(90.0, lat + rng.uniform(-wide, wide))), (lon + rng.uniform(-wide, wide) + 180) % 360 - 180) for k in range(n)]


@pytest.mark.parametrize("where,radius", [((0, 0, 3), 150_000), ((52, 21, 1), 9_000), ((-41, 179.9, 2), 80_000), ((89.4, 10, 40), 60_000), ((-89.9, 0, 180), 400_000), ((10, -179.99, 0.02), 900)])
@pytest.mark.parametrize("hot", [100_000, 5])
def test_within_gives_all_pairs_once(spark, where, radius, hot):
    rng = random.Random(str(where))
    some, others = points(rng, 80, where), points(rng, 120, where)
    a = spark.createDataFrame(some + [(900, None, 1.0), (901, float("nan"), 1.0)], "k long, lat double, lon double")
    b = spark.createDataFrame(others + [(902, 1.0, float("inf"))], "p long, lat double, lon double")
    found = nearby.within(a, b, radius, "p", hot).select("k", "p").collect()

    def meters(x, y):
        (_, lat1, lon1), (_, lat2, lon2) = x, y
        h = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
        return 2 * geo.EARTH_M * math.asin(math.sqrt(min(1, h)))

    wanted = {(x[0], y[0]) for x in some for y in others if meters(x, y) <= radius}
    assert len(found) == len(set(found)) and set(map(tuple, found)) == wanted and wanted


def test_same_place_at_the_bound(spark):
    rng = random.Random(6)
    rows = [(k, rng.randrange(-20, 20) * 0.001, rng.randrange(-20, 20) * 0.001) for k in range(150)]
    df = spark.createDataFrame([*rows, (999, None, 0.0)], "k long, lat double, lon double")
    other = df.withColumnRenamed("k", "p")
    for hot in (100_000, 3):
        met = nearby.same_place(df, other, "p", hot=hot)
        found = [(r.k, r.p) for r in met.collect()]
        assert len(found) == len(set(found)) and set(found) == {(x, y) for x, a, b in rows for y, c, d in rows if abs(a - c) <= 0.002 and abs(b - d) <= 0.002}
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


VIEWERS = "viewer string, lat double, lon double, age_band string, sportiness int, mobility string, likes array<string>, dislikes array<string>, women_only boolean, start_minute int, end_minute int, embedding array<double>, notes array<string>, want array<double>"


def world(spark):
    rng = random.Random(12)
    tags = ["tea", "Padel open", "chess night", "paddle", "choir", "river walk"]
    vector = lambda: rng.choice([None, [rng.uniform(-1, 1), rng.uniform(-1, 1)]])
    events = [(k, 51 + rng.uniform(-0.1, 0.1), 17 + rng.uniform(-0.1, 0.1), [rng.choice(tags)], rng.choice(["Open day", "Chess"]), rng.random() < 0.2, rng.random() < 0.3, rng.randrange(1440)) for k in range(90)]
    df = spark.createDataFrame(events, "event_id long, lat double, lon double, tags array<string>, title string, women_only boolean, promoted boolean, m int")
    df = df.withColumn("starts_at", F.expr("timestamp_ntz'2026-02-01 00:00:00' + make_dt_interval(0, 0, m)")).drop("m")
    vectors = spark.createDataFrame([(k, v) for k in range(90) if (v := vector())], "event_id long, embedding array<double>")
    people = [(f"p{k}", f"P{k}", rng.choice([None, "18-24", "45_54"]), rng.choice([None, 0, 3]), rng.sample(tags, 2), rng.random() < 0.2, *rng.choice([(None, None), (0, 600), (1200, 300)]), vector(), rng.choice([None, ["mood", "lives alone"]])) for k in range(30)]
    people = spark.createDataFrame(people, "user_id string, first_name string, age_band string, sportiness int, tags array<string>, women_only boolean, start_minute int, end_minute int, embedding array<double>, notes array<string>")
    going = spark.createDataFrame([(rng.randrange(90), f"p{rng.randrange(33)}", rng.choice(["going", "going", "cancelled"])) for _ in range(150)], "event_id long, user_id string, status string").distinct()
    viewers = [
        ranking.Viewer(51.0, 17.0), ranking.Viewer(51.02, 17.03, likes=("tea", "wants company"), embedding=(1.0, 0.5)), ranking.Viewer(50.95, 17.0, age_band="18-24", mobility="electric wheelchair", sportiness=1),
        ranking.Viewer(51.0, 16.95, dislikes=("chess!",), window=(1320, 400), notes=("wants company",), want=(0.3, -1.0)), ranking.Viewer(51.0, 17.0, women_only=True, likes=("paddle",)), ranking.Viewer(10.0, 10.0, likes=("tea",)),
    ]
    return df, vectors, people, going, dict(zip("abcdef", viewers, strict=True))


def as_table(spark, viewers):
    rows = [(k, *(list(x) if isinstance(x, tuple) else x for x in (v.lat, v.lon, v.age_band, v.sportiness, v.mobility, v.likes, v.dislikes, v.women_only, *(v.window or (None, None)), v.embedding, v.notes, v.want))) for k, v in viewers.items()]
    return spark.createDataFrame(rows, VIEWERS)


def test_a_table_of_viewers_ranks_events_as_one_viewer_does(spark):
    events, vectors, people, going, viewers = world(spark)
    found = ranking.rank_events_for(events, people, going, as_table(spark, viewers), 9000.0, L(True), vectors)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortAggregate" not in plan and plan.count("WindowGroupLimit") >= 1
    rows = found.orderBy("viewer", "place").collect()
    for name, viewer in viewers.items():
        wanted = ranking.rank_events(events, people, going, viewer, 9000.0, L(True), vectors=vectors).collect()
        mine = [r for r in rows if r.viewer == name]
        assert [r.event_id for r in mine] == [r.event_id for r in wanted], name
        assert [r.score for r in mine] == pytest.approx([r.score for r in wanted], abs=1e-12) and [r.place for r in mine] == list(range(1, len(mine) + 1))
        assert bool(mine) == (name != "f")


def test_pages_are_whole_however_viewers_and_events_are_dealt(spark, monkeypatch):
    events, vectors, people, going, viewers = world(spark)
    key = lambda: sorted((r.viewer, r.place, r.event_id, round(r.score, 9), r.signed_count) for r in ranking.rank_events_for(events, people, going, as_table(spark, viewers), 9000.0, L(True), vectors).collect())
    monkeypatch.setattr(ranking, "WARM_LIMIT", 5)
    whole = key()
    for name, value in (("BLOCK_VIEWERS", 1), ("BLOCK_PAIRS", 20.0), ("MOST_GOERS", 1)):
        monkeypatch.setattr(ranking, name, value)
    monkeypatch.setattr(pairs, "GROUP", 1)
    # Events come two at a time, so that most pages are full when others come.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert key() == whole and len(whole) > 20
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert max(r.signed_count for r in ranking.rank_events_for(events, people, going, as_table(spark, viewers), 9000.0, L(True)).collect()) > 1


def test_viewers_are_not_repeated_for_pairs(spark):
    """A block's tasks get each viewer once, and each event once, however many pairs they make."""
    spots = spark.range(300).select(F.col("id").alias("k"), L(51.0).alias("lat"), L(17.0).alias("lon"))
    some, others, number, whole = nearby.blocks(spots, spots.withColumnRenamed("k", "p"), 9000.0, "k", "p", 1000, 1e6)
    assert (some.count(), others.count(), number, whole) == (300, 300, 1, True)
    some, others, number, whole = nearby.blocks(spots, spots.withColumnRenamed("k", "p"), 9000.0, "k", "p", 100, 1e4)
    assert (some.count(), others.count(), number, whole) == (900, 900, 9, False)


def test_a_page_is_cut_as_for_one_viewer(spark, monkeypatch):
    monkeypatch.setattr(ranking, "WARM_LIMIT", 7)
    monkeypatch.setattr(ranking, "COLD_LIMIT", 4)
    events, _, people, going, viewers = world(spark)
    found = ranking.rank_events_for(events, people, going, as_table(spark, viewers).drop("notes", "want"), 9000.0, L(True)).groupBy("viewer").count().collect()
    assert {r.viewer: r["count"] for r in found} == {"a": 4, "b": 7, "c": 7, "d": 4, "e": 7}  # d has no more within its window


def test_a_table_of_viewers_ranks_people_as_one_viewer_does(spark):
    _, _, people, _, viewers = world(spark)
    rng = random.Random(1)
    places = spark.createDataFrame([(f"p{k}", 51 + rng.uniform(-0.1, 0.1), 17 + rng.uniform(-0.1, 0.1)) for k in range(30)], "user_id string, lat double, lon double")
    rows = ranking.rank_people_near(people, places, as_table(spark, viewers), 9000.0).collect()
    for name, viewer in viewers.items():
        all_of_them = ranking.rank_people(people, places, viewer).filter(F.col("distance_m") <= 9000).collect()
        mine = [r for r in rows if r.viewer == name]
        assert [(r.user_id, r.band, r.shared) for r in mine] == [(r.user_id, r.band, r.shared) for r in all_of_them], name
        assert [r.similarity for r in mine] == pytest.approx([r.similarity for r in all_of_them]) and [r.profile_cosine is None for r in mine] == [r.profile_cosine is None for r in all_of_them]


def test_neighbours_are_whole_and_in_order_however_they_are_dealt(spark, monkeypatch):
    _, _, people, _, viewers = world(spark)
    places = spark.createDataFrame([(f"p{k}", 51 + k % 7 * 0.01, 17 - k % 5 * 0.01) for k in range(30)], "user_id string, lat double, lon double")
    found = lambda: ranking.rank_people_near(people, places, as_table(spark, viewers), 9000.0)
    once = found()
    # All rows of a viewer are made in one task, in order: none is shuffled after it met people.
    assert "MapInArrow" in (plan := once._jdf.queryExecution().executedPlan().toString()) and "Exchange" not in plan[: plan.index("MapInArrow")]
    key = lambda df: sorted(([tuple(r) for r in df.collect()]), key=lambda r: r[0])
    whole = key(once)
    monkeypatch.setattr(ranking, "NEAR_VIEWERS", 1)
    monkeypatch.setattr(ranking, "HELD_PEOPLE", 4)
    assert key(found()) == whole and len(whole) > 60


def test_attendances_may_be_a_function_of_the_events(spark):
    events, vectors, people, going, viewers = world(spark)
    viewer = dataclasses.replace(viewers["b"])
    asked = []

    def of(ids):
        asked.append(ids.columns)
        return going.join(ids, "event_id", "left_semi")

    whole = ranking.scored_events(events, people, going, viewer, 9000.0, L(True), vectors=vectors)
    part = ranking.scored_events(events, people, of, viewer, 9000.0, L(True), vectors=vectors)
    key = lambda df: sorted((r.event_id, r.signed_count, round(r.score, 12)) for r in df.collect())
    assert key(whole) == key(part) and asked == [["event_id"]]
    # One who goes but isn't known counts and says nothing of likeness.
    assert whole.filter("signed_count > 0").count() > 10
