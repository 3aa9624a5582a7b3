"""Known values of the functions, with nulls and bounds."""

import dataclasses
import math
import random

import pytest
from pyspark.sql import functions as F

from plazaworks.functions import geo, similarity, time
from plazaworks.operators import joins, mutations, paging, ranking, search

L = F.lit


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def strings(*values):
    return F.array(*map(L, values)).cast("array<string>")


def doubles(*values):
    return F.array(*map(L, values)).cast("array<double>")


def test_geo(spark):
    quarter = one(spark, geo.haversine_m(L(-90.0), L(33.0), L(0.0), L(-120.0)))
    assert math.isclose(quarter, 6_371_000 * math.pi / 2, rel_tol=1e-12) and one(spark, geo.haversine_m(L(47.5), L(19.0), L(47.5), L(19.0))) == 0
    shown = [one(spark, geo.viewport_radius_m(L(lat), L(zoom))) for lat, zoom in ((60.0, 12.0), (-33.0, 3.0), (70.0, 19.0))]
    assert shown == pytest.approx([156_543.03 * math.cos(math.radians(60)) / 4096 * 600, 30_000, 400])
    assert [one(spark, geo.distance_band(L(m))) for m in (499.9, 501.0, 2000.0, 4999.0, 5000.0)] == ["within_500m", "within_2km", "within_5km", "within_5km", "farther"]
    assert not one(spark, geo.within_radius(L(1.0), L(float("inf")), 1, 1, 5e6)) and not one(spark, F.coalesce(geo.within_radius(L(1.0), L(None).cast("double"), 1, 1, 5e6), L(False)))
    pacific = (-20, 160, 20, -150)
    assert [one(spark, geo.within_bbox(L(3.0), L(lon), *pacific)) for lon in (160.0, 180.0, -150.0, -149.9, 12.0)] == [True, True, True, False, False]


#: A choir singer of middle age who is known by everything.
ME = {"age": "45-54", "sport": 2, "tags": ("choir", "chess", "Tea "), "vector": (0.6, 0.8)}


@pytest.mark.parametrize("them,company,wanted", [
    ({"vector": (0.8, 0.6), "tags": ("tea", "jazz")}, False, (0.96 + 1 / 4) / 2),
    ({"age": "55_64", "sport": 0}, False, (0.5 + 1 / 3) / 2),
    ({}, True, 1.0),
    ({"age": "18-24", "tags": ("CHOIR", "chess", "tea")}, True, (0 + 1 + 1) / 3),
    ({"vector": (-0.6, -0.8), "sport": 2}, False, 0.0),
    ({"vector": (0.6, 0.8, 0.0), "sport": 3}, False, (0 + 2 / 3) / 2),
    ({"age": "middle", "tags": ()}, False, 0.0),
    ({"tags": ("knitting",), "sport": 7}, False, (0 + 2 / 3) / 2),
])
def test_profile_similarity(spark, them, company, wanted):
    text, number = lambda x: L(x).cast("string"), lambda x: L(x).cast("int")
    vector = lambda x: doubles(*x) if x else L(None).cast("array<double>")
    both = lambda kind, name, none: (kind(ME[name]), kind(them.get(name, none)))
    found = similarity.profile_similarity(both(text, "age", None), both(number, "sport", None), both(lambda x: strings(*x), "tags", ()), both(vector, "vector", ()), L(company))
    assert one(spark, found) == pytest.approx(wanted, abs=1e-9)


def test_parts(spark):
    assert one(spark, similarity.sport_similarity(L(1), L(2))) == pytest.approx(2 / 3) and one(spark, similarity.sport_similarity(L(-1), L(9))) == 0
    assert one(spark, similarity.age_similarity(L("custom"), L(" Custom"))) == 1.0
    assert one(spark, similarity.weighted_present((0.45, L(1.0)), (0.25, L(1.0)), (0.2, L(None).cast("double")), (0.1, L(1.0)))) == pytest.approx(1.0)
    assert one(spark, similarity.weighted_present((0.5, L(None).cast("double")))) == 0
    assert one(spark, similarity.cosine(doubles(1.0), doubles(1.0, 2.0))) == 0 and one(spark, similarity.cosine(doubles(), doubles())) == 0
    for mobility, tags, wanted in (("Wheelchair", ["Paddle court"], True), ("wheelchair", ["coffee"], False), ("cane", ["padel"], False), (None, ["padel"], False)):
        assert one(spark, similarity.mobility_conflict(L(mobility).cast("string"), strings(*tags))) is wanted


def test_company(spark):
    none = strings()
    cases = [(("lonely",), ("wants company",), True), (("wants company", "tea"), ("Wants Company", "TEA"), True), (("wants company",), ("towarzystwo",), False), (("lonely",), ("lonely",), False), ((), (), False), (("samotny",), ("towarzystwo",), True)]
    for a, b, wanted in cases:
        assert one(spark, similarity.company_complement(strings(*a), none, strings(*b), none)) is wanted


def test_warsaw_windows(spark):
    at = lambda t: one(spark, time.warsaw_minute(L(t).cast("timestamp_ntz")))
    # Clocks go forward on 30 March 2031 and back on 26 October, both at 01:00 UTC.
    assert [at(t) for t in ("2031-03-30 00:30:00", "2031-03-30 01:30:00", "2031-10-26 00:59:59", "2031-10-26 01:00:00", "2031-12-31 23:15:00")] == [90, 210, 179, 120, 15]
    inside = lambda start, end: [m for m in (0, 44, 45, 809, 810, 899, 900, 1439) if one(spark, time.window_contains(L(start), L(end), L(m)))]
    assert inside(810, 900) == [810, 899] and inside(900, 45) == [0, 44, 900, 1439] and inside(7, 7) == [0, 44, 45, 809, 810, 899, 900, 1439] and inside(0, 1441) == []
    assert one(spark, time.time_fit(L(None).cast("int"), L(90), L(5))) == 1.0 and one(spark, time.time_fit(L(810), L(900), L(855))) == 1.0 and one(spark, time.time_fit(L(1410), L(30), L(15))) == pytest.approx(0.75)


PERSON = "user_id string, first_name string, tags array<string>, women_only boolean, age_band string, sportiness int, start_minute int, end_minute int"


def crowd(spark, **people):
    """People of these tags, each in the same place."""
    rows = [(k, k.title(), tags, flag, None, None, None, None) for k, (tags, flag) in people.items()]
    return spark.createDataFrame(rows, PERSON), spark.createDataFrame([(k, 51.1, 17.0) for k in people], "user_id string, lat double, lon double")


@pytest.mark.parametrize("given,left", [
    ({}, {"cyclist", "chess", "squash", "choir", "mixed"}),  # cold: nothing is ruled out
    ({"likes": ("choir",)}, {"cyclist", "chess", "squash", "mixed"}),
    ({"women_only": True}, {"cyclist", "chess", "squash", "choir", "mixed"}),
    ({"likes": ("x",), "mobility": "uses a WHEELCHAIR"}, {"cyclist", "chess"}),
    ({"likes": ("x",), "mobility": "walking stick"}, {"cyclist", "chess", "squash", "mixed"}),
    ({"likes": ("x",), "dislikes": ("Blitz chess!", "old")}, {"cyclist", "squash", "mixed"}),
    ({"women_only": True, "dislikes": ("road bikes",)}, {"chess", "squash", "choir", "mixed"}),
])
def test_people_are_ruled_out(spark, given, left):
    people, places = crowd(spark, cyclist=(["road cycling"], False), chess=(["chess club"], False), squash=(["Squash at noon"], False), choir=(["choir"], True), mixed=(["tea", "beach volleyball"], None))
    viewer = ranking.Viewer(51.1, 17.0, **given)
    found = {r.user_id for r in ranking.rank_people(people, places, viewer).collect()}
    assert found == (left - {"cyclist"} if "road bikes" in given.get("dislikes", ()) else left)


def test_passed_constraints_are_named_in_order(spark):
    viewer = ranking.Viewer(51.1, 17.0, window=(0, 60), women_only=True, dislikes=("noise",), mobility="cane")
    assert one(spark, F.array_join(ranking.constraints_passed(viewer), ",")) == "mobility,dislikes,women_only,time_window"
    assert one(spark, F.array_join(ranking.constraints_passed(ranking.Viewer(0, 0)), ",")) == "" and ranking.Viewer(0, 0).cold and not viewer.cold


def test_several_viewers_at_once(spark):
    people, places = crowd(spark, near=(["tea"], False), other=(["chess"], False))
    found = ranking.rank_people_for(people, places, {"b": ranking.Viewer(51.1, 17.0), "a": ranking.Viewer(51.1, 17.0, likes=("chess",), dislikes=("tea",))}).collect()
    assert [(r.viewer, r.user_id) for r in found] == [("a", "other"), ("b", "near"), ("b", "other")]


EVENT = "event_id long, lat double, lon double, tags array<string>, title string, women_only boolean, promoted boolean, embedding array<float>"


def meetings(spark, *rows):
    events = spark.createDataFrame([(k, lat, lon, ["tea"], "t", False, promoted, vector) for k, lat, lon, promoted, vector in rows], EVENT)
    return events.withColumn("starts_at", L("2026-01-10 12:00:00").cast("timestamp_ntz"))


def test_a_box_takes_the_place_of_the_radius(spark):
    events = meetings(spark, (1, 51.1, 17.0, False, None), (2, 51.1, 179.9, False, None), (3, 51.1, -179.9, False, None), (4, 53.0, 17.0, False, None))
    people, _ = crowd(spark, near=(["tea"], False))
    going = spark.createDataFrame([(1, "near", "going"), (1, "unknown", "going"), (4, "near", "cancelled")], "event_id long, user_id string, status string")
    for viewer in (ranking.Viewer(51.1, 17.0), ranking.Viewer(51.1, 17.0, likes=("tea",))):
        at = lambda *how: sorted(r.event_id for r in ranking.rank_events(events, people, going, viewer, 1000.0, L(True), *how).collect())  # noqa: B023, E731
        assert at() == [1] and at(geo.Box(50, 170, 52, -170)) == [2, 3] and at(geo.Box(50, 16, 54, 18)) == [1, 4] and at(geo.Box(0, 0, 1, 1)) == []
    counted = {r.event_id: (r.people, r.signed_count) for r in ranking.scored_events(events, people, going, viewer, 1000.0, L(True), geo.Box(50, 16, 54, 18)).collect()}
    # Who isn't known counts as one who goes, and says nothing about likeness.
    assert counted == {1: (1.0, 2), 4: (None, 0)}


def test_scores_of_what_is_known(spark):
    """Distance 0 and no window: both parts are 1. What is missing isn't 0."""
    people, _ = crowd(spark, near=(["tea"], False), far=(["golf"], False))
    events = meetings(spark, (1, 51.1, 17.0, False, None), (2, 51.1, 17.0, True, None), (3, 51.1, 17.0, False, [0.0, 1.0]), (4, 51.1, 17.0, False, None))
    going = spark.createDataFrame([(4, "near", "going"), (4, "far", "going")], "event_id long, user_id string, status string")
    viewer = ranking.Viewer(51.1, 17.0, likes=("tea",), want=(1.0, 0.0))
    found = {r.event_id: r.score for r in ranking.scored_events(events, people, going, viewer, 1000.0, L(True)).collect()}
    assert found == {1: pytest.approx(1.0), 2: pytest.approx(1.05), 3: pytest.approx(0.35 / 0.55), 4: pytest.approx((0.45 * 0.5 + 0.35) / 0.8)}
    full = meetings(spark, (1, 51.1, 17.0, False, None), (2, 51.1, 17.0, True, None)).withColumn("capacity", F.when(F.col("event_id") == 2, 0)).withColumn("signed_count", L(0))
    assert [r.event_id for r in ranking.first_open(full, [F.col("event_id").desc()]).collect()] == [1]
    assert ranking.first_open(full.filter("event_id = 2"), [F.col("event_id")]).count() == 0


def test_boxes_around_circles_hold_them(spark):
    rng = random.Random(3)
    for lat, lon, radius in ((0.0, 0.0, 5e5), (60.0, 20.0, 3e5), (-70.0, -100.0, 8e5), (88.9, 10.0, 2e5), (10.0, 179.9, 1e5)):
        points = [(lat + rng.uniform(-9, 9), lon + rng.uniform(-40, 40)) for _ in range(300)]
        df = spark.createDataFrame(points, "lat double, lon double").filter("abs(lat) <= 90")
        inside = geo.haversine_m(F.col("lat"), F.col("lon"), L(lat), L(lon)) <= radius
        assert df.filter(inside).count() == df.filter(geo.within_radius(F.col("lat"), F.col("lon"), lat, lon, radius)).count() > 0


def library(spark):
    docs = spark.createDataFrame([(1, "u1", "Warm beds", "text one"), (2, "u2", "Tea house", "text two"), (3, "u3", "Old", "about tea house walks"), (4, "u1", "Warm bed", "x")], "doc long, url string, title string, digest string")
    chunks = spark.createDataFrame([(1, 10, [1.0, 0.0]), (1, 11, [0.8, 0.6]), (2, 20, [0.2, 0.98]), (4, 40, [0.0, 0.0])], "doc long, chunk long, embedding array<float>")
    return docs, chunks


def test_hybrid_search(spark):
    docs, chunks = library(spark)
    rows = [(r.doc, r.score, r.chunk) for r in search.hybrid(docs, chunks, "Tea house", [0.8, 0.6]).collect()]
    # By title; by its best chunk; without vectors by its digest.
    assert rows == [(2, 1.0, None), (1, pytest.approx(1.0), 11), (3, pytest.approx(5 / 11), None)] or rows == [(1, pytest.approx(1.0), 11), (2, 1.0, None), (3, pytest.approx(5 / 11), None)]
    assert [r.doc for r in search.hybrid(docs, chunks.limit(0), "tea house walks about", None).collect()] == [3, 2]
    assert search.hybrid(docs, chunks, "zzz", [0.5, -0.87]).count() == 0
    assert search.hybrid(docs, chunks, "  ", [0.8, 0.6]).count() == 0 and search.hybrid(docs.withColumn("digest", L(None).cast("string")), chunks, "Tea house", [0.8, 0.6]).count() == 0
    kinds = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "a")], "doc long, slug string")
    of = lambda category: [r.doc for r in search.hybrid(docs, chunks, "Tea house", [0.8, 0.6], categories=kinds, category=category).collect()]
    assert of("b") == [2] and of("a") == [1, 3] and of("none") == [] and of(None) == [2, 1, 3]


def test_zero_and_missing_vectors_are_no_best(spark):
    scored = spark.createDataFrame([(1, 1, float("nan")), (1, 2, 0.5), (1, 3, 0.5), (2, 4, None)], "g int, t int, s double")
    assert [tuple(r) for r in joins.best_per_group(scored, "g", F.col("s"), "t").collect()] == [(1, 0.5, 2)]


def test_turns_and_pages(spark):
    # A greeting, three questions, two of them answered twice, and a last word.
    said = "Ahoj b, q1 u, a1 b, a1' b, q2 u, q3 u, a3 b, bye b".split(", ")
    rows = [(10 * k, 5, {"u": "user", "b": "assistant"}[x.split()[1]], x.split()[0], k // 2) for k, x in enumerate(said)]
    df = spark.createDataFrame(rows, "id long, user_id long, role string, body string, created long")
    of = lambda found: [r.body for r in found.collect()]
    assert of(paging.recent_turns(df, 2).orderBy("id")) == ["q2", "q3", "a3", "bye"] and of(paging.recent_turns(df, 9).orderBy("id")) == of(paging.history(df))
    assert of(paging.page_before(df, 5, None, 3)) == ["q3", "a3", "bye"] and of(paging.page_before(df, 5, 50, 2)) == ["a1'", "q2"] and of(paging.page_before(df, 5, 0)) == [] == of(paging.page_before(df, 5, None, 0))
    assert [tuple(r) for r in paging.older_than_recent(df, 2).collect()] == [(5, 4, 30)]
    # What is before the first of no more turns than stay isn't old, and only a multiple of turns is due.
    assert paging.older_than_recent(df, 3).count() == 0 and paging.older_than_recent(df, 2, 2).count() == 0 and paging.older_than_recent(df, 2, 3).count() == 1


def test_pages_go_by_the_users_own_message_in_its_own_types(spark):
    said = [("u", "c9", "12:00:00.9"), ("u", "b7", "12:00:00.1"), ("u", "d1", "12:00:00.5"), ("u", "a0", "12:00:00.5"), ("u", "z", "12:00:01"), ("v", "b7x", "11:00:00"), ("v", "q", "12:00:00.4")]
    df = spark.createDataFrame(said, "user_id string, id string, at string").withColumn("created", F.concat(L("2031-05-01 "), "at").cast("timestamp"))
    page = lambda *how: [r.id for r in paging.page_before(df, *how).collect()]
    assert page("u", "c9", 9) == ["b7", "a0", "d1"] and page("u", "d1", 1) == ["a0"] and page("u", "b7") == [] and page("u", None, 2) == ["c9", "z"]
    # Another user's message is no cursor, nor is one that isn't there.
    assert page("u", "q") == [] == page("u", "none") and page("v", "q") == ["b7x"]
    cursors = spark.createDataFrame([("u", "c9"), ("u", "c9"), ("v", None), ("u", "q"), ("w", None)], "user_id string, before string")
    found = [(r.user_id, r.before, r.id) for r in paging.pages_before(df, cursors, 2).collect()]
    assert found == [("u", "c9", "a0"), ("u", "c9", "d1"), ("v", None, "b7x"), ("v", None, "q")] and paging.pages_before(df, cursors, 0).count() == 0


def test_admission(spark):
    events = spark.createDataFrame([(1, 2), (2, None), (3, 1)], "event_id long, capacity int")
    going = spark.createDataFrame([(1, 7), (3, 5)], "event_id long, user_id long")
    asked = spark.createDataFrame([(1, 8, 1), (1, 9, 2), (1, 7, 3), (1, 8, 4), (2, 1, 1), (3, 6, 1), (9, 1, 1)], "event_id long, user_id long, seq int")
    found = {(r.event_id, r.user_id): r.outcome for r in mutations.admitted(asked, events, going).collect()}
    assert found == {(1, 8): "going", (1, 9): "full", (1, 7): "already", (2, 1): "going", (3, 6): "full"}


def test_admission_of_very_many(spark):
    rng = random.Random(4)
    asked = [(e, u, rng.randrange(50)) for e in (1, 2, 3) for u in rng.sample(range(1000), 400)]
    events, going = {1: 30, 2: 400, 3: 2}, [(1, u) for u in range(20)] + [(3, 1), (3, 2), (3, 3)]
    found = {(r.event_id, r.user_id): r.outcome for r in mutations.admitted(spark.createDataFrame(asked, "event_id long, user_id long, seq int"), spark.createDataFrame(list(events.items()), "event_id long, capacity int"), spark.createDataFrame(going, "event_id long, user_id long")).collect()}
    wanted = {}
    for e, room in events.items():
        free = room - sum(x == e for x, _ in going)
        for _, u in sorted((s, u) for x, u, s in asked if x == e):
            wanted[e, u] = "already" if (e, u) in going else "going" if free > 0 else "full"
            free -= wanted[e, u] == "going"
    assert found == wanted


def test_latest_rows_by_one_number_or_a_struct(spark):
    rows = [("a", 1, None, 10, "x"), ("a", None, 9, 11, "y"), ("a", 1, -(2**63), 12, "z"), ("b", -5, 3, 13, "p"), ("b", -5, 4, 14, "q"), ("c", None, None, 15, "r")]
    df = spark.createDataFrame(rows, "k string, i int, j long, v int, t string")
    for part in (df.drop("t"), df, df.drop("t").withColumn("i", F.col("i").cast("long")), df.drop("t").withColumn("j", F.col("j").cast("int"))):
        if dict(part.dtypes)["j"] == "int":
            part = df.drop("t").withColumn("j", F.when(F.col("j") > 0, F.col("j")).cast("int"))
        found = mutations.latest_wins(part, ["k"], ["i", "j"])
        last = {r.k: r.v for r in found.collect()}
        assert last == {"a": 12, "b": 14, "c": 15} or dict(part.dtypes)["j"] == "int" and last == {"a": 10, "b": 14, "c": 15}  # a tie
    plan = mutations.latest_wins(df.drop("t"), ["k"], ["i", "j"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("HashAggregate") == 2


def test_known_words_are_found_as_tokens_are(spark):
    from plazaworks.functions import text

    rows = [(["Paddle court", "tea"],), (["golfclub", "xgolf"],), (["Golf-club"],), (["ęgolf golfę"],), ([],), (["a b"],), (["PADEL"],)]
    df = spark.createDataFrame(rows, "texts array<string>")
    for known in ("golf", "paddle", "padel tea", "a", "!"):
        by_tokens = similarity.dislikes_any(strings(known), F.col("texts"))
        by_words = text.has_word(F.col("texts"), text.words_of(known))
        assert [r.x for r in df.select(by_tokens.alias("x")).collect()] == [r.x for r in df.select(by_words.alias("x")).collect()], known


def test_vectors_and_notes_of_the_ranking(spark):
    rows = [("1", [1.0, 0.0], None), ("2", [0.6, 0.8], ["mood", "Lonely"]), ("3", None, None), ("4", [0.0, 0.0], [])]
    known = [("18-24", 1, ["walks"])] * 2 + [("25-34", 1, ["coffee"])] * 2
    schema = "user_id string, embedding array<float>, notes array<string>, age_band string, sportiness int, tags array<string>, women_only boolean, start_minute int, end_minute int"
    people = spark.createDataFrame([(*r, *k, False, None, None) for r, k in zip(rows, known)], schema)
    places = spark.createDataFrame([(r[0], 50.0, 20.0) for r in rows], "user_id string, lat double, lon double")
    viewer = ranking.Viewer(50.0, 20.0, age_band="25-34", sportiness=1, likes=("coffee",), embedding=(0.0, 1.0), notes=("asks", "wants company"), want=(1.0, 0.0))
    ranked = ranking.rank_people(people, places, viewer).collect()
    # By similarity alone, the third would be the first.
    assert [r.user_id for r in ranked] == ["2", "4", "1", "3"]
    assert [None if r.profile_cosine is None else round(r.profile_cosine, 6) for r in ranked] == [0.8, 0.0, 0.0, None]
    wanted = {"1": (0.5 + 1 + 0 + 0) / 4, "2": (0.5 + 1 + 0 + 0.8 + 1) / 5, "3": 1.0, "4": (1 + 1 + 1 + 0) / 4}
    assert {r.user_id: r.similarity for r in ranked} == {k: pytest.approx(x) for k, x in wanted.items()}

    events = spark.createDataFrame([(k, 50.0, 20.0, ["tea"], "t", False, False, v) for k, v in ((1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None))], "event_id long, lat double, lon double, tags array<string>, title string, women_only boolean, promoted boolean, embedding array<float>")
    events = events.withColumn("starts_at", L("2026-01-10 12:00:00").cast("timestamp_ntz"))
    going = spark.createDataFrame([(1, "1", "going"), (1, "2", "going")], "event_id long, user_id string, status string")
    scored = {r.event_id: r.score for r in ranking.scored_events(events, people, going, viewer, 1000.0, L(True)).collect()}
    mean = (wanted["1"] + wanted["2"]) / 2
    assert ranking.scored_events(events, people, going.limit(0), dataclasses.replace(viewer, want=()), 1000.0, L(True)).filter("event_id = 2").first().score == pytest.approx(1.0)
    assert scored == {1: pytest.approx(0.45 * mean + 0.25 + 0.20 + 0.10), 2: pytest.approx(0.35 / 0.55), 3: pytest.approx(1.0)}


def test_the_bound_of_same_coordinates_is_inclusive(spark):
    from plazaworks.plans import catalogue

    at = lambda lat, lon: one(spark, geo.same_coordinates(L(0.0), L(0.0), L(lat), L(lon)))
    assert at(0.002, -0.002) and not at(math.nextafter(0.002, 1), 0.0) and not at(0.0, -math.nextafter(0.002, 1))
    folder = "/root/testdata/sf0.001"
    assert catalogue.QUERIES["coord_match"](spark, folder).count() == spark.read.parquet(f"{folder}/customer.parquet").count()


def test_cards_are_merged_by_category_before_they_are_collected(spark):
    from plazaworks.operators import library

    rows = [("a", 3, "x", "long"), ("a", 1, "y", "four"), ("a", 2, "x", None), ("a", 4, None, "s"), ("b", 5, "x", None), ("b", None, "z", "t")]
    found = library.merged_cards(spark.createDataFrame(rows, "slug string, seq int, category string, summary string"))
    assert sorted(map(tuple, found.collect())) == [("a", "four", "y,x"), ("b", "t", "z,x")]
    # What is collected is one entry for each category, which a first aggregate has made.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
