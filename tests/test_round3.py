"""What the third round's findings say, on small tables."""

import itertools
import random

import duckdb
from pyspark.sql import functions as F

from plazaworks.functions import similarity
from plazaworks.operators import nearby, ranking
from plazaworks.plans import catalogue
from tests.test_nearby import as_table, world

FOLDER = "/root/testdata/sf0.001"


def sql(name, **views):
    con = duckdb.connect()
    for view, source in views.items():
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM read_parquet('{source}')")
    return con.execute(catalogue.ORACLES[name]).fetchall()


def test_append_messages_where_ids_exceed_what_the_sql_adds(spark, tmp_path):
    rows = [(k, turn, role, "x") for k in (3, 9_999, 10_001, 60_000) for turn, role in enumerate(["system", "user", "assistant", "user"])]
    for name, kept in (("long", rows), ("short", rows[:8]), ("none", [r for r in rows if r[2] != "user"])):
        folder = tmp_path / name
        spark.createDataFrame(kept, "conv_id long, turn long, role string, text string").write.parquet(str(folder / "conversations.parquet"))
        found = list(map(tuple, catalogue.QUERIES["append_messages"](spark, str(folder)).collect()))
        assert found == sql("append_messages", conversations=folder / "conversations.parquet" / "*.parquet"), name
        assert found[0][0] is {"long": False, "short": True, "none": None}[name]


def test_rank_people_gives_each_one_s_place(spark):
    assert "place" in catalogue.QUERIES["rank_people"](spark, FOLDER).columns and "AS place" in catalogue.ORACLES["rank_people"]
    rng = random.Random(4)
    rows = [(k, rng.choice(["tea", "chess"]), rng.choice([None, [1.0, 0.0], [0.0, 1.0], [rng.uniform(-1, 1), 1.0]]), 51 + rng.randrange(3) / 100) for k in range(300)]
    df = spark.createDataFrame(rows, "user_id long, tag string, embedding array<double>, lat double")
    people = df.selectExpr("user_id", "'x' AS first_name", "CAST(NULL AS string) AS age_band", "CAST(NULL AS int) AS sportiness", "array(tag) AS tags", "false AS women_only", "CAST(NULL AS int) AS start_minute", "CAST(NULL AS int) AS end_minute", "embedding")
    at = df.select("user_id", "lat", F.lit(17.0).alias("lon"))
    viewer = ranking.Viewer(51.0, 17.0, likes=("tea",), embedding=(0.5, 0.5))
    wanted = [r.user_id for r in ranking.rank_people(people, at, viewer).collect()]
    for spans in (1, 7, 400):
        placed = ranking.placed_people(people, at, viewer, spans)
        assert [(r.user_id, r.place) for r in placed.orderBy("place").collect()] == [(u, k + 1) for k, u in enumerate(wanted)]
    assert ranking.placed_people(people.limit(0), at, viewer).count() == 0


def test_same_place_deals_one_coordinate_out_to_many_tasks(spark):
    known = spark.range(400).selectExpr("id AS p", "50.0D AS lat", "20.0D AS lon")
    for n in (900, 100):
        proposed = spark.range(n).selectExpr("id AS k", "50.001D AS lat", "20.0D AS lon")
        met = nearby.same_place(proposed, known, "p", most=1000)
        pairs = [(r.k, r.p, r.part) for r in met.withColumn("part", F.spark_partition_id()).collect()]
        assert len(pairs) == len({x[:2] for x in pairs}) == n * 400
        sizes = [sum(1 for _ in group) for _, group in itertools.groupby(sorted(pairs, key=lambda x: x[2]), key=lambda x: x[2])]
        assert len(sizes) > n * 400 / 1000 / 3 and max(sizes) < 20_000


def above_the_pairs(df):
    """The part of the plan above the join of pairs."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan[: plan.index("_row_part")]


def test_rank_events_for_rates_pairs_by_traits_and_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "MOST_GOERS", 1)
    events, vectors, people, going, viewers = world(spark)
    chosen = {k: viewers[k] for k in "ab"}
    found = ranking.rank_events_for(events, people, going, as_table(spark, chosen), 9000.0, F.lit(True), vectors)
    assert "RLIKE" not in above_the_pairs(found)
    rows = found.orderBy("viewer", "place").collect()
    for name, viewer in chosen.items():
        wanted = ranking.rank_events(events, people, going, viewer, 9000.0, F.lit(True), vectors=vectors).collect()
        assert [r.event_id for r in rows if r.viewer == name] == [r.event_id for r in wanted]
    signed = {r.event_id: r["count"] for r in going.filter("status = 'going'").groupBy("event_id").count().collect()}
    assert max(signed.values()) > 1 and all(r.signed_count == signed.get(r.event_id, 0) for r in rows)


def test_rank_people_near_compares_traits_as_profiles(spark):
    rng = random.Random(3)
    vectors = [None, [], [0.0, 0.0], [1.0, 2.0], [1.0, -0.5], [1.0, 2.0, 3.0], [float("nan"), 1.0]]
    profile = lambda: (rng.choice([None, "18-24", "25_34", "65+", "other", "OTHER "]), rng.choice([None, -1, 0, 2, 9]), rng.choice([None, [], ["Paddle", None], ["padel", "tea"], ["wants company", "tea"], ["I feel lonely"]]), rng.choice(vectors), rng.choice([[], ["lives alone"], ["wants company"]]))
    names = ["age", "sport", "tags", "vector", "notes"]
    kinds = ["string", "int", "array<string>", "array<double>", "array<string>"]
    schema = ", ".join(f"{n}{k} {t}" for k in (1, 2) for n, t in zip(names, kinds, strict=True))
    df = spark.createDataFrame([profile() + profile() for _ in range(600)], schema)
    c = lambda n: (F.col(f"{n}1"), F.col(f"{n}2"))
    told = similarity.company_complement(F.col("tags1"), F.col("notes1"), F.col("tags2"), F.col("notes2"))
    df = df.withColumn("wanted", similarity.profile_similarity(c("age"), c("sport"), c("tags"), c("vector"), told))
    df = df.withColumns({k: similarity.traits(*[F.col(f"{n}{i}") for n in names]) for i, k in ((1, "a"), (2, "b"))})
    rows = df.select("wanted", similarity.traits_similarity(F.col("a"), F.col("b")).alias("found")).collect()
    assert all(r.found == r.wanted for r in rows) and len({r.wanted for r in rows}) > 10
    _, _, people, _, viewers = world(spark)
    places = people.select("user_id", F.lit(51.0).alias("lat"), F.lit(17.0).alias("lon"))
    assert "RLIKE" not in above_the_pairs(ranking.rank_people_near(people, places, as_table(spark, viewers), 9000.0))
