"""Queries over events, places, people and attendances."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from plazaworks.functions import geo, similarity, time
from plazaworks.operators import filters, joins, mutations, nearby, ranking, validation
from plazaworks.plans import adapt
from plazaworks.plans.adapt import AS_OF, CENTER, canon, contains, ctes, distance, tag_set, tokens, warsaw
from plazaworks.plans.registry import query, table
from plazaworks.plans.scalars import profile_sql

C = F.col
RADIUS = 30_000.0
VIEWER = ranking.Viewer(*CENTER, age_band="25-34", sportiness=1, mobility=None, likes=("walks", "coffee", "wants company"), dislikes=("golf club",), women_only=False, window=(480, 1320))
COLD = ranking.Viewer(*CENTER)


def _live(spark, d):
    return adapt.events(spark, d).join(adapt.places(spark, d), "place_id").filter(filters.live(AS_OF))


@query("live_events", f"{ctes('evs', 'places', 'live')} SELECT event_id, kind FROM live")
def live_events(spark, d):
    return _live(spark, d).select("event_id", "kind")


@query("radius_filter", f"{ctes('places')} SELECT place_id FROM places WHERE {distance()} <= 30000")
def radius_filter(spark, d):
    return adapt.places(spark, d).filter(geo.within_radius(C("lat"), C("lon"), *CENTER, RADIUS)).select("place_id")


@query("bbox_filter", f"{ctes('places')} SELECT place_id FROM places WHERE lat BETWEEN 49.5 AND 50 AND lon BETWEEN 19.5 AND 20.5")
def bbox_filter(spark, d):
    return adapt.places(spark, d).filter(geo.within_bbox(C("lat"), C("lon"), 49.5, 19.5, 50.0, 20.5)).select("place_id")


@query("bbox_wrap", f"{ctes('places')} SELECT place_id FROM places WHERE lat BETWEEN 49.5 AND 50 AND (lon >= 21 OR lon <= 19.2)")
def bbox_wrap(spark, d):
    return adapt.places(spark, d).filter(geo.within_bbox(C("lat"), C("lon"), 49.5, 21.0, 50.0, 19.2)).select("place_id")


@query("pref_drops", f"{ctes('evs')} SELECT event_id FROM evs WHERE NOT women_only AND {contains('480', '1320', warsaw('starts_at'))}")
def pref_drops(spark, d):
    read = adapt.events(spark, d)
    return read.filter(~C("women_only") & time.window_contains(F.lit(480), F.lit(1320), time.warsaw_minute(C("starts_at")))).select("event_id")


_WORDS_OF = lambda tags: f"flatten(list_transform({tags}, lambda t: {tokens('t')}))"


@query("mobility_drop", f"{ctes('evs')} SELECT event_id, len(list_intersect({_WORDS_OF('tags')}, [{', '.join(repr(x) for x in similarity.BLOCKED)}])) > 0 AS dropped FROM evs")
def mobility_drop(spark, d):
    return adapt.events(spark, d).select("event_id", similarity.mobility_conflict(F.lit("Wheelchair user"), C("tags")).alias("dropped"))


@query("dislike_drop", f"{ctes('evs')} SELECT event_id, len(list_intersect({_WORDS_OF('list_append(tags, title)')}, ['golf', 'club', 'urgent'])) > 0 AS dropped FROM evs")
def dislike_drop(spark, d):
    read = adapt.events(spark, d)
    dislikes = F.array(F.lit("Golf club"), F.lit("urgent!"))
    return read.select("event_id", similarity.dislikes_any(dislikes, F.concat(C("tags"), F.array("title"))).alias("dropped"))


@query("event_base", f"{ctes('evs', 'places', 'attendances', 'signed')} SELECT event_id, place_name, kind, coalesce(n, 0) AS signed_count FROM evs JOIN places USING (place_id) LEFT JOIN signed USING (event_id)")
def event_base(spark, d):
    return joins.event_base(adapt.events(spark, d), adapt.places(spark, d), adapt.attendances(spark, d)).select("event_id", "place_name", "kind", "signed_count")


@query("signed_count", f"{ctes('attendances')} SELECT event_id, count(*) AS signed_count FROM attendances WHERE status = 'going' GROUP BY 1")
def signed_count(spark, d):
    return joins.signed_counts(adapt.attendances(spark, d))


@query("email_lookup", "SELECT c_custkey FROM customer WHERE lower(replace(c_name, '#', '.')) || '@mail.example' = 'customer.000000007@mail.example'")
def email_lookup(spark, d):
    """By an address as someone might type it."""
    users = table(spark, d, "customer").select("c_custkey", F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@mail.example")).alias("email"))
    return filters.by_email(users, "  Customer.000000007@Mail.Example ").select("c_custkey")


@query("point_lookup", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, d):
    return filters.by_key(table(spark, d, "orders"), "o_orderkey", 7).select("o_orderkey", "o_custkey", "o_orderpriority")


@query("my_events", f"{ctes('evs', 'attendances')} SELECT a.user_id, event_id, a.status, title FROM evs JOIN attendances a USING (event_id) WHERE a.user_id = 3")
def my_events(spark, d):
    return adapt.attendances(spark, d).filter("user_id = 3").join(adapt.events(spark, d).select("event_id", "title"), "event_id").select("user_id", "event_id", "status", "title")


@query("attendee_rows", f"{ctes('attendances', 'people')} SELECT event_id, user_id, age_band, sportiness FROM attendances LEFT JOIN people USING (user_id) WHERE status = 'going'")
def attendee_rows(spark, d):
    return adapt.attendances(spark, d).filter("status = 'going'").join(adapt.people(spark, d), "user_id", "left").select("event_id", "user_id", "age_band", "sportiness")


@query("mean_attendee_sim_bare", f"{ctes('attendances', 'people')} SELECT event_id, round(avg({profile_sql('''CAST('25-34' AS VARCHAR)''', 'age_band', '1', 'sportiness', '''['walks','coffee','wants company']''', 'tags')}), 6) AS people FROM attendances JOIN people USING (user_id) WHERE status = 'going' GROUP BY 1")
def mean_attendee_sim_bare(spark, d):
    found = ranking.attendee_likeness(adapt.people(spark, d), adapt.attendances(spark, d), VIEWER)
    return found.select("event_id", F.round("people", 6).alias("people"))


_PEOPLE = f"SELECT event_id, avg({profile_sql('''CAST('25-34' AS VARCHAR)''', 'age_band', '1', 'sportiness', '''['walks','coffee','wants company']''', 'tags')}) AS people FROM attendances JOIN people USING (user_id) WHERE status = 'going' GROUP BY 1"
_FIT = f"CASE WHEN NOT {contains('480', '1320', 'minute')} THEN 0 ELSE 1 - abs(minute - 480 - 420e0) / 840 END"
_DROPPED = f"women_only OR len(list_intersect({_WORDS_OF('list_append(tags, title)')}, ['golf', 'club'])) > 0"
_WARM = f"""{ctes('evs', 'places', 'live', 'attendances', 'people', 'signed')},
near AS (SELECT *, {distance()} AS distance_m, {warsaw('starts_at')} AS minute FROM live WHERE {distance()} <= 30000),
likes AS ({_PEOPLE}),
warm AS (SELECT near.*, (coalesce(0.45 * people, 0) + 0.25 * exp(-distance_m / 2500) + 0.10 * ({_FIT})) / (CASE WHEN people IS NULL THEN 0.35 ELSE 0.8 END) + CASE WHEN promoted THEN 0.05 ELSE 0 END AS score
         FROM near LEFT JOIN likes USING (event_id) WHERE NOT ({_DROPPED}) AND {contains('480', '1320', 'minute')}),
top AS (SELECT * FROM warm ORDER BY score DESC, distance_m, starts_at, event_id LIMIT 50)"""


def _attended(spark, d):
    return lambda ids: adapt.attendances(spark, d, ids)


def _warm(spark, d):
    placed = adapt.events(spark, d).join(adapt.places(spark, d), "place_id")
    return ranking.rank_events(placed, adapt.people(spark, d), _attended(spark, d), VIEWER, RADIUS, filters.live(AS_OF))


@query("rank_events_bare", f"{_WARM} SELECT event_id, round(score, 6) AS score, round(distance_m, 3) AS distance_m FROM top")
def rank_events_bare(spark, d):
    return _warm(spark, d).select("event_id", F.round("score", 6).alias("score"), F.round("distance_m", 3).alias("distance_m"))


@query("event_score_bare", f"{_WARM} SELECT event_id, round(score, 6) AS score FROM warm")
def event_score_bare(spark, d):
    """The score of every event that isn't ruled out, without the limit of a page."""
    placed = adapt.events(spark, d).join(adapt.places(spark, d), "place_id")
    return ranking.scored_events(placed, adapt.people(spark, d), _attended(spark, d), VIEWER, RADIUS, filters.live(AS_OF)).select("event_id", F.round("score", 6).alias("score"))


@query("rank_events_cold", f"{ctes('evs', 'places', 'live')} SELECT event_id, 0e0 AS score, round({distance()}, 3) AS distance_m FROM live WHERE {distance()} <= 30000 ORDER BY starts_at, {distance()}, event_id LIMIT 40")
def rank_events_cold(spark, d):
    placed = adapt.events(spark, d).join(adapt.places(spark, d), "place_id")
    found = ranking.rank_events(placed, adapt.people(spark, d), adapt.attendances(spark, d), COLD, RADIUS, filters.live(AS_OF))
    return found.select("event_id", F.round("score", 6).alias("score"), F.round("distance_m", 3).alias("distance_m"))


@query("first_open_offer_bare", f"{_WARM} SELECT event_id, coalesce(n, 0) AS signed_count FROM top LEFT JOIN signed USING (event_id) WHERE capacity IS NULL OR coalesce(n, 0) < capacity ORDER BY score DESC, distance_m, starts_at, event_id LIMIT 1")
def first_open_offer_bare(spark, d):
    order = [F.desc("score"), C("distance_m"), C("starts_at"), C("event_id")]
    return ranking.first_open(_warm(spark, d), order).select("event_id", "signed_count")


@query("visible_events", f"{ctes('evs', 'attendances', 'signed')} SELECT event_id FROM evs LEFT JOIN signed USING (event_id) WHERE capacity IS NOT NULL AND coalesce(n, 0) < capacity")
def visible_events(spark, d):
    read = adapt.events(spark, d).join(joins.signed_counts(adapt.attendances(spark, d)), "event_id", "left").withColumn("signed_count", F.coalesce("signed_count", F.lit(0)))
    return read.filter(C("capacity").isNotNull() & filters.not_full()).select("event_id")


@query("visible_in_session", f"{ctes('evs', 'attendances', 'signed')} SELECT event_id FROM evs LEFT JOIN signed USING (event_id) WHERE capacity IS NOT NULL AND coalesce(n, 0) < capacity AND event_id IN (SELECT event_id FROM attendances WHERE user_id = 3)")
def visible_in_session(spark, d):
    counted = adapt.events(spark, d).join(joins.signed_counts(adapt.attendances(spark, d)), "event_id", "left").withColumn("signed_count", F.coalesce("signed_count", F.lit(0)))
    return joins.visible_in_session(counted, adapt.attendances(spark, d).filter("user_id = 3")).select("event_id")


@query("hosted_by_me", f"{ctes('evs')} SELECT event_id, host_id = 7 AS hosted_by_me FROM evs")
def hosted_by_me(spark, d):
    return adapt.events(spark, d).select("event_id", (C("host_id") == 7).alias("hosted_by_me"))


_LOCATIONS = """hosting AS (SELECT host_id AS user_id, 0 AS going, event_id, starts_at, place_id FROM evs UNION ALL SELECT a.user_id, 1, event_id, starts_at, place_id FROM attendances a JOIN evs USING (event_id) WHERE a.status = 'going'),
located AS (SELECT * FROM hosting WHERE user_id IN (SELECT user_id FROM people) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY going DESC, starts_at, event_id) = 1)"""


@query("person_location", f"{ctes('evs', 'attendances', 'people')}, {_LOCATIONS} SELECT user_id, event_id, place_id, going FROM located")
def person_location(spark, d):
    return joins.person_locations(adapt.people(spark, d), adapt.events(spark, d), adapt.attendances(spark, d))


_LIKE = profile_sql("CAST('25-34' AS VARCHAR)", "age_band", "1", "sportiness", "['walks','coffee','wants company']", "tags")
_MEETS = f"start_minute IS NULL OR (SELECT bool_or({contains('480', '1320', 'x')} AND {contains('start_minute', 'end_minute', 'x')}) FROM range(1440) r(x))"
_MINE = tag_set("['walks','coffee','wants company']")
_RANKED = f"""{ctes('evs', 'attendances', 'people', 'places')}, {_LOCATIONS}, ranked AS (SELECT user_id, first_name, {_LIKE} AS similarity, {distance()} AS m, array_to_string(list_transform(list_sort(list_filter(list_transform(tags, lambda t: {{'c': {canon('t')}, 'raw': t}}), lambda p: list_contains({_MINE}, p.c))), lambda p: p.raw), ',') AS shared
FROM people JOIN located USING (user_id) JOIN places USING (place_id) WHERE NOT women_only AND len(list_intersect({_WORDS_OF('tags')}, ['golf', 'club'])) = 0 AND ({_MEETS}))"""


def _people(spark, d):
    located = person_location(spark, d).join(adapt.places(spark, d), "place_id").select("user_id", "lat", "lon")
    return ranking.rank_people(adapt.people(spark, d), located, VIEWER)


@query("rank_people_bare", f"{_RANKED} SELECT user_id, round(similarity, 6) AS similarity, CASE WHEN m < 500 THEN 'within_500m' WHEN m < 2000 THEN 'within_2km' WHEN m < 5000 THEN 'within_5km' ELSE 'farther' END AS band, shared FROM ranked")
def rank_people_bare(spark, d):
    return _people(spark, d).select("user_id", F.round("similarity", 6).alias("similarity"), "band", "shared")


@query("people_text_filter", f"{_RANKED} SELECT user_id FROM ranked WHERE contains(lower(first_name), 'walk') OR contains(lower(shared), 'walk')")
def people_text_filter(spark, d):
    return _people(spark, d).filter(filters.contains_text(C("first_name"), "Walk") | filters.contains_text(C("shared"), "Walk")).select("user_id")


# With vectors and notes; the queries above named ..._bare rank tables without them.

_NOTES = "CASE user_id % 5 WHEN 0 THEN {a}'mood', 'Lives alone'{b} WHEN 1 THEN {a}'asks', 'wants company'{b} END"


def _vectors(spark, d, key: str):
    return table(spark, d, "embeddings").select(C("vec_id").alias(key), "embedding")


def _rich_people(spark, d):
    return adapt.people(spark, d).join(_vectors(spark, d, "user_id"), "user_id", "left").withColumn("notes", F.expr(_NOTES.format(a="array(", b=")")))


def _placed_events(spark, d):
    return adapt.events(spark, d).join(adapt.places(spark, d), "place_id")


def _rich_viewer(spark, d) -> ranking.Viewer:
    """The viewer with a vector, another of what they want (two rows), and notes."""
    rows = {r.vec_id: tuple(r.embedding) for r in table(spark, d, "embeddings").filter("vec_id IN (0, 1)").collect()}
    return dataclasses.replace(VIEWER, embedding=rows[0], want=rows[1], notes=("mood", "lonely"))


def _cos(k: int) -> str:
    return f"CASE WHEN embedding IS NOT NULL THEN list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {k})) END"


_SAYS = "(list_bool_or(list_transform(list_concat(tags, coalesce(notes, [])), lambda t: regexp_matches(lower(t), '{}'))))"
#: The viewer is lonely by a note and wants company by a like.
_MATE = f"({_SAYS.format('wants company|towarzystwo')} OR {_SAYS.format('lonely|lives alone|samotn')})"
_RICH_PARTS = ", ".join(
    [
        "CAST(" + adapt.age_similarity("CAST('25-34' AS VARCHAR)", "age_band") + " AS DOUBLE)",
        adapt.sport_similarity("1", "sportiness"),
        adapt.tag_jaccard("['walks','coffee','wants company']", "tags"),
        _cos(0),
        f"CASE WHEN {_MATE} THEN 1e0 END",
    ]
)
_RICH_LIKE = f"coalesce(list_avg(list_filter([{_RICH_PARTS}], lambda x: x IS NOT NULL)), 0)"
_RICH = f"""{ctes('evs', 'places', 'live', 'attendances', 'people', 'signed')},
rich AS (SELECT people.*, embedding, {_NOTES.format(a='[', b=']')} AS notes FROM people LEFT JOIN embeddings ON vec_id = user_id),
likes AS (SELECT event_id, avg({_RICH_LIKE}) AS people FROM attendances JOIN rich USING (user_id) WHERE status = 'going' GROUP BY 1)"""
_BOX = geo.Box(49.9, 21.2, 50.4, 20.0)


def _rich_warm_sql(where: str) -> str:
    return f"""{_RICH},
near AS (SELECT live.*, {_cos(1)} AS match, {distance()} AS distance_m, {warsaw('starts_at')} AS minute FROM live LEFT JOIN embeddings ON vec_id = event_id WHERE {where}),
warm AS (SELECT near.*, (coalesce(0.45 * people, 0) + 0.25 * exp(-distance_m / 2500) + coalesce(0.20 * match, 0) + 0.10 * ({_FIT})) / (0.35 + CASE WHEN people IS NULL THEN 0 ELSE 0.45 END + CASE WHEN match IS NULL THEN 0 ELSE 0.20 END) + CASE WHEN promoted THEN 0.05 ELSE 0 END AS score
         FROM near LEFT JOIN likes USING (event_id) WHERE NOT ({_DROPPED}) AND {contains('480', '1320', 'minute')}),
top AS (SELECT * FROM warm ORDER BY score DESC, distance_m, starts_at, event_id LIMIT 50)"""


_RICH_WARM = _rich_warm_sql(f"{distance()} <= 30000")


@query("mean_attendee_sim", f"{_RICH} SELECT event_id, round(people, 6) AS people FROM likes")
def mean_attendee_sim(spark, d):
    return ranking.attendee_likeness(_rich_people(spark, d), adapt.attendances(spark, d), _rich_viewer(spark, d)).select("event_id", F.round("people", 6).alias("people"))


@query("event_score", f"{_RICH_WARM} SELECT event_id, round(score, 6) AS score FROM warm")
def event_score(spark, d):
    scored = ranking.scored_events(_placed_events(spark, d), _rich_people(spark, d), _attended(spark, d), _rich_viewer(spark, d), RADIUS, filters.live(AS_OF), vectors=_vectors(spark, d, "event_id"))
    return scored.select("event_id", F.round("score", 6).alias("score"))


def _rich_warm(spark, d, bounds=None):
    return ranking.rank_events(_placed_events(spark, d), _rich_people(spark, d), _attended(spark, d), _rich_viewer(spark, d), RADIUS, filters.live(AS_OF), bounds, _vectors(spark, d, "event_id"))


@query("rank_events_warm", f"{_RICH_WARM} SELECT event_id, round(score, 6) AS score, round(distance_m, 3) AS distance_m FROM top")
def rank_events_warm(spark, d):
    return _rich_warm(spark, d).select("event_id", F.round("score", 6).alias("score"), F.round("distance_m", 3).alias("distance_m"))


@query("rank_events_bbox", _rich_warm_sql("lat BETWEEN 49.9 AND 50.4 AND (lon >= 21.2 OR lon <= 20.0)") + " SELECT event_id, round(score, 6) AS score, round(distance_m, 3) AS distance_m FROM top")
def rank_events_bbox(spark, d):
    """A box, here one that wraps, in place of the radius."""
    return _rich_warm(spark, d, _BOX).select("event_id", F.round("score", 6).alias("score"), F.round("distance_m", 3).alias("distance_m"))


@query("rank_events_bbox_cold", f"{ctes('evs', 'places', 'live')} SELECT event_id, 0e0 AS score, round({distance()}, 3) AS distance_m FROM live WHERE lat BETWEEN 49.5 AND 50 AND lon BETWEEN 19.5 AND 20.5 ORDER BY starts_at, {distance()}, event_id LIMIT 40")
def rank_events_bbox_cold(spark, d):
    placed = adapt.events(spark, d).join(adapt.places(spark, d), "place_id")
    found = ranking.rank_events(placed, adapt.people(spark, d), adapt.attendances(spark, d), COLD, RADIUS, filters.live(AS_OF), geo.Box(49.5, 19.5, 50.0, 20.5))
    return found.select("event_id", F.round("score", 6).alias("score"), F.round("distance_m", 3).alias("distance_m"))


@query("first_open_offer", f"{_RICH_WARM} SELECT event_id, coalesce(n, 0) AS signed_count FROM top LEFT JOIN signed USING (event_id) WHERE capacity IS NULL OR coalesce(n, 0) < capacity ORDER BY score DESC, distance_m, starts_at, event_id LIMIT 1")
def first_open_offer(spark, d):
    order = [F.desc("score"), C("distance_m"), C("starts_at"), C("event_id")]
    return ranking.first_open(_rich_warm(spark, d), order).select("event_id", "signed_count")


_RICH_PEOPLE = f"""{_RICH}, {_LOCATIONS}, ranked AS (SELECT user_id, {_RICH_LIKE} AS similarity, {_cos(0)} AS profile_cosine, {distance()} AS m
FROM rich JOIN located USING (user_id) JOIN places USING (place_id) WHERE NOT women_only AND len(list_intersect({_WORDS_OF('tags')}, ['golf', 'club'])) = 0 AND ({_MEETS}))"""


def _located(spark, d):
    return person_location(spark, d).join(adapt.places(spark, d), "place_id").select("user_id", "lat", "lon")


@query("rank_people", f"{_RICH_PEOPLE} SELECT user_id, round(similarity, 6) AS similarity, round(profile_cosine, 6) AS profile_cosine, row_number() OVER (ORDER BY profile_cosine DESC NULLS LAST, similarity DESC, m, user_id) AS place FROM ranked")
def rank_people(spark, d):
    ranked = ranking.placed_people(_rich_people(spark, d), _located(spark, d), _rich_viewer(spark, d))
    return ranked.select("user_id", F.round("similarity", 6).alias("similarity"), F.round("profile_cosine", 6).alias("profile_cosine"), "place")


@query("rank_people_for", f"{_RICH_PEOPLE} SELECT 'warm' AS viewer, user_id, round(similarity, 6) AS similarity, round(profile_cosine, 6) AS profile_cosine FROM ranked UNION ALL SELECT 'cold', user_id, 0e0, NULL FROM people JOIN located USING (user_id)")
def rank_people_for(spark, d):
    """A stated set of viewers: one about whom nothing is known, and one who is known."""
    found = ranking.rank_people_for(_rich_people(spark, d), _located(spark, d), {"cold": COLD, "warm": _rich_viewer(spark, d)})
    return found.select("viewer", "user_id", F.round("similarity", 6).alias("similarity"), F.round("profile_cosine", 6).alias("profile_cosine"))


# A table of viewers: all people as viewers, each at a place of their own; one in nine is cold.

_VIEWER = """SELECT user_id AS viewer, 49.9e0 + ((user_id * 37) % 100) / 100e0 * 0.4e0 AS lat, 19.7e0 + ((user_id * 91) % 100) / 100e0 * 0.6e0 AS lon, {warm} AS warm,
CASE WHEN {warm} THEN age_band END AS age_band, CASE WHEN {warm} THEN sportiness END AS sportiness, CASE WHEN {warm} AND user_id % 7 = 0 THEN 'Wheelchair user' END AS mobility, CASE WHEN {warm} THEN tags END AS likes,
CASE WHEN {warm} AND user_id % 3 = 0 THEN {a}'Golf club'{b} END AS dislikes, {warm} AND user_id % 5 = 0 AS women_only, CASE WHEN {warm} THEN start_minute END AS start_minute, CASE WHEN {warm} THEN end_minute END AS end_minute,
CASE WHEN {warm} THEN embedding END AS embedding, CASE WHEN {warm} THEN notes END AS notes, CASE WHEN {warm} AND user_id % 2 = 0 THEN other END AS want FROM {source}"""
_WARM_ROW = "user_id % 9 <> 0"
_VIEWERS = _VIEWER.format(warm=_WARM_ROW, a="[", b="]", source="rich LEFT JOIN (SELECT vec_id - 1 AS user_id, embedding AS other FROM embeddings) USING (user_id)")
_APART = adapt.HAVERSINE.format(a="p.lat", b="p.lon", c="v.lat", d="v.lon")


def _viewers(spark, d):
    other = table(spark, d, "embeddings").select((C("vec_id") - 1).alias("user_id"), C("embedding").alias("other"))
    made = _VIEWER.format(warm=_WARM_ROW, a="array(", b=")", source="{people}")
    return spark.sql(made, people=_rich_people(spark, d).join(other, "user_id", "left"))


def _cos2(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]) END"


_SAYS2 = "coalesce(list_bool_or(list_transform(list_concat(coalesce({0}, []), coalesce({1}, [])), lambda t: regexp_matches(lower(t), '{2}'))), false)"
_LONELY, _WANTS = "lonely|lives alone|samotn", "wants company|towarzystwo"
_MATES = " OR ".join([
    f"{_SAYS2.format('v.likes', 'v.notes', _LONELY)} AND {_SAYS2.format('t.tags', 't.notes', _WANTS)}", f"{_SAYS2.format('t.tags', 't.notes', _LONELY)} AND {_SAYS2.format('v.likes', 'v.notes', _WANTS)}",
    f"{_SAYS2.format('v.likes', 'v.notes', _WANTS)} AND {_SAYS2.format('t.tags', 't.notes', _WANTS)} AND len(list_intersect({tag_set('coalesce(v.likes, [])')}, {tag_set('t.tags')})) > 0",
])
_ALIKE = ", ".join([f"CAST({adapt.age_similarity('v.age_band', 't.age_band')} AS DOUBLE)", adapt.sport_similarity("v.sportiness", "t.sportiness"), adapt.tag_jaccard("coalesce(v.likes, [])", "t.tags"), _cos2("v.embedding", "t.embedding"), f"CASE WHEN {_MATES} THEN 1e0 END"])
_ALIKE = f"coalesce(list_avg(list_filter([{_ALIKE}], lambda x: x IS NOT NULL)), 0)"
_BLOCKED_WORDS = "[" + ", ".join(repr(x) for x in similarity.BLOCKED) + "]"
_SIZE = "((v.end_minute - v.start_minute + 1440) % 1440)"
_FIT2 = f"CASE WHEN v.start_minute IS NULL OR {_SIZE} = 0 THEN 1e0 WHEN NOT {contains('v.start_minute', 'v.end_minute', 'minute')} THEN 0e0 ELSE 1 - abs((minute - v.start_minute + 1440) % 1440 - {_SIZE} / 2e0) / {_SIZE} END"
_FOR_RADIUS = 15_000.0
_RANKED_FOR = f"""{_RICH}, viewers AS ({_VIEWERS}), pool AS (SELECT live.*, embedding, {warsaw('starts_at')} AS minute FROM live LEFT JOIN embeddings ON vec_id = event_id),
pairs AS (SELECT viewer, warm, p.event_id, {_APART} AS m, p.starts_at, p.promoted, CASE WHEN warm THEN {_cos2('p.embedding', 'coalesce(v.want, v.embedding)')} END AS match, {_FIT2} AS fit FROM pool p, viewers v
  WHERE {_APART} <= {_FOR_RADIUS} AND (NOT warm OR (NOT (coalesce(v.mobility, '') <> '' AND len(list_intersect({_WORDS_OF('p.tags')}, {_BLOCKED_WORDS})) > 0) AND NOT (v.dislikes IS NOT NULL AND len(list_intersect({_WORDS_OF('list_append(p.tags, p.title)')}, ['golf', 'club'])) > 0)
    AND (v.women_only OR NOT p.women_only) AND (v.start_minute IS NULL OR {contains('v.start_minute', 'v.end_minute', 'minute')})))),
liked AS (SELECT viewer, event_id, avg(CASE WHEN warm THEN {_ALIKE} END) AS people FROM pairs JOIN attendances a USING (event_id) JOIN rich t ON t.user_id = a.user_id JOIN viewers v USING (viewer, warm) WHERE a.status = 'going' GROUP BY 1, 2),
rated AS (SELECT pairs.*, coalesce(n, 0) AS signed_count, CASE WHEN warm THEN (coalesce(0.45 * people, 0) + 0.25 * exp(-m / 2500) + coalesce(0.20 * match, 0) + 0.10 * fit) / (0.35 + CASE WHEN people IS NULL THEN 0 ELSE 0.45 END + CASE WHEN match IS NULL THEN 0 ELSE 0.20 END) + CASE WHEN promoted THEN 0.05 ELSE 0 END ELSE 0 END AS score
  FROM pairs LEFT JOIN liked USING (viewer, event_id) LEFT JOIN signed USING (event_id))
SELECT viewer, event_id, round(score, 6) AS score, round(m, 3) AS distance_m, signed_count FROM rated QUALIFY row_number() OVER (PARTITION BY viewer ORDER BY score DESC, CASE WHEN NOT warm THEN starts_at END, m, starts_at, event_id) <= CASE WHEN warm THEN 50 ELSE 40 END"""


@query("rank_events_for", _RANKED_FOR)
def rank_events_for(spark, d):
    """The best events near each of all people."""
    found = ranking.rank_events_for(_placed_events(spark, d), _rich_people(spark, d), _attended(spark, d), _viewers(spark, d), _FOR_RADIUS, filters.live(AS_OF), _vectors(spark, d, "event_id"))
    return found.select("viewer", "event_id", F.round("score", 6).alias("score"), F.round("distance_m", 3).alias("distance_m"), "signed_count")


_MEETS2 = f"v.start_minute IS NULL OR t.start_minute IS NULL OR (SELECT bool_or({contains('v.start_minute', 'v.end_minute', 'x')} AND {contains('t.start_minute', 't.end_minute', 'x')}) FROM range(1440) r(x))"


@query(
    "rank_people_near",
    f"""{_RICH}, {_LOCATIONS}, viewers AS ({_VIEWERS}) SELECT viewer, t.user_id, round({_ALIKE}, 6) AS similarity, round({_cos2('v.embedding', 't.embedding')}, 6) AS profile_cosine, round({_APART}, 3) AS distance_m FROM rich t JOIN located USING (user_id) JOIN places p USING (place_id), viewers v
WHERE {_APART} <= {_FOR_RADIUS} AND (NOT warm OR (NOT (coalesce(v.mobility, '') <> '' AND len(list_intersect({_WORDS_OF('t.tags')}, {_BLOCKED_WORDS})) > 0) AND NOT (v.dislikes IS NOT NULL AND len(list_intersect({_WORDS_OF('t.tags')}, ['golf', 'club'])) > 0) AND (v.women_only OR NOT t.women_only) AND ({_MEETS2})))""",
)
def rank_people_near(spark, d):
    """The people near each of all people, who are their own neighbours too."""
    found = ranking.rank_people_near(_rich_people(spark, d), _located(spark, d), _viewers(spark, d), _FOR_RADIUS)
    return found.select("viewer", "user_id", F.round("similarity", 6).alias("similarity"), F.round("profile_cosine", 6).alias("profile_cosine"), F.round("distance_m", 3).alias("distance_m"))


_PROPOSED = "SELECT {k} AS proposed, {lat} + ({k} % 5) * 0.001e0 AS lat, {lon} + ({k} % 7) * 0.0005e0 AS lon FROM {source}"


@query("same_place", f"{ctes('places')}, proposed AS ({_PROPOSED.format(k='place_id', lat='lat', lon='lon', source='places')}) SELECT proposed, place_id FROM proposed q, places p WHERE abs(q.lat - p.lat) <= 0.002 AND abs(q.lon - p.lon) <= 0.002")
def same_place(spark, d):
    """Known places that each of a table of proposed ones may be; shifts reach the bound."""
    known = adapt.places(spark, d).select("place_id", "lat", "lon")
    proposed = spark.sql(_PROPOSED.format(k="place_id", lat="lat", lon="lon", source="{places}"), places=known)
    return nearby.same_place(proposed, known, "place_id").select("proposed", "place_id")


@query("constraints_passed", f"{ctes('people')} SELECT user_id, 'dislikes,time_window' AS passed FROM people")
def constraints_passed(spark, d):
    return adapt.people(spark, d).select("user_id", F.array_join(ranking.constraints_passed(VIEWER), ",").alias("passed"))


_SHIFT = "(place_id % 5) * 0.001e0"


@query("coord_match", f"{ctes('places')} SELECT place_id, abs(lat - (lat + {_SHIFT})) <= 0.002 AND abs(lon - (lon + {_SHIFT} / 2)) <= 0.002 AS same FROM places")
def coord_match(spark, d):
    """All places, those whose shift is the bound among them: both engines add and compare the same doubles."""
    shift = F.expr(_SHIFT)
    return adapt.places(spark, d).select("place_id", geo.same_coordinates(C("lat"), C("lon"), C("lat") + shift, C("lon") + shift / 2).alias("same"))


@query("suffix_match", "SELECT p_partkey FROM part WHERE ends_with(p_type, 'ARD') OR ends_with(p_name, ' ' || split_part(p_name, ' ', 1))")
def suffix_match(spark, d):
    return table(spark, d, "part").filter(C("p_type").endswith("ARD") | C("p_name").endswith(F.concat(F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(1))))).select("p_partkey")


# Changes of tables.


@query("latest_wins", ctes("attendances") + "SELECT * FROM attendances")
def latest_wins(spark, d):
    return adapt.attendances(spark, d)


@query(
    "upsert_coalesce",
    "SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.name ELSE o.name END AS name, coalesce(n.zip, o.zip) AS zip FROM (SELECT p_partkey AS k, p_name AS name, p_type AS zip FROM part WHERE p_partkey % 3 <> 0) o FULL JOIN (SELECT p_partkey AS k, p_brand AS name, CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS zip FROM part WHERE p_partkey % 2 = 0) n ON o.k = n.k",
)
def upsert_coalesce(spark, d):
    part = table(spark, d, "part")
    old = part.filter("p_partkey % 3 <> 0").select(C("p_partkey").alias("k"), C("p_name").alias("name"), C("p_type").alias("zip"))
    new = part.filter("p_partkey % 2 = 0").select(C("p_partkey").alias("k"), C("p_brand").alias("name"), F.when(C("p_partkey") % 4 == 0, C("p_brand")).alias("zip"))
    return mutations.upsert(old, new, ["k"], ["zip"])


@query("insert_ignore", "SELECT p_partkey AS k, CASE WHEN p_partkey % 3 <> 0 THEN 'old' ELSE 'new' END AS origin FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0")
def insert_ignore(spark, d):
    part = table(spark, d, "part")
    return mutations.insert_ignore(part.filter("p_partkey % 3 <> 0").select(C("p_partkey").alias("k"), F.lit("old").alias("origin")), part.filter("p_partkey % 2 = 0").select(C("p_partkey").alias("k"), F.lit("new").alias("origin")), ["k"])


@query("replace_children", "SELECT l_orderkey AS parent, l_linenumber AS child, 'old' AS origin FROM lineitem WHERE l_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, 0, 'new' FROM orders WHERE o_orderkey % 4 = 0")
def replace_children(spark, d):
    old = table(spark, d, "lineitem").select(C("l_orderkey").alias("parent"), C("l_linenumber").alias("child"), F.lit("old").alias("origin"))
    new = table(spark, d, "orders").filter("o_orderkey % 4 = 0").select(C("o_orderkey").alias("parent"), F.lit(0).alias("child"), F.lit("new").alias("origin"))
    return mutations.replace_children(old, new, "parent")


@query("mark_failed_case", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'digested' ELSE 'failed' END AS status, substring(repeat(p_name || ' ', 120), 1, 2000) AS error FROM part")
def mark_failed_case(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.when(C("p_partkey") % 3 == 0, C("p_name")).alias("digest_text"), F.lit("digested").alias("status"))
    return mutations.failed(rows, F.repeat(F.concat("p_name", F.lit(" ")), F.lit(120))).select("p_partkey", "status", "error")


@query("sparse_patch", "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'patched' ELSE s_name END AS name, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN 1 ELSE s_nationkey END AS nation FROM supplier")
def sparse_patch(spark, d):
    base = table(spark, d, "supplier").select(C("s_suppkey").alias("k"), C("s_name").alias("name"), C("s_nationkey").alias("nation"))
    changes = base.filter("k % 3 = 0").select("k", F.lit("patched").alias("name"), F.when(C("k") % 2 == 0, 1).alias("nation"))
    return mutations.patch(base, changes, "k")


_MEMO = "SELECT p_partkey AS k, p_name AS key, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS value FROM part"


def _forgotten(spark, d):
    memo = table(spark, d, "part").select(C("p_partkey").alias("k"), C("p_name").alias("key"), F.when(C("p_partkey") % 3 != 0, C("p_type")).alias("value"))
    return mutations.forget(memo, filters.contains_text(C("key"), "A") & filters.contains_text(C("value"), "Smal"))


@query("forget_matched", f"SELECT k FROM ({_MEMO}) WHERE contains(lower(key), 'a') AND contains(lower(value), 'smal')")
def forget_matched(spark, d):
    return _forgotten(spark, d)[0].select("k")


@query("forget_remaining", f"SELECT k FROM ({_MEMO}) WHERE NOT coalesce(contains(lower(key), 'a') AND contains(lower(value), 'smal'), false)")
def forget_remaining(spark, d):
    return _forgotten(spark, d)[1].select("k")


@query(
    "capacity_admission",
    f"""{ctes('evs', 'attendances')}, req AS (SELECT l_orderkey AS event_id, l_partkey % 40 AS user_id, min(l_linenumber) AS seq FROM lineitem GROUP BY 1, 2), held AS (SELECT event_id, user_id FROM attendances WHERE status = 'going'), n AS (SELECT event_id, count(*) AS held FROM held GROUP BY 1),
j AS (SELECT r.event_id, r.user_id, capacity, coalesce(n.held, 0) AS held, h.user_id IS NOT NULL AS here, sum(CASE WHEN h.user_id IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY r.event_id ORDER BY seq, r.user_id) AS place FROM req r JOIN evs USING (event_id) LEFT JOIN n USING (event_id) LEFT JOIN held h ON h.event_id = r.event_id AND h.user_id = r.user_id)
SELECT event_id, user_id, CASE WHEN here THEN 'already' WHEN capacity IS NULL OR held + place <= capacity THEN 'going' ELSE 'full' END AS outcome FROM j""",
)
def capacity_admission(spark, d):
    requests = table(spark, d, "lineitem").select(C("l_orderkey").alias("event_id"), (C("l_partkey") % 40).alias("user_id"), C("l_linenumber").alias("seq"))
    return mutations.admitted(requests, adapt.events(spark, d), adapt.attendances(spark, d).filter("status = 'going'"))


@query("attendance_transition", f"{ctes('attendances')} SELECT o_orderkey AS event_id, o_custkey % 100 AS user_id, CASE WHEN a.user_id IS NOT NULL THEN 'cancelled' END AS status, a.user_id IS NOT NULL AS found FROM orders LEFT JOIN attendances a ON a.event_id = o_orderkey AND a.user_id = o_custkey % 100")
def attendance_transition(spark, d):
    changes = table(spark, d, "orders").select(C("o_orderkey").alias("event_id"), (C("o_custkey") % 100).alias("user_id"), F.lit("cancelled").alias("status"))
    return mutations.transitioned(adapt.attendances(spark, d), changes, ["event_id", "user_id"])


@query("guarded_update", f"{ctes('messages')} SELECT c_custkey AS user_id, c_name AS summary FROM customer WHERE EXISTS (SELECT 1 FROM messages m WHERE m.user_id = c_custkey)")
def guarded_update(spark, d):
    return mutations.guarded(table(spark, d, "customer").select(C("c_custkey").alias("user_id"), C("c_name").alias("summary")), adapt.messages(spark, d), ["user_id"])


@query("host_backfill", f"{ctes('evs', 'attendances', 'signed')} SELECT e.event_id, e.host_id AS user_id FROM evs e LEFT JOIN signed s USING (event_id) WHERE NOT EXISTS (SELECT 1 FROM attendances a WHERE a.event_id = e.event_id AND a.user_id = e.host_id) AND (capacity IS NULL OR coalesce(n, 0) < capacity)")
def host_backfill(spark, d):
    return mutations.host_backfill(adapt.events(spark, d), adapt.attendances(spark, d))


_NEW = "SELECT o_orderkey AS event_id, o_custkey AS host_id, o_orderkey + 1000000 AS place_id, CASE o_orderkey % 4 WHEN 0 THEN 'home' WHEN 1 THEN 'cafe' ELSE 'park' END AS kind, CASE o_orderkey % 5 WHEN 0 THEN NULL ELSE o_orderkey % 5 - 1 END AS capacity FROM orders"
_TAKEN = f"SELECT * FROM ({_NEW}) WHERE kind <> 'home' AND (capacity IS NULL OR capacity >= 1)"


@query("create_events", f"SELECT 'place' AS row_of, place_id AS id, kind AS what FROM ({_TAKEN}) UNION ALL SELECT 'event', event_id, CAST(capacity AS VARCHAR) FROM ({_TAKEN}) UNION ALL SELECT 'attendance', event_id, 'going' FROM ({_TAKEN})")
def create_events(spark, d):
    """Place, event and the host's attendance of each new event that is in order."""
    k = C("o_orderkey")
    new = table(spark, d, "orders").select(
        k.alias("event_id"), C("o_custkey").alias("host_id"), (k + 1_000_000).alias("place_id"), F.lit("P").alias("place_name"), F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'home' WHEN 1 THEN 'cafe' ELSE 'park' END").alias("kind"),
        F.lit(50.0).alias("lat"), F.lit(20.0).alias("lon"), F.expr("CASE o_orderkey % 5 WHEN 0 THEN NULL ELSE o_orderkey % 5 - 1 END").alias("capacity"),
    )
    places, events, going = mutations.created_events(new)
    rows = [places.select(F.lit("place").alias("row_of"), C("place_id").alias("id"), C("kind").alias("what")), events.select(F.lit("event"), "event_id", C("capacity").cast("string")), going.select(F.lit("attendance"), "event_id", "status")]
    return rows[0].union(rows[1]).union(rows[2])


@query("event_errors", f"SELECT c_custkey, CASE WHEN c_custkey % 7 IN (0, 1) THEN 'coordinates' WHEN c_custkey % 5 = 0 THEN 'capacity' WHEN c_custkey % 3 = 0 THEN 'kind' END AS error FROM customer")
def event_errors(spark, d):
    k = C("c_custkey")
    lat = F.when(k % 7 == 0, float("nan")).when(k % 7 == 1, float("inf")).otherwise(50.0)
    return table(spark, d, "customer").select("c_custkey", validation.event_error(lat, F.lit(20.0), F.when(k % 2 == 0, k % 5).otherwise(F.nullif(k % 5, F.lit(1))), F.when(k % 3 == 0, "home").otherwise("park")).alias("error"))
