"""Joins of events, places, people and attendances; correlated lookups as aggregates before a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signed_counts(attendances: DataFrame) -> DataFrame:
    return attendances.filter("status = 'going'").groupBy("event_id").agg(F.count("*").alias("signed_count"))


def event_base(events: DataFrame, places: DataFrame, attendances: DataFrame) -> DataFrame:
    """Events with their place and how many go; counts are made before the join."""
    joined = events.join(places, "place_id").join(signed_counts(attendances), "event_id", "left")
    return joined.withColumn("signed_count", F.coalesce("signed_count", F.lit(0)))


def best_per_group(df: DataFrame, group: str, score: Column, tie: str, *keep: str) -> DataFrame:
    """The row of each group with the highest score, the smallest tie among equals. Null and NaN scores don't count."""
    rated = df.select(group, tie, *keep, score.alias("score")).filter(F.col("score").isNotNull() & ~F.isnan("score"))
    best = rated.groupBy(group).agg(F.max_by(F.struct("score", tie, *keep), F.struct("score", (-F.col(tie)).alias("t"))).alias("best"))
    return best.select(group, "best.*")


def missing(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children.select(key).distinct(), key, "left_anti")


def missing_chunks(documents: DataFrame, chunks: DataFrame, key: str = "doc") -> DataFrame:
    """Digested documents that lack a card chunk, or have sections and lack a chunk of one.

    documents has key, digest and sections (an array), chunks key and field.
    """
    has = chunks.groupBy(key).agg(F.max((F.col("field") == "card").cast("int")).alias("_card"), F.max((F.col("field") == "section").cast("int")).alias("_section"))
    joined = documents.filter(F.col("digest").isNotNull()).join(has, key, "left")
    lacks = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    return joined.filter(lacks("_card") | (F.coalesce(F.size("sections"), F.lit(0)) > 0) & lacks("_section")).drop("_card", "_section")


def visible_in_session(events: DataFrame, attending: DataFrame) -> DataFrame:
    """Events with a capacity that aren't full (they have signed_count), of those that the session attends."""
    return events.filter(F.col("capacity").isNotNull() & (F.col("signed_count") < F.col("capacity"))).join(attending.select("event_id"), "event_id", "left_semi")


def with_any(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children.select(key), key, "left_semi")


def ordered_lists(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """For each key its values in order, joined by commas."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_value"))))
    return df.groupBy(key).agg(F.array_join(F.transform(items, lambda x: x["_value"].cast("string")), ",").alias(name))


def person_locations(people: DataFrame, events: DataFrame, attendances: DataFrame) -> DataFrame:
    """Where each person is: the place of an event they go to or else host, the earliest first.

    Hosts' and attendees' events are two joins on equal keys, not one on either.
    """
    hosted = events.select(F.col("host_id").alias("user_id"), F.lit(0).alias("going"), "event_id", "starts_at", "place_id")
    going = attendances.filter("status = 'going'").join(events.select("event_id", "starts_at", "place_id"), "event_id").select("user_id", F.lit(1).alias("going"), "event_id", "starts_at", "place_id")
    hosted = hosted.join(people.select("user_id"), "user_id", "left_semi")
    first = hosted.unionByName(going).groupBy("user_id").agg(F.min_by(F.struct("event_id", "place_id", "going"), F.struct((-F.col("going")).alias("g"), "starts_at", "event_id")).alias("at"))
    return people.select("user_id").join(first, "user_id").select("user_id", "at.event_id", "at.place_id", "at.going")
