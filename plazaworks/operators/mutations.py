"""Changes as new snapshots: each function gives the table after a batch of changes."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plazaworks.operators.filters import PUBLIC_KINDS, contains_text

#: Characters of an error that are kept.
MOST_ERROR = 2000

#: Types of a fixed width that aggregates can hold in place, and bits of those that are whole numbers.
_FIXED = frozenset("boolean tinyint smallint int bigint float double date timestamp timestamp_ntz".split())
_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def _one_number(log: DataFrame, order: list[str]) -> Column | None:
    """A number that orders rows as the columns do, nulls first; None if they aren't whole numbers or too wide together."""
    kinds = dict(log.dtypes)
    if any(kinds[c] not in _BITS for c in order):
        return None
    total, found = 1, F.lit(0).cast("decimal(38,0)")
    for c in order:
        bits = _BITS[kinds[c]]
        total *= (1 << bits) + 1
        found = found * F.lit(Decimal((1 << bits) + 1)) + F.coalesce(F.col(c).cast("decimal(38,0)") + F.lit(Decimal((1 << bits - 1) + 1)), F.lit(Decimal(0)))
    if total < 1 << 63:
        return found.cast("long")
    return found.cast("decimal(38,0)") if total < 10**37 else None


def latest_wins(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order, pre-aggregated before the shuffle.

    Where all columns but the key's are of fixed width and the order is of
    whole numbers, both aggregates hash; with strings among them they sort.
    """
    rest = [c for c in log.columns if c not in key]
    at, kinds = _one_number(log, order), dict(log.dtypes)
    if at is not None and all(kinds[c] in _FIXED for c in rest):
        return log.withColumn("_at", at).groupBy(*key).agg(*[F.max_by(c, "_at").alias(c) for c in rest])
    last = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return last.select(*key, *[F.col(f"last.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep_old_if_null: list[str]) -> DataFrame:
    """Rows of new replace those of old; named columns keep the old value where the new one is null."""
    values = [c for c in old.columns if c not in key]
    o, n = old.withColumn("_o", F.lit(True)), new.withColumn("_n", F.lit(True))
    for c in values:
        o, n = o.withColumnRenamed(c, f"_o_{c}"), n.withColumnRenamed(c, f"_n_{c}")
    both = o.join(n, key, "full")
    pick = lambda c: F.coalesce(f"_n_{c}", f"_o_{c}") if c in keep_old_if_null else F.when(F.col("_n"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}"))
    return both.select(*key, *[pick(c).alias(c) for c in values])


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and those rows of new whose key it lacks."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All rows of the parents in new are replaced by new's."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def patch(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with the values that changes has; its nulls change nothing. Keys that base lacks are ignored."""
    values = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *[F.col(c).alias(f"_{c}") for c in values])
    joined = base.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in values else F.col(c) for c in base.columns])


def forget(df: DataFrame, matches: Column) -> tuple[DataFrame, DataFrame]:
    """(rows taken out, rows left); a row where the match is unknown is left."""
    known = F.coalesce(matches, F.lit(False))
    return df.filter(known), df.filter(~known)


#: Parts that an event's requests are dealt into.
PARTS = 16


def admitted(requests: DataFrame, events: DataFrame, going: DataFrame) -> DataFrame:
    """Requests (event_id, user_id, seq) with the outcome: going, already or full.

    Those who go already are let in again; of the others each event admits, in
    order, as many as it has room for. Equal requests count once. An event with
    very many requests is dealt into parts first: only those that are among the
    first of their part, as many as there is room, meet in one task.
    """
    fresh = requests.groupBy("event_id", "user_id").agg(F.min("seq").alias("seq"))
    counted = going.groupBy("event_id").agg(F.count("*").alias("held"))
    joined = fresh.join(events.select("event_id", "capacity"), "event_id").join(counted, "event_id", "left").join(going.select("event_id", "user_id", F.lit(True).alias("here")), ["event_id", "user_id"], "left")
    room = F.col("capacity") - F.coalesce("held", F.lit(0))
    part = F.pmod(F.xxhash64("user_id"), F.lit(PARTS))
    waits = F.col("here").isNull() & F.col("capacity").isNotNull() & (room > 0)
    local = F.row_number().over(W.partitionBy("event_id", F.when(waits, part).otherwise(PARTS + part)).orderBy("seq", "user_id"))
    early = joined.withColumns({"room": room, "part": part}).withColumn("early", waits & (local <= room))
    place = F.row_number().over(W.partitionBy("event_id", F.when(F.col("early"), -1).otherwise(F.col("part"))).orderBy("seq", "user_id"))
    going_now = F.col("capacity").isNull() | F.col("early") & (F.col("place") <= F.col("room"))
    return early.withColumn("place", place).select("event_id", "user_id", F.when(F.col("here"), "already").when(going_now, "going").otherwise("full").alias("outcome"))


def transitioned(current: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """changes (key, status) with found: whether there is a row to change."""
    return changes.join(current.select(*key, F.lit(True).alias("_found")), key, "left").select(*key, F.when(F.col("_found"), F.col("status")).alias("status"), F.coalesce("_found", F.lit(False)).alias("found"))


def guarded(changes: DataFrame, evidence: DataFrame, key: list[str]) -> DataFrame:
    """Only the changes that evidence has a row for."""
    return changes.join(evidence.select(*key).distinct(), key, "left_semi")


def host_backfill(events: DataFrame, attendances: DataFrame) -> DataFrame:
    """(event_id, user_id) of hosts that don't attend their event, though it has room."""
    held = attendances.filter("status = 'going'").groupBy("event_id").agg(F.count("*").alias("held"))
    absent = events.select("event_id", F.col("host_id").alias("user_id"), "capacity").join(attendances.select("event_id", "user_id"), ["event_id", "user_id"], "left_anti")
    room = F.col("capacity").isNull() | (F.coalesce("held", F.lit(0)) < F.col("capacity"))
    return absent.join(held, "event_id", "left").filter(room).select("event_id", "user_id")


def numbered_after(existing: DataFrame, new: DataFrame, group: str, ordinal: str, order: list[str]) -> DataFrame:
    """new with ordinals that go on after the group's largest."""
    last = existing.groupBy(group).agg(F.max(ordinal).alias("_last"))
    joined = new.join(last, group, "left")
    at = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return joined.withColumn(ordinal, (F.coalesce("_last", F.lit(-1)) + at).cast("long")).drop("_last")


def created_events(new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(places, events, attendances) to append for new events: their place, the event, and its host, who goes.

    new has event_id, host_id, place_id, place_name, kind, lat, lon and the
    event's own columns; rows with a kind that isn't public or a capacity
    below 1 give nothing.
    """
    good = new.filter(F.col("kind").isin(*PUBLIC_KINDS) & (F.col("capacity").isNull() | (F.col("capacity") >= 1)))
    of_place = ["place_name", "kind", "lat", "lon"]
    places = good.select("place_id", *of_place)
    events = good.drop(*of_place)
    return places, events, good.select("event_id", F.col("host_id").alias("user_id"), F.lit("going").alias("status"))


def appended(log: DataFrame, new: DataFrame, order: list[str], id_col: str = "id") -> DataFrame:
    """new with ids that go on after the log's largest, ascending in its order; as a serial's, they may leave gaps."""
    last = log.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_last"))
    ordered = new.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ordered.withColumn(id_col, F.monotonically_increasing_id())
    # One row meets all: the largest id.
    return numbered.join(F.broadcast(last)).withColumn(id_col, F.col(id_col) + F.col("_last") + 1).drop("_last")


def folded(changes: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """The state that changes to single fields leave: for each key and field the last value set, null if none was.

    A turn is one: its status goes from running to done or failed, and texts,
    checkpoint and error are set on the way.
    """
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields]
    return changes.groupBy(key).agg(*last)


def pending(log: DataFrame, key: str, order: str, field: str, value: str) -> DataFrame:
    """(key, field, value) of what is pending: the last value set for each key and field, unless it was cleared (null) since."""
    last = log.groupBy(key, field).agg(F.max_by(value, order).alias(value))
    return last.filter(F.col(value).isNotNull())


def failed(rows: DataFrame, error: Column, digest: str = "digest_text", status: str = "status") -> DataFrame:
    """rows with their error, cut to 2000 characters; the status is failed only where there is no digest."""
    return rows.withColumns({"error": F.substring(error, 1, MOST_ERROR), status: F.when(F.col(digest).isNull(), "failed").otherwise(F.col(status))})


def forget_topic(memories: DataFrame, tags: DataFrame, topic: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(memories taken out, left, tags taken out, left): those with the topic in key, value or quote, and in the tag. A blank topic takes nothing."""
    topic = topic.strip()
    nothing = F.lit(False)
    says = lambda c: F.coalesce(contains_text(F.col(c), topic), nothing) if topic else nothing
    gone, left = forget(memories, says("key") | says("value") | says("quote"))
    gone_tags, left_tags = forget(tags, says("tag"))
    return gone.orderBy("key", "id"), left, gone_tags.orderBy("tag"), left_tags
