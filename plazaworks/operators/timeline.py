"""Histories of users, laid out so that a page of one reads a few files, however long the history and however many the users.

messages/ has a folder for each bucket of users, period and batch, its files
sorted by user, time and id; counts/ has how many messages a user has in each
period.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets of users, and bytes of a row group: a page reads one or two of them in a file.
BUCKETS, ROW_GROUP = 64, 8 << 20
USER, TIME, ID = "user_id", "created", "id"


#: A whole number that never falls as time goes on.
Period = Callable[[Column], Column]


def days(n: int) -> Period:
    """Periods of n days since 1970, the same in all time zones; times without a zone are the session's, which must be the same for writers and readers then."""
    return lambda created: F.floor(F.unix_seconds(created.cast("timestamp")) / (n * 86400)).cast("int")


MONTH = days(30)


def _bucket(user: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(user), F.lit(buckets)).cast("int")


def append(messages: DataFrame, path: str, batch: int, period: Period = MONTH, buckets: int = BUCKETS) -> None:
    """Adds a batch of messages (user_id, created, id and others); one that is run again replaces itself.

    period and buckets must be the same for all batches. A user with very many
    messages is written by several tasks, each a stretch of time.
    """
    of = messages.withColumns({"_bucket": _bucket(F.col(USER), buckets), "_period": period(F.col(TIME)).cast("int"), "_batch": F.lit(batch)})
    order = ["_bucket", "_period", USER, TIME, ID]
    ordered = of.repartitionByRange(*order).sortWithinPartitions(*order)
    to = lambda df, name, *parts: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.block.size", ROW_GROUP).partitionBy(*parts).parquet(f"{path}/{name}")
    to(ordered, "messages", "_bucket", "_period", "_batch")
    counted = of.groupBy("_bucket", "_batch", USER, "_period").agg(F.count("*").alias("n"))
    to(counted.repartitionByRange("_bucket", USER, "_period").sortWithinPartitions("_bucket", USER, "_period"), "counts", "_bucket", "_batch")


def _of_user(spark: SparkSession, path: str, name: str, user_id, buckets: int) -> DataFrame:
    rows = spark.read.parquet(f"{path}/{name}")
    user = F.lit(user_id).cast(rows.schema[USER].dataType)
    return rows.filter((F.col("_bucket") == _bucket(user, buckets)) & (F.col(USER) == user))


def position_of(spark: SparkSession, path: str, user_id, id_, buckets: int = BUCKETS) -> tuple | None:
    """(time, id) of a user's message; None if the user has none of that id. All periods of the user's bucket are looked through."""
    row = _of_user(spark, path, "messages", user_id, buckets).filter(F.col(ID) == F.lit(id_)).select(TIME, ID).first()
    return tuple(row) if row else None


def page(spark: SparkSession, path: str, user_id, before: tuple | None = None, size: int = 3, period: Period = MONTH, buckets: int = BUCKETS) -> DataFrame:
    """A user's newest size messages before a position (time, id), or of all without one; the oldest of them first.

    The counts say from which period on there are enough, so only files of the
    user's bucket from there to the position's period are opened. Of the
    position's own period it isn't known how many are before it; it counts as
    none.
    """
    rows = _of_user(spark, path, "messages", user_id, buckets)
    counts = _of_user(spark, path, "counts", user_id, buckets)
    if before is not None:
        at = F.lit(before[0]).cast(rows.schema[TIME].dataType), F.lit(before[1]).cast(rows.schema[ID].dataType)
        last = period(at[0]).cast("int")
        older = (F.col(TIME) < at[0]) | ((F.col(TIME) == at[0]) & (F.col(ID) < at[1]))
        rows, counts = rows.filter((F.col("_period") <= last) & (F.col(TIME) <= at[0]) & older), counts.filter(F.col("_period") < last)
    newer = W.orderBy(F.desc("_period"))
    # One user's periods, so the window has few rows.
    totals = counts.groupBy("_period").agg(F.sum("n").alias("n")).withColumn("sum", F.sum("n").over(newer))
    enough = totals.agg(F.max(F.when(F.col("sum") >= size, F.col("_period"))).alias("p")).first().p
    if enough is not None:
        rows = rows.filter(F.col("_period") >= enough)
    return rows.drop("_bucket", "_period", "_batch").orderBy(F.desc(TIME), F.desc(ID)).limit(max(0, size)).orderBy(TIME, ID)
