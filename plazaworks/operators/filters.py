"""Predicates on events and people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PUBLIC_KINDS = ("cafe", "park", "hall", "square", "other_public")


def live(as_of: str) -> Column:
    """Scheduled and begun less than 24 hours before as_of, or not yet; in a public place."""
    begun_after = F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL 24 HOURS")
    return (F.col("status") == "scheduled") & (F.col("starts_at") > begun_after) & F.col("kind").isin(*PUBLIC_KINDS)


def not_full(signed: str = "signed_count", capacity: str = "capacity") -> Column:
    return F.col(capacity).isNull() | (F.col(signed) < F.col(capacity))


def normalised_email(raw: Column) -> Column:
    """The address trimmed and in lower case; null if it can't be one: one @, a part of 1 to 64 characters before it, a
    domain of 3 to 253 with a dot after it, 254 in all, no dot at either end of both, plain ASCII without blanks or controls."""
    email = F.lower(F.btrim(raw, F.lit(" \t\n\x0b\f\r")))
    local, domain = F.substring_index(email, "@", 1), F.substring_index(email, "@", -1)
    sound = email.rlike(r"\A[!-?A-~]+@[!-?A-~]+\z") & (F.length(local) <= 64) & F.length(domain).between(3, 253) & (F.length(email) <= 254) & domain.contains(".")
    return F.when(sound & ~email.rlike(r"\A\.|\.@|@\.|\.\z"), email)


def by_email(users: DataFrame, raw: str) -> DataFrame:
    """The user with the address, whose column email holds normalised ones; none for what is no address."""
    return users.filter(F.col("email") == normalised_email(F.lit(raw)))


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """The row with a key; the filter reaches the scan."""
    return df.filter(F.col(key) == F.lit(value))


def contains_text(col: Column, part: str) -> Column:
    """part stands somewhere in col, in any case; its characters have no special meaning."""
    return F.contains(F.lower(col), F.lit(part.lower()))


def stale(vector: str, model: str, current: str) -> Column:
    return F.col(vector).isNull() | ~F.col(model).eqNullSafe(F.lit(current))


def blocked_after(df: DataFrame, group: list[str], order: list[str], flag: Column, name: str = "blocked") -> DataFrame:
    """df with a column that is true after the first row of the group where flag is."""
    before = F.max(flag.cast("int")).over(W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn(name, F.coalesce(before == 1, F.lit(False)))
