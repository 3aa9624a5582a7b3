"""What is wrong with what users send: a column of the first error, null if there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plazaworks.operators.filters import PUBLIC_KINDS

#: Messages of a page of history unless a number is asked for.
PAGE = 3


def single_grapheme(text: Column) -> Column:
    """One character as readers see it, however many code points; blanks around it don't count."""
    return F.coalesce(F.trim(text).rlike(r"\A\X\z"), F.lit(False))


def event_error(lat: Column, lon: Column, capacity: Column, kind: Column, emoji: Column | None = None) -> Column:
    """coordinates, capacity, kind or emoji, in this order."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    error = F.when(~(finite(lat) & finite(lon)), "coordinates").when(capacity < 1, "capacity").when(~F.coalesce(kind.isin(*PUBLIC_KINDS), F.lit(False)), "kind")
    return error if emoji is None else error.when(~single_grapheme(emoji), "emoji")


def history_limit(limit: Column) -> Column:
    """The number of messages asked for, PAGE if none is; null if it isn't above 0."""
    return F.when(limit.isNull(), F.lit(PAGE)).when(limit > 0, limit)
