"""Word similarity of a search text and messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazaworks.functions.text import ordered_trigrams, trigrams_of
from plazaworks.operators.filters import contains_text


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _grouped(marks: Column, splits: Callable[[Column], Column]) -> Column:
    """The marks in stretches: a new one begins at each whose number splits() is true for, and at the first."""
    firsts = F.filter(F.transform(marks, lambda _, k: k), lambda k: (k == 0) | splits(k))
    return _let(firsts, lambda at: F.transform(at, lambda k, j: F.slice(marks, k + 1, F.coalesce(F.get(at, j + 1), F.size(marks)) - k)))


def _best_from(ordered: Column, marks: Column, known: Column, most: int, first: Column, best: Column) -> Column:
    """The best likeness of stretches that begin at the mark of that number, or the one known before if none is better."""
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.get(marks, first).alias("at"), best.alias("best"), F.lit(False).alias("done"))

    def grow(s: Column, mark: Column) -> Column:
        seen = F.array_union(s["seen"], F.slice(ordered, s["at"] + 1, mark - s["at"] + 1))
        found = F.struct(seen.alias("seen"), F.size(F.array_intersect(seen, known)).alias("shared"))

        def rated(f: Column) -> Column:
            rest = F.size(f["seen"]) + most - f["shared"]
            better = F.greatest(s["best"], f["shared"].cast("double") / rest)
            # Once there is so much else that all of the query's trigrams could make no better stretch, what follows is passed over.
            return F.struct(f["seen"].alias("seen"), (mark + 1).alias("at"), better.alias("best"), (F.lit(float(most)) / rest < better).alias("done"))

        return F.when(s["done"], s).otherwise(_let(found, rated))

    return F.aggregate(F.slice(marks, first + 1, F.size(marks)), start, grow, lambda s: s["best"])


def word_similarity(query: str, body: Column) -> Column:
    """The largest likeness of the query's trigrams to those of a stretch of the body's; 0 if they share none, and for null.

    A stretch starts and ends at trigrams that the query has; others are less
    alike than what they hold. Likeness is of sets: what repeats counts once.
    Places of the query's trigrams are listed first. The longest row of them
    gives a likeness to beat, and with it how many other trigrams a better
    stretch can hold at most. Where more lie between two places, the list is
    cut, and only parts with enough places are searched for the best stretch.
    """
    wanted = sorted(set(trigrams_of(query)))
    if not wanted:
        return F.lit(0.0)
    known, most = F.array(*map(F.lit, wanted)), len(wanted)

    def searched(ordered: Column, marks: Column, least: Column) -> Column:
        others = F.floor(F.lit(float(most)) / least - most + 1e-9)
        between = lambda k: F.slice(ordered, F.get(marks, k - 1) + 2, F.get(marks, k) - F.get(marks, k - 1) - 1)
        parts = _grouped(marks, lambda k: F.when(F.get(marks, k) - F.get(marks, k - 1) - 1 <= others, False).otherwise(F.size(F.array_distinct(between(k))) > others))
        large = F.filter(parts, lambda p: F.size(p) > least * most + 1e-9)
        whole = lambda p, best: F.aggregate(F.transform(p, lambda _, k: k), best, lambda b, k: _best_from(ordered, p, known, most, k, b))
        return F.aggregate(large, least, lambda best, p: whole(p, best))

    def placed(ordered: Column, marks: Column) -> Column:
        rows = _grouped(marks, lambda k: F.get(marks, k) - F.get(marks, k - 1) > 1)
        distinct = F.transform(rows, lambda r: F.size(F.array_distinct(F.slice(ordered, F.get(r, F.lit(0)) + 1, F.size(r)))))
        return _let(F.array_max(distinct).cast("double") / most, lambda least: searched(ordered, marks, least))

    def rated(ordered: Column) -> Column:
        marks = F.filter(F.transform(ordered, lambda t, i: F.when(F.array_contains(known, t), i)), lambda i: i.isNotNull())
        return _let(marks, lambda m: F.when(F.size(m) > 0, placed(ordered, m)))

    return F.coalesce(_let(ordered_trigrams(body), rated), F.lit(0.0))


def search(messages: DataFrame, query: str, user_id=None) -> DataFrame:
    """Messages that hold the query, with score: the most alike first, then the oldest; of one user or, without one, of all.

    A blank query finds nothing. Only messages that hold it are rated.
    """
    query = query.strip()
    found = messages if user_id is None else messages.filter(F.col("user_id") == user_id)
    found = found.filter(contains_text(F.col("body"), query) if query else F.lit(False))
    # A sort samples its input first: what it samples is shuffled by then, and not rated twice.
    rated = found.withColumn("score", word_similarity(query, F.col("body"))).repartition("id")
    return rated.orderBy("user_id", F.desc("score"), "created", "id")
