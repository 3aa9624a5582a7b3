"""How alike two people, tags or vectors are. Missing parts are null, which is not 0."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plazaworks.functions.text import canonical_tag, tokens

AGE_BANDS = ("18_24", "25_34", "35_44", "45_54", "55_64", "65_plus")
#: Sports and surfaces that a wheelchair rules out.
BLOCKED = ("padel", "tennis", "basketball", "volleyball", "squash", "badminton", "football", "soccer", "court", "running", "run")


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def _cosine(a: Column, b: Column, norm_b: Column) -> Column:
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    value = F.try_divide(dot(a, b), norm(a) * norm_b)
    found = F.when(fits, F.coalesce(F.when(~F.isnan(value), value), F.lit(0.0))).otherwise(F.lit(0.0))
    return F.when(a.isNotNull() & b.isNotNull(), found)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 where it isn't defined; null if one is missing."""
    return _cosine(a, b, norm(b))


def cosine_with(a: Column, vector: Sequence[float]) -> Column:
    """Cosine with a known vector, whose norm is computed once; null if either is missing, as an empty one is here."""
    known = F.array(*[F.lit(float(x)) for x in vector])
    return _cosine(a, known, F.lit(math.sqrt(sum(float(x) ** 2 for x in vector)))) if len(vector) else F.lit(None).cast("double")


def age_index(band: Column) -> Column:
    name = F.regexp_replace(F.replace(F.lower(F.trim(band)), F.lit("-"), F.lit("_")), r"\+$", "plus")
    found = F.when(name.isin("65_plus", "65plus"), 5)
    for k, known in enumerate(AGE_BANDS[:5]):
        found = found.when(name == known, k)
    return found


def age_similarity(a: Column, b: Column) -> Column:
    gap = F.abs(age_index(a) - age_index(b))
    near = F.when(gap == 0, 1.0).when(gap == 1, 0.5).otherwise(0.0)
    same = F.when(canonical_tag(a) == canonical_tag(b), 1.0).otherwise(0.0)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(gap.isNotNull(), near).otherwise(same))


def sport_similarity(a: Column, b: Column) -> Column:
    level = lambda x: F.greatest(F.lit(0), F.least(F.lit(3), x)).cast("double")
    return F.when(a.isNotNull() & b.isNotNull(), 1 - F.abs(level(a) - level(b)) / 3)


def tag_set(tags: Column) -> Column:
    return F.array_distinct(F.transform(tags, canonical_tag))


def tag_jaccard(a: Column, b: Column) -> Column:
    """Shared tags to all tags; null if either has none."""
    x, y = tag_set(a), tag_set(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)).cast("double") / F.size(F.array_union(x, y)))


def mean_of_present(*parts: Column) -> Column:
    """The mean of the parts that aren't null; 0 if all are."""
    present = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.coalesce(F.try_divide(F.aggregate(present, F.lit(0.0), lambda t, x: t + x), F.size(present).cast("double")), F.lit(0.0))


def weighted_present(*parts: tuple[float, Column]) -> Column:
    """The mean by weight of the parts that aren't null; 0 if all are."""
    total = sum((F.when(p.isNotNull(), F.lit(w)).otherwise(0.0) for w, p in parts), F.lit(0.0))
    value = sum((F.coalesce(w * p, F.lit(0.0)) for w, p in parts), F.lit(0.0))
    return F.coalesce(F.try_divide(value, total), F.lit(0.0))


def profile_similarity(age: tuple[Column, Column], sport: tuple[Column, Column], tags: tuple[Column, Column], vectors: tuple[Column, Column], complements: Column) -> Column:
    """Mean of what both profiles tell: age, sportiness, tags, vectors, and company that one seeks and the other gives."""
    return mean_of_present(age_similarity(*age), sport_similarity(*sport), tag_jaccard(*tags), cosine(*vectors), F.when(complements, F.lit(1.0)))


def traits(age: Column, sport: Column, tags: Column, vector: Column, notes: Column) -> Column:
    """What traits_similarity() compares of a profile, made once for each, not for each pair."""
    lonely, company = company_signals(F.concat(tags, notes))
    kept = tag_set(tags)
    no = F.lit(False)
    return F.struct(
        canonical_tag(age).alias("age"), age_index(age).alias("band"), F.when(sport.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(3), sport))).cast("double").alias("level"), kept.alias("tags"), F.size(kept).alias("n_tags"),
        vector.cast("array<double>").alias("vector"), norm(vector).alias("norm"), F.coalesce(lonely, no).alias("lonely"), F.coalesce(company, no).alias("company"),
    )


def traits_similarity(a: Column, b: Column) -> Column:
    """profile_similarity() of two profiles by their traits()."""
    gap = F.abs(a["band"] - b["band"])
    same = F.when(gap.isNull(), F.when(a["age"] == b["age"], 1.0).otherwise(0.0)).when(gap == 0, 1.0).when(gap == 1, 0.5).otherwise(0.0)
    age = F.when(a["age"].isNotNull() & b["age"].isNotNull(), same)
    sport = 1 - F.abs(a["level"] - b["level"]) / 3
    both = F.size(F.array_intersect(a["tags"], b["tags"])).cast("double")
    jaccard = F.when((a["n_tags"] > 0) & (b["n_tags"] > 0), both / (a["n_tags"] + b["n_tags"] - both))
    shared = F.coalesce(F.arrays_overlap(a["tags"], b["tags"]), F.lit(False))
    complement = (a["lonely"] & b["company"]) | (b["lonely"] & a["company"]) | (a["company"] & b["company"] & shared)
    return mean_of_present(age, sport, jaccard, cosine_of(a["vector"], a["norm"], b["vector"], b["norm"]), F.when(complement, F.lit(1.0)))


def cosine_of(a: Column, norm_a: Column, b: Column, norm_b: Column) -> Column:
    """cosine() of vectors whose norms are known."""
    value = F.try_divide(dot(a, b), norm_a * norm_b)
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(fits, F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(0.0)))


def mobility_conflict(mobility: Column, tags: Column) -> Column:
    blocked = F.exists(tags, lambda t: F.exists(tokens(t), lambda w: w.isin(*BLOCKED)))
    return F.coalesce(F.array_contains(tokens(mobility), "wheelchair") & blocked, F.lit(False))


def dislikes_any(dislikes: Column, texts: Column) -> Column:
    """A disliked thing shares a word with one of the texts."""
    words = lambda xs: F.flatten(F.transform(xs, tokens))
    return F.coalesce(F.arrays_overlap(words(dislikes), words(texts)), F.lit(False))


def company_signals(texts: Column) -> tuple[Column, Column]:
    """(lonely, wants company) by what likes and notes say."""
    says = lambda *parts: F.exists(texts, lambda t: F.lower(t).rlike("|".join(parts)))
    return says("lonely", "lives alone", "samotn"), says("wants company", "towarzystwo")


def company_complement(likes1: Column, notes1: Column, likes2: Column, notes2: Column) -> Column:
    """One is lonely and the other wants company, or both want it and share a like."""
    lonely1, company1 = company_signals(F.concat(likes1, notes1))
    lonely2, company2 = company_signals(F.concat(likes2, notes2))
    shared = F.arrays_overlap(tag_set(likes1), tag_set(likes2))
    return (lonely1 & company2) | (lonely2 & company1) | (company1 & company2 & F.coalesce(shared, F.lit(False)))


def shared_tags(a: Column, b: Column) -> Column:
    """Tags of a that b has too, one for each canonical form, in its order."""
    pairs = F.array_sort(F.transform(a, lambda t: F.struct(canonical_tag(t).alias("c"), t.alias("raw"))))
    both = F.filter(pairs, lambda p: F.array_contains(tag_set(b), p["c"]))
    firsts = F.filter(both, lambda p, i: (i == 0) | (F.get(both, i - 1)["c"] != p["c"]))
    return F.transform(firsts, lambda p: p["raw"])
