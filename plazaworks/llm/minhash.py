"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Each distinct set of shingles is one class with a sketch, its K smallest hashes.
2. Inverted lists of retained values: two sketches of sets with a Jaccard of
   75 % share at least OVERLAP values (but for a chance below 1e-6), so each
   class is listed under its K - OVERLAP + 1 rarest values only.
3. In each list every class meets the class whose values are the most frequent,
   and the union's sketch estimates the Jaccard; pairs near the bound and above
   are verified on full sets and joined into components.
4. Lists that still hold several components go on by full sets: classes are
   listed under the rarest shingles, one of which any linked pair must share,
   and meet where they can still reach the bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazaworks.llm.components import components
from plazaworks.llm.shared import fresh, release, stored
from plazaworks.llm.shingles import lists_of, mixed, shingle_sets

#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Retained values of a sketch, and how many two linked sketches share at least.
K, OVERLAP = 32, 12
#: A pair is verified if its estimate is above the bound less so many standard deviations.
DEVIATIONS = 5


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, len(whole), 512):
            batch = whole.slice(start, 512)
            sizes, sums, sketches = [], [], []
            for s in shingle_sets(batch.column(1)):
                bits = s.view(np.uint64)
                sizes.append(len(s))
                sums.append((int(bits.sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(mixed(bits)).astype(np.int64))))
                sketches.append(s[:K].copy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array([x for x, _ in sums], pa.int64()), pa.array([y for _, y in sums], pa.int64()), lists_of(sketches)],
                ["doc", "n", "s1", "s2", "sketch"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), 256):
            part = batch.slice(start, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), lists_of(list(shingle_sets(part.column(1))))], ["doc", "shingles"])


def _linked(shared: Column, n: Column, m: Column) -> Column:
    return 100 * shared >= PERCENT * (n + m - shared)


def _sizes_fit(n: Column, m: Column) -> Column:
    return _linked(F.least(n, m), n, m)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are linked. The set of b travels; that of a, perhaps in very many pairs, stays."""
    of_b = pairs.join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("of_b")), "b")
    both = of_b.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("of_a")), "a")
    shared = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    return both.filter(_linked(shared, F.size("of_a"), F.size("of_b"))).select("a", "b")


def _postings(classes: DataFrame) -> DataFrame:
    """(v, doc, n, score): each class under the rarest of the retained values that others retain too."""
    all_ = classes.select("doc", F.explode("sketch").alias("v"))
    shared = all_.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    found = all_.join(shared, "v").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("values"), F.sum("df").alias("score"))
    found = classes.select("doc", "n", F.size("sketch").alias("k")).join(found, "doc")
    # Smaller sets are their own sketch: there the bound itself says what linked ones share.
    least = F.least(F.lit(OVERLAP), F.ceil(F.col("k") * PERCENT / 100)).cast("int")
    listed = (F.col("k") - least + 1) - (F.col("k") - F.size("values"))
    return found.filter(listed > 0).select("doc", "n", "score", F.explode(F.slice("values", 1, listed)).alias("x")).select("x.v", "doc", "n", "score")


def _met_leaders(postings: DataFrame) -> DataFrame:
    """Pairs (a, b): a, the class of the list whose values are the most frequent, and every other."""
    lead = postings.groupBy("v").agg(F.max(F.struct("score", (-F.col("doc")).alias("minus"), F.col("n").alias("m"))).alias("top"), F.count("*").alias("held")).filter("held > 1")
    met = postings.join(lead.select("v", (-F.col("top.minus")).alias("a"), "top.m"), "v")
    return met.filter((F.col("a") != F.col("doc")) & _sizes_fit(F.col("n"), F.col("m"))).select("a", F.col("doc").alias("b")).distinct()


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose union's sketch doesn't speak against a link."""
    of_b = pairs.join(classes.select(F.col("doc").alias("b"), F.col("sketch").alias("of_b")), "b")
    both = of_b.join(classes.select(F.col("doc").alias("a"), F.col("sketch").alias("of_a")), "a")
    both = both.select("a", "b", "of_a", "of_b", F.slice(F.sort_array(F.array_union("of_a", "of_b")), 1, K).alias("union"))
    share = F.size(F.array_intersect(F.array_intersect("union", "of_a"), F.col("of_b"))) / F.size("union")
    bound = PERCENT / 100 - DEVIATIONS * math.sqrt(PERCENT * (100 - PERCENT) / 1e4 / K)
    return both.filter(share >= bound).select("a", "b")


def _prefixes(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc, n, v, rest, component): each set under the rarest of its shingles, and how many come from there on.

    In one order of all shingles, rarest first, linked sets share one of the
    first n - ceil(0.75 n) + 1.
    """
    each = sets.select("doc", F.size("shingles").alias("n"), F.explode("shingles").alias("v"))
    df = each.groupBy("v").agg(F.count("*").alias("df"))
    ranked = each.join(df.filter("df > 1"), "v").groupBy("doc", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("values"))
    alone = F.col("n") - F.size("values")
    reach = F.col("n") - F.ceil(F.col("n") * PERCENT / 100).cast("int") + 1
    ranked = ranked.filter(reach > alone).select("doc", "n", alone.alias("alone"), F.posexplode(F.slice("values", 1, reach - alone)).alias("p", "x"))
    return ranked.select("doc", "n", "x.v", (F.col("n") - F.col("alone") - F.col("p")).alias("rest")).join(labels, "doc", "left").select("doc", "n", "v", "rest", F.coalesce("component", "doc").alias("component"))


def _met_by_prefix(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that full sets may link: exact.

    From the places where they first meet follows how much they can share at most.
    """
    x, y = lists.alias("x"), lists.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    may = (F.col("x.doc") < F.col("y.doc")) & (F.col("x.component") != F.col("y.component")) & _linked(F.least("x.rest", "y.rest"), n, m)
    return x.join(y, (F.col("x.v") == F.col("y.v")) & may).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_shingles, component_id, kept), a row for each row of docs.

    component_id is the smallest id reachable by links, kept whether it is the
    row's own. Null and empty texts have no shingles and link with nothing. A
    row without id links with nothing: its component is null, and it is kept.
    Rows that share an id are one document, linked with what any of its texts
    is linked with; they have the smallest component of theirs. Other columns
    of docs are not read; an empty table gives an empty table.
    """
    text = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sketches = stored(text.mapInArrow(_sketches, "doc long, n long, s1 long, s2 long, sketch array<long>"), "sketches")
    own = sketches.filter("n > 0 AND doc IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("doc").alias("doc"), F.first("sketch").alias("sketch"))
    classes = stored(own, "classes")

    postings = stored(_postings(classes), "postings")
    needed = stored(postings.select("doc").distinct(), "needed")
    sets = stored(text.join(needed, "doc", "left_semi").mapInArrow(_full_sets, "doc long, shingles array<long>"), "sets")
    pairs = stored(_estimated(_met_leaders(postings), classes), "pairs")
    near = stored(_verified(pairs, sets), "links")
    labels = components(near)

    of_lists = postings.join(labels, postings.doc == labels.node, "left").select("v", "doc", F.coalesce("component", "doc").alias("component"))
    open_ = of_lists.groupBy("v").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most")
    rest = stored(of_lists.join(open_, "v").select("doc", F.col("component")).distinct(), "open")
    release(postings, needed, pairs, labels)
    lists = stored(_prefixes(sets.join(rest, "doc", "left_semi"), rest), "prefixes")
    pairs = stored(_met_by_prefix(lists), "pairs")
    release(lists, rest)
    labels = components(near.unionByName(_verified(pairs, sets)))
    release(sets, near, pairs)

    by_set = classes.join(labels, classes.doc == labels.node, "left").select("n", "s1", "s2", F.coalesce("component", "doc").alias("component"))
    outcome = sketches.select("doc", "n", "s1", "s2").join(by_set, ["n", "s1", "s2"], "left")
    outcome = outcome.select("doc", "n", F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component"))
    if outcome.filter("doc IS NOT NULL").groupBy("doc").count().filter("count > 1").isEmpty():
        return outcome.select("doc", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("kept"))
    least = outcome.groupBy("doc").agg(F.min("component").alias("component_id"))
    outcome = outcome.drop("component").join(least, "doc", "left")
    return outcome.select("doc", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, columns as they were, with one document of each component: that of the smallest id.

    Null and empty texts are near nothing: their rows stay. Of rows that repeat
    an id one stays; rows without id all stay. An empty table gives an empty
    table.
    """
    found = near_components(docs, id_col, text_col)
    gone = stored(found.filter("NOT kept").select(F.col("doc").alias("_gone")).distinct(), "gone")
    ids = F.col(f"`{id_col}`")
    (gone_col,) = fresh(docs, "_gone")
    left = docs.join(gone.withColumnRenamed("_gone", gone_col), ids.cast("long") == F.col(gone_col), "left_anti")
    if found.filter("doc IS NOT NULL").groupBy("doc").count().filter("count > 1").isEmpty():
        return left
    return left.filter(ids.isNull()).unionByName(left.filter(ids.isNotNull()).dropDuplicates([id_col]))
