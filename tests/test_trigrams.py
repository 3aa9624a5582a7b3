"""Search by lists gives what a scan gives, and reads only the lists it needs."""

import random

import pytest
from pyspark.sql import functions as F

from plazaworks.functions import text
from plazaworks.operators import chat, search, trigrams
from plazaworks.operators.filters import contains_text

WORDS = "tea teapot house houses walk walking the of thing no-thing ąę zażółć 12 123 x _a a_b it's Δx".split()


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(9)))) for k in range(400)] + [(900, None), (901, ""), (902, "!?")]
    return spark.createDataFrame(rows, "id long, body string").cache()


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("lists"))
    trigrams.write_index(trigrams.listed(texts, "id", "body", 16), where)
    return trigrams.read_index(spark, where, 16)


@pytest.mark.parametrize("query,least", [("tea house", 0.3), ("tea house", 1.0), ("walking the thing", 0.5), ("zażółć", 0.2), ("x", 0.05), ("!", 0.4), ("unknown words", 0.1), ("the of", 1 / 3)])
def test_similar_texts(texts, index, query, least):
    score = text.trigram_similarity(F.col("body"), F.lit(query))
    wanted = sorted((r.id, r.s) for r in texts.withColumn("s", score).filter(F.col("s") >= least).collect())
    assert sorted((r.id, r.score) for r in trigrams.similar(index, texts, "id", "body", query, least).collect()) == wanted


def test_a_search_needs_a_bound(texts, index):
    with pytest.raises(ValueError, match="bound"):
        trigrams.similar(index, texts, "id", "body", "tea", 0.0)


@pytest.mark.parametrize("part", ["tea", "TEA h", "e house", "ing th", "o-th", "x", "12", "123 ", " of ", "", "zażół", "_a", "it's", "Δx", "no such"])
def test_texts_that_hold_a_part(texts, index, part):
    wanted = sorted(r.id for r in texts.filter(contains_text(F.col("body"), part)).collect())
    assert sorted(r.id for r in trigrams.holding(index, texts, "id", "body", part).collect()) == wanted


def test_only_lists_of_the_query_are_read(spark, texts, index):
    every = index.lists.count()
    read = index.of(["tea", " te"])
    assert 0 < read.count() < every / 4
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(trigram" in plan
    # Rare lists first: "the" is in very many texts, what stands beside it in few.
    ordered = trigrams.by_length(index, ["the", "aż", "zaż", "none"])
    assert ordered[0] in ("none", "aż") and ordered[-1] == "the"
    assert {r["trigram"]: r["n"] for r in index.lengths.collect()} == {r["trigram"]: r["count"] for r in index.lists.groupBy("trigram").count().collect()}


def test_hybrid_search_by_lists(spark, texts):
    docs = texts.select(F.col("id").alias("doc"), F.concat(F.lit("u"), F.col("id") % 50).alias("url"), F.col("body").alias("title"), F.when(F.col("id") % 3 > 0, F.reverse("body")).alias("digest"))
    chunks = docs.filter("doc % 4 = 0").select("doc", (F.col("doc") * 10).alias("chunk"), F.array((F.col("doc") % 7).cast("double"), F.lit(1.0)).alias("embedding"))
    indexes = {"titles": trigrams.listed(docs, "doc", "title"), "digests": trigrams.listed(docs, "doc", "digest")}
    for query, vector in (("tea house", [1.0, 0.2]), ("walking the", None), ("!", [1.0, 0.0]), ("", [1.0, 0.0])):
        scan = search.hybrid(docs, chunks, query, vector).collect()
        assert search.hybrid(docs, chunks, query, vector, **indexes).collect() == scan and (scan or query == "")


def plain_likeness(query, body):
    ordered, wanted = text.trigrams_of(body), set(text.trigrams_of(query))
    best = 0.0
    for start in (i for i, t in enumerate(ordered) if t in wanted):
        seen = set()
        for t in ordered[start:]:
            seen.add(t)
            if t in wanted:
                best = max(best, len(seen & wanted) / len(seen | wanted))
    return best


@pytest.mark.parametrize("query", ["thing", "tea house", "a walk the", "x", "!", "it's no-thing", "zażółć 12"])
def test_word_similarity_is_that_of_the_best_stretch(spark, query):
    rng = random.Random(query)
    bodies = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(40))) for _ in range(120)] + ["the " * 30 + "thing", "thing " + "of " * 50 + "tea house", "", "x" * 3000 + " thing"]
    df = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)] + [(999, None)], "k int, body string")
    rated = df.select("k", chat.word_similarity(query, F.col("body")).alias("x"))
    found = {r.k: r.x for r in rated.collect()}
    assert found.pop(999) == 0 and found == {k: pytest.approx(plain_likeness(query, b), abs=1e-12) for k, b in enumerate(bodies)}
    assert "Python" not in rated._jdf.queryExecution().executedPlan().toString()


def test_hits_as_readers_see_them(spark):
    hits = spark.createDataFrame([(1, "u1", "T1", 0.9, 10), (2, "u2", "T2", 0.8, None), (3, "u3", "T3", 0.8, None)], "doc long, url string, title string, score double, chunk long")
    documents = spark.createDataFrame([(1, "d1", "CC"), (2, "d2", None), (3, None, None), (4, "d4", "x")], "doc long, digest string, licence string")
    bodies = spark.createDataFrame([(10, "the chunk"), (11, "other")], "chunk long, body string")
    categories = spark.createDataFrame([(1, "b", "Second"), (1, "a", "First"), (1, "a", "First"), (4, "a", "First")], "doc long, slug string, name string")
    links = spark.createDataFrame([(2, 5, "video", "later"), (2, 4, "video", "first"), (2, 3, "zip", "z")], "doc long, id long, kind string, url string")
    rows = [(r.doc, r.licence, r.categories, r.snippet, r.film_url) for r in search.shown(hits, documents, bodies, categories, links).collect()]
    assert rows == [(1, "CC", ["First", "Second"], "the chunk", None), (2, None, [], "d2", "first"), (3, None, [], None, None)]
