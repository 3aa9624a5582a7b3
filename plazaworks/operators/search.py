"""Library search: the best chunk of each document by cosine, names by trigrams, merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plazaworks.functions.similarity import cosine_with
from plazaworks.functions.text import trigram_similarity
from plazaworks.operators.joins import best_per_group
from plazaworks.operators.trigrams import TextIndex, similar_keys

VECTOR_HIT, NAME_HIT, FALLBACK_HIT = 0.75, 0.5, 0.4


def hybrid(documents: DataFrame, chunks: DataFrame, query_text: str, query_vector: list[float] | None, vector_hit: float = VECTOR_HIT, name_hit: float = NAME_HIT, fallback_hit: float = FALLBACK_HIT, categories: DataFrame | None = None, category: str | None = None, titles: TextIndex | None = None, digests: TextIndex | None = None) -> DataFrame:
    """(doc, url, title, score, chunk), the best first.

    documents has doc, url, title, digest, chunks doc, chunk, embedding, and
    categories doc, slug: with a category only documents in it are searched.
    Documents without a digest aren't found, and a blank query finds none. A
    document is hit by its best chunk's cosine, by its title, or both (the
    larger counts); one without vectors by title or digest. Of documents with
    one address the best stays. With indexes of titles and digests (by doc) only
    documents that their lists or a vector tell of are compared; the result is
    the same.
    """
    documents = documents.filter(F.col("digest").isNotNull() if query_text.strip() else F.lit(False))
    if category is not None:
        documents = documents.join(categories.filter(F.col("slug") == category).select("doc"), "doc", "left_semi")
    title = trigram_similarity(F.col("title"), F.lit(query_text))
    digest = trigram_similarity(F.col("digest"), F.lit(query_text))
    named = documents.withColumns({"title_score": title, "digest_score": digest})
    with_vectors = chunks.filter(F.col("embedding").isNotNull())
    best = best_per_group(with_vectors, "doc", cosine_with(F.col("embedding"), query_vector), "chunk") if query_vector else with_vectors.select("doc", F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("chunk")).limit(0)
    if titles is not None and digests is not None:
        told = similar_keys(titles, query_text, min(name_hit, fallback_hit)).unionByName(similar_keys(digests, query_text, fallback_hit)).select(F.col("key").alias("doc"))
        named = named.join(told.unionByName(best.filter(F.col("score") >= vector_hit).select("doc")).distinct(), "doc", "left_semi")
    joined = named.join(best.withColumnRenamed("score", "cosine"), "doc", "left")
    by_vector, by_name = F.col("cosine") >= vector_hit, F.col("title_score") >= name_hit
    score = (
        F.when(F.col("cosine").isNull(), F.when(F.greatest("title_score", "digest_score") >= fallback_hit, F.greatest("title_score", "digest_score")))
        .when(by_vector & by_name, F.greatest("cosine", "title_score"))
        .when(by_name, F.col("title_score"))
        .when(by_vector, F.col("cosine"))
    )
    hits = joined.withColumn("score", score).filter(F.col("score").isNotNull()).withColumn("chunk", F.when(by_vector, F.col("chunk")))
    first = F.row_number().over(W.partitionBy("url").orderBy(F.desc("score"), "title", "doc"))
    return hits.withColumn("_n", first).filter("_n = 1").select("doc", "url", "title", "score", "chunk").orderBy(F.desc("score"), "title", "url")


def shown(hits: DataFrame, documents: DataFrame, bodies: DataFrame, categories: DataFrame, links: DataFrame) -> DataFrame:
    """hits (of hybrid()) as readers see them: with licence, categories (names in their order), snippet and film_url.

    documents has doc, digest and licence, bodies chunk and body, categories
    doc, slug and name, links doc, id, kind and url. The snippet is the chunk
    that was hit, or the digest without one; the film is the first link to a
    video. A document without categories has an empty list.
    """
    named = categories.groupBy("doc").agg(F.transform(F.array_sort(F.collect_set(F.struct("slug", "name"))), lambda x: x["name"]).alias("categories"))
    films = links.filter("kind = 'video'").groupBy("doc").agg(F.min_by("url", "id").alias("film_url"))
    found = hits.join(documents.select("doc", "digest", "licence"), "doc").join(bodies.select("chunk", "body"), "chunk", "left")
    found = found.join(named, "doc", "left").join(films, "doc", "left")
    snippet = F.when(F.col("chunk").isNotNull(), F.col("body")).otherwise(F.col("digest")).alias("snippet")
    none = F.array().cast("array<string>")
    return found.select("doc", "url", "title", "score", "licence", F.coalesce("categories", none).alias("categories"), snippet, "film_url").orderBy(F.desc("score"), "title", "url")


def nearest(chunks: DataFrame, vector: list[float], k: int, key: str = "chunk") -> DataFrame:
    """The k rows with the largest cosine; the smallest key among equals."""
    rated = chunks.select(key, cosine_with(F.col("embedding"), vector).alias("score"))
    return rated.orderBy(F.desc("score"), key).limit(k)
