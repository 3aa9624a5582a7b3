"""Search by lists of trigrams: which texts hold each, the shortest lists first.

A text index is a table (bucket, trigram, size, key): for each trigram of each
text the text's key and how many trigrams it has. It is stored by bucket, a
hash of the trigram, and sorted within, so that a search reads the files of its
own trigrams' buckets and of these the row groups that hold them. A second,
small table has the length of each list.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plazaworks.functions.text import runs_of, trigram_similarity, trigrams, trigrams_of
from plazaworks.operators.filters import contains_text

#: Files that an index is dealt into.
BUCKETS = 64


@dataclass(frozen=True)
class TextIndex:
    """Lists (bucket, trigram, size, key) and their lengths (bucket, trigram, n)."""

    lists: DataFrame
    lengths: DataFrame
    buckets: int = BUCKETS

    def of(self, wanted: list[str]) -> DataFrame:
        """The lists of these trigrams."""
        return _of(self.lists, wanted, self.buckets)


def _bucket(trigram: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(trigram.cast("binary")), F.lit(buckets)).cast("int")


def _of(table: DataFrame, wanted: list[str], buckets: int) -> DataFrame:
    here = sorted({zlib.crc32(t.encode()) % buckets for t in wanted})
    return table.filter(F.col("bucket").isin(here) & F.col("trigram").isin(wanted))


def listed(texts: DataFrame, key: str, text: str, buckets: int = BUCKETS) -> TextIndex:
    """The index of a table's texts, keys unique; texts without a word are in no list."""
    found = texts.select(F.col(key).alias("key"), trigrams(F.col(text)).alias("_all")).filter(F.size("_all") > 0)
    lists = found.select(F.explode("_all").alias("trigram"), F.size("_all").alias("size"), "key").withColumn("bucket", _bucket(F.col("trigram"), buckets))
    lengths = lists.groupBy("bucket", "trigram").agg(F.count("*").alias("n"))
    return TextIndex(lists.select("bucket", "trigram", "size", "key"), lengths, buckets)


def write_index(index: TextIndex, where: str) -> None:
    """Stores an index in a folder: a file or more for each bucket, sorted by trigram and size."""
    dealt = index.lists.repartition(index.buckets, "bucket").sortWithinPartitions("bucket", "trigram", "size", "key")
    dealt.write.partitionBy("bucket").mode("overwrite").parquet(f"{where}/lists")
    stored = index.lists.sparkSession.read.parquet(f"{where}/lists")
    stored.groupBy("bucket", "trigram").agg(F.count("*").alias("n")).repartition(1).sortWithinPartitions("trigram").write.mode("overwrite").parquet(f"{where}/lengths")


def read_index(spark: SparkSession, where: str, buckets: int = BUCKETS) -> TextIndex:
    return TextIndex(spark.read.parquet(f"{where}/lists"), spark.read.parquet(f"{where}/lengths"), buckets)


def by_length(index: TextIndex, wanted: list[str]) -> list[str]:
    """The trigrams, those with the shortest lists first; at most as many rows as a search text has trigrams are read."""
    n = {r["trigram"]: r["n"] for r in _of(index.lengths, wanted, index.buckets).collect()}
    return sorted(wanted, key=lambda t: (n.get(t, 0), t))


def similar_keys(index: TextIndex, query: str, least: float) -> DataFrame:
    """(key) of all texts whose trigram similarity to the query is least or more, and of few others, each once.

    A text so alike shares all but w - least * w of the query's w trigrams,
    so it is in one of that many lists and one more: the shortest ones are read,
    and of them only texts whose size allows the similarity.
    """
    wanted = sorted(set(trigrams_of(query)))
    if not 0 < least <= 1:
        raise ValueError("without a bound above 0 all texts are similar enough")
    w = len(wanted)
    # Rounding mustn't cost a text at the bound itself.
    shared = max(1, -int(-(least * w - 1e-9) // 1))
    first = by_length(index, wanted)[: w - shared + 1]
    return index.of(first).filter(F.col("size").between(least * w - 1e-9, w / least + 1e-9)).select("key").distinct()


def similar(index: TextIndex, texts: DataFrame, key: str, text: str, query: str, least: float, name: str = "score") -> DataFrame:
    """Rows of texts whose trigram similarity to the query is least or more, with it: what a scan of all texts gives."""
    keys = similar_keys(index, query, least).withColumnRenamed("key", key)
    rated = texts.join(keys, key, "left_semi").withColumn(name, trigram_similarity(F.col(text), F.lit(query)))
    return rated.filter(F.col(name) >= least)


def holding_keys(index: TextIndex, part: str) -> DataFrame | None:
    """(key) of all texts that hold the part in any case, and of some others; None if the part has no three letters in a row, which no list tells of.

    What stands at the part's ends may go on in a text; only trigrams within
    its words, and the ends of words that blanks or signs close off, are asked for.
    """
    wanted = sorted({t for run, opens, closes in runs_of(part) for w in [("  " if opens else "") + run + (" " if closes else "")] for t in (w[i : i + 3] for i in range(len(w) - 2))})
    if not wanted:
        return None
    # Most lists make the result no smaller; the shortest few do.
    first = by_length(index, wanted)[:4]
    held = index.of(first).groupBy("key").agg(F.count("*").alias("n"))
    return held.filter(F.col("n") == len(first)).select("key")


def holding(index: TextIndex, texts: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """Rows of texts that hold the part in any case: what a scan of all texts gives. A part that no list tells of is looked for in all."""
    keys = holding_keys(index, part)
    if keys is not None:
        texts = texts.join(keys.withColumnRenamed("key", key), key, "left_semi")
    return texts.filter(contains_text(F.col(text), part))
