"""From raw documents to packed sequences: quality rules, line dedup, near-dedup, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plazaworks.llm.linededup import line_dedup
from plazaworks.llm.minhash import near_dedup
from plazaworks.llm.packing import pack
from plazaworks.llm.quality import quality_filter
from plazaworks.llm.shared import stored
from plazaworks.session import shipped


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, columns as they were; null and empty texts fail, repeated and null ids are rows like others."""
    return quality_filter(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that one of a smaller id has; n_chars follows the text.

    All rows stay: one that loses every line has an empty text. Rows without id
    and null texts stay as they are; rows that share an id drop nothing for
    each other's sake.
    """
    return line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id.

    Null and empty texts are near nothing and stay, as do rows without id; of
    rows that repeat an id one stays.
    """
    shipped(spark)
    return near_dedup(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' ids in sequences; a null or empty text is its end id alone, each row a document of its own."""
    shipped(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", repeated_lines), ("near_dedup", near_duplicates), ("packing", packing)]

#: The last stages aren't SQL's to express; tests hold the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each on what the one before left; an empty table gives an empty one.

    Columns of documents besides doc_id, text and n_chars are carried along whatever their names, up to the packing.
    """
    docs = shipped(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
