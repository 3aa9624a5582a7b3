"""The corpus operators as registered queries."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plazaworks.llm import bpe, html, lattice, licenses, linededup, minhash, packing, periods, quality, secrets, tokenfile, warc, whitening
from plazaworks.session import shipped

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: The vocabulary of the token queries.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shipped(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op5_quality_rules", quality.ORACLE_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = quality.with_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return read.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


@_query("op3_line_dedup", linededup.ORACLE_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = linededup.with_line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return read.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.col("line_dedup.text"), 256).alias("kept_sha256"))


@_query("op1_minhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = minhash.near_components(_table(spark, sf_dir, "documents"))
    return read.withColumnRenamed("doc", "doc_id")


@_query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), VOCABULARY)


@_query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_file_round_trip(_table(spark, sf_dir, "documents"), VOCABULARY)


@_query("op8_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY).select("doc_id", "ids")
    read = bpe.decode(read, VOCABULARY)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return read.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query("op9_license_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = licenses.with_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return read.select("doc_id", *[f"licenses.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])


@_query("op10_embedding_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(_table(spark, sf_dir, "embeddings"))


@_query("op2_html_main_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = html.with_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), name="text")
    return read.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@_query("op4_warc", warc.ORACLE_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


@_query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digests(_table(spark, sf_dir, "documents"))


@_query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_vectors(_table(spark, sf_dir, "embeddings"))


@_query("op12_secret_scan", secrets.ORACLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    read = secrets.with_secrets(docs.select("doc_id", "text"), secrets.model_of(docs))
    return read.select("doc_id", *[f"secrets.{c}" for c in ("n_assign", "n_access", "n_hex")], F.sha2(secrets.joined(F.col("secrets.base")), 256).alias("base_sha256"), secrets.joined(F.col("secrets.spans")).alias("spans"))
