"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm import decontam, idfiles, licenses, ngramjoin, packing, pii, quality, toxicity, urls, vectors
from lattice.llm.tokens import Vocabulary


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_vocabulary() -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def word_vocabulary() -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path("word_bpe_49k.json"), end_id=2, spaces=True, lower=True)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), byte_vocabulary(), 2048)


def op3_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.read_digest(idfiles.write_ids(_read(spark, sf_dir, "documents"), word_vocabulary()))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").alias("n_spans"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.classes(_read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


_keys: dict[str, bytes] = {}


def surrogate_key(spark: SparkSession) -> bytes:
    """The key of surrogates: ``spark.lattice.surrogates.key``, or, where that is unset, one drawn for this application."""
    given = spark.conf.get("spark.lattice.surrogates.key", None)
    return given.encode() if given else _keys.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replaced(docs, surrogate_key(spark)).withColumnRenamed("_entities", "n_entities")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _read(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_best_fit_packing, op3_token_id_files, op4_toxicity, op5_embedding_near_dedup, op6_ngram_jaccard_join, op7_decontamination, op8_pii_surrogates, op9_url_filter, op10_quality)}

#: What SQL can say of whole results; the other operators are held against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op5_embedding_near_dedup": vectors.oracle_sql(),
    "op6_ngram_jaccard_join": ngramjoin.oracle_sql(),
    "op7_decontamination": decontam.oracle_sql(),
    "op9_url_filter": urls.oracle_sql(),
}
