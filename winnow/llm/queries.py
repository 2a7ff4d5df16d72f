"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from winnow.llm.packing import best_fit_pack

    return best_fit_pack(_read(spark, sf_dir, "documents"), f"{TOKENIZER_DIR}/byte_bpe_50k.json")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from winnow.llm.dartminhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def held_out() -> Column:
    """Rows that no model may learn from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from winnow.llm.langid import learn_prototypes, predict_language

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    learned = learn_prototypes(docs.where("not held_out and lang is not null"))
    return predict_language(docs.drop("lang"), learned).select("doc_id", "held_out", "lang_pred", "score")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from winnow.llm.urlfilter import RULES, judge_urls

    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def labelled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, text, toxic) of the documents a model may learn from."""
    labels = _read(spark, sf_dir, "labels").where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(labels.where(~held_out()), "doc_id")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from winnow.llm.spm import encode_documents

    return encode_documents(_read(spark, sf_dir, "documents"), f"{TOKENIZER_DIR}/piece_bpe_32k.model", with_ids=False)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from winnow.llm.lm import stupid_backoff

    return stupid_backoff(_read(spark, sf_dir, "documents"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from winnow.llm.omh import edited_fingerprints

    return edited_fingerprints(_read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from winnow.llm.toxicity import learn, score_toxicity

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    model = learn(labelled(spark, docs, sf_dir))
    return score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")


def op9_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from winnow.llm.sadedup import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents")).drop("kept_text")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from winnow.llm.lsh import near_duplicate_vectors

    return near_duplicate_vectors(_read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    from winnow.llm import lm, lsh, urlfilter

    return {"op4_url_filters": urlfilter.oracle(), "op6_lm_scoring": lm.ORACLE, "op10_embedding_near_dedup": lsh.ORACLE}
