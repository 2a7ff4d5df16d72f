"""Corpus pipeline: stages over documents, each written and read again.

toxicity -> language ID -> MinHash near-dedup -> suffix-array dedup -> packing.
Every stage works on all rows its predecessor kept; all but the last return the
columns they got.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.dartminhash import near_duplicates
from winnow.llm.langid import UNKNOWN, learn_prototypes, predict_language
from winnow.llm.packing import best_fit_pack
from winnow.llm.queries import TOKENIZER_DIR, held_out, labelled
from winnow.llm.sadedup import remove_repeats
from winnow.llm.toxicity import learn, score_toxicity
from winnow.storage import lasting, scratch

MIN_LANGUAGE_SCORE = 0.04  # of a text of few n-grams; clean texts of a single word lie above
FEW_GRAMS = 30  # different ones; the floor rises with each further one
SCORE_PER_GRAM = 0.002
MAX_LANGUAGE_SCORE = 0.35  # of long texts; ones of a learned language lie above, unlearned ones and junk below


def _carried(docs: DataFrame) -> DataFrame:
    """The whole row as one column, so that no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def language_floor(n_grams: Column) -> Column:
    """The least score a text of so many different n-grams must reach."""
    rising = MIN_LANGUAGE_SCORE + SCORE_PER_GRAM * (n_grams - FEW_GRAMS)
    return F.greatest(F.lit(MIN_LANGUAGE_SCORE), F.least(F.lit(MAX_LANGUAGE_SCORE), rising))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic; learns as op8 does.  Null and empty
    texts have no vote and stay, as do null ids; repeated rows are judged alike."""
    model = learn(labelled(spark, docs, sf_dir))
    return score_toxicity(_carried(docs), model, "row.text").where("predicted = 0").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and ones like no learned language;
    where nothing can be learned, only the former.  Null texts go; null ids and
    repeated rows are judged like any other."""
    protos = learn_prototypes(docs.select("text", "lang").where(F.coalesce(~held_out(), F.lit(False))))
    floor = language_floor(F.col("n_grams")) if protos else F.lit(0.0)
    judged = predict_language(_carried(docs), protos or {"any": learn_any()}, "row.text")
    return judged.where(F.col("lang_pred") != UNKNOWN).where(F.col("score") >= floor).select("row.*")


def learn_any():
    """A prototype that any text with a letter may match."""
    import numpy as np

    from winnow.llm.langid import DIM

    return np.ones(DIM) / DIM**0.5


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the one with the smallest id.  A row
    given twice is kept once; rows with a null id stay."""
    kept = near_duplicates(docs.select("doc_id", "text")).where("kept and doc_id is not null").select("doc_id").distinct()
    known = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return known.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated strings out of the texts; n_chars follows.  Every row
    stays; null texts become empty, null ids are not cut, repeated rows are cut
    alike."""
    cut = remove_repeats(docs, carry=True)
    changed = F.col("n_removed") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return cut.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every row into sequences of 2048 tokens, as op1 does; null and
    empty texts are one token, an empty table gives an empty result."""
    return best_fit_pack(docs, f"{TOKENIZER_DIR}/byte_bpe_50k.json")


STAGES = [("toxicity", toxicity), ("language_id", language_id), ("minhash", minhash), ("suffix_array", suffix_array), ("packing", packing)]
ORACLE_SQL = None  # no stage can be stated in SQL; tests/llm holds them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; tables that a stage writes for itself go once
    its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch():
            docs = lasting(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
