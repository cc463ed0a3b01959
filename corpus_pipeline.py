"""Training corpus from raw documents: stages over the operators in ``faultatlas.llm``.

Each stage works on all that the one before it kept and reads it as Parquet.  All but
the last return the columns of ``documents`` (and any others the rows have).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultatlas.llm import jaccard, language, packing, private, quality
from faultatlas.llm.worker import small_batches
from faultatlas.plans.layout import checkpoint_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

ACCEPTED_QUALITY = 0.3
# Near copies share 80 percent of their runs of five words; op9's own query has its contract's four words and 85.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier accepts."""
    small_batches(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality.quality_of(model, F.col("text")) >= ACCEPTED_QUALITY)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified with enough confidence."""
    small_batches(spark)
    model = language.fit(docs)
    return docs.where(language.language_of(model, F.col("text"))["accepted"])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of similar ones.

    Documents without a word are in no group and stay.  Of rows that repeat an id and
    a text one stays.
    """
    small_batches(spark)
    return jaccard.first_of_groups(docs, words=SHINGLE_WORDS, percent=SIMILAR_PERCENT)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates for personal data; ``n_chars`` follows the text."""
    replaced = private.pseudonymize(docs)
    if "n_chars" not in docs.columns:
        return replaced
    return replaced.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document, placed in sequences of at most 2048 ids."""
    small_batches(spark)
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_quality),
    ("language_id", keep_known_language),
    ("ngram_jaccard", keep_one_of_each_group),
    ("private_surrogates", replace_private),
    ("best_fit_packing", pack_sequences),
]

# Models, keyed surrogates and the packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline/{uuid.uuid4().hex}"
    for place, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{place}_{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
