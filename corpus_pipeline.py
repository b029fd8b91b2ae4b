"""The corpus pipeline: quality, toxicity, near-duplicates, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept.  All but the last return the columns of ``docs``; the last returns the
packed pieces.  Extra columns pass through the first four stages untouched.
Nulls: a null text is judged as an empty one and stays null.  An empty table
stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm.common import checksum, load, stored
from offerlake.llm.minhash import NearDuplicates
from offerlake.llm.packing import CuttingStock
from offerlake.llm.pii import PersonalData
from offerlake.llm.quality import PassageAttention
from offerlake.llm.toxicity import FactorizationMachine

#: The pipeline's files are those of the documents table; models learn from it with its labels, outside their held-out folds.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.3, as in ``op6``."""
    model = PassageAttention().fitted(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), "quality", checksum("doc_id") % 5 != 0)
    return docs.filter(model.score(F.col("text")) >= 0.3)


def civil_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.7, as in ``op9``."""
    model = FactorizationMachine().fitted(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), "toxic", checksum("doc_id") % 3 != 1)
    return docs.filter(model.score(F.col("text")) < 0.7)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, that with the smallest id."""
    return NearDuplicates().deduplicated(docs)


def private_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; ``n_chars`` counts the new text."""
    masked = PersonalData.trained().masked(F.col("text"))
    out = docs.withColumn("text", masked)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and offset."""
    packed = CuttingStock(TOKENIZER).packed(docs)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", good_documents),
    ("toxicity", civil_documents),
    ("near_duplicates", distinct_documents),
    ("personal_data", private_documents),
    ("packing", packed_documents),
]

#: Learned scores, Viterbi paths and token ids are not expressible in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
