"""Corpus pipeline: language ID, near-duplicates, decontamination, personal data, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read again as the next
stage's documents. All stages but the last return the columns of ``documents``.

Cases that hold for every stage: an empty table gives an empty one; null ids, languages and sources are kept as they are; extra columns travel
along, whatever their names; texts of any length are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscreen.llm import decontaminate, language_id, pieces, pii, simhash
from quillscreen.llm.common import cut, documents


def keep_recognised_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter; every other text gets a learned language, and is kept if none could be learned.

    The classifiers learn from the stage's own labelled rows. Text in a language that was never learned is kept. Null, empty and letterless
    texts go; repeated rows stay or go together.
    """
    return language_id.keep_known(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of linked fingerprints.

    Null and blank texts have the fingerprint zero and are near copies of each other; rows that agree in id and text become one; a null id
    is kept only where no member of its component has an id; rows of one id with different texts are told apart by the text.
    """
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold at least 0.8 of an item's five-word shingles.

    Null texts and texts under five words hold nothing and stay; items under five words match nothing; repeated rows go together.
    """
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts and counts their characters anew.

    Every row stays; a null text stays null, with a null count, and a text without personal data stays as it is.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Size and digest of each text's SentencePiece encoding, and whether it decodes to the text.

    A null text encodes like the empty one, to no pieces; every row gives one row.
    """
    return pieces.piece_report(docs, pieces.default_model())


STAGES = [
    ("language_id", keep_recognised_language),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("sentencepiece", encode_pieces),
]
#: SQL can express neither the classifiers nor the transducer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
