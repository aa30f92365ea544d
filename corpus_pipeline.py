"""A corpus pipeline of four stages: language, near copies, personal data, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet in the shared folder and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import langid, packing, pii, simhash
from panelforge.llm.common import remove, shared_folder, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach.

    What goes: null texts, texts without a letter, and those whose words equally likely bytes explain better than every learned language. All rows are
    judged alone, so repeated rows stay or go together; ids and other columns are not looked at. Without a label nothing is known, and all go; an
    empty table stays empty. Texts of any length are judged whole.
    """
    return langid.keep_known(docs, langid.train(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: a row with the smallest id. Links are op8's, so edited copies mostly stay (README: recall).

    Null and empty texts are alike, one of them stays; rows without an id all stay; of rows that repeat id and text one stays, unlike texts under one id
    are judged apart. An empty table stays empty; texts of any length are read whole.
    """
    return simhash.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data in their whole texts replaced by its kind, and ``n_chars`` counted anew where a text has changed.

    Null texts stay null, empty ones empty, repeated rows repeated and alike. Where too little is there to learn from, the fixed formats alone are
    replaced. An empty table stays empty.
    """
    return pii.redact(docs, pii.train(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their places in sequences of at most 1024 tokens.

    A null or empty text is its end token; longer texts are cut into pieces; every row is packed, repeated ones and those without an id too. An
    empty table gives no piece.
    """
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language_id", known_language),
    ("near_dedup", without_near_copies),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: The stages learn models and run a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's rows are deleted once the next one's are written."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            remove(spark, f"{folder}/{before}")
        before = name
    return docs
