"""Documents to packed training sequences in five stages; each stage's result is written and read again.

Every stage takes rows with nulls in any column, empty and very long texts, repeated rows and further columns, which come
back as they are, and gives an empty table for an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factloom.llm import compression, language, lines, packing, simhash
from factloom.llm.common import written

#: No stage after language ID can be told in SQL.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, without a language that holds a fifth of the letters, or with letters far less likely
    than those of taught documents in every language (other languages and scripts, letter junk) go."""
    return language.known_language(docs, language.fit(docs, floor=True))


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier calls bad go; it learns from the labels of those that are left.

    A null text scores as an empty one; a score of the threshold itself is good; repeated rows fare alike. Without labels
    of both kinds all documents have the share of good ones as score.
    """
    model = compression.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return compression.good_ones(docs, model)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the one with the smallest id; ``n_chars`` is counted anew.

    No document goes: one that loses all its lines, or had none, stays with an empty text. Rows without an id are one
    document that comes last, repeated rows of one id are one document.
    """
    return lines.without_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id.

    Documents are linked by fingerprints of four-word shingles that differ in at most four bits. Texts without words are
    copies of each other. Repeated rows of the id that stays all stay; a row without an id cannot be named as a copy and stays.
    """
    return simhash.one_of_each(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as pieces of at most 1024 tokens in as few sequences as packing finds. A null or empty text is its end token.

    Rows without an id have a null one; repeated rows are packed each.
    """
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("quality", judge_quality),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_copies),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that pass all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
