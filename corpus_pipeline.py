"""A corpus from raw documents to packed training sequences.

STAGES are applied in order; each works on all rows that the one before kept,
is written as Parquet and read again.  Documents that are in no language go; of
each group of near copies (five-word shingles, similarity 0.8 or more) the one
with the smallest id stays; documents that hold benchmark items go; personal
data become pseudonyms; what is left is tokenised and packed.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession

from logmill.llm import textkernel
from logmill.llm.decontamination import clean
from logmill.llm.language_id import in_a_language
from logmill.llm.ngram_jaccard import first_of_each
from logmill.llm.packing import default_vocabulary, pack
from logmill.llm.pii import without_pii


#: Setting of the session that holds the key of the pseudonyms, named so that Spark redacts it in its UI and event log; with the same key, equal values are linked across runs too.
PII_KEY = "spark.corpus.pii.secret"
_DRAWN = secrets.token_bytes(32)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language; a missing language is filled in."""
    return in_a_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return first_of_each(docs, size=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the table benchmark."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data, by the key in PII_KEY; where none is set, by one drawn for this session."""
    return without_pii(docs, spark.conf.get(PII_KEY, "").encode() or _DRAWN)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens, with their ids."""
    return pack(docs, default_vocabulary())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal_data", personal_data), ("packing", packing)]

#: SQL expresses none of the learned, aligned or tokenised stages; tests/llm/test_pipeline.py compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage makes of the table documents; a stage's own tables are deleted after it, and its result after the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs, before = textkernel.written(lambda: stage(spark, docs, sf_dir)), docs
        textkernel.dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
