"""From raw documents to packed training sequences, in five stages.

Each stage is one operator of ``proxyscope.llm``. It works on all rows that its predecessor
kept and is written as Parquet in the shared folder and read again before the next, so a
lost executor never repeats more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proxyscope.llm.common import read, stage
from proxyscope.llm.jaccard import keep_one_of_each
from proxyscope.llm.langid import keep_identified
from proxyscope.llm.lines import remove_repeats
from proxyscope.llm.mixing import mixed_documents
from proxyscope.llm.packing import pack_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; texts without a letter go."""
    return keep_identified(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines and passages that occur earlier."""
    return remove_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words that the mix takes, one row per pass."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised pieces with their places in training sequences."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("mix", mix),
    ("pack", pack),
]

# The network of the first stage is trained by gradient steps, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
