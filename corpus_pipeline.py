"""A corpus pipeline: language ID, exact dedup, near-duplicate join, mixing and BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. run() applies them to the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.llm import bpe, exact_dedup, language_id, mixing, ngram_join
from pricewren.llm.common import cut, hash_mod
from pricewren.llm.queries import MIX, WORD_BPE

#: A document is rejected when no language is found in it, or none with more than this mean probability.
LEAST_SCORE = 0.3
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; trained on the labelled rows of docs itself, of which a fifth is held out."""
    found = language_id.identify(docs, hash_mod("doc_id", 5) != 0)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") > LEAST_SCORE)).select(*COLUMNS)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, white space aside; null, empty and blank texts are one."""
    return exact_dedup.drop_duplicates(docs).select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row, by doc_id, of each class of near copies; documents without links stay."""
    return ngram_join.keep_one_a_class(docs).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: one row for each epoch."""
    taken = mixing.mix(docs, **MIX)
    return taken.withColumn("_epoch", F.explode(F.sequence(F.lit(1), F.col("mix_epochs").cast("int")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each row's ids and decoded text; null counts as empty, and a row taken twice has two rows."""
    return bpe.digests(bpe.encode(docs, WORD_BPE))


STAGES = [
    ("language ID", known_language),
    ("exact dedup", distinct_texts),
    ("n-gram Jaccard join", one_of_near_copies),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return docs


ORACLE_SQL = None
