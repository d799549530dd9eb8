"""The corpus pipeline: toxic documents go, then boilerplate lines, near duplicates and repeated strings; what is left is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the columns of documents;
n_chars follows the text. Near duplicates have a Jaccard similarity of 0.8 or more on five-word shingles.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and further columns of any name, which it returns as they
are. A null text is scored and packed as an empty one, stays null in line dedup and suffix-array dedup (its n_chars is null), and is a near duplicate of
other texts without words. Rows with a null id come after all others, so copies of them stay rather than they. Of repeated rows (alike in id and text)
near-duplicate removal keeps one; the other stages treat each alike.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm import line_dedup, near_duplicates, packing, suffix_dedup, toxicity
from kgloom.llm.common import discard, written


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*(F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels.where(~toxicity.held_out())))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(line_dedup.drop_boilerplate(docs), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(suffix_dedup.without_repeats(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeats),
    ("best_fit_packing", pack),
]

#: SQL cannot express the classifier, the fingerprints or the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each stage's result written to the shared folder and read again; what a stage has read goes when its own is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
