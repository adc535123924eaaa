"""A corpus pipeline over ``documents``: five stages, each written as Parquet
and read again as the next one's documents.

A stage takes (spark, docs, sf_dir), works on all rows of docs and returns
their columns, but the last, which returns the packed pieces.

In all stages texts are read whole, however long, columns that a stage does
not name pass through as they are, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import exact_dedup, language_id, mixing, ngram_join, packing
from shelfline.llm.common import stored
from shelfline.llm.queries import tokenizer

#: The least share of its main language that a document needs.
LEAST_SHARE = 0.5
#: How often a scarce source may be read when every document is read once.
MAX_EPOCHS = 1.5


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one main language; the model learns from four folds of
    five of the labelled ones.  Null and empty texts, and those without a
    letter, go.  Null ids and repeated rows stay; ties go to the language first
    by name."""
    model = language_id.learn(docs.where(~language_id.in_fold(F.col("doc_id"), 5, 0)))
    return language_id.keep_identified(docs, model, LEAST_SHARE)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, by a new digest index: that of the smallest
    id, one with a null id only where no other has the text, and of repeated
    rows one.  Null texts equal empty ones."""
    return exact_dedup.keep_first(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8), that of
    the smallest id.  Empty and null texts are near none.  Rows that share an
    id stay or go together; rows with a null id stay."""
    return ngram_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of scarce sources again as far as the
    mix asks for it.  A null source is the one with the empty name; rows that
    share id and source are used together, null ids too; an empty or null text
    counts one token; ties go to the smaller id."""
    return mixing.mixed(docs, max_epochs=MAX_EPOCHS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents packed into sequences of 2048 tokens; each row, repeated
    ones and null ids too, has pieces of its own.  A null text counts as empty;
    pieces of equal length are dealt in any order."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language_id", identified),
    ("exact_dedup", deduplicated),
    ("ngram_jaccard_join", unlike),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]

#: No stage but exact dedup can be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
