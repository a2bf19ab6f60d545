"""Corpus pipeline: toxicity, exact duplicates, near duplicates, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept. All but the last return the columns of documents.

Decisions are made and applied by row, not by id. Edge cases: null counts as
empty text, which isn't toxic; of rows that repeat an id and a text one stays;
an id that comes with two texts is two documents; null ids are documents too
(the last choice of a group); null lang or source count as the empty text; an
empty table goes through all stages; other columns are kept, whatever their
names, by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, dedup, mixing, neardup, toxicity
from weftline.llm.common import Scratch, keyed, small_batches, table, without_rows

#: The budget of tokens, as a quotient; a document is read once at most.
MIX = {"fraction": (3, 5), "max_epochs": 1}


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5."""
    small_batches(spark)
    model = toxicity.train_on(docs, table(spark, sf_dir, "labels"))
    score = toxicity.score_column(model, spark)
    return docs.filter(score("text") < 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of equal texts."""
    scratch = Scratch(spark, "exact")
    rows, key = keyed(docs, scratch, repeatable=True)
    dropped = scratch.save(dedup.later_copies(rows, key, scratch), "dropped")
    scratch.drop("looked_up", "verified", "copies")
    return without_rows(rows, key, dropped)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates."""
    scratch = Scratch(spark, "near")
    rows, key = keyed(docs, scratch, repeatable=True)
    dropped = scratch.save(neardup.later_members(rows, key, scratch), "dropped")
    scratch.drop("signed", "reps", "wanted", "dense", "labels", "labels1", "named", "members")
    return without_rows(rows, key, dropped)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the budgets of domain, language and source select."""
    scratch = Scratch(spark, "mix")
    rows, key = keyed(docs, scratch, repeatable=True)
    kept = mixing.selected(rows, key, scratch, **MIX)
    scratch.drop("tokens", "plan")
    return kept.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the digests of ids and decoded text."""
    return bpe.encode_documents(docs, ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The classifier, MinHash and token ids aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents in order, writing what each stage keeps."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, name)
            if i:
                scratch.drop(STAGES[i - 1][0])
    return docs
