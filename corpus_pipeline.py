"""Corpus pipeline: quality rules, quality classifier, exact dedup, near-duplicate join, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of documents. run() writes each stage's result and reads it again for the next.

Defined results of every stage: null texts count as empty; an empty table gives an empty
table; extra columns pass through all stages but the last unchanged, whatever their names;
texts of any length are read whole; no stage depends on the order of rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordon.llm import exact_dedup, jaccard_join, packing, quality_classifier, quality_rules
from cordon.llm.common import table, written
from cordon.llm.queries import BPE_FILE, trusted


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Empty texts and those of too few words fail the base rules and go. Repeated rows are judged
    alike, each by its own text; a doc_id that is null is trusted by no label. Without labels
    all ratios are 0, and the base rules alone decide.
    """
    scored = quality_rules.quality_rules(docs, trusted(spark, sf_dir), carry=True)
    return scored.where("kept").select("row.*")


#: Documents with a lower score are rejected. Scores are calibrated, so that this is the point of even odds.
REJECT_BELOW = 0.5


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labelled documents of the corpus, does not reject.

    The model is fitted on the table of documents, since the rules before have removed most of
    the labelled documents of low quality. Repeated rows get equal scores; scores at the
    threshold stay; without labels of both kinds all scores are 0.5, and all documents stay.
    """
    scored = quality_classifier.quality_classifier(docs, table(spark, sf_dir, "labels"), carry=True, fit_on=table(spark, sf_dir, "documents"))
    return scored.where(F.col("score") >= REJECT_BELOW).select("row.*")


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id; of rows equal in both, one. Null and empty texts are equal."""
    return exact_dedup.keep_one(docs)


def distinct_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document with the smallest doc_id.

    Documents whose doc_id is null are compared with nothing and stay.
    """
    found = jaccard_join.near_duplicates(docs, words=5, percent=80)
    others = written(found.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct(), "other-copies")
    way = "broadcast" if others.count() <= jaccard_join.LISTED else "merge"  # while the list is short, texts stay where they are
    return docs.join(others.hint(way), "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their places in sequences of 2048 tokens.

    An empty text is one piece of the end token alone; repeated rows are packed each for itself;
    pieces of equal length are ordered by a key of doc_id, start and checksum.
    """
    return packing.pack(docs, public_tokenizers.path(BPE_FILE))


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("exact_dedup", distinct_texts),
    ("jaccard_join", distinct_groups),
    ("packing", packed),
]

#: Hashes, a fitted model and a tokenizer are not for SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
