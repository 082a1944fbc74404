"""Folds and bounded samples of labelled documents, for the two operators that fit a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, folds: int) -> Column:
    """crc32 of the identifier as text, modulo `folds`."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, held_out: int, most: int, id_col: str, text_col: str) -> DataFrame:
    """(text, y) of at most `most` labelled documents outside the held-out fold, chosen by a hash of the identifier.

    The ids and labels are `most` rows at most, so they are broadcast and texts stay where
    they are. An identifier with several labels counts with the largest, one with several
    texts with the smallest; null labels don't count. Other columns of both have no influence.
    """
    # only the two columns, under names of their own, so that no other column's name can clash
    texts = docs.select(F.col(id_col).alias("text_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    chosen = (
        labels.where(F.col(label_col).isNotNull() & (remainder(id_col, folds) != held_out))
        .groupBy(F.col(id_col).alias("labelled_id")).agg(F.max(label_col).cast("double").alias("y"))
        .orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(most)
    )
    return texts.join(F.broadcast(chosen), F.col("text_id") == F.col("labelled_id")).groupBy("labelled_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")
