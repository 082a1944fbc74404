"""Whole pipelines from file to file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cordon.config import SEED
from cordon.operators import quotes
from cordon.sources import files


def build_and_save_canonical(spark: SparkSession, csv: str, out: str, seed: int = SEED) -> DataFrame:
    """Raw quotes of a CSV file to canonical quotes, written as Parquet and read again."""
    files.write_parquet(quotes.canonical_quotes(files.read_quotes_csv(spark, csv), seed), out)
    return files.read_parquet(spark, out)
