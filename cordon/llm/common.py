"""Shared pieces of the training-data operators: tables, the shared folder, Arrow passes."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cordon.shared import shared_dir

#: ASCII white space, [\x20\x09-\x0D], as a Java regex class and as characters to trim.
WS_CLASS = "[\\x20\\x09-\\x0D]"
WS_CHARS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows that Parquet's reader decodes at once. It holds their texts in one piece of memory that doubles as it grows, in
#: every task: with Spark's 4,096 rows that is more than a heap has where texts are long.
READ_ROWS = 64


def read_in_portions(spark: SparkSession) -> None:
    """From now on the session's readers decode READ_ROWS rows at once at most; results are lazy, so this stays."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(key)) > READ_ROWS:
        spark.conf.set(key, str(READ_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read_in_portions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


#: Rows that go to a Python worker at once while a table is written; with whole texts in them, fewer than Spark's default.
BATCH_ROWS = 4000


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Within, plans that are run send at most so many rows at once to Python workers; then the session is as before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, written as Parquet in the shared folder and read again.

    This cuts the lineage: a lost executor costs no recomputation of what lies before, and
    whatever is read more than once is computed once. Readers prune its columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    read_in_portions(spark)
    with batches_of(spark, BATCH_ROWS):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once a row.

    A column named inside a lambda would be computed for every element; a lambda's own
    variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
