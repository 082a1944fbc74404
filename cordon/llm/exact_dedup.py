"""Exact dedup by content sort, in DataFrame operations only.

Rows are range-partitioned by content: the order is that of the first characters, then a
64-bit hash, then the whole text, and Spark samples splitters for the first two, so that
splitters stay short however long the texts are. Each partition is sorted externally, equal
texts become neighbours, and the window over the whole text compares them in full.

A text held by very many rows would fill one partition. A first pass counts rows by hash;
texts of hashes over the limit (a quarter of a mean partition, so at most four times as many
as there are partitions) are dealt over all partitions by a salt, compared in full within
each share, and the shares' results, one row a text and salt, are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cordon.llm.common import partitions, written

PREFIX = 32


def content_sorted(docs: DataFrame, text: Column, id_col: str, keep: str, carry: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows with their (share of a) group: t_id, t_text_sha, t_hot, t_salt, t_first (rank 1 in the share),
    t_keep, t_size and `carry`; and hot groups put together: g_sha, g_keep, g_size."""
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col(id_col).alias("t_id"), F.coalesce(text, F.lit("")).alias("t_text"), *carry).withColumn("t_hash", F.xxhash64("t_text"))
    limit = max(64, docs.count() // (4 * n))
    hot = rows.groupBy("t_hash").count().where(F.col("count") > limit).select("t_hash", F.lit(True).alias("t_hot"))
    order = F.col("t_id").asc_nulls_last() if keep == "smallest" else F.col("t_id").desc_nulls_last()
    group = W.partitionBy("t_prefix", "t_hash", "t_salt", "t_text").orderBy(order)
    whole = group.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    shares = (
        rows.join(F.broadcast(hot), "t_hash", "left")  # at most 4 n rows
        .withColumn("t_hot", F.coalesce("t_hot", F.lit(False)))
        .withColumn("t_salt", F.when(F.col("t_hot"), F.pmod(F.xxhash64("t_id"), F.lit(n))).otherwise(0))
        .withColumn("t_prefix", F.substring("t_text", 1, PREFIX))
        .repartitionByRange(n, "t_prefix", "t_hash", "t_salt")
        .withColumn("t_first", F.row_number().over(group) == 1)
        .withColumn("t_keep", F.first("t_id").over(whole))
        .withColumn("t_size", F.count(F.lit(1)).over(whole))
        .withColumn("t_sha", F.unhex(F.sha2("t_text", 256)))
        .drop("t_text", "t_prefix", "t_hash")
    )
    best = F.min if keep == "smallest" else F.max
    return shares, lambda table: (
        table.where("t_hot and t_first").groupBy(F.col("t_sha").alias("g_sha")).agg(best("t_keep").alias("g_keep"), F.sum("t_size").alias("g_size"))
    )


def exact_dedup(docs: DataFrame, keep: str = "smallest", normalise=lambda c: c, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Null texts count as empty and are equal to it. Of rows that repeat both identifier and
    text one is marked kept. Null identifiers come after all others. An empty table gives no
    rows. Other columns are ignored, whatever their names.
    """
    shares, together = content_sorted(docs, normalise(F.col(text_col)), id_col, keep, [])
    shares = written(shares, "exact-dedup")
    return shares.join(F.broadcast(together(shares)), F.col("t_hot") & (F.col("t_sha") == F.col("g_sha")), "left").select(
        F.col("t_id").alias(id_col),
        F.coalesce("g_keep", "t_keep").alias("keep_id"),
        F.coalesce("g_size", "t_size").alias("group_size"),
        (F.col("t_first") & (F.col("t_id").eqNullSafe(F.coalesce("g_keep", "t_keep")))).alias("kept"),
        F.lower(F.hex("t_sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, keep: str = "smallest", normalise=lambda c: c, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns; texts travel once."""
    shares, together = content_sorted(docs, normalise(F.col(text_col)), id_col, keep, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("t_row")])
    shares = written(shares.where("t_first"), "exact-dedup")
    stays = shares.join(F.broadcast(together(shares)), F.col("t_hot") & (F.col("t_sha") == F.col("g_sha")), "left").where(F.col("g_sha").isNull() | F.col("t_id").eqNullSafe(F.col("g_keep")))
    return stays.select(*[F.col("t_row").getField(c).alias(c) for c in docs.columns])
