"""Line dedup in DataFrame operations only: explode, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordon.llm.common import WS_CHARS, let, lower_ascii

#: Shares of a line's places.
SALTS = 16


def line_keys(text: Column) -> Column:
    """A key for each line: ASCII white space stripped, A-Z lower-cased. Text in ASCII takes the cheaper lower()."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(lower_ascii(text))
    return F.transform(F.split(low, "\n", -1), lambda x: F.btrim(x, F.lit(WS_CHARS)))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_lines, n_dropped, kept_sha256 and kept_text.

    Every row is a document. Null and empty texts are one empty line, which no threshold
    drops (min_chars is at least 1). Rows that repeat identifier and text give equal rows.
    A text of which all lines go becomes "". Other columns are ignored.

    Keys travel as 128-bit hashes. A document sends each of its distinct keys once, and
    counts are summed before they are shuffled, so a line that a third of all documents hold
    is no burden. Positions of lines join the frequent hashes in SALTS shares; that join has
    the long side left, where adaptive execution splits what still fills a partition. Whole
    texts move
    once, to meet their dropped positions, and are put together from the slices between.
    """
    rows = docs.select(F.col(id_col).alias("d"), F.coalesce(text_col, F.lit("")).alias("t")).withColumn("v", F.xxhash64("t"))
    hashed = rows.select("d", "v", F.transform(line_keys(F.col("t")), lambda k: F.when(F.length(k) >= max(1, min_chars), F.struct(F.xxhash64(k).alias("a"), F.xxhash64(k, F.lit(1)).alias("b")))).alias("k"))
    frequent = hashed.select(F.explode(F.array_distinct(F.filter("k", lambda x: x.isNotNull()))).alias("k")).groupBy(F.col("k.a").alias("a"), F.col("k.b").alias("b")).count().where(F.col("count") >= min_docs).select("a", "b")
    at = hashed.select("d", "v", F.posexplode("k").alias("p", "k")).where("k is not null").select("d", "v", "p", F.col("k.a").alias("a"), F.col("k.b").alias("b"))
    # a line of a third of all documents is met in SALTS places
    salted = at.withColumn("s", F.pmod(F.xxhash64("d", "p"), F.lit(SALTS)).cast("int"))
    places = frequent.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    gone = salted.join(places, ["a", "b", "s"], "left_semi").groupBy(F.col("d").alias("gd"), F.col("v").alias("gv")).agg(F.array_sort(F.collect_set("p")).alias("p"))
    met = rows.join(gone, F.col("d").eqNullSafe(F.col("gd")) & (F.col("v") == F.col("gv")), "left")

    def kept(lines: Column, cut: Column) -> Column:
        """The slices of lines between the cuts."""
        ends = F.concat(F.array(F.lit(-1)), cut, F.array(F.size(lines)))
        return let(ends, lambda e: F.array_join(F.flatten(F.transform(F.sequence(F.lit(1), F.size(cut) + 1), lambda j: F.slice(lines, F.element_at(e, j) + 2, F.element_at(e, j + 1) - F.element_at(e, j) - 1))), "\n"))

    text = F.when(F.col("p").isNull(), F.col("t")).otherwise(let(F.struct(F.split("t", "\n", -1).alias("l"), F.col("p").alias("p")), lambda x: kept(x["l"], x["p"])))
    return met.select(
        F.col("d").alias(id_col),
        (F.length("t") - F.length(F.replace(F.col("t"), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("p"), F.lit(0)).cast("long").alias("n_dropped"),
        text.alias("kept_text"),
    ).withColumn("kept_sha256", F.sha2("kept_text", 256))
