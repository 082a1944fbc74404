"""Quality rules in DataFrame operations only: base rules and a hashed n-gram log-likelihood ratio.

Tokens are runs of letters and digits, and runs of other characters that are not white
space. Their unigrams and bigrams fall into BUCKETS hash buckets. Two multinomials over the
buckets, of trusted documents and of the whole corpus, give each bucket a log-likelihood
ratio; a document's verdict is the mean over its n-grams, against a fixed threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordon.llm.common import WS_CLASS, let, written

BUCKETS = 10_000
#: Trusted identifiers are listed to all executors up to this many, 8 bytes each; more are met by a shuffle of the buckets.
LISTED = 500_000
#: Documents with a lower mean log-likelihood ratio go.
THRESHOLD = -0.35
MIN_WORDS, REPEAT_PERCENT = 10, 20
SYMBOLS = "#*$%&|<>"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{WS_CLASS}+", -1), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words stand in 5-word windows that the text has twice or more. `words` must be a lambda's variable."""
    windows = F.when(F.size(words) >= 6, F.transform(F.sequence(F.lit(1), F.size(words) - 4), lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(5)])))

    def covered(hashes: Column) -> Column:
        def starts(s: Column) -> Column:
            """Starts of windows whose hash has an equal neighbour in sorted order."""
            same = lambda j, k: F.get(s, j)["h"] == F.get(s, k)["h"]
            return F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False))), lambda j: F.get(s, j)["i"]))

        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        total = F.aggregate(let(ordered, starts), F.struct(F.lit(0).alias("n"), F.lit(-5).alias("at")), lambda a, x: F.struct((a["n"] + F.least(F.lit(5), x - a["at"])).alias("n"), x.alias("at")))["n"]
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), total)

    return F.coalesce(let(windows, covered), F.lit(0)).cast("long")


def base_rules(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; null text has no words."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\f\r"))) > 0)
    parts = let(
        words_of(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    symbols = F.length(t) - F.length(F.translate(t, SYMBOLS, ""))
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    failed = lambda p: (p["n_words"] < MIN_WORDS) | (100 * p["n_repeat_words"] > REPEAT_PERCENT * p["n_words"])
    return let(parts, lambda p: F.struct(p["n_words"].alias("n_words"), p["word_chars"].alias("word_chars"), symbols.cast("long").alias("n_symbols"), dup.cast("long").alias("n_dup_lines"), p["n_repeat_words"].alias("n_repeat_words"), failed(p).alias("base_failed")))


def ngram_buckets(text: Column) -> Column:
    """Buckets of the text's unigrams and bigrams, as an array of int."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    bucket = lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")

    def grams(h: Column) -> Column:
        """Unigrams and bigrams of token hashes."""
        pairs = F.when(F.size(h) > 1, F.transform(F.sequence(F.lit(1), F.size(h) - 1), lambda i: bucket(F.xxhash64(F.get(h, i - 1), F.get(h, i)))))
        return F.concat(F.transform(h, bucket), F.coalesce(pairs, F.array().cast("array<int>")))

    return let(F.transform(tokens, lambda x: F.xxhash64(x)), grams)


def log_ratios(grams: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row, one array: the log-likelihood ratio of each bucket.

    `grams` has documents (i, b: their buckets), `trusted` the identifiers (t) of the target;
    all its documents count. Counts are summed by bucket before their shuffle. Without
    trusted documents all ratios are 0.
    """
    spark = grams.sparkSession
    chosen = written(trusted.where("t is not null").distinct(), "trusted")
    way = "broadcast" if chosen.count() <= LISTED else "merge"
    flagged = grams.join(chosen.hint(way), F.col("i") == F.col("t"), "left").select(F.col("t").isNotNull().cast("long").alias("is_good"), F.explode("b").alias("k"))
    counts = flagged.groupBy("k").agg(F.count(F.lit(1)).alias("raw"), F.sum("is_good").alias("good"))
    both = spark.range(BUCKETS).join(F.broadcast(counts), F.col("id") == F.col("k"), "left")  # BUCKETS rows at most
    both = both.select("id", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good"))
    one = both.agg(F.array_sort(F.collect_list(F.struct("id", "raw", "good"))).alias("c"), F.sum("raw").alias("n"), F.sum("good").alias("g"))
    ratio = lambda x: F.log((x["good"] + 1) / (F.col("g") + BUCKETS)) - F.log((x["raw"] + 1) / (F.col("n") + BUCKETS))
    return one.select(F.when(F.col("g") > 0, F.transform("c", ratio)).otherwise(F.array_repeat(F.lit(0.0), BUCKETS)).alias("w"))


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per row of `docs`: id, the base counts, base_failed, llr (mean log-likelihood ratio) and kept.

    Texts are read once: their base counts and buckets are written, then counted, then scored.
    With `carry`, where the texts would have to be written too, they are read twice instead.
    Null and empty texts have no words, fail the base rules and have llr 0; very long ones are
    read whole. Repeated rows get equal rows; each counts in the corpus. An empty table gives
    no rows. Other columns, of `trusted` too, are ignored, or with `carry` come along as the struct `row`.
    """
    measured = docs.select(
        F.col(id_col).alias("i"),
        base_rules(F.col(text_col)).alias("m"),
        ngram_buckets(F.col(text_col)).alias("b"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
    )
    measured = measured if carry else written(measured, "text-measures")
    ratios = log_ratios(measured.select("i", "b"), trusted.select(F.col(id_col).alias("t"))).first()["w"]  # BUCKETS numbers, whatever the input
    weights = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded into one constant
    mean = lambda b, w: F.when(F.size(b) > 0, F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(w, x)) / F.size(b)).otherwise(0.0)
    scored = measured.withColumn("llr", mean(F.col("b"), weights))
    return scored.select(F.col("i").alias(id_col), "m.*", "llr", (~F.col("m.base_failed") & (F.col("llr") >= threshold)).alias("kept"), *(["row"] if carry else []))
