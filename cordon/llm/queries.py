"""Queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordon.llm import bpe, exact_dedup, html_extract, jaccard_join, line_dedup, packing, quality_classifier, quality_rules, token_output, toxicity
from cordon.llm.common import table

BPE_FILE = "byte_bpe_50k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.digests(token_output.matrices(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE)))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85)


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), trusted(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_toxicity": op2_toxicity,
        "op3_line_dedup": op3_line_dedup,
        "op4_packing": op4_packing,
        "op5_token_output": op5_token_output,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_quality_rules": op8_quality_rules,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_html_extract": op10_html_extract,
    }


OP3_SQL = """
with rows as (select doc_id, coalesce(text, '') as t from documents),
lines as (
  select doc_id, unnest(string_split(t, chr(10))) as line, unnest(range(len(string_split(t, chr(10))))) as pos from rows
),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines
),
frequent as (select k from keyed where length(k) >= 1 group by k having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (where f.k is not null) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where f.k is null), '')) as kept_sha256
from keyed left join frequent f on keyed.k = f.k group by doc_id
"""

OP9_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op9_exact_dedup": OP9_SQL}
