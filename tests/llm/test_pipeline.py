from collections import Counter

import corpus_pipeline
from cordon.llm import common, queries
from test_jaccard import brute
from test_packing import check_pieces
from test_quality import brute_base


def test_stages_one_by_one(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.select("doc_id", "text").collect()
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        ids = {r.doc_id for r in kept.collect()}
        assert ids <= {r.doc_id for r in before} and kept.count() == len(ids)
        if name == "quality_rules":
            assert not any(brute_base(r.text)[-1] for r in before if r.doc_id in ids)
            assert len(ids) > 0.7 * len(before)
        if name == "quality_classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            good = [r.doc_id for r in before if labels.get(r.doc_id) == 1]
            assert sum(d in ids for d in good) > 0.98 * len(good)
        if name == "exact_dedup":
            first = {}
            for r in before:
                first[r.text] = min(first.get(r.text, r.doc_id), r.doc_id)
            assert ids == set(first.values())
        if name == "jaccard_join":
            assert ids == {c for _, _, c in brute([(r.doc_id, r.text) for r in before], 5, 80)}
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect()
    check_pieces(pieces, [(r.doc_id, r.text) for r in kept.collect()], 2048)
    whole = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in whole) == Counter(r.doc_id for r in pieces)


def test_stages_take_hard_and_empty_tables(spark, hard, empty, sf):
    for df in (hard, empty):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, df, sf).collect()


def test_every_operator_has_a_query():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))


def test_texts_are_read_in_portions(spark, sf):
    """Parquet's reader holds the texts of a portion in one piece of memory in every task; a smaller setting of the session stays."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    given = spark.conf.get(key)
    try:
        for before, after in ((4096, common.READ_ROWS), (16, 16)):
            spark.conf.set(key, str(before))
            common.table(spark, sf, "documents")
            assert int(spark.conf.get(key)) == after
            spark.conf.set(key, str(before))
            common.written(spark.range(1), "portion")
            assert int(spark.conf.get(key)) == after
    finally:
        spark.conf.set(key, given)
