import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from cordon.llm import quality_classifier, quality_rules, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    t = text or ""
    words = WORD.findall(t)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), failed


def test_base_rules_against_brute_force(hard, docs, labels):
    for df in (hard, docs):
        rows = quality_rules.quality_rules(df, labels.where("quality = 1").select("doc_id")).collect()
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
        assert got == Counter((r.doc_id, *brute_base(r.text)) for r in df.collect())
        assert all(r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD) for r in rows)


def test_ratio_separates_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_rules.quality_rules(docs, labels.where("quality = 1").select("doc_id")).join(labels, "doc_id").where("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.1


def test_mean_ratio_against_brute_force(spark):
    texts = {1: "good words here", 2: "bad *** words", 3: "good here", 4: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    trusted = df.where("doc_id in (1, 3)").select("doc_id")
    buckets = {r.doc_id: r.b for r in df.select("doc_id", quality_rules.ngram_buckets(df["text"]).alias("b")).collect()}
    raw, good = Counter(sum(buckets.values(), [])), Counter(buckets[1] + buckets[3])
    n, g, b = sum(raw.values()), sum(good.values()), quality_rules.BUCKETS
    want = {i: float(np.mean([np.log((good[x] + 1) / (g + b)) - np.log((raw[x] + 1) / (n + b)) for x in v])) if v else 0.0 for i, v in buckets.items()}
    got = {r.doc_id: r.llr for r in quality_rules.quality_rules(df, trusted).collect()}
    assert got == pytest.approx(want)
    assert len(buckets[2]) == 5 and buckets[4] == []


def test_every_trusted_document_counts(spark):
    df = spark.range(20_500).selectExpr("id as doc_id", "concat('word', id % 5000, ' text') as text")
    assert {r.llr for r in quality_rules.quality_rules(df, df.select("doc_id")).collect()} == {0.0}


def test_rules_without_trusted_documents_or_rows(hard, empty, labels):
    none = labels.where("false").select("doc_id")
    assert {r.llr for r in quality_rules.quality_rules(hard, none).collect()} == {0.0}
    assert quality_rules.quality_rules(empty, none).count() == 0


def auc(score, y):
    order = np.argsort(np.argsort(score)) + 1
    return (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_classifier.quality_classifier(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    assert (got.held_out == [crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got.merge(labels.toPandas(), on="doc_id").query("held_out")
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.95


def test_isotonic_is_monotone_and_pools_ties():
    raw, y = np.array([0.1, 0.2, 0.2, 0.3, 0.4, 0.5]), np.array([0, 1, 0, 0, 1, 1.0])
    knots, values = quality_classifier.isotonic(raw, y)
    assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all() and values[0] == 0 and values[-1] == 1


def test_models_without_labels_and_hard_rows(hard, empty, labels):
    none = labels.where("false")
    for f in (quality_classifier.quality_classifier, toxicity.toxicity):
        assert {(r.score, r.predicted) for r in f(hard, none).collect()} == {(0.5, 0)}
        assert f(hard, none).count() == hard.count() and f(empty, labels).count() == 0


def test_labels_of_the_held_out_fold_have_no_influence(docs, labels):
    from pyspark.sql import functions as F

    from cordon.llm.labelled import remainder

    flipped = labels.withColumn("quality", F.when(remainder("doc_id", 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality_classifier.quality_classifier(docs, x).select("doc_id", "score").collect())) for x in (labels, flipped))
    assert a == b


def test_extra_columns_with_names_that_operators_use(spark, labels):
    """Names of inner columns in both tables, and repeated rows, change nothing."""
    texts = [(i, f"a document number {i} of some words " * (2 + i % 5)) for i in range(60)] + [(3, "another text of the same identifier")]
    plain = spark.createDataFrame(texts, "doc_id long, text string")
    marks = plain.select("doc_id").distinct().selectExpr("doc_id", "cast(doc_id % 2 as int) as quality", "cast(doc_id % 2 as int) as toxic")
    extra = ["y", "labelled_id", "trusted_id", "text_id", "i", "m", "b", "t", "k", "row", "llr", "the_text", "term", "n", "x"]
    wide = plain.selectExpr("*", *[f"'z' as {c}" for c in extra])
    wide_marks = marks.selectExpr("*", *[f"7 as {c}" for c in [*extra, "text"]])
    for f in (quality_classifier.quality_classifier, toxicity.toxicity):
        a, b = (sorted(map(tuple, f(d, m).collect())) for d, m in ((plain, marks), (wide, wide_marks)))
        assert a == b and len(a) == 61
    a, b = (sorted(map(tuple, quality_rules.quality_rules(d, m.where("quality = 1")).collect())) for d, m in ((plain, marks), (wide, wide_marks)))
    assert a == b and len(a) == 61
    assert sorted(r.row.doc_id for r in quality_rules.quality_rules(wide, marks, carry=True).collect()) == sorted(i for i, _ in texts)


def test_classifier_against_brute_force(spark):
    """Scores equal dense ridge on the same features, solved at once, and pooled means found by trying all cuts."""
    from zlib import crc32 as crc

    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma!", "d,", "42"], rng.integers(3, 60))) + ("." if i % 2 else " BUY #") for i in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    marks = spark.createDataFrame([(i, int(i % 2 or rng.random() < 0.2)) for i in range(300)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality_classifier.quality_classifier(docs, marks).collect()}
    y = {r.doc_id: r.quality for r in marks.collect()}
    used = [i for i in y if crc32(str(i).encode()) % 4 != 2]
    x = np.array([quality_classifier.statistics(t) for t in texts])
    mean, scale = x[used].mean(0), np.maximum(x[used].std(0), 1e-6)
    draw = np.random.default_rng(quality_classifier.SEED)
    w = draw.normal(0, 1 / quality_classifier.BANDWIDTH, (x.shape[1], quality_classifier.FEATURES))
    phase = draw.uniform(0, 2 * np.pi, quality_classifier.FEATURES)
    z = np.hstack([np.sqrt(2 / quality_classifier.FEATURES) * np.cos(np.clip((x - mean) / scale, -6, 6) @ w + phase), np.ones((300, 1))])
    fit = [i for i in used if crc(texts[i].encode()) % quality_classifier.CALIBRATION_SHARE]
    held = [i for i in used if i not in set(fit)]
    penalty = np.diag([quality_classifier.RIDGE * len(fit) / quality_classifier.FEATURES] * quality_classifier.FEATURES + [1e-9])
    raw = z @ np.linalg.solve(z[fit].T @ z[fit] + penalty, z[fit].T @ np.array([y[i] for i in fit], float))
    order = sorted(held, key=lambda i: raw[i])
    t = np.array([y[i] for i in order], float)
    least = [max(min(t[a : b + 1].mean() for b in range(k, len(t))) for a in range(k + 1)) for k in range(len(t))]  # isotonic regression, by its max-min formula
    pools = sorted(set(least))
    knots = [np.mean([raw[i] for i, v in zip(order, least) if v == p]) for p in pools]
    want = np.clip(0.999 * np.interp(raw, knots, pools) + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)
    assert np.allclose([got[i] for i in range(300)], want, atol=1e-6)
