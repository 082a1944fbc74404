from itertools import product

import pytest

from cordon.llm import toxicity as tx


def within_one(a, b):
    """Edit distance of at most one."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def test_near_finds_are_exactly_those_within_one_edit():
    terms = ["idiot", "moron", "stupid"]
    lexicon = tx.Lexicon(terms, [3.0, 2.0, 1.0], {0, 1, 2})
    words = set()
    for t in terms:
        for i, c in product(range(len(t) + 1), "aimx"):
            words |= {t[:i] + c + t[i:], t[:i] + c + t[i + 1 :], t[:i] + t[i + 1 :], t[:i] + c + c + t[i:], t[::-1], t[:i]}
    for w in words - {""}:
        near = [k for k, t in enumerate(terms) if within_one(t, w)]
        assert lexicon.near(w) == (near[0] if near else -1), w


def test_exact_terms_begin_words():
    lexicon = tx.Lexicon(["lowei", "scum"], [1.0, 2.0], set())
    assert lexicon.exact("loweichen") == 0 and lexicon.exact("scum") == 1 and lexicon.exact("a scum") == -1 and lexicon.exact("low") == -1
    assert lexicon.look({"(scum),", "idle"}) == {"(scum),": (1, 0)}


@pytest.mark.parametrize("text, quoted", [('he said "you idiot" and left', True), ("you idiot go away", False), ("the word idiot is a slur", True), ("such an idiot", False)])
def test_quotation(text, quoted):
    lexicon = tx.Lexicon(["idiot"], [3.0], {0})
    assert [x[4] for x in tx.spans(text, lexicon)] == [quoted]


def test_misspelled_and_abusive_documents_score_higher(spark):
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        filler = " ".join(f"w{(i * 7 + k) % 97}" for k in range(40))
        rows.append((i, f"{filler} {'you are a worthless moron' if toxic else 'have a good day'} {filler}"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, "go away you morron now"), (1001, "the weather is fine today"), (1002, ""), (1003, None)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in tx.toxicity(docs, labels).collect()}
    assert all((got[i].predicted == 1) == (i % 3 == 0) for i in range(600))
    assert got[1000].score > got[1001].score and got[1002].score == got[1003].score == got[1001].score


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    p = tx.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert ((p.predicted == 1) == (p.toxic == 1)).mean() > 0.97
    assert (p[p.predicted == 1].toxic == 1).mean() > 0.95


def brute_finds(text, lexicon):
    """Each word against each term, by the definitions of exact and near finds."""
    out = {}
    for token in set(text.lower().split()):
        word = token.strip(tx.STRIP)
        exact = [k for k, t in enumerate(lexicon.terms) if (word.startswith(t) if len(t) >= tx.SHORTEST else word == t)]
        if exact:
            out[token] = (max(exact, key=lambda k: len(lexicon.terms[k])), 0)
            continue
        near = [k for k in lexicon.fuzzy if any(len(word) > e and within_one(lexicon.terms[k], word[: len(word) - e]) for e in range(tx.ENDING + 1 if len(lexicon.terms[k]) >= tx.ENDED_FROM else 1))]
        if near:
            out[token] = (max(near, key=lambda k: lexicon.weights[k]), 1)
    return out


def test_finds_and_scores_against_brute_force():
    """Short and very long terms, misspelled inflected forms; and the score as the model defines it."""
    import math
    import random

    import numpy as np

    rng = random.Random(2)
    terms = ["kys", "scum", "idiot", "worthless", "antidisestablishmentarian"]
    lexicon = tx.Lexicon(terms, [5.0, 4.0, 3.0, 2.0, 1.0], {2, 3, 4})
    words = []
    for t in terms:
        for _ in range(150):
            w = list(t + rng.choice(["", "s", "ly", "ness", "er"]))
            for _ in range(rng.choice([0, 1, 1, 2])):
                i = rng.randrange(len(w))
                w[i : i + rng.choice([0, 1])] = rng.choice(["", "x", "e", "ss"])
            words.append("".join(w))
    words += ["kysan", "skys", '"kys"', "sc", "idio"]
    text = " ".join(words)
    assert lexicon.look(set(text.lower().split())) == brute_finds(text, lexicon)
    model = tx.Model(lexicon, np.array([0.5, 0.4, -0.3, 0.2, 0.1, 0.05, 1.0, -2.0]))
    for t in ("", "you idiot", "the word scum is a slur", "plain text here", text):
        x = tx.features(t, lexicon)
        z = sum(a * b for a, b in zip(x, [0.5, 0.4, -0.3, 0.2, 0.1, 0.05, 1.0])) - 2.0
        assert abs(model.score([t])[0] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-12


def test_short_and_long_terms_are_learned(spark):
    rows, labels = [], []
    for i in range(600):
        bad = ("zog", "pfui", "unmitigatedblatherskites")[i % 3] if i % 2 else "fine"
        rows.append((i, " ".join(f"w{(i * 7 + k) % 97}" for k in range(40)) + f" {bad} end"))
        labels.append((i, i % 2))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in tx.toxicity(docs, labels).collect()}
    assert got == {i: i % 2 for i in range(600)}


def test_labels_of_the_held_out_fold_have_no_influence(docs, labels):
    from pyspark.sql import functions as F

    from cordon.llm.labelled import remainder

    flipped = labels.withColumn("toxic", F.when(remainder("doc_id", 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, tx.toxicity(docs, x).select("doc_id", "score").collect())) for x in (labels, flipped))
    assert a == b
