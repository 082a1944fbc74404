from collections import Counter, defaultdict
from hashlib import sha256

import pytest

from cordon.llm import exact_dedup, line_dedup

WS, UPPER = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_against_grouping(hard, docs, keep):
    for df in (hard.select("doc_id", "text"), docs.select("doc_id", "text")):
        rows = [(r.doc_id, r.text or "") for r in df.collect()]
        groups = defaultdict(list)
        for i, t in rows:
            groups[t].append(i)
        best = min if keep == "smallest" else max
        got = exact_dedup.exact_dedup(df, keep).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter((i, best(groups[t]), len(groups[t]), sha256(t.encode()).hexdigest()) for i, t in rows)
        kept = Counter(r.text_sha256 for r in got if r.kept)
        assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_hot_group_is_split(spark):
    rows = [(i, "same text") for i in range(900)] + [(1000 + i, f"text {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df, "largest").collect()}
    assert all(got[i] == (899, 900, i == 899) for i in range(900)) and all(got[1000 + i] == (1000 + i, 1, True) for i in range(100))
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, *range(1000, 1100)]


def test_exact_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.keep_one(empty).count() == 0


def brute_lines(rows, least):
    docs_of = Counter()
    key = lambda x: x.translate(UPPER).strip(WS)
    for _, t in rows:
        docs_of.update({key(x) for x in (t or "").split("\n")})
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and docs_of[key(x)] >= least)]
        out[i, len(lines), len(lines) - len(kept), sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)] += 1
    return out


def test_lines_against_brute_force(hard, docs):
    for df, least in ((hard, 2), (hard, 4), (docs, 3), (docs, 10)):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256, r.kept_text) for r in line_dedup.line_dedup(df, least).collect())
        assert got == brute_lines(rows, least)


def test_lines_stay_unicode(spark):
    df = spark.createDataFrame([(i, "É line\n x\nİ") for i in range(3)] + [(9, "é line")], "doc_id long, text string")
    assert Counter(r.n_dropped for r in line_dedup.line_dedup(df, 3).collect()) == Counter({3: 3, 0: 1})


def test_lines_empty(empty):
    assert line_dedup.line_dedup(empty).count() == 0
