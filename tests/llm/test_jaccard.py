from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cordon.llm import jaccard_join as jj


def brute(rows, words, percent):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = (t or "").translate(table).encode().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    head = list(range(len(rows)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                head[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def family(rng, n, length, edits):
    base = [f"w{x}" for x in rng.integers(0, 5000, length)]
    for _ in range(n):
        w = list(base)
        for k in rng.integers(0, length, rng.integers(0, edits + 1)):
            w[k] = f"e{rng.integers(0, 10**6)}"
        yield " ".join(w)


@pytest.fixture(scope="module")
def mixed(spark):
    """Families of near copies of many sizes and lengths, and short texts that share a line."""
    rng, texts = np.random.default_rng(5), []
    for n, length, edits in ((2, 60, 3), (3, 200, 5), (12, 120, 4), (40, 90, 3), (25, 12, 1), (30, 400, 14), (6, 5, 1)):
        texts += family(rng, n, length, edits)
    line = "this common line stands in very many short texts of all"
    texts += [f"{line} {' '.join(f'o{x}' for x in rng.integers(0, 10**6, 5))}" for _ in range(60)]
    texts += [f"{line} tail" for _ in range(4)] + ["", None, "  ", "One", "one", "a b c", "A B C"]
    return [(int(i), t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("words, percent", [(4, 85), (5, 80)])
def test_components_against_brute_force(spark, mixed, words, percent):
    df = spark.createDataFrame(mixed, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, jj.near_duplicates(df, words, percent).collect()))
    assert got == brute(mixed, words, percent)


def met(sig, key, size):
    """(members with their sig, pairs) that meet() gives for batches of so many rows."""
    batches = [pa.RecordBatch.from_arrays([pa.array(sig[i : i + size]), jj.keys_array(key[i : i + size])], ["sig", "key"]) for i in range(0, len(sig), size)]
    rows = [r for b in jj.meet(batches) for r in b.to_pylist()]
    return {(r["a"], r["sig"]) for r in rows if r["sig"] is not None}, {frozenset((r["a"], r["b"])) for r in rows if r["sig"] is None}, rows


def test_small_hold_streams_large_buckets(monkeypatch):
    sig = np.sort(np.random.default_rng(1).integers(0, 6, 400))
    key = np.random.default_rng(2).integers(0, 256, (400, jj.KEY)).astype(np.uint8)
    whole = met(sig, key, 400)
    monkeypatch.setattr(jj, "HOLD", 10)
    streamed = met(sig, key, 7)
    assert streamed[0] == whole[0] == {(bytes(k), s) for k, s in zip(key, sig)}
    for _, _, rows in (whole, streamed):  # one head a bucket
        assert all(len({r["b"] for r in rows if r["sig"] == s}) == 1 for s in range(6))


@pytest.mark.parametrize("early", [1, 2, 3, 4])
def test_repeated_keys_of_a_bucket_cut_at_hold_are_kept(early):
    """At the real HOLD: thousands of rows of few keys, then new keys, in one bucket."""
    keys = np.arange(9 * jj.KEY, dtype=np.uint8).reshape(9, jj.KEY)
    key = np.vstack([np.repeat(keys[:early], 5000, axis=0), keys[early:]])
    kept, _, _ = met(np.full(len(key), 7), key, 1000)
    assert kept == {(bytes(k), 7) for k in keys}


def test_words_with_colliding_running_sums_differ():
    """Thue-Morse words, which polynomial hashes modulo 2^64 confuse."""
    for n in (1024, 2048, 4096):
        a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        x, y = (jj.shingles(t, 4) for t in (a, a.translate(str.maketrans("ab", "ba"))))
        assert jj.set_key(x) != jj.set_key(y) and not jj.similar(x, y, 80) and not (x == y).any()


def test_many_copies_of_few_near_equal_texts(spark, monkeypatch):
    """Copies in many splits, so that repeated rows of a bucket exceed HOLD, against brute force."""
    monkeypatch.setattr(jj, "HOLD", 8)
    monkeypatch.setattr(jj, "SEEN", 1)
    rng = np.random.default_rng(8)
    heads = list(family(rng, 3, 60, 2))
    texts = [t for t in heads for _ in range(30)] + list(family(np.random.default_rng(8), 9, 60, 3))[3:]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    assert sorted(map(tuple, jj.near_duplicates(df).collect())) == brute(rows, 5, 80)


def test_blocks_of_a_bucket_meet(spark, mixed, monkeypatch):
    """Whatever the size of blocks, all pairs of different components that sketches allow are found; in one block with wider sets some more."""
    df = spark.createDataFrame(mixed, "doc_id long, text string").repartition(3)
    join = jj.Join(df, 5, 80, "doc_id", "text")
    sets = join.sets().where("key is not null").dropDuplicates(["key"])
    keys = [r["key"] for r in sets.collect()]
    rest = spark.createDataFrame([(1, k) for k in keys], "sig long, key binary")
    labels = spark.createDataFrame([(bytearray(k), bytearray(keys[i % 3])) for i, k in enumerate(keys) if i % 5], "key binary, comp binary")
    found = []
    for block in (5, 10_000):
        monkeypatch.setattr(jj, "BLOCK", block)
        found.append({tuple(map(bytes, r)) for r in join.around(rest, labels, sets, True).collect()})
        one = [tuple(map(bytes, r)) for r in join.around(rest, labels, sets, False).collect()]
        assert set(one) <= found[-1] and len(one) <= len(keys)
    comp = {bytes(k): bytes(keys[i % 3]) if i % 5 else bytes(k) for i, k in enumerate(keys)}
    rows = {bytes(r["key"]): r for r in sets.collect()}
    want = {(a, b) for a in comp for b in comp if a < b and comp[a] != comp[b] and jj.allowed(rows[a]["n"], rows[b]["n"], jj.folded([rows[a]["bits"], rows[b]["bits"]]), 80)}
    assert want <= found[0] and want <= found[1] and all(comp[a] != comp[b] for f in found for a, b in f)


def test_null_identifiers_link_others(spark):
    near = list(family(np.random.default_rng(4), 3, 120, 1))
    rows = [(None, near[0]), (7, near[1]), (9, near[2]), (None, "only here and nowhere else"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jj.near_duplicates(df).collect()), key=str)
    assert got == [(7, 7), (9, 7), (None, 7), (None, None), (None, None)]


def test_similar_sets_share_a_signature_or_are_both_dull():
    """The pigeonhole claim, for random pairs at the limit."""
    rng = np.random.default_rng(3)
    for percent in (80, 85):
        for n in (5, 8, 13, 40, 200, 900):
            for _ in range(30):
                a = rng.integers(1, 1 << 63, n, dtype=np.uint64)
                h = (100 - percent) * 2 * n // (100 + percent)
                b = np.r_[a[h // 2 :], rng.integers(1, 1 << 63, h - h // 2, dtype=np.uint64)]
                a, b = np.unique(a), np.unique(b)
                if jj.similar(np.vstack([a, a]), np.vstack([b, b]), percent) and len(set(a.tolist()) ^ set(b.tolist())):
                    assert set(jj.signatures(a, percent).tolist()) & set(jj.signatures(b, percent).tolist())
                    assert jj.allowed(len(a), len(b), jj.folded([jj.sketch(a), jj.sketch(b)]), percent)


def test_hard_rows(hard, empty):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    assert sorted(map(tuple, jj.near_duplicates(hard).collect())) == brute(rows, 5, 80)
    assert jj.near_duplicates(empty).count() == 0
