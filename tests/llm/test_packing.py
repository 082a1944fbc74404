import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cordon.llm import packing, token_output

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def one_by_one(counts, capacity):
    windows = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [i for i, r in enumerate(windows) if r >= length]
            if fits:
                windows[min(fits, key=lambda i: windows[i])] -= length
            else:
                windows.append(capacity - length)
    return sorted(windows)


def test_plan_equals_packing_one_by_one():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([16, 31, 50])
        counts = {rng.randint(1, capacity): rng.randint(1, 12) for _ in range(rng.randint(1, 12))}
        spans, seen = defaultdict(list), Counter()
        for length, rank, n, window, per, offset in packing.plan(counts, capacity):
            assert rank == seen[length]
            seen[length] += n
            for j in range(n):
                spans[window + j // per].append((offset + j % per * length, length))
        assert seen == Counter(counts)
        for s in spans.values():
            ends = 0
            for at, length in sorted(s):
                assert at == ends
                ends += length
        assert sorted(capacity - sum(x for _, x in s) for s in spans.values()) == one_by_one(counts, capacity)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def check_pieces(rows, docs, capacity):
    """Every id of every document in one piece; sequences without gaps."""
    per_doc, per_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        per_doc[r.doc_id].append(r)
        per_sequence[r.sequence_id].append((r.offset, r.length))
    for s in per_sequence.values():
        ends = 0
        for at, length in sorted(s):
            assert at == ends
            ends += length
        assert ends <= capacity
    wanted = defaultdict(Counter)
    for i, t in docs:
        ids = np.array(ids_of(t), "<u4")
        for k in range(0, len(ids), capacity):
            wanted[i][k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes()), len(ids)] += 1
    assert {i: Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in v) for i, v in per_doc.items()} == dict(wanted)


def test_hard_rows(hard, empty):
    rows = packing.pack(hard, PATH, capacity=64).collect()
    check_pieces(rows, [(r.doc_id, r.text) for r in hard.collect()], 64)
    assert packing.pack(empty, PATH).count() == 0


def test_documents_with_little_padding(docs):
    rows = packing.pack(docs, PATH).collect()
    check_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    padding = sum(2048 - u for u in used.values() if u & (u - 1))
    assert padding < 0.02 * sum(used.values())


def test_matrices(hard, empty):
    rows = token_output.matrices(hard, PATH, capacity=64).collect()
    texts = defaultdict(list)
    for r in hard.collect():
        texts[r.doc_id].append(ids_of(r.text))
    found = Counter()
    for r in rows:
        ids, positions = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(positions) == token_output.padded_length(r.n_tokens, 64) and r.cu_seqlens[-1] == r.n_tokens and len(r.cu_seqlens) == r.n_segments + 1
        assert not ids[r.n_tokens :].any() and not positions[r.n_tokens :].any()
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
            assert any(x[start : start + b - a] == ids[a:b].tolist() for x in texts[doc])
            found[doc] += b - a
    assert found == Counter({d: sum(map(len, x)) for d, x in texts.items()})
    assert token_output.digests(token_output.matrices(empty, PATH)).count() == 0


def test_written_matrices(docs, tmp_path, spark):
    packed = token_output.matrices(docs.limit(20), PATH)
    token_output.write_matrices(packed, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == packed.count()


def test_ranks_of_a_length_that_holds_most_pieces(spark):
    pieces = spark.range(30_000).selectExpr("if(id % 3 = 0, id % 5 + 1, 7) as length", "cast(concat('k', id) as binary) as piece_key")
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    for share in (None, 100, 10**6):
        ranks = defaultdict(list)
        for r in packing.ranked(pieces, counts, share).collect():
            ranks[r.length].append(r["rank"])
        assert {n: sorted(x) for n, x in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}


def test_repeated_identifiers_with_different_texts_keep_their_places(spark):
    rows = [(1, f"text {k % 4}") for k in range(12)] + [(None, "a b"), (None, "c d")]
    frames = [spark.createDataFrame(rows[::step], "doc_id long, text string").repartition(n) for step, n in ((1, 1), (-1, 5))]
    a, b = (sorted(map(str, packing.pack(f, PATH, capacity=8).collect())) for f in frames)
    assert a == b and len(a) == 14
