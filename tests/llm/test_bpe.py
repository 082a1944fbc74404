from hashlib import sha256

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cordon.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY, OURS = Tokenizer.from_file(PATH), bpe.TrieBpe(PATH)


def library_ids(text):
    return np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abAB '\"stdlrve1½²é日 \n\t\r\x0b\x85  !?-_.😀́ß", max_size=60))
def test_ids_and_text_are_the_librarys(text):
    ids = OURS.encode(text)
    assert ids == library_ids(text)
    assert OURS.decode(ids) == LIBRARY.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_special_string_and_long_words():
    for text in ("<|endoftext|>", "a<|endoftext|><|endoftext|> b", "ab" * 4000, "-" * 3000, " " * 3000 + "x"):
        assert OURS.encode(text) == library_ids(text)


def test_bytes_that_are_no_utf8_become_replacement_characters():
    ids = np.array([OURS.ids[b"\xff"], OURS.ids[b"a"]], "<u4").tobytes()
    assert OURS.decode(ids) == LIBRARY.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_small_trie_gives_the_same(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_NODES", 20)
    monkeypatch.setattr(bpe, "MAX_WORDS", 5)
    small = bpe.TrieBpe(PATH)
    text = "the quick brown fox jumps over the lazy dog and the quick red fox " * 3
    assert small.encode(text) == library_ids(text)


def test_hard_rows(hard, empty):
    got = sorted(map(tuple, bpe.encode_decode(hard, PATH).collect()))
    want = []
    for r in hard.select("doc_id", "text").collect():
        ids = library_ids(r.text or "")
        want.append((r.doc_id, len(ids) // 4, sha256(ids).hexdigest(), sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode_decode(empty, PATH).count() == 0


def test_very_long_words_in_bounded_memory():
    """Words beyond LONG leave neither nodes nor cached words, and are the library's."""
    rng = np.random.default_rng(3)
    fresh = bpe.TrieBpe(PATH)
    for text in ("".join(rng.choice(list("abcdeé日"), 200_000)), "ab" * 40_000, "q" * 30_001, "x " + "!?" * 5000 + " y" * 3):
        assert fresh.encode(text) == library_ids(text)
    assert len(fresh.last) < 1000 and max(map(len, fresh.words)) <= bpe.LONG


def test_texts_of_more_words_than_are_looked_up_at_once(monkeypatch):
    monkeypatch.setattr(bpe, "AT_ONCE", 7)
    text = "the quick brown fox, 12 jumps <|endoftext|> over  the lazy dog\n" * 9
    assert OURS.encode(text) == library_ids(text)
