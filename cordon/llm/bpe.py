"""Byte-level BPE by prefix-sharing trie traversal.

Greedy BPE has a prefix property: dropping the last token of a text's encoding leaves the
encoding of the text without that token's bytes. So one number, the last token, describes
the encoding of every prefix, and the last token of a longer prefix is the one vocabulary
entry that (a) is a suffix of it and (b) may stand after the last token of what precedes.

Distinct words are inserted in sorted order into a trie, so that nodes come into being depth
first; each new node gets its last token from its ancestors once, however many words share
it. A word's ids are read by walking last tokens back to the root. The trie and the word
cache live as long as a Python worker and are emptied at a fixed size. Words of more than
LONG bytes share no prefix worth keeping: they are walked by the same rule with a number a
byte, outside trie and cache. So memory is bounded but for a few bytes for each of the text at hand.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache
from itertools import islice
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The pattern of byte-level pre-tokenisation (white space as in Unicode).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""

#: Bytes that stand for themselves in the vocabulary file; the others follow from U+0100.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

MAX_NODES, MAX_WORDS = 600_000, 300_000
#: Longest word, in bytes, that goes into the trie; words of a text that are looked up at once.
LONG, AT_ONCE = 64, 200_000
NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBpe:
    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model, alphabet = spec["model"], byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.ids = {as_bytes(s): i for s, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.text_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made_at: dict[int, int] = {}
        for r, (a, b) in enumerate(pairs):
            a, b = as_bytes(a), as_bytes(b)
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[x, y] = r
            if z not in self.parts:
                self.parts[z], self.made_at[z] = (x, y), r
        # suffix automaton of the vocabulary, grown as words need it: a state is the longest end of
        # what has been read that begins some token, and knows the tokens that end there
        self.beginnings = {t[:k] for t in self.ids for k in range(1, len(t) + 1)} | {b""}
        self.state_of: dict[bytes, int] = {b"": 0}
        self.read: list[bytes] = [b""]
        self.ends: list[list[tuple[int, int]]] = [[]]
        self.step: dict[int, int] = {}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.find, self.iterate = regex.compile(PATTERN).findall, regex.compile(PATTERN).finditer
        self.pairs_ok: dict[int, bool] = {}
        self.spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.words: dict[str, bytes] = {}
        self.clear()

    def clear(self) -> None:
        """An empty trie: node 0 is the root. child is keyed by node * 256 + byte."""
        self.child: dict[int, int] = {}
        self.last, self.before, self.states = [-1], [-1], [0]

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one end of `token` while it forms, each with the rank at which it is merged away."""
        key = (token, side)
        if key not in self.spines:
            out, until = [(token, NEVER)], NEVER
            while token in self.parts:
                until, token = self.made_at[token], self.parts[token][side]
                out.append((token, until))
            self.spines[key] = out
        return self.spines[key]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the bytes of both, encoded together, give these two tokens.

        They don't if some merge across the border comes before the merges that use up its
        two sides. Of equal ranks the leftmost merge comes first.
        """
        key = left << 32 | right
        ok = self.pairs_ok.get(key)
        if ok is None:
            get = self.rank.get
            ok = not any((r := get((a, b))) is not None and r < gone_a and r <= gone_b for a, gone_a in self.spine(left, 1) for b, gone_b in self.spine(right, 0))
            if len(self.pairs_ok) > 2_000_000:
                self.pairs_ok.clear()
            self.pairs_ok[key] = ok
        return ok

    def stands_alone(self, token: int) -> bool:
        """Whether the bytes of the token encode to it: its two halves meet on their own, by this merge."""
        key = 1 << 62 | token
        ok = self.pairs_ok.get(key)
        if ok is None:
            ok = self.pairs_ok[key] = self.merged(self.text_of[token]) == [token]
        return ok

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE, for single tokens."""
        ids = [self.ids[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            r, i = min((self.rank.get((a, b), NEVER), i) for i, (a, b) in enumerate(zip(ids, ids[1:])))
            if r == NEVER:
                break
            ids[i : i + 2] = [self.ids[self.text_of[ids[i]] + self.text_of[ids[i + 1]]]]
        return ids

    def advance(self, state: int, byte: int) -> int:
        """The state after one more byte."""
        read = self.read[state] + bytes((byte,))
        while read not in self.beginnings:
            read = read[1:]
        nxt = self.state_of.get(read)
        if nxt is None:
            nxt = self.state_of[read] = len(self.read)
            self.read.append(read)
            self.ends.append([(len(read) - k, self.ids[read[k:]]) for k in range(len(read)) if read[k:] in self.ids])
        self.step[state << 8 | byte] = nxt
        return nxt

    def insert(self, word: bytes) -> int:
        """The node of the word; new nodes get their last token here: of the tokens that end there, the one that may follow."""
        child, last, before, states = self.child, self.last, self.before, self.states
        step, ends, ok_pairs = self.step, self.ends, self.pairs_ok
        node, depth, path = 0, 0, [0]
        for byte in word:
            depth += 1
            key = node << 8 | byte
            nxt = child.get(key)
            if nxt is None:
                state = step.get(states[node] << 8 | byte)
                if state is None:
                    state = self.advance(states[node], byte)
                for length, token in ends[state]:
                    if length < depth:
                        left = last[path[depth - length]]
                        ok = ok_pairs.get(left << 32 | token)
                        if ok is None:
                            ok = self.may_follow(left, token)
                    else:
                        ok = self.stands_alone(token)
                    if ok:
                        break
                nxt = child[key] = len(last)
                last.append(token)
                before.append(path[depth - length])
                states.append(state)
            node = nxt
            path.append(node)
        return node

    def walk(self, word: bytes) -> bytes:
        """Ids of a long word: the last token of each of its beginnings follows from those before, as in the trie."""
        step, ends, state = self.step, self.ends, 0
        last = array("I", bytes(4 * (len(word) + 1)))  # by bytes read
        for depth, byte in enumerate(word, 1):
            nxt = step.get(state << 8 | byte)
            state = self.advance(state, byte) if nxt is None else nxt
            for length, token in ends[state]:
                if self.may_follow(last[depth - length], token) if length < depth else self.stands_alone(token):
                    break
            last[depth] = token
        ids, depth = array("I"), len(word)
        while depth:
            ids.append(last[depth])
            depth -= len(self.text_of[last[depth]])
        ids.reverse()
        return ids.tobytes()

    def learn(self, words: set[str]) -> None:
        """Adds the words' encodings to the cache, depth first."""
        if len(self.words) + len(words) > MAX_WORDS:
            self.words.clear()
        for word in sorted(w.encode() for w in words):
            if len(self.last) > MAX_NODES:
                self.clear()
            node, ids = self.insert(word), []
            while node:
                ids.append(self.last[node])
                node = self.before[node]
            ids.reverse()
            self.words[word.decode()] = array("I", ids).tobytes()

    def encode_plain(self, text: str) -> bytes:
        if len(text) <= AT_ONCE:
            return self.encode_words(self.find(text))
        out, rest = [], (m[0] for m in self.iterate(text))
        while found := list(islice(rest, AT_ONCE)):
            out.append(self.encode_words(found))
        return b"".join(out)

    def encode_words(self, found: list[str]) -> bytes:
        new = {w for w in set(found).difference(self.words) if len(w) <= LONG // 4 or len(w.encode()) <= LONG}
        if new:
            self.learn(new)
        try:
            return b"".join(map(self.words.__getitem__, found))
        except KeyError:  # a long word, or the cache was emptied on the way
            return b"".join([self.words[w] if w in self.words else self.fresh(w) for w in found])

    def fresh(self, word: str) -> bytes:
        data = word.encode()
        if len(data) > LONG:
            return self.walk(data)
        self.learn({word})
        return self.words[word]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Null is empty; special strings give their ids."""
        if not text:
            return b""
        if self.split_special is None or not any(s in text for s in self.special):
            return self.encode_plain(text)
        return b"".join(array("I", [self.special[x]]).tobytes() if x in self.special else self.encode_plain(x) for x in self.split_special.split(text))

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        numbers = array("I")
        numbers.frombytes(ids)
        return b"".join(map(self.text_of.__getitem__, numbers)).decode("utf-8", "replace")


@lru_cache(1)
def loaded(path: str) -> TrieBpe:
    """One per Python worker."""
    return TrieBpe(path)


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text: one pass, no shuffle.

    Null and empty texts have no ids and decode to "". Very long texts are encoded whole, in
    portions of words. Repeated rows each get their row; an empty table gives none; other
    columns of `docs` are ignored, so names can't clash. With `keep_ids` the result also has
    `ids` (binary, little-endian unsigned 32-bit) and `decoded`.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep_ids

    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            out = []
            texts = batch.column(1).to_pylist()
            for t in texts:
                ids = bpe.encode(t)
                decoded = bpe.decode(ids)
                out.append((len(ids) // 4, sha256(ids).hexdigest(), sha256(decoded.encode()).hexdigest(), *((ids, decoded) if keep_ids else ())))
            cols = list(zip(*out)) if out else [[]] * (3 + 2 * keep_ids)
            types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))]
            yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
