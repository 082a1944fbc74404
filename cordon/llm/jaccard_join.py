"""N-gram Jaccard join by universe partition, for near-duplicate groups. Exact.

Sets of word shingles of Jaccard similarity J >= t differ in at most H = (1-t)/(1+t) (|r|+|s|)
elements. Sizes are cut into bands so wide that such sets lie in one band or in two that
touch; each set is indexed in its own band and the next. In a band all shingles (the
universe) are hashed into m = H + 1 + e segments. By the pigeonhole principle at least 1 + e
segments of the two sets are equal. A segment is dull if it is empty, or if many sets share
it. If either set has at most e dull segments in the band, the two share one that isn't dull:
a bucket of at most SMALL sets, all of whose pairs are candidates. So a dull segment need be
searched only for pairs of sets that both have more than e of them. Empty segments are not
indexed, but of sets with more than e of those all segments are, and each segment's
one-deletion neighbourhood too: two such sets have some segment that differs by one element
or none, since 2 m > H, and there one set's segment is equal to the other's or to it less
one element.

e is allocated to each band by cost: rows to index against the rows and company of sets with
more than e dull segments.

Larger buckets, of dull segments, are taken in three steps. Every set is paired with two of
its buckets' heads, which is enough to tie most of a group of near copies together. Then,
after these pairs are verified and components found, sets with more than e dull segments look
around in their buckets: first each set outside the bucket's largest component for the
likeliest partner in one block of the bucket, then, with the components that this gives, for
all partners of other components in all blocks. They are compared by odd sketches, bitmaps
that bound the difference of two sets from below; pairs that the bound allows are verified.
So no link is lost, and neither a group of thousands of near copies nor one of texts that
share a passage gives all its pairs. A task holds two blocks of a bucket, whatever the
bucket's size. Equal sets are one class from the start.

Words are hashed by XXH3 to 128 bits, shingles from these to 128 bits in two lanes. Sets are
equal, and elements shared, if both lanes are.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordon.llm.common import LOWER, UPPER, WS_CHARS, partitions, written

#: Buckets of at most so many sets give all pairs at once.
SMALL = 4
#: Cost of a set with too many dull segments, in rows; shingles of a text that belong to passages many texts share;
#: numbers of dull segments that are tried: up to so many, and their mean and up to so many standard deviations more.
COMPANY, COMMON, FEW = 500.0, 30.0, 6
#: Sets that a task remembers as indexed, words whose hashes a worker remembers, and the longest such words in bytes.
SEEN, KNOWN, KNOWN_BYTES = 200_000, 100_000, 32
#: Bits of the widest sketch. It rules pairs out up to some 200,000 shingles; larger sets are told apart by size and text only.
WIDEST = 1 << 16
#: Sets in a block of a large bucket.
BLOCK = 2048
#: Sets of pairs are listed to all executors up to this many, 40 bytes each.
LISTED = 500_000
#: Rows of one bucket that wait for its end; of more, each is given as it comes.
HOLD = 4096
#: Texts are cut into words in stretches of about so many bytes.
STRETCH = 1 << 20

WHITE = re.compile(rb"[\x20\x09-\x0D]")
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * ODD[1]
    x = (x ^ (x >> np.uint64(31))) * ODD[3]
    return x ^ (x >> np.uint64(29))


class Words(dict):
    """128-bit hashes of words as bytes, made when first asked for. Long words aren't kept, and at KNOWN words all are dropped."""

    def __missing__(self, word: bytes) -> bytes:
        found = xxhash.xxh3_128_digest(word)
        if len(word) <= KNOWN_BYTES:
            if len(self) >= KNOWN:
                self.clear()
            self[word] = found
        return found


_hash_of = Words().__getitem__


def word_hashes(data: bytes) -> np.ndarray:
    """Both lanes of each word's hash, in order (n x 2)."""
    out, at = [], 0
    while at < len(data):
        cut = WHITE.search(data, at + STRETCH) if at + STRETCH < len(data) else None
        to = cut.start() if cut else len(data)
        out.append(b"".join(map(_hash_of, data[at:to].split())))
        at = to
    return np.frombuffer(b"".join(out), np.uint64).reshape(-1, 2)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Distinct 128-bit hashes of the text's shingles, in order, as two rows of 64 bits; with fewer words the whole sequence is one."""
    h = word_hashes((text or "").encode().translate(TO_LOWER))
    if not len(h):
        return np.empty((2, 0), np.uint64)
    k = min(words, len(h))
    n = len(h) - k + 1
    lanes = []
    for lane in (0, 1):
        x = np.full(n, k + 1000 * lane, np.uint64)
        for i in range(k):
            x = (x ^ h[i : i + n, lane]) * ODD[(i + 3 * lane) % 8]
            x ^= x >> np.uint64(32)
        lanes.append(x)
    s = np.vstack(lanes)
    s = s[:, np.argsort(s[0])]
    if (s[0, 1:] == s[0, :-1]).any():
        s = s[:, np.lexsort((s[1], s[0]))]
        s = s[:, np.r_[True, (s[:, 1:] != s[:, :-1]).any(0)]]
    return s


def set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def sketch(s: np.ndarray) -> bytes:
    """Odd sketch of a set (first lane): each bit is the parity of the elements that fall on it, in 4 to 8 bits an element (2 to 4 for
    large sets). Bits in which two sketches differ need an element each in which the sets differ; this bounds their difference
    from below, and shared elements don't blur it."""
    width = 64
    while width < WIDEST and width < len(s) * (4 if len(s) <= 1024 else 2):
        width *= 2
    bits = np.bincount((((s * ODD[5]) >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """Sketches as rows of words, all as narrow as the narrowest: a sketch's halves, one on the other, are the sketch of half the width."""
    width, rows = min(map(len, maps)), []
    for x in maps:
        row = np.frombuffer(x, np.uint64)
        while len(row) * 8 > width:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        rows.append(row)
    return np.vstack(rows)


def beyond(mean: float, k: int) -> float:
    """Chance that a Poisson variable exceeds k."""
    low = max(0, math.floor(mean - 12 * math.sqrt(mean)))
    return max(0.0, 1 - sum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(low, k + 1)))


class Bands:
    """Size bands, and for each (H, segments, dull segments allowed for)."""

    def __init__(self, percent: int):
        self.percent, self.tops, self.plans = percent, [0], [(0, 1, 0)]

    def of(self, n: int) -> int:
        while self.tops[-1] < n:
            low = self.tops[-1] + 1
            self.tops.append(max(low, -(-low * 100 // self.percent) - 1))
            self.plans.append(self.allocate(self.tops[-1]))
        return bisect_left(self.tops, n)

    def plan(self, band: int) -> tuple[int, int, int]:
        while len(self.tops) <= band:
            self.of(self.tops[-1] + 1)
        return self.plans[band]

    def allocate(self, top: int) -> tuple[int, int, int]:
        """The cheapest plan of a band up to size `top`, on the mean of sizes that use it: its own and those of the band before."""
        h = (100 - self.percent) * 2 * top // (100 + self.percent)
        t, options = self.percent / 100, []
        sizes = [max(1.0, top * x) for x in (1, (1 + t) / 2, t, t * (1 + t) / 2, t * t)]

        def dull(n: float, m: int) -> float:
            """Segments without an element of one's own; of these there are about as many as a Poisson law says."""
            return m * math.exp(-n / m * (1 - min(0.5, COMMON / n)))

        usual = dull(sizes[-1], h + 1)
        for e in sorted({*range(FEW + 1), *(math.ceil(k * usual + z * math.sqrt(usual)) for k in (0.5, 1.0, 1.5, 2.0) for z in range(FEW + 1))}):
            m = h + 1 + e
            options.append((m + sum(beyond(dull(n, m), e) * (n + COMPANY) for n in sizes) / len(sizes), h, m, e))
        return min(options)[1:]


@lru_cache(4)
def bands(percent: int) -> Bands:
    return Bands(percent)


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a set that isn't empty, in its own band and the next. The last bit says whether the band is odd."""
    table, out = bands(percent), []
    own = table.of(len(s))
    for band in (own, own + 1):
        h, m, e = table.plan(band)
        if h == 0:
            continue  # only equal sets are similar
        mixed = mix(s, 2 * band + 1)
        segment = (mixed >> np.uint64(32)) % np.uint64(m)
        order = np.argsort(segment)
        segment, mixed = segment[order], mix(mixed[order], 3)
        parity = np.uint64(band & 1)
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        sums = np.zeros(m, np.uint64)
        sums[segment[starts]] = np.add.reduceat(mixed, starts)
        tag = np.arange(1, m + 1, dtype=np.uint64) * ODD[4]
        if m - len(starts) <= e:
            full = segment[starts]
            found = [mix(sums[full] ^ tag[full], band)]
        else:
            found = [mix(sums ^ tag, band), mix((sums[segment] - mixed) ^ tag[segment], band)]
        out += [x & ~np.uint64(1) | parity for x in found]
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def slack(s: np.ndarray, percent: int) -> tuple[int, int]:
    """How many dull segments besides empty ones are allowed for, in the set's even and odd band."""
    table, out = bands(percent), [0, 0]
    own = table.of(len(s))
    for band in (own, own + 1):
        h, m, e = table.plan(band)
        if h:
            full = np.bincount(((mix(s, 2 * band + 1) >> np.uint64(32)) % np.uint64(m)).astype(np.int64), minlength=m)
            out[band & 1] = e - int((full == 0).sum())
    return out[0], out[1]


def similar(r: np.ndarray, s: np.ndarray, percent: int) -> bool:
    both = np.hstack([r, s])
    both = both[:, np.lexsort((both[1], both[0]))]
    shared = int((both[:, 1:] == both[:, :-1]).all(0).sum())
    return shared > 0 and 100 * shared >= percent * (both.shape[1] - shared)


KEY = 16


def keys_array(keys: np.ndarray) -> pa.Array:
    """Keys (n x 16 bytes) as a binary column."""
    n = len(keys)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, KEY * (n + 1), KEY, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(keys))])


def keys_of(column: pa.Array) -> np.ndarray:
    fixed = column.cast(pa.binary(KEY))
    return np.frombuffer(fixed.buffers()[1], np.uint8, len(fixed) * KEY, fixed.offset * KEY).reshape(-1, KEY)


def differs(keys: np.ndarray) -> np.ndarray:
    """Where a row's key is not that of the row before; the first row's is not."""
    return np.r_[True, (keys[1:] != keys[:-1]).any(1)] if len(keys) else np.empty(0, bool)


BUCKETS = "a binary, b binary, sig long"


def bucket_rows(sig: np.ndarray, key: np.ndarray):
    """Of sorted rows, whole buckets: pairs (a, b, null), and of larger buckets rows (member, head, sig)."""
    pairs, rest = [], []
    new = np.r_[True, sig[1:] != sig[:-1]]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, len(sig)])
    for k in range(2, SMALL + 1):
        at = starts[sizes == k]
        pairs += [(key[at + i], key[at + j]) for i in range(k) for j in range(i + 1, k)] if len(at) else []
    large = np.repeat(sizes > SMALL, sizes)
    if large.any():
        rows = np.flatnonzero(large)
        rest.append((key[rows], key[np.repeat(starts, sizes)[rows]], sig[rows]))
    return pairs, rest


def distinct_rows(sig: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by both, each once."""
    words = key.view(">u8")
    order = np.lexsort((words[:, 1], words[:, 0], sig))
    sig, key = sig[order], key[order]
    once = differs(key) | np.r_[True, sig[1:] != sig[:-1]] if len(sig) else np.empty(0, bool)
    return sig[once], key[once]


def meet(batches):
    """Rows (sig, key), sorted by sig, to what bucket_rows gives. A bucket's rows wait for its end, but for HOLD at most.

    A bucket that goes on beyond HOLD is large, however few keys it has: all its keys are
    given as members, under the head that it had then.
    """
    hold_sig, hold_key = np.empty(0, np.int64), np.empty((0, KEY), np.uint8)
    going: tuple | None = None  # a large bucket that has begun: sig, head

    def out(pairs, rest):
        pairs = [(a, b) for a, b in pairs if len(a)]
        if pairs:
            both = ordered(np.vstack([x for x, _ in pairs]), np.vstack([x for _, x in pairs]))
            yield pa.RecordBatch.from_arrays([keys_array(both[:, :KEY]), keys_array(both[:, KEY:]), pa.nulls(len(both), pa.int64())], ["a", "b", "sig"])
        for key, head, sig in rest:
            yield pa.RecordBatch.from_arrays([keys_array(key), keys_array(head), pa.array(sig)], ["a", "b", "sig"])

    def finished(sig, key):
        """Rows of buckets with two different keys at least, each once. Most signatures are of one set."""
        same = sig[1:] == sig[:-1]
        some = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
        sig, key = distinct_rows(sig[some], key[some])
        return out(*bucket_rows(sig, key)) if len(sig) else ()

    for batch in batches:
        if not batch.num_rows:
            continue
        sig, key = batch.column(0).to_numpy(), keys_of(batch.column(1))
        if going is not None:
            n = len(sig) if sig[-1] == going[0] else int(np.argmax(sig != going[0]))
            if n:
                more, members = distinct_rows(sig[:n], key[:n])
                yield from out([], [(members, np.broadcast_to(going[1], members.shape), more)])
            if n == len(sig):
                continue
            going, sig, key = None, sig[n:], key[n:]
        if len(hold_sig):
            sig, key = np.concatenate([hold_sig, sig]), np.vstack([hold_key, key])
        last = int(np.searchsorted(sig, sig[-1]))
        if last:
            yield from finished(sig[:last], key[:last])
        hold_sig, hold_key = sig[last:], key[last:]
        if len(hold_sig) > HOLD:
            begun, members = distinct_rows(hold_sig, hold_key)
            going = (begun[0], members[0])
            yield from out([], [(members, np.broadcast_to(members[0], members.shape), begun)])
            hold_sig, hold_key = sig[:0], key[:0]
    if len(hold_sig):
        yield from finished(hold_sig, hold_key)


def ordered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct pairs of different keys, the smaller first."""
    x, y = a.reshape(-1, KEY).copy().view(">u8"), b.reshape(-1, KEY).copy().view(">u8")
    less = (x[:, 0] < y[:, 0]) | (x[:, 0] == y[:, 0]) & (x[:, 1] < y[:, 1])
    both = np.where(less[:, None], np.hstack([a, b]), np.hstack([b, a]))
    return np.unique(both[(a != b).any(1)], axis=0)


def components(links: DataFrame) -> DataFrame:
    """(key, comp): of each key in `links` (a, b), the smallest key that it reaches. Smallest labels spread, and labels take their label's label."""
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        told = both.join(labels, both["b"] == labels["key"]).groupBy("a").agg(F.min("comp").alias("heard"))
        near = labels.join(told, labels["key"] == told["a"], "left").select("key", F.col("comp").alias("was"), F.least("comp", "heard").alias("mid"))
        up = labels.select(F.col("key").alias("k2"), F.col("comp").alias("top"))
        new = written(near.join(up, near["mid"] == up["k2"], "left").select("key", "was", F.least("mid", "top").alias("comp")), "labels")
        labels = new.select("key", "comp")
        if new.where("comp <> was").isEmpty():
            return labels


class Join:
    """The join over one table: shingle sets, candidate pairs, verification."""

    def __init__(self, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str):
        self.spark, self.words, self.percent = docs.sparkSession, words, percent
        self.docs = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).withColumn("v", F.xxhash64("t"))
        self.kind = docs.schema[id_col].dataType.simpleString()

    def sets(self) -> DataFrame:
        """(d, v, n, key, bits, even, odd) per document, with slack(); key, bits and slack null for an empty set."""
        words, percent = self.words, self.percent

        def row(s: np.ndarray) -> tuple:
            return (s.shape[1], set_key(s), sketch(s[0]), *slack(s[0], percent)) if s.size else (0, None, None, None, None)

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                found = [row(shingles(t.as_py(), words)) for t in batch.column(2)]
                types = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(zip(*found), types))], ["d", "v", "n", "key", "bits", "even", "odd"])

        return self.docs.select("d", "v", "t").mapInArrow(run, f"d {self.kind}, v long, n long, key binary, bits binary, even int, odd int")

    def buckets(self) -> DataFrame:
        words, percent = self.words, self.percent

        def run(batches):
            seen: set[bytes] = set()
            for batch in batches:
                texts = batch.column(0)
                for k in range(0, len(texts), 1000):
                    sigs, keys = [], []
                    for t in texts.slice(k, 1000):
                        s = shingles(t.as_py(), words)
                        if not s.size or (key := set_key(s)) in seen:
                            continue
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        sigs.append(signatures(s[0], percent))
                        keys.append(key)
                    if sigs:
                        rows = np.repeat(np.frombuffer(b"".join(keys), np.uint8).reshape(-1, KEY), [len(x) for x in sigs], axis=0)
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), keys_array(rows)], ["sig", "key"])

        rows = self.docs.select("t").mapInArrow(run, "sig long, key binary")
        return rows.repartition(partitions(self.spark), "sig").sortWithinPartitions("sig").mapInArrow(meet, BUCKETS)

    def possible(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """Those of `pairs` (a, b) that sizes and sketches don't rule out."""
        percent = self.percent

        def run(batches):
            for batch in batches:
                n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
                ok = [allowed(int(x), int(y), folded([u, v]), percent) for x, u, y, v in zip(n, batch.column(3).to_pylist(), m, batch.column(5).to_pylist())]
                mask = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

        right = sketches.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
        left = sketches.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
        return written(pairs.join(right, "b").join(left, "a").select("a", "b", "na", "ba", "nb", "bb").mapInArrow(run, "a binary, b binary"), "possible-pairs")

    def verified(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """Those of `pairs` (a, b), a written table, whose sets are similar, by their texts.

        Only texts of these pairs are sent. While those are few enough to be listed to all
        executors (LISTED), they are picked where the table is read.
        """
        words, percent = self.words, self.percent
        need = written(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct().join(classes, "key").select("key", "first", F.col("v").alias("v2")), "pair-keys")
        way = "broadcast" if need.count() <= LISTED else "merge"
        texts = self.docs.join(need.hint(way), F.col("d").eqNullSafe(F.col("first")) & (F.col("v") == F.col("v2"))).select("key", "t").dropDuplicates(["key"])

        def run(batches):
            held: dict[bytes, np.ndarray] = {}

            def of(key, text):
                if key not in held:
                    if len(held) >= 256:
                        held.clear()
                    held[key] = shingles(text, words)
                return held[key]

            for batch in batches:
                for k in range(0, batch.num_rows, 1000):
                    part = batch.slice(k, 1000)
                    a, b = part.column(0), part.column(1)
                    ok = [similar(of(x, t), of(y, u), percent) for x, y, t, u in zip(a.to_pylist(), b.to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist())]
                    mask = pa.array(ok, pa.bool_())
                    yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

        texts = written(texts, "pair-texts")
        right = texts.select(F.col("key").alias("b"), F.col("t").alias("tb")).hint("merge")
        left = texts.select(F.col("key").alias("a"), F.col("t").alias("ta")).hint("merge")
        return written(pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary"), "links")

    def around(self, rest: DataFrame, labels: DataFrame, sketches: DataFrame, everywhere: bool) -> DataFrame:
        """Pairs (a, b) of members of a bucket (sig, key) in different components that sizes and sketches allow to be similar.

        Members outside the bucket's largest component look around in blocks of it: all in
        all of them and give every such pair, or each in one of them and give their likeliest.
        """
        labelled = rest.join(labels, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        shares = labelled.groupBy("sig", "comp").agg(F.count("*").alias("n"))
        mixed = shares.groupBy("sig").agg(F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("lead"), F.count("*").alias("comps")).where("comps > 1")
        blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
        mixed = mixed.select("sig", F.col("lead.comp").alias("lead"), blocks(F.col("all")).alias("columns"), blocks(F.col("all") - F.col("lead.n")).alias("rows"))
        members = labelled.join(mixed, "sig").join(sketches.select("key", "n", "bits"), "key")
        place = lambda n, salt: F.pmod(F.xxhash64("key", F.lit(salt)), F.col(n)).cast("int")
        minor = F.col("comp") != F.col("lead")
        # one row for each meeting of two blocks, of those that ask and of those that are asked
        line = lambda u, v, asks: F.struct(u.cast("int").alias("u"), v.cast("int").alias("v"), F.lit(asks).alias("asks"))
        each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        if everywhere:
            asking = F.transform(each("columns"), lambda v: line(place("rows", 1), v, True))
            asked = F.transform(each("rows"), lambda u: line(u, place("columns", 2), False))
        else:
            asking, asked = (F.array(line(F.lit(0), place("columns", 2), asks)) for asks in (True, False))
        rows = members.withColumn("at", F.explode(F.when(minor, F.concat(asking, asked)).otherwise(asked)))
        rows = rows.select("sig", "at.u", "at.v", "at.asks", minor.alias("minor"), "comp", "key", "n", "bits").repartition(partitions(self.spark), "sig", "u", "v").sortWithinPartitions("sig", "u", "v")
        return rows.mapInArrow(meetings(self.percent, everywhere), "a binary, b binary").distinct()


def allowed(n: int, m: int, maps: np.ndarray, percent: int) -> bool:
    """Whether sets of these sizes and sketches may be similar."""
    return max(int(np.bitwise_count(maps[0] ^ maps[1]).sum()), abs(n - m)) <= (100 - percent) * (n + m) // (100 + percent)


def meetings(percent: int, everywhere: bool):
    """Over rows (sig, u, v, asks, minor, comp, key, n, bits) with a meeting's rows together: for rows that ask, pairs with
    rows that are asked, of other components, that sizes and sketches allow to be similar; or only the pair with the
    smallest difference. What is compared are sketches in memory."""

    def meeting(rows: pa.RecordBatch):
        asks, minor = (rows.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
        comp, key, n = keys_of(rows.column(5)), keys_of(rows.column(6)), rows.column(7).to_numpy()
        there = np.flatnonzero(~asks)
        if not asks.any() or not len(there):
            return
        table = folded(rows.column(8).to_pylist())
        code = comp.view(">u8")
        order = key.view(">u8")
        for i in np.flatnonzero(asks):
            other = (code[there] != code[i]).any(1)
            if everywhere:  # of two that both ask, the smaller key does
                after = (order[there, 0] > order[i, 0]) | (order[there, 0] == order[i, 0]) & (order[there, 1] > order[i, 1])
                other &= ~minor[there] | after
            places = there[other]
            apart = np.maximum(abs(n[places] - n[i]), np.bitwise_count(table[places] ^ table[i]).sum(1))
            fits = apart <= (100 - percent) * (n[places] + n[i]) // (100 + percent)
            places = places[fits]
            if len(places) and not everywhere:
                places = places[np.argmin(apart[fits])][None]
            if len(places):
                yield ordered(np.broadcast_to(key[i], (len(places), KEY)), key[places])

    def run(batches):
        hold: list[pa.RecordBatch] = []

        def out(rows: pa.RecordBatch):
            marks, held, n = np.column_stack([rows.column(i).to_numpy() for i in range(3)]), [], 0
            starts = np.flatnonzero(differs(marks))
            for x, y in zip(starts, np.r_[starts[1:], len(marks)]):
                for found in meeting(rows.slice(x, y - x)):
                    held.append(found)
                    n += len(found)
                    if n > 20_000:
                        yield pair_batch(held)
                        held, n = [], 0
            if n:
                yield pair_batch(held)

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            cut = int(np.flatnonzero(differs(marks))[-1])
            if hold and (cut or [hold[-1].column(i)[-1].as_py() for i in range(3)] != marks[-1].tolist()):
                yield from out(joined([*hold, batch.slice(0, cut)]))
                hold, batch = [], batch.slice(cut)
            elif cut:
                yield from out(batch.slice(0, cut))
                batch = batch.slice(cut)
            hold.append(batch)
        if hold:
            yield from out(joined(hold))

    return run


def pair_batch(held: list[np.ndarray]) -> pa.RecordBatch:
    rows = np.unique(np.vstack(held), axis=0)
    return pa.RecordBatch.from_arrays([keys_array(rows[:, :KEY]), keys_array(rows[:, KEY:])], ["a", "b"])


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id (the smallest identifier reachable by links).

    A-Z are lower-cased; words are runs of what is not ASCII white space. Null, empty and
    blank texts have no shingles and are linked with nothing, not with each other either.
    Equal sets are linked. Rows that repeat an identifier have rows of their own; rows whose
    identifier is null link others and have the smallest identifier of those, or null. Very
    long texts are read whole; a task holds the shingles of two. An empty table gives no
    rows; other columns are ignored.
    """
    join = Join(docs, words, percent, id_col, text_col)
    sets = written(join.sets(), "shingle-sets")
    full = sets.where("key is not null")
    classes = full.groupBy("key").agg(F.min("d").alias("first"), F.coalesce(F.min_by("v", "d"), F.min("v")).alias("v"))
    sketches = full.select("key", "n", "bits").dropDuplicates(["key"])
    spare = full.select("key", "even", "odd").dropDuplicates(["key"])
    found = written(join.buckets(), "buckets")
    # of large buckets, a member is tied to the smallest and the largest of its heads
    ties = found.where("sig is not null and a <> b").groupBy("a").agg(F.min("b").alias("x"), F.max("b").alias("y")).select("a", F.explode(F.array("x", "y")).alias("b"))
    pairs = found.where("sig is null").select("a", "b").union(ties.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    links = join.verified(join.possible(pairs, sketches), classes)
    labels = components(links)
    rest = found.where("sig is not null").select("sig", F.col("a").alias("key"), F.col("sig").bitwiseAND(1).alias("parity"))
    dull = rest.groupBy("key", "parity").agg(F.count("*").alias("dull")).join(spare, "key").where(F.col("dull") > F.when(F.col("parity") == 0, F.col("even")).otherwise(F.col("odd")))
    rest = written(rest.join(dull.select("key", "parity"), ["key", "parity"]).select("sig", "key").distinct(), "dull-rows")
    for everywhere in (False, True):
        asked = written(join.around(rest, labels, sketches, everywhere), "pairs")
        if not asked.isEmpty():
            links = links.union(join.verified(asked, classes))
            labels = components(links)
    named = classes.join(labels, "key", "left").select("key", "first", F.coalesce("comp", "key").alias("comp"))
    small = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    final = named.join(small, "comp").select(F.col("key").alias("key2"), "component_id")
    return sets.join(final, sets["key"] == final["key2"], "left").select(F.col("d").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "d").alias("component_id"))
