"""Packing into windows by best-fit decreasing, exact over the whole corpus.

Best-fit decreasing sees of a piece only its length, and lengths are 1 to the window size.
So the driver packs a histogram, at most one count a length, whatever the corpus: lengths in
falling order, each into the tightest open window, found in a segment tree over remaining
capacities. Windows that have been filled alike stay together as a run, so a step places
many pieces at once, just as one after the other would. The plan says, for ranks of pieces
of each length, which window and offset they get; pieces get their rank in Spark.

Overlong documents are first cut into full windows; what remains is the last piece.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cordon.llm import bpe
from cordon.llm.common import written

CAPACITY = 2048
END_ID = 1
#: The least number of pieces of a length that a task ranks alone. Beyond its square, shares grow in size and number as the root of all pieces.
SHARE = 1_000


class CapacityTree:
    """Segment tree over remaining capacities 0 to n: which of them some open window has."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.some = [False] * (2 * self.size)

    def mark(self, r: int, open_: bool) -> None:
        i = r + self.size
        self.some[i] = open_
        while i > 1:
            i >>= 1
            self.some[i] = self.some[2 * i] or self.some[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest marked capacity of at least `need`."""
        i = need + self.size
        if self.some[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.some[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank, n, window, per, offset): pieces of that length with ranks from `rank`, `n` of
    them, go `per` a window into the windows from `window`, one behind the other from `offset`."""
    tree, open_runs, rows, windows = CapacityTree(capacity), defaultdict(deque), [], 0

    def put(run: tuple[int, int], left: int, front: bool = False) -> None:
        if left and run[1]:
            (open_runs[left].appendleft if front else open_runs[left].append)(run)
            tree.mark(left, True)

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            room = tree.tightest(length)
            if room is None:
                room, start, many = capacity, windows, -(-todo // (capacity // length))
                windows += many
            else:
                start, many = open_runs[room].popleft()
                tree.mark(room, bool(open_runs[room]))
            per = min(room // length, todo)
            full = min(many, todo // per)
            rows.append((length, rank, full * per, start, per, capacity - room))
            rank, todo = rank + full * per, todo - full * per
            put((start + full, many - full), room, True)
            put((start, full), room - per * length)
    return rows


def ranked(pieces: DataFrame, counts: dict[int, int], share: int | None = None) -> DataFrame:
    """`pieces` (length and piece_key, an order within a length) with their rank among those of equal length, from 0.

    Pieces of a length are dealt into shares of about `share`, as many as its count asks for; the
    shares' counts, a row for each `share` pieces and length, give each share the ranks before it.
    Neither a share nor their number grows faster than the root of the number of pieces.
    """
    share = share or max(SHARE, isqrt(sum(counts.values())))
    shares = F.array(*[F.lit(-(-counts.get(n, 0) // share)) for n in range(max(counts, default=0) + 1)])
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("piece_key"), F.greatest(F.get(shares, F.col("length").cast("int")), F.lit(1))).cast("int"))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    firsts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("c")).select("length", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"))
    own = W.partitionBy("length", "salt").orderBy("piece_key")
    return salted.withColumn("own", F.row_number().over(own) - 1).join(F.broadcast(firsts), ["length", "salt"]).withColumn("rank", F.col("own") + F.col("first")).drop("own", "first", "salt")


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` with sequence_id and offset. `pieces` is read three times: pass a written table."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    by_length: dict[int, list] = defaultdict(list)
    for length, *step in plan(counts, capacity):
        by_length[length].append(tuple(step))
    # a row a length, with its steps in order of their ranks; the plan's size follows the number of lengths, not the corpus
    steps = spark.createDataFrame(list(by_length.items()), "length long, steps array<struct<from_rank: long, n: long, window: long, per: long, from_offset: long>>")
    at = F.col("rank") - F.col("step.from_rank")
    return (
        ranked(pieces, counts)
        .join(F.broadcast(steps), "length")
        .withColumn("step", F.element_at(F.filter("steps", lambda s: s["from_rank"] <= F.col("rank")), -1))
        .withColumn("sequence_id", F.col("step.window") + F.floor(at / F.col("step.per")))
        .withColumn("offset", F.col("step.from_offset") + (at % F.col("step.per")) * F.col("length"))
        .drop("rank", "steps", "step")
    )


class FileTokens:
    """Ids as the tokenizer file gives them, by a compiled encoder that is loaded with the file's vocabulary."""

    def __init__(self, path: str):
        self.trie = bpe.loaded(path)
        ranks = {b: i for b, i in self.trie.ids.items()}
        self.special = self.trie.special
        self.fast = tiktoken.Encoding("file", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32, copy=False)
        except BaseException as e:  # the compiled pattern gives up on extreme runs of white space
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return np.frombuffer(self.trie.encode(text), np.uint32)


@lru_cache(1)
def file_tokens(path: str) -> FileTokens:
    return FileTokens(path)


def id_type(path: str, end_id: int) -> str:
    """The numpy type in which ids travel."""
    return "<u2" if max(end_id, *bpe.loaded(path).text_of) < 1 << 16 else "<u4"


def cut(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, piece_key (id, start and crc);
    with_ids: also ids (binary: 16-bit if the vocabulary allows, as a zstd frame of their own)."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, piece_key binary" + ", ids binary" * with_ids

    def run(batches):
        tokens = file_tokens(path)
        narrow, frame = id_type(path, end_id), zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        for batch in batches:
            names, rows = batch.column(0).to_pylist(), []
            for name, text in zip(names, batch.column(1).to_pylist()):
                ids = np.append(tokens.ids(text), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    crc = zlib.crc32(piece.tobytes())
                    packed = [frame(piece.astype(narrow).tobytes())] if with_ids else []
                    rows.append((name, start, len(piece), crc, len(ids), f"{name!r} {start:012d} {crc:08x}".encode(), *packed))
            types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            labels = [id_col, "start", "length", "ids_crc32", "doc_tokens", "piece_key", "ids"]
            cols = list(zip(*rows)) if rows else [[]] * (6 + with_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], labels[: len(cols)])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one piece of one id, the end. Repeated rows are documents of
    their own. Ties of length go by identifier, start and crc of the ids. An empty table gives no rows. Other
    columns are ignored. Texts are encoded once; the pieces, without ids, are written, then ranked.
    """
    pieces = written(cut(docs, path, capacity, end_id, id_col, text_col, False), "pieces")
    return placed(pieces, capacity).select(id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.col("offset").cast("long").alias("offset"))
